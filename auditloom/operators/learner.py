"""One turn of adaptive learning as tables: parameters in, candidates of every strategy, their performance over judged
detections, the best one's parameters out, and the way back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import summaries

FAMILIES = ("statistical", "behavioral", "market", "semantic")
CURRENT = "CURRENT"


def predicted(detections: DataFrame, parameters: DataFrame) -> DataFrame:
    """Detections (the four families' scores, truth) once for each set of ``parameters`` (strategy, threshold, a weight a
    family), of which there are a few: with ``hit``, whether the weighted score reaches the threshold."""
    score = reduce(lambda a, b: a + b, [F.col(f) * F.col(f"weight_{f}") for f in FAMILIES])
    return detections.crossJoin(F.broadcast(parameters)).withColumn("hit", score >= F.col("threshold"))  # a row a strategy


def performance(detections: DataFrame, parameters: DataFrame) -> DataFrame:
    """(strategy, n, accuracy, precision, recall, f1_score, false_positive_rate, false_positives, missed) of each set."""
    p, truth, hit = predicted(detections, parameters), F.col("truth"), F.col("hit")
    row = p.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("false_positives"), F.count_if(~hit & truth).alias("missed"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("false_positives"), F.col("missed")
    return row.select("strategy", "n", share(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1_score"), share(fp, F.col("n") - tp - fn).alias("false_positive_rate"), "false_positives", "missed")


def candidates(parameters: DataFrame, now: DataFrame, trigger: str) -> DataFrame:
    """The current set and one for each strategy that the trigger calls for, given the current ``performance``: thresholds
    go up where over 30 % of the judged are false positives, else down where over 20 % are missed; the ensemble leans to
    semantics when performance falls; parameters become less strict."""
    joined = parameters.crossJoin(F.broadcast(now.where(F.col("strategy") == CURRENT).select((F.col("false_positives") / F.col("n")).alias("fp"), (F.col("missed") / F.col("n")).alias("fn"))))  # one row
    falls = trigger == "PERFORMANCE_DEGRADATION"
    threshold, semantic = F.col("threshold"), F.col("weight_semantic")
    moved = F.when(F.col("fp") > 0.3, F.least(F.lit(0.9), threshold + 0.05)).when(F.col("fn") > 0.2, F.greatest(F.lit(0.1), threshold - 0.05)).otherwise(threshold)
    leaning = F.least(F.lit(0.4), semantic + 0.05) if falls else semantic
    whole = reduce(lambda a, b: a + b, [F.col(f"weight_{f}") for f in FAMILIES if f != "semantic"]) + leaning
    made = {
        "THRESHOLDS": {"threshold": moved},
        "ENSEMBLE": {f"weight_{f}": (leaning if f == "semantic" else F.col(f"weight_{f}")) / whole for f in FAMILIES} if falls else {},
        "PARAMETERS": {"threshold": F.greatest(F.lit(0.1), threshold - 0.1)} if falls else {},
        "FEATURES": {},
    }
    columns = ["strategy", "threshold", *[f"weight_{f}" for f in FAMILIES]]
    sets = [joined.select(F.lit(s).alias("strategy"), *[made[s].get(c, F.col(c)).alias(c) for c in columns[1:]]) for s in summaries.STRATEGIES.get(trigger, ("THRESHOLDS",))]
    return reduce(DataFrame.unionByName, sets, parameters.select(F.lit(CURRENT).alias("strategy"), *columns[1:]))


def tried(detections: DataFrame, parameters: DataFrame, trigger: str) -> DataFrame:
    """(strategy, the set, its performance, improvement, confidence, chosen): every strategy against the current set. The
    best improvement is chosen if it is above 0 and sure enough, ties to the first in the alphabet; else the current set
    stays."""
    now = performance(detections, parameters.withColumn("strategy", F.lit(CURRENT)))
    sets = candidates(parameters, now, trigger)
    found = sets.join(performance(detections, sets), "strategy")
    names = [n for n, _, _ in summaries.OBJECTIVES]
    before = found.where(F.col("strategy") == CURRENT).select(*[F.col(n).alias(f"before_{n}") for n in names])
    both = found.crossJoin(F.broadcast(before))  # one row
    gain, sure, apply = summaries.outcome({n: F.col(f"before_{n}") for n in names}, {n: F.col(n) for n in names})
    told = both.withColumns({"improvement": gain, "confidence": sure, "fit": apply & (gain > 0) & (F.col("strategy") != CURRENT)}).drop(*before.columns)
    best = told.where("fit").agg(F.min_by("strategy", F.struct(-F.col("improvement"), F.col("strategy"))).alias("best"))
    return told.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("strategy") == F.coalesce("best", F.lit(CURRENT))).drop("fit", "best")


def applied(history: DataFrame, turn: DataFrame) -> DataFrame:
    """The history of sets (version, threshold, weights) with the chosen one as a new version, if it is not the current."""
    newest = history.agg(F.max("version").alias("v"))
    fresh = turn.where(F.col("chosen") & (F.col("strategy") != CURRENT)).crossJoin(F.broadcast(newest)).withColumn("version", F.col("v") + 1)
    return history.unionByName(fresh.select(*history.columns))


def rolled_back(history: DataFrame) -> DataFrame:
    """The history with the set before the newest as a new version; the first has none before it and stays."""
    newest = history.agg(F.max("version").alias("v"))
    before = history.crossJoin(F.broadcast(newest)).where(F.col("version") == F.col("v") - 1).withColumn("version", F.col("v") + 1)
    return history.unionByName(before.select(*history.columns))


def current(history: DataFrame) -> DataFrame:
    """The newest set."""
    columns = [c for c in history.columns if c != "version"]
    return history.agg(F.max_by(F.struct(*columns), "version").alias("s")).select("s.*")
