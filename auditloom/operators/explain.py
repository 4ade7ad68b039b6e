"""Explaining scores: differences of features, contrasts, perturbations, and sets of counterfactuals."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[dict[str, Column]], Column]


def match(a: Column, b: Column, kind: str, within: float = 0.1) -> Column:
    """Whether two values are alike: numbers less than a tenth apart of the greater, strings equal or of about the same
    length, others equal."""
    if kind == "number":
        top = F.greatest(F.abs(a), F.abs(b))
        return F.when(top == 0, F.lit(True)).otherwise(F.abs(a - b) / top < within)
    if kind == "string":
        return (a == b) | (F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)) < within)
    return a == b


def differences(a: dict[str, Column], b: dict[str, Column], kinds: dict[str, str]) -> tuple[Column, Column]:
    """Names of the matching and of the contrasting features; one that is missing on a side contrasts."""
    alike = {n: F.coalesce(match(a[n], b[n], k), F.lit(False)) for n, k in kinds.items()}
    pick = lambda wanted: F.array_compact(F.array(*[F.when(c if wanted else ~c, F.lit(n)) for n, c in alike.items()]))
    return pick(True), pick(False)


def common_contrasts(samples: DataFrame, key: str) -> DataFrame:
    """(key, feature, n) of samples (key, contrasting: array): features that contrast in half of a key's samples or more."""
    sizes = samples.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    counted = samples.select(key, F.explode("contrasting").alias("feature")).groupBy(key, "feature").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(sizes, key).where(F.col("n") >= F.floor(F.col("size") / 2)).select(key, "feature", "n")


def mean_jaccard(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The mean Jaccard share over pairs of sets, of those that are not both empty; 0 if all are."""
    both = lambda x, y: F.transform(F.array(F.size(F.array_union(x, y))), lambda n: F.when(n > 0, F.size(F.array_intersect(x, y)) / n))[0]
    parts = F.array(*[both(x, y) for x, y in zip(a, b)])
    return F.transform(F.array(parts), _known_mean)[0]


def _known_mean(parts: Column) -> Column:
    """The mean of an array's known entries; 0 if there are none."""
    known = F.array_compact(parts)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda p, q: p + q) / F.size(known)).otherwise(0.0)


def permutation(rows: DataFrame, key: str, names: Sequence[str], model: Model, draws: Sequence[float]) -> DataFrame:
    """(key, feature, importance, confidence): how much the score falls, in the mean, when a feature is shaken by noise
    of a tenth of its size; ``draws`` are the standard normal numbers used, the same for every row, so that a result
    does not hang on where it is computed."""
    base = model({n: F.col(n) for n in names})
    parts = []
    for n in names:
        scale = F.abs(F.col(n)) * 0.1 + 0.01
        falls = F.array(*[base - model({m: F.col(m) + scale * z if m == n else F.col(m) for m in names}) for z in draws])
        parts.append(F.struct(F.lit(n).alias("feature"), falls.alias("falls")))
    found = rows.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.feature", "p.falls")
    k = len(draws)
    found = found.withColumn("mean", F.aggregate("falls", F.lit(0.0), lambda a, x: a + x) / k)
    found = found.withColumn("std", F.sqrt(F.aggregate("falls", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / k))
    return found.select(key, "feature", F.abs("mean").alias("importance"), F.greatest(F.lit(0.1), 1 - F.col("std") / (F.abs("mean") + 1e-6)).alias("confidence"))


def gradient(rows: DataFrame, key: str, names: Sequence[str], model: Model, step: float = 1e-3) -> DataFrame:
    """(key, feature, gradient, drop): the slope of the score at each feature, by a step of a thousandth of it, and
    what the score loses without the feature."""
    here = {n: F.col(n) for n in names}
    parts = []
    for n in names:
        h = F.greatest(F.abs(F.col(n)) * step, F.lit(step))
        slope = (model({**here, n: F.col(n) + h}) - model({**here, n: F.col(n) - h})) / (2 * h)
        parts.append(F.struct(F.lit(n).alias("feature"), slope.alias("gradient"), (model(here) - model({**here, n: F.lit(0.0)})).alias("drop")))
    return rows.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")


def candidates(rows: DataFrame, key: str, names: Sequence[str], factors: Sequence[Sequence[float]]) -> DataFrame:
    """A row's alternatives: (key, original: struct, examples: array of (number, factors applied, values)), one for each
    tuple of factors, by which its features are scaled."""
    made = [F.struct(F.lit(i).alias("number"), *[(F.col(n) * f).alias(n) for n, f in zip(names, fs)]) for i, fs in enumerate(factors)]
    return rows.select(key, F.struct(*names).alias("original"), F.array(*made).alias("examples"))


def distance(a: Column, b: Column, names: Sequence[str]) -> Column:
    """The sum over features of what they differ by, relative to both."""
    return reduce(lambda p, q: p + q, [F.abs(a[n] - b[n]) / (F.abs(a[n]) + F.abs(b[n]) + 1e-6) for n in names])


def set_quality(sets: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, n, diversity, coverage, mean_distance, mean_plausibility) of sets (key, original, examples) of few examples:
    the mean distance of their pairs, the share of features that any example alters, their mean distance from the
    original, and how plausible so many alterations are."""
    examples, original = F.col("examples"), F.col("original")
    n = F.size(examples)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    pairs = F.flatten(F.transform(examples, lambda a, i: F.transform(F.filter(examples, lambda b, j: j > i), lambda b: distance(a, b, names))))
    altered = lambda e: reduce(lambda p, q: p + q, [(e[x] != original[x]).cast("int") for x in names])
    differs = lambda x: lambda e: e[x] != original[x]
    covered = reduce(lambda p, q: p + q, [F.exists(examples, differs(x)).cast("int") for x in names])
    return sets.select(
        key, n.alias("n"), F.when(F.size(pairs) > 0, total(pairs) / F.size(pairs)).otherwise(0.0).alias("diversity"), (covered / len(names)).alias("coverage"),
        F.when(n > 0, total(F.transform(examples, lambda e: distance(e, original, names))) / n).otherwise(0.0).alias("mean_distance"),
        F.when(n > 0, total(F.transform(examples, lambda e: F.greatest(F.lit(0.1), 1 - altered(e) / len(names)))) / n).otherwise(0.0).alias("mean_plausibility"),
    )


def diverse(sets: DataFrame, key: str, names: Sequence[str], k: int = 3) -> DataFrame:
    """(key, chosen: numbers of examples): the most plausible example (the first of equals), then time and again the one
    that lies farthest from those chosen."""
    original = F.col("original")
    altered = lambda e: reduce(lambda p, q: p + q, [(e[x] != original[x]).cast("int") for x in names])
    first = F.array_min(F.transform("examples", lambda e: F.struct(altered(e).alias("a"), e["number"].alias("number"), e.alias("e"))))["e"]
    found = sets.withColumn("picked", F.array(first))
    for _ in range(k - 1):
        left = F.filter("examples", lambda e: ~F.exists("picked", lambda p: p["number"] == e["number"]))
        far = F.transform(left, lambda e: F.struct((-F.array_min(F.transform("picked", lambda p: distance(e, p, names)))).alias("d"), e["number"].alias("number"), e.alias("e")))
        found = found.withColumn("far", far).withColumn("picked", F.when(F.size("far") > 0, F.concat("picked", F.array(F.array_min("far")["e"]))).otherwise(F.col("picked"))).drop("far")
    return found.select(key, F.transform("picked", lambda p: p["number"]).alias("chosen"))


def most_altered(sets: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(feature, n): how often examples alter each feature: what a global explanation tells."""
    e = sets.select("original", F.explode("examples").alias("e"))
    return e.agg(*[F.count_if(F.col(f"e.{x}") != F.col(f"original.{x}")).alias(x) for x in names]).unpivot([], list(names), "feature", "n")


def is_anomaly(level: Column, score: Column) -> Column:
    return F.coalesce(level.isin("CRITICAL", "HIGH"), F.lit(False)) | F.coalesce(score > 0.5, F.lit(False))


def bar(value: Column, greatest: Column, width: int = 20) -> Column:
    """A bar of hashes, as long as a value's share of the greatest."""
    return F.repeat(F.lit("#"), F.when(greatest > 0, F.round(value / greatest * width)).otherwise(0).cast("int"))


def highlights(weights: Column, above: float = 0.7) -> tuple[Column, Column]:
    """Weights scaled to 0 and 1 by their least and greatest (all 0 if equal), and the places of those beyond ``above``."""
    spread = F.array_max(weights) - F.array_min(weights)
    scaled = F.transform(weights, lambda w: F.when(spread == 0, F.lit(0.0)).otherwise((w - F.array_min(weights)) / spread))
    return scaled, F.filter(F.transform(scaled, lambda w, i: F.when(w > above, i)), lambda i: i.isNotNull())


def comparison(sets: DataFrame, key: str, names: Sequence[str], model: Model) -> DataFrame:
    """(key, number, changed, distance, plausibility, score_change): a row an example of a set, with the names of the
    features that it alters and what that does to the score."""
    e = sets.select(key, "original", F.explode("examples").alias("e"))
    original, made = F.col("original"), F.col("e")
    changed = F.array_compact(F.array(*[F.when(made[n] != original[n], F.lit(n)) for n in names]))
    change = model({n: made[n] for n in names}) - model({n: original[n] for n in names})
    return e.select(key, F.col("e.number").alias("number"), F.concat_ws(",", changed).alias("changed"), distance(made, original, names).alias("distance"), F.greatest(F.lit(0.1), 1 - F.size(changed) / len(names)).alias("plausibility"), change.alias("score_change"))


def comparison_summary(compared: DataFrame, key: str) -> DataFrame:
    """(key, n, mean_change, mean_plausibility, most_changed): the whole set in a line; the three features that most
    examples alter, of equals the first in the alphabet."""
    row = compared.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("score_change").alias("mean_change"), F.avg("plausibility").alias("mean_plausibility"))
    counted = compared.select(key, F.explode(F.split("changed", ",")).alias("feature")).where("feature <> ''").groupBy(key, "feature").agg(F.count(F.lit(1)).alias("c"))
    most = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "feature"))).alias("l"))
    told = F.concat_ws(",", F.transform(F.slice("l", 1, 3), lambda x: x["feature"]))
    return row.join(most.select(key, told.alias("most_changed")), key, "left").select(key, "n", "mean_change", "mean_plausibility", F.coalesce("most_changed", F.lit("")).alias("most_changed"))


def similarity_report(found: DataFrame) -> DataFrame:
    """(target, place, section, sample, text): the lines of a report on ``similarity.nearest`` rows: the samples of the
    target's class and of others, each with its rank and similarity."""
    section = F.when(F.col("same_class"), "similar").otherwise("contrasting")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("same_class"), "rank"))  # a few rows a target
    text = F.format_string("%d. %s %.3f", F.col("rank"), F.col("id").cast("string"), F.col("similarity"))
    return found.select("target", place.alias("place"), section.alias("section"), F.col("id").alias("sample"), text.alias("text"))
