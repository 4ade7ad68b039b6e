"""Quality rules, toxicity, importance resampling, BPE and packing against plain versions and edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditloom.llm import bpe, cutting_stock, packing, quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id long, text string, score double, n_words string"
EDGES = [None, "", " \n\t ", "word", "a b c d e f g h " * 40, "x" * 50_000, "Été ça — naïve word\x1cone", "same text here", "same text here", "line one\nline one\n \nline two\nline one", "# * $ % & | < >", "don't I'LL we've <|endoftext|> done", "日本語テキスト 😀 е́"]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge texts, with other columns whose names clash with results, and a repeated row."""
    rows = [(i, t, 1.0, "clash") for i, t in enumerate(EDGES)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_match_plain(docs):
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    for i, t in enumerate(EDGES):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(t), t
    assert quality_rules.ledger(docs).count() == len(EDGES) + 1


def test_random_texts_match_plain(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 120))) * rng.randint(1, 3)) for i in range(150)]
    got = {r["doc_id"]: r for r in quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(t), t


def test_policies_and_ablations(docs):
    found = quality_rules.ledger(docs)
    rows = {(r["version"], r["rule"]): r for r in quality_rules.ablations(found, [quality_rules.BASE, quality_rules.STRICT]).collect()}
    kept = quality_rules.apply_policy(found, quality_rules.BASE).where("kept").count()
    assert rows["base", "few_words"]["n_docs"] - rows["base", "few_words"]["rejected"] == kept
    alone = found.where("n_words < 20 and not (100 * n_repeat_words > 30 * n_words)").count()
    assert rows["base", "few_words"]["rejected_by_rule_alone"] == alone


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert quality_rules.ledger(none).count() == 0
    model = toxicity.fit(none, labels)
    assert len(model.index) == 0 and toxicity.score(none, model).count() == 0
    model = quality_classifier.fit(none, labels)
    threshold, verdicts = quality_classifier.draw(quality_classifier.score(none, model), model.k)
    assert threshold is None and verdicts.count() == 0
    assert bpe.decode(bpe.encode(none, path), path).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_toxicity_learns_words(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text.insert(rng.randrange(60), rng.choice(["grimble", "snarkox"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0) if i % 50 else None))
    docs = spark.createDataFrame([*rows, (9999, None), (10000, "GRIMBLE! you"), (10001, "w1 w2 w3")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (77777, 1)], "doc_id long, toxic int")
    config = toxicity.FtrlConfig(alpha=0.3, l1=4.0, toxic_weight=2.0, bits=18, epochs=5, shards=1)
    model = toxicity.fit(docs, known.where("doc_id < 400 or doc_id = 77777"), config=config)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scores[i] >= 0.5) == (i % 4 == 0) for i in range(400, 600)]
    assert np.mean(held) > 0.95 and scores[10000] >= 0.5 > scores[10001]
    assert scores[9999] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def plain_features(text, bits):
    """Coordinates of words, stems, neighbours and skip-grams, text by text, through the block hash of single words."""
    from auditloom.llm import text_blocks

    def hashed(word):
        block = next(text_blocks.blocks(pa.array([word])))
        return block.tokens(toxicity._WORDS).hashes[0]

    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    h = [int(hashed(w)) for w in words]
    stems = [int(hashed(w[:5])) for w in words]
    mix = lambda *x: int(text_blocks.ngrams(np.array(x[:-1], np.uint64), tuple(range(1, len(x) - 1)), x[-1])[0])
    found = [mix(x, 1) for x in h] + [mix(x, 4) for x in stems]
    found += [mix(a, b, 2) for a, b in zip(h, h[1:])] + [mix(a, b, 3) for a, b in zip(h, h[2:])]
    return sorted({x >> (64 - bits) for x in found})


def plain_ftrl(cases, config):
    """The published update, coordinate by coordinate in dictionaries; the bias has no L1."""
    z, n = Counter(), Counter()
    bias = 1 << config.bits

    def weight(i):
        l1 = 0.0 if i == bias else config.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((config.beta + math.sqrt(n[i])) / config.alpha + config.l2)

    rng = np.random.default_rng(7)
    for _ in range(config.epochs):
        for k in rng.permutation(len(cases)):
            label, at = cases[k]
            w = {i: weight(i) for i in [*at, bias]}
            g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (config.toxic_weight if label else 1)
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / config.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.mark.parametrize("shards", [1, 3])
def test_fit_is_plain_ftrl(spark, shards):
    """The same sample and order through plain loops gives the same weights; shards of equal counts stay apart."""
    rng = random.Random(shards)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "toxicish", "efghij", "k!l"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), rows[5], (7, "zz"), (9, ""), *[(11, "toxicish again and again")] * 50]
    labels = [(i, int("toxicish" in (t or ""))) for i, t in rows[:60]] + [(100, 1), (5, 1), (7, None), (None, 1), (999, 1)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, toxic string")
    config = toxicity.FtrlConfig(alpha=0.5, l1=0.5, bits=16, epochs=3, shards=shards, sample=1000)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), config=config)
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    cases, least = {}, {}
    for i, t in rows:  # of the rows of an id that of the least text is a case
        least[i] = min(t or "", least.get(i, t or ""))
    for i, t in least.items():
        if i in known:
            h = xxhash.xxh64_intdigest(str(i).encode(), 42)
            h = h - (1 << 64) if h >= 1 << 63 else h
            at = plain_features(t, config.bits)
            cases.setdefault(toxicity.shard_of(h, shards), []).append((h, known[i], zlib.crc32(np.array(at, np.uint32)), at))
    total = sum(map(len, cases.values()))
    want = Counter()
    for mine in cases.values():
        mine.sort(key=lambda c: c[:3])
        for i, w in plain_ftrl([(y, at) for _, y, _, at in mine], config).items():
            want[i] += w * len(mine) / total
    assert len(cases) == shards and model.bias == pytest.approx(want.pop(1 << config.bits))
    got = {int(i): w for i, w in zip(model.index, model.weight) if w}
    assert got == pytest.approx({i: w for i, w in want.items() if w})


def test_shards_of_equal_counts(spark):
    """Two shards with the same numbers of cases and toxic cases are two shards: no weight is doubled."""
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad words") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    one, two = (toxicity.fit(docs, labels, config=toxicity.FtrlConfig(bits=16, shards=n)) for n in (1, 2))
    assert np.abs(two.weight).max() < 1.5 * np.abs(one.weight).max()


def test_scores_of_edge_texts(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(len(EDGES))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, config=toxicity.FtrlConfig(l1=0.1, sample=5))
    found = toxicity.score(docs, model, name="toxicity").collect()
    got = {r["doc_id"]: r["toxicity"] for r in found}
    assert len(found) == len(EDGES) + 1 and all(0 <= x <= 1 for x in got.values())
    assert got[0] == got[1] == got[2] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    with pytest.raises(ValueError):
        toxicity.score(docs, model, keep=("doc_id", "score"))


def test_one_class_of_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, model).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(-(10**12), 10**12, 500)] + [7, 7, 7]
    keys = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 2, 250, 503, 600):
        assert quality_classifier.kth_largest(keys, "k", k, bins=16) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert quality_classifier.kth_largest(keys, "k", 0) is None


def plain_grams(text):
    """Words and marks, pairs of neighbours and repeats, as strings."""
    pieces = [p.encode() for p in re.findall(r"[^\x00-\x7f]|[A-Za-z0-9]|[^\sA-Za-z0-9]|\s+", text or "")]
    runs, kind = [], lambda p: 0 if p[:1].isspace() else 1 if p[0] > 127 or p.isalnum() else 2
    for p in pieces:
        if runs and kind(p) and runs[-1][0] == kind(p):
            runs[-1][1] += p
        else:
            runs.append([kind(p), bytearray(p)])
    words = [bytes(r) for k, r in runs if k]
    return [("one", w) for w in words] + [("two", a, b) for a, b in zip(words, words[1:])] + [("again",) for a, b in zip(words, words[1:]) if a == b]


def test_importance_matches_plain_counts(spark):
    """With more buckets than grams nearly no two share one: log ratios of plainly counted grams must come out,
    but for the smoothing, which counts in buckets; and brute-force Gumbel top-k must draw the same rows."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "Ü-x", "word", "!!"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "a a a", "x" * 40_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, raw string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 1), (21, None), (None, 1)], "doc_id long, quality int")
    good = {i for i in range(20) if i % 2} | {0}
    config = quality_classifier.DsirConfig(buckets=1 << 22)
    model = quality_classifier.fit(docs, labels, config=config)
    raw, target = Counter(), Counter()
    for i, t, _ in [*rows, rows[1]]:
        raw.update(plain_grams(t))
        target.update(plain_grams(t) if i in good else [])
    assert (model.documents, model.share) == (45, (len(good) + 1) / 21)  # row 1 stands twice, and is good
    assert model.effective == config.effective
    b, s = config.buckets, config.smooth
    n_raw, n_target = sum(raw.values()) + s * b, sum(target.values()) + s * b
    ratio = {g: np.log((target[g] + s * b * (n + s) / n_raw) / n_target) - np.log((n + s) / n_raw) for g, n in raw.items()}
    want = {i: model.effective * sum(ratio[g] for g in plain_grams(t)) / (len(plain_grams(t)) + config.prior) for i, t, _ in rows}
    scored = quality_classifier.score(docs, model)
    got = {r["doc_id"]: r["log_weight"] for r in scored.collect()}
    assert got == pytest.approx(want, abs=1e-6) and got[40] == got[41] == 0
    for k in (1, 7, 30, 44):
        threshold, verdicts = quality_classifier.draw(scored, k)
        found = verdicts.collect()
        best = sorted((r["gumbel"] for r in found), reverse=True)[:k]
        assert threshold == best[-1] and sorted((r["gumbel"] for r in found if r["kept"]), reverse=True)[: len(best)] == best
        noise = {r["doc_id"]: r["gumbel"] * quality_classifier.KEY_STEP - r["log_weight"] for r in found}
        for i, x in noise.items():
            h = xxhash.xxh64_intdigest(str(i).encode(), xxhash.xxh64_intdigest((17).to_bytes(4, "little"), 42)) >> 11
            assert x == pytest.approx(-np.log(-np.log((h + 0.5) / 2**53)), abs=1e-5)


def test_the_draw_follows_importance(spark):
    """Of many groups of five each draws one row in proportion to importance; other seeds draw others."""
    weight, trials = {1: 0.0, 2: 1.0, 3: 2.0, 4: -1.0, 5: 0.5}, 2000
    rows = spark.createDataFrame([(f"{t}-{i}", t, i, float(w)) for t in range(trials) for i, w in weight.items()], "doc_id string, t int, i int, log_weight double")
    best = rows.withColumn("key", quality_classifier.gumbel_key()).groupBy("t").agg(F.max_by("i", "key").alias("i"))
    first = Counter(r["i"] for r in best.collect())
    whole = sum(math.exp(w) for w in weight.values())
    for i, w in weight.items():
        p = math.exp(w) / whole
        assert abs(first[i] / trials - p) < 4 * math.sqrt(p * (1 - p) / trials)
    scored = rows.where("t < 4")
    drawn = [frozenset(r["doc_id"] for r in quality_classifier.draw(scored, 8, seed=s)[1].where("kept").collect()) for s in range(3)]
    assert all(len(d) == 8 for d in drawn) and len(set(drawn)) == 3


def test_ties_at_the_threshold_over_different_ids(spark):
    keys = spark.createDataFrame([(i, i // 3) for i in range(12)], "doc_id long, k long")
    assert quality_classifier.kth_largest(keys, "k", 4) == 2 and keys.where("k >= 2").count() == 6


def test_importance_prefers_the_target(spark):
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}***" for i in range(200)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(80))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model)
    kept = {r["doc_id"] for r in quality_classifier.draw(scored, model.k)[1].where("kept").collect()}
    assert model.k == 200 and kept == {i for i in range(300) if i % 3}
    assert quality_classifier.draw(scored, 10)[1].where("kept").count() == 10
    repeated = quality_classifier.draw(scored.union(scored), 1)[1]
    assert repeated.where("kept").count() == 2  # tied with the last one drawn


def test_bpe_is_the_librarys(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, text in enumerate(EDGES):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_on_random_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, v, rng = Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(4)
    texts = ["".join(rng.choice("abcdef theing 's\n\té日😀12!?$  ²ªΣ\xa0") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text, ids in zip(texts, v.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == t.encode(text, add_special_tokens=False).ids
    for word in {w for text in texts[:200] for w in text.split()}:
        assert v.merge(word.encode()) == np.frombuffer(dict(v.encode_words([word.encode()]))[word.encode()], np.int32).tolist()


def test_decoding_bad_bytes(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = t.encode("😀", add_special_tokens=False).ids[:1]
    df = spark.createDataFrame([(1, ids), (2, None), (3, [999999, ids[0]])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, path).collect()}
    assert got == {1: t.decode(ids, skip_special_tokens=False), 2: "", 3: t.decode(ids, skip_special_tokens=False)}


def test_packing_covers_every_id(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), path, with_ids=True).toPandas()
    for i, text in enumerate(EDGES):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = rows[rows.doc_id == i].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert b"".join(map(bytes, mine.ids)) == ids.tobytes()
        assert [zlib.crc32(bytes(b)) for b in mine.ids] == list(mine.ids_crc32)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= packing.LENGTH


def test_packing_repeated_rows(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c " * 300)] * 5, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert rows.length.sum() == 5 * rows.doc_tokens.iloc[0]
    assert not rows.duplicated(["sequence_id", "offset"]).any()


def test_clashing_columns(docs, spark):
    """Columns named like results are an error where they are to be kept, and do not matter elsewhere."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        quality_rules.ledger(docs, keep=("doc_id", "n_words"))
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), path, keep=("ids",))
    with pytest.raises(ValueError):
        bpe.decode(bpe.encode(docs, path).withColumn("decoded", F.lit(1)), path, keep=("decoded",))
    with pytest.raises(ValueError):
        quality_classifier.score(docs, quality_classifier.DsirModel(np.zeros(8), 1.0, 1, 1.0), keep=("doc_id", "score"), name="score")
    clash = spark.createDataFrame([(1, "a b c", 7, 8, 9), (None, "x", 7, 8, 9)], "doc_id long, text string, length int, offset int, sequence_id int")
    got = packing.pack(clash, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (1, 4)] and len({r["sequence_id"] for r in got}) == 1


def test_very_long_texts(spark):
    """A text of several blocks' size through every reader of texts."""
    text = "Some words of a long text, and then some more of them! " * 60_000
    docs = spark.createDataFrame([(1, text), (2, "short"), (1, text)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert found[1]["n_words"] == len(text.split()) and found[1]["n_repeat_words"] == found[1]["n_words"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = {r["doc_id"]: len(r["ids"]) for r in bpe.encode(docs, path).collect()}
    assert ids[1] == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    model = quality_classifier.DsirModel(np.ones(64), 10.0, 3, 1.0)
    weight = {r["doc_id"]: r["log_weight"] for r in quality_classifier.score(docs, model).collect()}
    assert weight[1] == pytest.approx(10.0, rel=1e-3) and 0 < weight[2] < 1
    scores = toxicity.score(docs, toxicity.ToxicityModel(16, 0.0, np.zeros(0, np.int64), np.zeros(0))).collect()
    assert [r["score"] for r in scores] == [0.5] * 3


def test_cutting_stock_wastes_little():
    rng = np.random.default_rng(0)
    histogram = {int(s): int(n) for s, n in zip(rng.choice(range(1, 256), 120, replace=False), rng.integers(1, 5000, 120))} | {1024: 900, 512: 700, 256: 1300, 2048: 5}
    rows = cutting_stock.plan(histogram, 2048)
    for size, n in histogram.items():
        spans = sorted((lo, hi) for s, lo, hi, *_ in rows if s == size)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    used = Counter()
    for size, lo, hi, first, each, _ in rows:
        for r in range((hi - lo) // each):
            used[first + r] += size * each
    assert max(used.values()) <= 2048 and len(used) * 2048 <= 1.01 * sum(s * n for s, n in histogram.items()) + 2048


def test_base32_digest():
    from auditloom.llm.archives import base32_sha1

    assert base32_sha1(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_held_out(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
    assert spark.range(1).select(F.lit(1)).count() == 1
