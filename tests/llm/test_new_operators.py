"""Spelling variants, learned partitions and target sampling: parts and edge cases against plain versions."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import learned_partitions, spelling_variants, target_sampling
from auditloom.llm.spelling_variants import VariantConfig


def plain_near(words):
    near = {w: set() for w in words}
    for a, b in itertools.combinations(words, 2):
        if len(a) == len(b):
            close = sum(x != y for x, y in zip(a, b)) == 1
        else:
            short, long = sorted((a, b), key=len)
            close = len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
        if close:
            near[a].add(b)
            near[b].add(a)
    return near


def words_frame(spark, counts):
    return spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "id long, word string, n long")


@pytest.mark.parametrize("alphabet,seed", [("ab", 1), ("abé", 2), ("aàÿz", 3)])
def test_near_words_are_those_at_one_edit(spark, alphabet, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(150)} | {"a" * n for n in range(1, 9)}
    counts = {w: rng.randint(2, 6) for w in words}
    frame = words_frame(spark, counts)
    names = {r["id"]: r["word"] for r in frame.collect()}
    near = plain_near(list(words))
    got = {names[r["id"]]: (r["n_near"], (-r["best"]["down"], r["best"]["word"])) for r in spelling_variants.near_words(frame).collect()}
    want = {w: (len(v), min(((counts[x], x) for x in v), key=lambda t: (-t[0], t[1]))) for w, v in near.items() if v}
    assert got == want


def test_words_whose_hashes_collide_part_again(spark, monkeypatch):
    # With tiny moduli nearly all keys collide; the strings still tell the words apart. Workers read the source, so the
    # keys are made here.
    monkeypatch.setattr(spelling_variants, "_PRIMES", ((3, 2), (5, 2)))
    words = ["".join(p) for p in itertools.product("ab", repeat=4)] + ["aaa", "bbb", "abab" + "c"]
    keys = []
    for i, w in enumerate(words):
        whole, gone, fresh = spelling_variants.deletion_keys([w])
        keys.append((int(whole[0]), -1, i))
        keys += [(int(gone[0, p]), 2 * p + int(fresh[0, p]), i) for p in range(len(w))]
    monkeypatch.undo()
    monkeypatch.setattr(spelling_variants, "_keyed", lambda _: spark.createDataFrame(keys, "key long, tag int, id long"))
    frame = words_frame(spark, {w: 2 for w in words})
    got = {words[r["id"]]: r["n_near"] for r in spelling_variants.near_words(frame).collect()}
    assert got == {w: len(v) for w, v in plain_near(words).items() if v}


def test_deletion_keys_are_those_of_the_shorter_words():
    rng = random.Random(5)
    for length in (1, 2, 3, 9, 40):
        words = ["".join(rng.choices("abcé", k=length)) for _ in range(20)]
        whole, gone, fresh = spelling_variants.deletion_keys(words)
        for i, w in enumerate(words):
            assert spelling_variants.deletion_keys([w])[0][0] == whole[i]
            for p in range(length):
                if length > 1:
                    assert spelling_variants.deletion_keys([w[:p] + w[p + 1 :]])[0][0] == gone[i, p]
                assert fresh[i, p] == (p == 0 or w[p] != w[p - 1])


def test_forms_roots_and_edge_texts(spark):
    rng = random.Random(9)
    long_word = "".join(rng.choices("abcdefg", k=30_000))
    counts = {"colours": 1000, "colors": 2, "colour": 5, "colourss": 90, "colourssx": 8, "colourssxx": 2, "unrelated": 3, "colourt": 2, "once more": 1}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = [(1, text, 5), (2, None, 5), (3, "", 5), (None, "nameless nameless", 5), (4, long_word, 5), (4, long_word, 5), (5, long_word[:100] + "z" + long_word[101:], 5), (5, long_word[:100] + "z" + long_word[101:], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    config = VariantConfig(damage=1 << 40)  # no deletions, but for a hash of 0
    got = {r["word"]: r for r in spelling_variants.variants(df, config=config).collect()}
    chain = [("colourssxx", None), ("colourssx", "colourss"), ("colourss", "colours"), ("colours", None)]
    for word, form in chain:
        assert got[word]["form"] == form, word
    assert got["colourssx"]["root"] == "colours" and got["colours"]["root"] == "colours" and got["colourssxx"]["root"] == "colourssxx"
    assert got["colourt"]["form"] == "colours" and got["colourt"]["form_n"] == 1000 and "colour" not in got and "colors" not in got
    assert got["nameless"]["n"] == 2 and got["unrelated"]["n_near"] == 0
    assert got[long_word]["n"] == 2 and got[long_word]["n_near"] == 1 and got[long_word]["form"] is None
    assert spelling_variants.variants(df.limit(0)).collect() == []


def test_repeated_ids_and_damaged_runs(spark):
    rows = [(7, "Incremental incremental INCREMENTAL"), (7, "incremental"), (31, "statement statement"), (33, "ÀÉÎstatement×÷ statement")]
    got = {r["word"]: r["n"] for r in spelling_variants.count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter()
    for i, t in rows:
        for run in t.replace("×÷", "×÷").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}


def cosine(a, b):
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def test_clustered_vectors_are_found_in_few_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 24))
    x = centres[rng.integers(16, size=4000)] + 0.15 * rng.normal(size=(4000, 24))
    seen = {}
    kept = learned_partitions._route

    def route(queries, router, mass, sizes, k):
        order, before = learned_partitions._before(router.probabilities(x[::20]))
        seen["share"] = ((before < mass) * sizes[order]).sum(axis=1).mean() / sizes.sum()
        seen["parts"] = len(sizes)
        return kept(queries, router, mass, sizes, k)

    monkeypatch.setattr(learned_partitions, "_route", route)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_partitions.search(df, F.col("id") % 20 == 0, config=learned_partitions.PartitionConfig(block=128)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 20):
        near = unit @ unit[q]
        near[q] = -2
        best = set(np.lexsort((np.arange(4000), -near))[:5].tolist())
        assert [r[0] for r in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len(best & {r[1] for r in got[q]})
    assert hits / 1000 >= 0.9
    assert seen["parts"] >= 32 and seen["share"] < 0.25


def test_a_third_of_all_vectors_are_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, (v * (1 + i % 5)).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_partitions.search(df, F.col("id") % 30 == 0, config=learned_partitions.PartitionConfig(block=32)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in range(0, 900, 30):  # all of these are copies of each other, of several lengths
        assert all(r[2] == pytest.approx(1.0) for r in got[q])
        assert {r[1] for r in got[q]} <= set(range(0, 900, 3)) - {q}


def test_fewer_vectors_than_asked_for(spark):
    schema = "vec_id long, embedding array<float>"
    search = lambda rows: [tuple(r) for r in learned_partitions.search(spark.createDataFrame(rows, schema), F.col("id") % 2 == 0).collect()]
    assert search([]) == [] and search([(0, None), (2, []), (4, [0.0, 0.0])]) == []
    assert search([(0, [1.0, 0.0])]) == []
    found = search([(0, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (4, [1.0])])
    assert [f[:3] for f in sorted(found) if f[0] == 0] == [(0, 1, 2), (0, 2, None), (0, 3, 3), (0, 4, 3)]
    assert sorted(f[2] is None for f in found if f[0] == 2) == [False, False, False, True]


def test_parts_are_balanced_and_cut_few_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 3
    x = centres[np.arange(800) % 8] + rng.normal(size=(800, 6)) * 0.2
    near = learned_partitions.graph(spark, x, 6)
    unit = learned_partitions._unit(x)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    for i in range(0, 800, 40):
        assert score[i, near[i]].min() >= np.sort(score[i])[-6] - 1e-6
    of = learned_partitions.cut(x, near, 8, 0.05)
    assert np.bincount(of, minlength=8).max() <= math.ceil(100 * 1.05)
    assert (of[near] != of[:, None]).mean() < 0.1


def test_matrix_sums_and_runs_of_words(spark):
    rows = [(1, "One two ONE two three"), (2, None), (2, "two"), (None, "é4 x_y"), (3, "a " * 5000)]
    config = target_sampling.SamplingConfig(buckets=97, longest=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    matrix = target_sampling.count_matrix(df, config=config)
    want = np.zeros(97, np.int64)
    plain = {}
    for j, (_, t) in enumerate(rows):
        words = ["é4", "x", "y"] if t == "é4 x_y" else (t or "").lower().split()
        features = words + [" ".join(p) for p in zip(words, words[1:])]
        plain[j] = (len(words), len(features))
        for f in features:
            want[zlib.crc32(f.encode()) % 97] += 1
    assert (target_sampling.column_sums(matrix, config) == want).all()
    gain = np.arange(97) - 50
    got = target_sampling.weights(matrix, gain).collect()
    assert sorted((r["n_words"], r["n_features"]) for r in got) == sorted(plain.values())
    one = next(r for r in got if r["doc_id"] == 1)
    features = "one two one two three".split()
    features += [" ".join(p) for p in zip(features, features[1:])]
    assert one["weight"] == sum(int(gain[zlib.crc32(f.encode()) % 97]) for f in features) // len(features)


def test_draws_with_ties_and_repeats(spark):
    rows = [(i % 50, 30 if i % 7 else 5, 30, 100 - (i % 3)) for i in range(400)]
    weighed = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long")
    found = target_sampling.draw(weighed, config=target_sampling.SamplingConfig(percent=25)).collect()
    fit = sorted((r for r in found if r["n_words"] >= 20), key=lambda r: (-r["score"], r["doc_id"], r["weight"]))
    k = 25 * len(fit) // 100
    assert len(found) == 400 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, k + 1))
    drawn = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [(r["score"], r["doc_id"], r["weight"]) for r in drawn] == [(r["score"], r["doc_id"], r["weight"]) for r in fit[:k]]
    assert target_sampling.draw(weighed.limit(0)).collect() == []
