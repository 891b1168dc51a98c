"""Operators 11 to 13 against brute force, and on rows that are odd."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeaudit.llm import centroids, decontamination, hard_negatives

#: Names that the operators use inside.
CLASH = ["id", "x", "q", "h", "row", "width", "best", "cluster", "distance", "words", "n_words", "win", "item", "slots", "anchor_row", "score", "rank"]


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH) if c not in df.columns})


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def brute_clusters(rows, width, scale, k, rounds):
    kept = [(i, floors(v, scale)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    middle = [q for _, q in seeds]
    far = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    pick = lambda q: min((far(q, c), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = [[q for _, q in kept if pick(q)[1] == n] for n in range(len(middle))]
        middle = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else middle[n] for n, g in enumerate(groups)]
    found = [(i, *pick(q)[::-1]) for i, q in kept]
    total = sum(d for _, _, d in found)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, n, d, sum(e for _, m, e in found if m == n), total, digest(middle[n])) for i, n, d in found]


def by_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize(("n", "k"), [(300, 6), (4, 6)])
def test_clusters_against_brute_force(spark, n, k):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5) * 3]) for i in range(n)]
    rows += [(7, [0.5] * 5), (7, [-0.5] * 5), (3, rows[3][1]), (None, [0.1] * 5), (900, None), (901, []), (902, [1.0] * 4), (903, [None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 5), (905, [float("inf")] * 5), (906, [-0.0] * 5)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out, middle = centroids.cluster(df, width=5, scale=64, k=k)
    assert by_text(out.collect()) == by_text(brute_clusters(rows, 5, 64, k, 3)) and len(middle) == k


def test_an_empty_cluster_keeps_its_centroid(spark):
    # Equal vectors all go to the first centroid; the others stay as they are.
    rows = [(i, [1.0, 2.0]) for i in range(20)]
    out, middle = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), width=2, k=3)
    assert middle == [[64, 128]] * 3 and {tuple(r)[1:5] for r in out.collect()} == {(0, 0, 0, 0)}


def test_clusters_of_none_and_of_extremes(spark):
    none, middle = centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.collect() == [] and middle == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = [(i, [1e300 * (-1) ** i] * 64) for i in range(40)]
    out, _ = centroids.cluster(spark.createDataFrame(far, "vec_id long, embedding array<double>"), k=1)
    assert all(0 < r["distance"] < 1 << 62 and r["inertia"] == (1 << 63) - 1 for r in out.collect())
    with pytest.raises(ValueError, match="id"):
        centroids.cluster(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<double>"))


def test_no_python_in_clusters(spark, sf):
    out, _ = centroids.cluster(spark.read.parquet(f"{sf}/embeddings.parquet"))
    q = spark.range(1).select(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")).alias("q"))
    assert centroids.moved(q.unionAll(q), [[0, 0], [5, 5]]) == [[1, 2], [5, 5]]
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, window=10):
    cut = {}
    for i, t in items:
        w = item_words(t)
        for a in range(max(1, len(w) - window + 1)) if w else ():
            cut.setdefault(tuple(w[a : a + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = item_words(t)
        hit, found = set(), set()
        for n in {len(k) for k in cut}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in cut:
                    hit |= set(range(a, a + n))
                    found |= cut[k]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "漢字", "the", "THE", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(25)
    items = [(i, text(rng.randrange(10, 40))) for i in range(30)]
    items += [(40, "one two three"), (41, "Solo"), (42, "two words"), (43, ""), (44, None), (45, "..!"), (None, text(14)), (46, items[0][1]), (47, items[0][1].upper()), (46, shared), (48, shared + " more"), (5, shared), (49, "a a a a a a a a a a a")]
    docs = []
    for i in range(80):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(w) - 9))
            parts += [", ".join(w[a : a + rng.randrange(8, 30)]), text(rng.randrange(0, 5))]
        docs.append((i, "\n".join(parts)))
    docs += [(3, docs[3][1]), (3, docs[3][1]), (3, "other one two three"), (None, shared), (None, shared), (None, "two words"), (90, None), (91, ""), (92, "solo"), (93, "a " * 3000), (94, shared.upper()), (95, shared[:-1]), (96, "x" * 200_000)]
    return docs, items


@pytest.mark.parametrize("rows", [decontamination.BROADCAST_ROWS, 40])
def test_decontamination_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)  # the second time in blocks, and counted by a shuffled join
    docs, items = corpus()
    out = decontamination.decontaminate(clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), clashing(spark.createDataFrame(items, "item_id long, text string")))
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in out.collect()]
    want = brute_hits(docs, items)
    assert by_text(got) == by_text(want) and sum(w[5] for w in want) > 40


def test_spans_of_windows(spark):
    docs = spark.createDataFrame([(1, "p q " + " ".join("abcdefghijkl") + " z solo")], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join("ABCDEFGHIJKL")), ("s", "solo")], "item_id string, text string")
    r = decontamination.decontaminate(docs, items).first()
    assert sorted(map(tuple, r["spans"])) == [(3, 12), (4, 13), (5, 14), (16, 16)] and (r["n_hit"], r["n_items"]) == (13, 2)


@pytest.mark.parametrize(("some_docs", "some_items"), [(0, 5), (5, 0), (0, 0)])
def test_decontamination_of_empty_tables(spark, some_docs, some_items):
    docs, items = corpus()
    out = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").limit(some_docs), spark.createDataFrame(items, "item_id long, text string").limit(some_items)).collect()
    assert len(out) == some_docs and all(not r["contaminated"] or some_items for r in out)


def test_no_python_and_no_shuffled_text_in_decontamination(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64("text").alias("h2"), decontamination.words(F.col("text")).alias("words"))
    places = decontamination._places(texts, ["id", "h1", "h2"], [3]).where("at > 0").select("h")
    known = spark.range(3).select(F.col("id").alias("h"))
    plan = places.join(F.broadcast(known), "h").groupBy("h").count()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|SortMergeJoin", plan)
    assert re.search("PushedFilters|ReadSchema: struct<text:string>|ReadSchema: struct<doc_id", plan)


def brute_negatives(rows, anchor, positives=5, negatives=10):
    good = [(r, i, y, floors(v, 256)) for r, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for r, i, y, q in good:
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, p, strict=True)), last(j), s, j, z) for s, j, z, p in good if s != r and len(p) == len(q)), key=lambda t: t[:3])
        for score, _, _, j, _ in [t for t in scored if t[4] == y][:positives]:
            p = -score
            fits = [t for t in scored if t[4] != y and 30 * p <= -100 * t[0] <= 90 * p]
            out += [(i, j, n, t[3], p, -t[0]) for n, t in enumerate(fits[:negatives], 1)]
    return out


def vectors(seed, n=240, width=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, width))
    v = [(i, [float(x) for x in np.round(middle[i % 4] + rng.normal(size=width), 1)], int(rng.integers(0, 4))) for i in range(n)]
    v += [(i, v[20][1], v[20][2]) for i in (20, 20, 300, 301, 302)] + [(i, v[40][1], (v[40][2] + 1) % 4) for i in range(310, 330)]  # copies: ties in plenty
    return v + [(None, v[0][1], 1), (None, v[1][1], 2), (400, None, 1), (410, v[0][1], None), (420, [float("nan")] * width, 1), (430, [None] * width, 1), (440, [], 1), (450, [1.0, 2.0], 1), (460, [1.0, 3.0], 1), (461, [1.0, 2.5], 0), (470, [0.0] * width, 1)]


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_negatives_against_brute_force(spark, monkeypatch, seed, small):
    if small:  # many blocks, strips and chunks
        for name, value in (("ANCHOR_COMPONENTS", 40), ("ROW_COMPONENTS", 200), ("BROADCAST_ROWS", 1), ("STRIP", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(seed)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    out = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"))
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert by_text(out.collect()) == by_text(want) and len(want) > 500


def test_chunks_and_big_numbers():
    rng = np.random.default_rng(3)
    for big in (False, True):
        x, y = (rng.integers(-9, 10, (n, 3)) * (1 << 23 if big else 1) for n in (4, 500))
        scores = x @ y.T
        label, own_label = rng.integers(0, 2, 500), rng.integers(0, 2, 4)
        lows, highs = np.array([[10, -40]] * 4) * (1 << 46 if big else 1), np.array([[80, 9]] * 4) * (1 << 46 if big else 1)
        places, score, at = hard_negatives.best_of_slots(x, np.arange(4), own_label, y, np.arange(500) + 2, label, lows, highs, False, 7)
        for i in range(4):
            for j in range(2):
                fit = [k for k in range(500) if lows[i, j] <= scores[i, k] <= highs[i, j] and label[k] != own_label[i]]
                want = sorted(fit, key=lambda k: (-scores[i, k], k))[:7]
                assert at[places == 2 * i + j].tolist() == want and score[places == 2 * i + j].tolist() == scores[i, want].tolist()


def test_negatives_of_none_and_of_extremes(spark):
    schema = "vec_id long, embedding array<double>, label int"
    mined = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 2 == 0, F.col("label")).collect()
    assert mined([]) == [] and mined([(2, [1.0], 1)]) == [] and mined([(1, [1.0], 1), (3, [1.0], 2)]) == []
    got = mined([(2, [1e300, 1.0], 1), (3, [1e300, 1.0], 1), (5, [1e6, 0.0], 2)])
    assert len(got) <= 1 and all(r["negative_score"] <= r["positive_score"] for r in got)
    with pytest.raises(ValueError, match="limits"):
        hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.lit(True), F.col("label"), low=50, high=40)
