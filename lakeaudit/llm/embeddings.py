"""Operator 9: near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of a bounded sample of the distinct ones of a width (``SAMPLE_A_PIVOT`` for each pivot wanted), none so close
to another that all between them are linked; their number grows with the square root of the distinct vectors. What the driver takes
of all widths together is held to ``SAMPLE_COMPONENTS`` components, and the pivots, which are broadcast, to half as many; where that
binds (at 64 components from 17 thousand million vectors, at 768 from 119 million), all widths have fewer in proportion and lists grow.
Every vector is described by its nearest pivots in order (seen from the mean of the sample, so that vectors that all point one
way are told apart), and posted in the inverted list of each. Within a list, the pivots that two vectors share are counted,
each with the product of its weights in both orders, the nearest weighing most; pairs that reach the least count are
candidates. These are verified by cosine in double precision: every one at ``least`` or more is a link, and no other is.

How many pivots are used, how many describe a vector and the least count are fitted on the sample (``fit``). Three kinds of pairs
are tried: those of the sample that are links, as the table has them, and pairs made at exactly the least cosine, turned towards other
vectors of the sample and in random directions. Of the choices that retrieve ``TARGET`` of each kind the one that compares the fewest
pairs is taken. Where none does, as for vectors that are nearly all linked, or very few, one list holds all, and the search is exact.
Vectors of different length are not compared; those of each length are, each by pivots of its own.

Equal vectors are one class, posted once. Vectors within half the least angle of one pivot are all linked with each other: where
a list has many of those, they are counted and joined without comparing them. A long list is dealt out in blocks, and each pair
of blocks is one group, so that no task holds more than two blocks; a pair is counted in the first list that holds both. A group
returns links and one edge for each vector, not pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Null ids: a row like any other; the
component is then named by its smallest non-null id. Repeated rows are separate vectors, equal to each other. Of the input only
the id and vector columns are read, so that other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.llm.graph import components
from lakeaudit.llm.text import durable, whole_groups

LEAST_COSINE = 0.9
PIVOTS_PER_ROOT = 4
SAMPLE_A_PIVOT = 2
#: Components of all sampled vectors together (0.5 GB in double precision).
SAMPLE_COMPONENTS = 1 << 26
#: Links of the sample that the fit is held to: so many at most, and at least.
TRUE_PAIRS = (4000, 50)
#: The share of the pairs at exactly the least cosine that the fitted index must retrieve.
TARGET = 0.985
POSTED = (1, 2, 3, 4, 6, 8, 12, 16, 24)
BLOCK = 1024
#: Block counts are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def core_cosine(least: float) -> float:
    """Vectors this close to one vector are linked with each other: half the angle of the least cosine."""
    return math.sqrt((1 + least) / 2) + 1e-9


def choose_pivots(sample: np.ndarray, wanted: int, least: float) -> np.ndarray:
    """Unit rows of the sample, in order, that are in no core of one taken before: one at least, if the sample has any."""
    bound = core_cosine(least)
    taken = np.zeros((0, sample.shape[1]))
    for a in range(0, len(sample), 512):
        part = sample[a : a + 512]
        if len(taken):
            part = part[(part @ taken.T).max(1) < bound]
        alike = part @ part.T >= bound
        keep: list[int] = []
        for i in range(len(part)):
            if not alike[i, keep].any():
                keep.append(i)
        taken = np.concatenate([taken, part[keep]])
        if len(taken) >= wanted:
            break
    return taken[:wanted]


@dataclass(frozen=True)
class Index:
    """The pivots of one width, and how vectors are described by the first ``used`` of them."""

    pivots: np.ndarray
    centre: np.ndarray
    used: int
    posted: int
    least_score: float

    def describe(self, u: np.ndarray, used: int | None = None, posted: int | None = None, dots: np.ndarray | None = None) -> np.ndarray:
        """The nearest pivots of unit rows, in order."""
        used, posted = used or self.used, posted or self.posted
        p = self.pivots[:used]
        dots = u @ p.T if dots is None else dots[:, :used]
        # The cosine of the differences from the centre, but for a factor of the row.
        near = (dots - p @ self.centre - (u @ self.centre)[:, None] + self.centre @ self.centre) / np.maximum(np.linalg.norm(p - self.centre, axis=1), 1e-12)
        if posted < used:
            first = np.argpartition(-near, posted - 1, axis=1)[:, :posted]
            order = np.take_along_axis(first, np.lexsort((first, -np.take_along_axis(near, first, 1))), 1)
            return order.astype(np.int32)
        return np.argsort(-near, axis=1, kind="stable").astype(np.int32)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of two ordered descriptions side by side: the shared pivots, each with the product of its two weights."""
    weight = np.arange(x.shape[1], 0, -1)
    return ((x[:, :, None] == y[:, None, :]) * np.outer(weight, weight)).sum((1, 2))


def score_grid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The scores of all rows of x with all rows of y."""
    _, place = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    width, weight = int(place.max()) + 1, np.arange(x.shape[1], 0, -1, dtype=np.float32)
    grids = []
    for rows, at in ((x, place[: x.size]), (y, place[x.size :])):
        grid = np.zeros((len(rows), width), np.float32)
        grid[np.repeat(np.arange(len(rows)), x.shape[1]), at] = np.tile(weight, len(rows))
        grids.append(grid)
    return grids[0] @ grids[1].T


def true_pairs(sample: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links among the sample, of its first rows with all: evenly taken if there are many, none if there are few."""
    most, fewest = TRUE_PAIRS
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, min(len(sample), 4000), 256):
        i, j = np.nonzero(sample[a : a + 256] @ sample.T >= least)
        keep = i + a < j
        left.append(i[keep] + a)
        right.append(j[keep])
    i, j = np.concatenate(left), np.concatenate(right)
    if len(i) < fewest:
        return i[:0], j[:0]
    at = np.unique(np.linspace(0, len(i) - 1, min(most, len(i))).astype(np.int64))
    return i[at], j[at]


def fit(sample: np.ndarray, pivots: np.ndarray, total: int, least: float, target: float = TARGET) -> Index:
    """The index over ``total`` vectors that compares the fewest pairs and still retrieves ``target`` of the pairs at the least cosine."""
    centre = sample.mean(0)
    every = Index(pivots, centre, 1, 1, 0.0)
    n = max(2, min(1000, len(sample), max(200, 4_000_000 // len(pivots))))
    rng = np.random.default_rng(20240517)
    q, z = sample[np.arange(n) % len(sample)], sample[(np.arange(n) * 7 + len(sample) // 2) % len(sample)]

    def turned(towards: np.ndarray) -> np.ndarray:
        towards = towards - (towards * q).sum(1, keepdims=True) * q
        size = np.linalg.norm(towards, axis=1, keepdims=True)
        return least * q + math.sqrt(max(0.0, 1 - least * least)) * towards / np.maximum(size, 1e-12)

    alike = [turned(z), turned(rng.normal(size=q.shape))]
    first, second = true_pairs(sample, least)
    best, cost = Index(pivots, centre, 1, 1, 0.0), 1 + 1.5 * total
    used = len(pivots)
    while used >= 16:
        most = min(used, max(POSTED))
        a = every.describe(q, used, most)
        kinds = [(a, every.describe(y, used, most)) for y in alike]
        if len(first):
            kinds.append((every.describe(sample[first], used, most), every.describe(sample[second], used, most)))
        for posted in POSTED:
            if posted > most:
                break
            share = float(((np.bincount(a[:, :posted].ravel(), minlength=used) / n) ** 2).sum())
            price = used + 1.5 * share * total + 30 * posted
            if price >= cost:
                continue
            reach = [np.sort(scores(x[:, :posted], y[:, :posted])) for x, y in kinds]
            least_score = min(float(r[int((1 - target) * len(r))]) for r in reach)
            if least_score > 0:
                best, cost = Index(pivots, centre, used, posted, least_score), price
        used //= 2
    return best


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def indexes(classes: DataFrame, least: float) -> dict[int, Index]:
    """The fitted index of each width that has two vectors or more, of classes(h1, h2, v, width). A table has few widths."""
    sizes = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).where("n > 1").collect()}
    if not sizes:
        return {}
    wanted = {w: max(16, round(PIVOTS_PER_ROOT * math.sqrt(n))) for w, n in sizes.items()}
    part = min(1.0, SAMPLE_COMPONENTS / max(1, sum(SAMPLE_A_PIVOT * k * w for w, k in wanted.items())))
    wanted = {w: max(2, int(k * part)) for w, k in wanted.items()}
    shares = [(w, int(min(1.0, SAMPLE_A_PIVOT * wanted[w] / n) * (1 << 30))) for w, n in sizes.items()]
    share = classes.sparkSession.createDataFrame(shares, "width int, share long")
    sampled = classes.join(F.broadcast(share), "width").where(F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) < F.col("share"))
    table = sampled.select("h1", "h2", "width", "v").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
    out = {}
    for width, n in sizes.items():
        sample = unit(_matrix(table.filter(pc.equal(table.column("width"), width)).column("v"), width))
        if len(sample) >= 2:
            out[width] = fit(sample, choose_pivots(sample, wanted[width], least), n, least)
    return out


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(id, n_links long, component_id, kept boolean), a row for each row of vectors."""
    x = F.col("x")
    good = F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))
    # What is float stays so on its way: half as many bytes, and the same numbers.
    given = vectors.schema[vector_column].dataType.simpleString()
    small = given if given == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("x"), F.col(vector_column).cast(small).alias("v")).withColumn("good", good)
    rows = rows.select("id", "good", F.when(F.col("good"), F.col("v")).alias("v"), F.when(F.col("good"), x).alias("x"))
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit("2"), "x")}).drop("x")
    classes = rows.where("good").groupBy("h1", "h2", F.size("v").alias("width")).agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))

    found = durable(_links_of(classes, least))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    state = classes.select("h1", "h2", "width", "node", "least_id", "copies").join(links, "node", "left").join(parts, "node", "left")
    state = state.withColumn("root", F.coalesce("root", "node"))
    named = state.groupBy("root").agg(F.min("least_id").alias("component_id"))
    state = durable(state.join(named, "root").select("h1", "h2", "width", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    # Both sides are shuffles as they are, so that rows of one vector that are very many are split among tasks at run time.
    out = rows.select("id", "h1", "h2", F.when(F.col("good"), F.size("v")).alias("width")).join(state, ["h1", "h2", "width"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _links_of(classes: DataFrame, least: float) -> DataFrame:
    """(node, links, root) of classes(h1, h2, width, node, copies, v), several rows for a node."""
    # At most SAMPLE_COMPONENTS / SAMPLE_A_PIVOT components in all.
    shared = classes.sparkSession.sparkContext.broadcast(indexes(classes, least))
    bound = core_cosine(least)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                index = known.get(width)
                step = max(1, 4_000_000 // (len(index.pivots) if index else 4_000_000 // 4096))
                for a in range(0, part.num_rows, step):
                    some = part.slice(a, step)
                    if index is None:
                        near, core = np.zeros((some.num_rows, 1), np.int32), np.full(some.num_rows, -1, np.int32)
                    else:
                        u = unit(_matrix(some.column("v"), width))
                        dots = u @ index.pivots.T
                        near, top = index.describe(u, dots=dots), dots.argmax(1)
                        core = np.where(dots[np.arange(len(u)), top] >= bound, top, -1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("node", "copies", "width", "v")), lists, pa.array(core)], ["node", "copies", "width", "v", "near", "core"])

    kind = classes.schema["v"].dataType.simpleString()
    described = durable(classes.select("node", "copies", "width", "v").mapInArrow(describe, f"node long, copies long, width int, v {kind}, near array<int>, core int"))
    # A row for each pivot at most. Smaller cores are compared like all others.
    cores = described.where("core >= 0").groupBy("width", "core").agg(F.count("*").alias("members"), F.sum("copies").alias("total"), F.min("node").alias("head"))
    cores = durable(cores.where(F.col("members") >= BLOCK))
    marked = described.join(F.broadcast(cores), ["width", "core"], "left").withColumn("core", F.when(F.col("members").isNotNull(), F.col("core")).otherwise(-1))
    within = marked.where("core >= 0").select("node", (F.col("total") - F.col("copies")).alias("links"), F.col("head").alias("root"))

    # Each list is dealt out in blocks; the members of a core that are many in a list have blocks of their own, never paired.
    slim = marked.select("width", "core", F.explode("near").alias("pivot"))
    counts = slim.groupBy("width", "pivot", "core").agg(F.count("*").alias("n"))
    apart = (F.col("core") >= 0) & (F.col("n") >= BLOCK)
    series = counts.groupBy("width", "pivot", F.when(apart, F.col("core")).otherwise(-1).alias("series")).agg(F.sum("n").alias("n"))
    series = series.withColumn("own", F.ceil(F.col("n") / BLOCK).cast("int"))
    in_list = W.partitionBy("width", "pivot")
    series = series.withColumns({"low": (F.sum("own").over(in_list.orderBy("series")) - F.col("own")).cast("int"), "blocks": F.sum("own").over(in_list).cast("int"), "rows": F.sum("n").over(in_list)})
    series = durable(series.where("rows > 1"))
    small = series.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    named = series.where("series >= 0").select("width", "pivot", F.col("series").alias("core"), F.col("own").alias("c_own"), F.col("low").alias("c_low"), F.col("blocks").alias("c_blocks"))
    mixed = series.where("series < 0").select("width", "pivot", "own", "low", "blocks")
    posts = marked.select("width", "core", "node", "copies", "near", "v", F.explode("near").alias("pivot"))
    posts = posts.join(hint(named), ["width", "pivot", "core"], "left").join(hint(mixed), ["width", "pivot"], "left")
    own_series = F.col("c_own").isNotNull()
    posts = posts.withColumns({"own": F.coalesce("c_own", "own"), "low": F.coalesce("c_low", "low"), "blocks": F.coalesce("c_blocks", "blocks"), "apart": own_series}).where("own is not null")
    posts = posts.withColumn("block", (F.col("low") + F.pmod(F.xxhash64("node", "pivot"), F.col("own"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    free = F.filter(others, lambda o: (o < F.col("low")) | (o >= F.col("low") + F.col("own")))
    posts = posts.withColumn("other", F.explode(F.when(F.col("apart"), free).otherwise(others)))
    posts = posts.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    posts = posts.withColumn("grp", F.xxhash64("width", "pivot", "b1", "b2")).select("grp", "width", "pivot", "block", "b1", "b2", "node", "copies", "core", "near", "v")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for table in whole_groups(batches, "grp"):
            keys = np.stack([table.column(c).to_numpy() for c in ("grp", "width", "pivot", "b1", "b2")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
            node, copies, block, core = (table.column(c).to_numpy() for c in ("node", "copies", "block", "core"))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                _, width, pivot, b1, b2 = keys[:, a].tolist()
                index = known.get(width)
                some = table.slice(a, b - a)
                near = some.column("near").combine_chunks().flatten().to_numpy().reshape(b - a, -1)
                left = np.flatnonzero(block[a:b] == b1)
                right = left if b1 == b2 else np.flatnonzero(block[a:b] == b2)
                if not len(left) or not len(right):
                    continue
                i, j = candidates(near, core[a:b], left, right, int(pivot), index.least_score if index else 0.0)
                if not len(i):
                    continue
                u = unit(_matrix(some.column("v"), int(width)))
                keep = np.concatenate([np.einsum("ij,ij->i", u[i[s : s + 65536]], u[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)])
                if keep.any():
                    yield _links(i[keep] + a, j[keep] + a, a, b, node, copies)

    between = posts.repartition("grp").sortWithinPartitions("grp", "width", "pivot", "b1", "b2", "node").mapInArrow(verify, "node long, links long, root long")
    return between.unionByName(within)


def candidates(near: np.ndarray, core: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int, least_score: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of left with right; each once if both are one) of a list that share enough pivots, have no list in common before
    this one, and are not of one core."""
    out_i, out_j = [], []
    for s in range(0, len(left), 256):
        rows = left[s : s + 256]
        if near.shape[1] == 1:
            i, j = (x.ravel() for x in np.indices((len(rows), len(right))))
        else:
            i, j = np.nonzero(score_grid(near[rows], near[right]) >= least_score)
        i, j = rows[i], right[j]
        keep = (core[i] < 0) | (core[i] != core[j])
        if left is right:
            keep &= i < j
        i, j = i[keep], j[keep]
        if near.shape[1] > 1:
            first = np.empty(len(i), np.int64)
            for t in range(0, len(i), 50_000):
                x, y = near[i[t : t + 50_000]], near[j[t : t + 50_000]]
                first[t : t + 50_000] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int32).max).min(1)
            i, j = i[first == pivot], j[first == pivot]
        out_i.append(i)
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _links(i: np.ndarray, j: np.ndarray, a: int, b: int, node: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """For each row of a group that has links: how many (by weight of the other side), and the least row it hangs together with."""
    links = np.bincount(i - a, weights=weight[j], minlength=b - a) + np.bincount(j - a, weights=weight[i], minlength=b - a)
    root = local_roots(i - a, j - a, b - a)
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[at + a], pa.int64()), pa.array(links[at].astype(np.int64)), pa.array(node[root[at] + a], pa.int64())], ["node", "links", "root"])


def local_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of each of n places, the least place that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        now = root.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if np.array_equal(now, root):
            return root
        root = now
