"""Operator 13: hard-negative mining by slot-decomposed selection.

The score of two rows is the inner product of their integers, floor(scale * x). An anchor's positives are its best ``positives``
other rows of its label; a row of another label is a hard negative of a positive if its score is between ``low`` and ``high`` per
cent of the positive's. The upper limits of an anchor's positives, in descending order, cut the scores into disjoint slots.
All rows are scored against all anchors once, in blocks, and each pair of blocks keeps the best ``negatives`` of each slot of each
anchor (the combiner); a window with a group limit then keeps the best of all blocks, before and after the shuffle. Slots do not
overlap and come in descending order, so the best of a positive's window are the first rows, above its lower limit, of its own
slot and the slots after it: every suffix answers one window, however the windows overlap.

Anchors are a stated share of the rows, so the work is in proportion to anchors times rows, as for any exact search. Anchors go to
the blocks of rows and rows to the blocks of anchors in one shuffle; a task holds one block of either (``ANCHOR_COMPONENTS``,
``ROW_COMPONENTS``). The search for positives meets each anchor with the rows of its own label only, in blocks too, so that a
label that a third of all rows has is many tasks.

Rows with a null label, a null vector, or a null or non-finite component take no part. Rows are compared with rows of as many
components. Components are held within sqrt(2**55 / width), 2**24 at 64, where scores and limits are exact in 64 bits. Rows with a
null id are never anchors; among equal scores they come last. Repeated rows are separate rows: an anchor's copies are among its
positives, and an anchor that is repeated is mined for each copy. A positive with a score below 0 has an empty window. Labels are
integers. An empty table gives no rows. Only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeaudit.llm.centroids import finite
from lakeaudit.llm.text import durable, whole_groups

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Components of the anchors, and of the rows, that a task holds.
ANCHOR_COMPONENTS = 1 << 20
ROW_COMPONENTS = 1 << 24
#: Of the sizes of groups, so many rows are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Anchors and rows whose scores are in memory at once.
STRIP, CHUNK = 1024, 4096
_FLOOR, _TOP = -(1 << 62), 1 << 62
_SLOTS = "array<struct<low: bigint, high: bigint>>"


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank int, negative_id, positive_score long, negative_score long): for each anchor and positive its
    best hard negatives. ``anchor`` (boolean) and ``label`` (integer) are columns of vectors."""
    if not 0 <= low <= high:
        raise ValueError("limits are shares of a score, the lower first")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bound = F.floor(F.sqrt(F.lit(float(1 << 55)) / F.greatest(F.size("x"), F.lit(1))))
    # Within 2**30, so that an int holds what a short vector may have.
    held = lambda c: F.floor(F.greatest(-F.col("bound"), F.least(F.col("bound"), c * scale))).cast("int")
    rows = rows.where(F.col("label").isNotNull() & finite(F.col("x"))).withColumn("bound", F.least(bound, F.lit(1 << 30)).cast("double"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("x").alias("width"), F.transform("x", held).alias("q"), (F.col("anchor") & F.col("id").isNotNull()).alias("anchor"))
    rows = durable(rows)

    best = W.partitionBy("anchor_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    anchors = rows.where("anchor").select("row", "id", "label", "width", "q")
    whole = F.array(F.struct(F.lit(_FLOOR).alias("low"), F.lit(_TOP).alias("high")))
    near = _best_of_slots(rows, anchors.withColumn("slots", whole), ["width", "label"], True, positives)
    found = durable(near.withColumn("i", F.row_number().over(best)).where(F.col("i") <= positives).select("anchor_row", "i", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # The window of a positive; below 0 it is empty.
    own = found.where("positive_score >= 0").withColumns({"low": F.expr(f"({low} * positive_score + 99) div 100"), "high": F.expr(f"{high} * positive_score div 100")})
    limits = own.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("w"))
    # Each slot ends above the limit that follows; none goes below the lowest window.
    after = lambda x, j: F.coalesce(F.get(F.col("w"), j + 1)["high"] + 1, F.lit(_FLOOR))
    least = F.array_min(F.transform("w", lambda x: x["low"]))
    limits = limits.select(F.col("anchor_row").alias("row"), F.transform("w", lambda x, j: F.struct(F.greatest(after(x, j), least).alias("low"), x["high"].alias("high"))).alias("slots"))
    far = _best_of_slots(rows, anchors.join(limits, "row"), ["width"], False, negatives)
    in_slot = W.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    kept = far.withColumn("n", F.row_number().over(in_slot)).where(F.col("n") <= negatives)
    # Slots in order, so scores in descending order: at most positives * negatives entries.
    lists = kept.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "id", "score"))).alias("best"))
    suffix = F.filter("best", lambda x: (x["slot"] >= F.col("i") - 1) & (x["score"] >= F.col("low")))
    out = own.join(lists, "anchor_row").join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "found"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("negative_id"), "positive_score", F.col("found.score").alias("negative_score"))


def _best_of_slots(rows: DataFrame, anchors: DataFrame, by: list[str], same: bool, keep: int) -> DataFrame:
    """(anchor_row, slot, score, id): of each pair of blocks the best ``keep`` rows of each slot of each of anchors(row, id, label,
    width, q, slots). ``by``: what anchor and row must share; ``same``: rows of the anchor's label, itself not among them, or of
    others."""
    of_anchors = anchors.groupBy(*by).agg(F.count("*").alias("m"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).join(of_anchors, by)
    width = F.greatest("width", F.lit(1))
    a = F.ceil(F.col("m") * width / ANCHOR_COMPONENTS)
    # As many blocks of rows as let both sides travel alike, and no block above what a task may hold.
    r = F.ceil(F.greatest(F.sqrt("n") / 8, F.col("n") * width / ROW_COMPONENTS))
    sizes = durable(sizes.select(*by, a.cast("int").alias("a"), r.cast("int").alias("r")))
    hint = F.broadcast if sizes.count() <= BROADCAST_ROWS else (lambda df: df)
    block = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    columns = ["i", "j", "row", "id", "label", "width", "q"]
    left = anchors.join(hint(sizes), by).withColumns({"i": block("a"), "j": F.explode(F.sequence(F.lit(0), F.col("r") - 1))}).select(*columns, "slots", F.lit(0).alias("kind"))
    right = rows.join(hint(sizes), by).withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("a") - 1)), "j": block("r")}).select(*columns, F.lit(None).cast(_SLOTS).alias("slots"), F.lit(1).alias("kind"))
    cell = [*by, "i", "j"]

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            keys = np.stack([table.column(c).to_numpy() for c in cell])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
            for start, end in zip(cuts, cuts[1:], strict=False):
                some = table.slice(start, end - start)
                at = int(np.searchsorted(some.column("kind").to_numpy(), 1))
                if at and at < some.num_rows:
                    yield from _select(some.slice(0, at), some.slice(at), same, keep)

    cells = left.unionByName(right).withColumn("grp", F.xxhash64(*cell)).repartition("grp").sortWithinPartitions("grp", *cell, "kind", F.col("id").asc_nulls_last())
    return cells.mapInArrow(select, "anchor_row long, slot int, score long, id long")


def _rows(table: pa.Table) -> np.ndarray:
    width = table.column("width")[0].as_py()
    return table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, width)


def _select(anchors: pa.Table, rows: pa.Table, same: bool, keep: int) -> Iterator[pa.RecordBatch]:
    """The rows, in order of their ids, against the anchors, in strips."""
    x, y = _rows(anchors), _rows(rows)
    if x.size and x.shape[1] * float(np.abs(x).max()) * float(np.abs(y).max()) < 2.0**53:
        x, y = x.astype(np.float64), y.astype(np.float64)  # exact, and much faster
    row, label = (rows.column(c).to_numpy() for c in ("row", "label"))
    ids = rows.column("id").combine_chunks()
    own, own_label, slots = anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("slots").to_pylist()
    for a in range(0, len(x), STRIP):
        part = slice(a, min(a + STRIP, len(x)))
        lows, highs = limits(slots[part])
        places, score, at = best_of_slots(x[part], own[part], own_label[part], y, row, label, lows, highs, same, keep)
        arrays = [pa.array(own[a + places // lows.shape[1]]), pa.array((places % lows.shape[1]).astype(np.int32)), pa.array(score), ids.take(pa.array(at))]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor_row", "slot", "score", "id"])


def limits(slots: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """The slots' limits side by side; what an anchor has fewer of is empty."""
    most = max(map(len, slots))
    lows, highs = np.full((len(slots), most), 1, np.int64), np.zeros((len(slots), most), np.int64)
    for i, some in enumerate(slots):
        for j, s in enumerate(some):
            lows[i, j], highs[i, j] = s["low"], s["high"]
    return lows, highs


def best_of_slots(
    x: np.ndarray, own: np.ndarray, own_label: np.ndarray, y: np.ndarray, row: np.ndarray, label: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool, keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor * slots + slot, score, place of the row) of the best ``keep`` of each slot; of equal scores the earlier rows.

    Once a slot is full, only what is above its least score can enter, as later rows lose ties."""
    n_slots = lows.shape[1]
    need = lows.copy()
    places, score, at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    a, step = 0, 64
    while a < len(y):
        part = slice(a, min(a + step, len(y)))
        scores = x @ y[part].T
        fits = (own_label[:, None] == label[None, part]) == same
        if same:
            fits &= own[:, None] != row[None, part]
        new = [(places, score, at)]
        for j in range(n_slots):
            i, k = np.nonzero((scores >= need[:, j, None]) & (scores <= highs[:, j, None]) & fits)
            new.append((i * n_slots + j, scores[i, k].astype(np.int64), k + a))
        places, score, at = (np.concatenate(c) for c in zip(*new, strict=True))
        order = np.lexsort((at, -score, places))
        places, score, at = places[order], score[order], at[order]
        first = np.searchsorted(places, places)
        good = np.arange(len(places)) - first < keep
        places, score, at = places[good], score[good], at[good]
        full, times = np.unique(places, return_counts=True)
        ends = np.cumsum(times) - 1
        full, ends = full[times == keep], ends[times == keep]
        need[full // n_slots, full % n_slots] = score[ends] + 1
        a, step = part.stop, min(2 * step, CHUNK)
    return places, score, at
