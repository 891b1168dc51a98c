"""Operator 10: substring deduplication by seed and extend.

Seeds: of every ``LENGTH`` consecutive words, winnowing selects one run of ``SEED`` words (the leftmost of least hash), which depends on
those words only; so equal passages select equal seeds. Documents are joined on their seeds. A seed stands for the stretch of
text whose windows of ``LENGTH`` words selected it. Where all stretches of a seed are equal, or some are, the later documents' ones
are repeats as they are. The first stretch of each kind is extended word by word to the left and to the right of the seed, against
the seed's first place in the corpus; the windows within what agrees are repeats. Windows that reach beyond it agree with no window
of that first place, and are held against each other by their hashes. Runs of repeated windows are joined to maximal repeats: the
words removed.

A window counts as repeated if its words also start in a document with a smaller id. Texts equal to that of a smaller id are
settled beforehand (all words go, if there is a window), so that large groups of copies travel as one row each.

Null text: no words, nothing removed. Null ids: no order, so nothing is removed and nothing counts as found there. Several rows
of one id are judged each by its text. Texts of fewer than ``LENGTH`` words keep everything. Of the input only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import GOLD, WORD, WordHash, durable, mix, shingle_hashes, slices, strings

LENGTH = 50
SEED = 16
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64: hashes of all spans of a text from one running sum."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def running(self, ids: np.ndarray) -> np.ndarray:
        self.need(len(ids) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * self.down[: len(ids)], dtype=np.uint64)])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the words start to end (exclusive), the same wherever they stand."""
        return mix((sums[end] - sums[start]) * self.up[start] + (end - start).astype(np.uint64) * GOLD)


def stretches(ids: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, first window, number of windows): the windows of the text, in order, by the seed that they select."""
    windows = len(ids) - length + 1
    if windows <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = shingle_hashes(ids, seed)
    wide = length - seed + 1
    pick = np.empty(windows, np.int64)
    for a in range(0, windows, 100_000):
        b = min(windows, a + 100_000)
        pick[a:b] = np.lib.stride_tricks.sliding_window_view(grams[a : b + wide - 1], wide).argmin(1) + np.arange(a, b)
    first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    return grams[pick[first]], first, np.diff(np.concatenate([first, [windows]]))


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, n_words long, n_removed long, kept_sha256 string, removed array<struct<start int, end int>>), a row for each row of docs;
    ``removed`` are the maximal repeats as word places, ends exclusive, in order."""
    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("t1"), F.xxhash64(F.lit("2"), text_column).alias("t2"))
    seed_type = pa.list_(pa.struct([("h", pa.int64()), ("b", pa.int64()), ("s", pa.int32()), ("n", pa.int32())]))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHash(), Powers()
        for batch in slices(batches):
            hashes.trim()
            n_words, shas, offsets, parts = [], [], [0], []
            for text in strings(batch.column("text")):
                words = WORD.findall(text or "")
                n_words.append(len(words))
                shas.append(_sha(words))
                ids = hashes.ids(words)
                h, first, n = stretches(ids, length, seed)
                span = powers.spans(powers.running(ids), first, first + n + length - 1) if len(h) else h
                offsets.append(offsets[-1] + len(h))
                parts.append((h.astype(np.int64), span.astype(np.int64), first.astype(np.int32), n.astype(np.int32)))
            flat = [np.concatenate([p[i] for p in parts]) for i in range(4)]
            seeds = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(seed_type.value_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "t1", "t2")), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), seeds], ["id", "t1", "t2", "n_words", "sha", "seeds"])

    described = durable(slim.mapInArrow(describe, f"id {kind}, t1 long, t2 long, n_words long, sha string, seeds array<struct<h: bigint, b: bigint, s: int, n: int>>"))
    rows = described.select("id", "t1", "t2", "n_words", "sha")
    # What is joined to rows by a key that very many may share is written first: both sides of the join are then shuffles as they are, and
    # such a key is split among tasks at run time.
    firsts = durable(rows.where("id is not null and n_words > 0").groupBy("t1", "t2").agg(F.min("id").alias("first_id")))

    own = described.where(F.col("id").isNotNull() & (F.size("seeds") > 0)).join(firsts.withColumnRenamed("first_id", "id"), ["t1", "t2", "id"], "left_semi")
    seeds = own.select("id", "t1", F.inline("seeds"))
    stats = seeds.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("b").alias("b1"), F.max("b").alias("b2"))
    stats = durable(stats.where("low < high").select("h", "low", (F.col("b1") < F.col("b2")).alias("differ")))
    joined = durable(seeds.join(stats, "h"))

    alike = joined.where("not differ and id > low").select("id", "t1", "s", F.col("n").alias("n"))
    kinds = joined.where("differ")
    lowest = durable(kinds.groupBy("h", "b").agg(F.min("id").alias("first")))
    kinds = durable(kinds.select("h", "b", "id", "t1", "s", "n").join(lowest, ["h", "b"]))
    later = kinds.where("id > first").select("id", "t1", "s", "n")

    # The words of the first stretch of each kind, found again in the texts.
    open_ = kinds.where("id = first").groupBy("id", "t1").agg(F.sort_array(F.collect_set(F.struct("s", "n", "h"))).alias("spans"))
    wanted = joined.select("id", "t1").distinct().join(open_, ["id", "t1"], "left")
    texts = durable(slim.join(wanted, ["id", "t1"]).select("id", "t1", "t2", "text", "spans"))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            hashes.trim()
            at, cuts, rows = [], [], []
            for k, (text, spans) in enumerate(zip(strings(batch.column("text")), batch.column("spans").to_pylist(), strict=True)):
                ids = hashes.ids(WORD.findall(text or ""))
                grams = shingle_hashes(ids, seed)
                for x in spans:
                    if x["s"] + x["n"] + length - 1 > len(ids):
                        continue  # another text of the same id and hash
                    at.append(k)
                    cuts.append(ids[x["s"] : x["s"] + x["n"] + length - 1])
                    rows.append((x["h"], x["s"], int(grams[x["s"] : x["s"] + length - seed + 1].argmin())))
            if not rows:
                continue
            h, s, o = (np.array(c) for c in zip(*rows, strict=True))
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cuts).astype(np.int64)))
            along = [batch.column(c).take(pa.array(at)) for c in ("id", "t1")]
            yield pa.RecordBatch.from_arrays([pa.array(h), *along, pa.array(s, pa.int32()), pa.array(o, pa.int32()), words], ["h", "id", "t1", "s", "o", "words"])

    single = texts.where("spans is not null").select("id", "t1", "text", "spans").mapInArrow(contexts, f"h long, id {kind}, t1 long, s int, o int, words array<bigint>")
    single = durable(single)
    first = F.min(F.struct("id", "t1", "s", "o", "words")).alias("first")
    reps = durable(single.groupBy("h").agg(first, F.count("*").alias("kinds")).where("kinds > 1").select("h", F.col("first.id").alias("r_id"), F.col("first.o").alias("r_o"), F.col("first.words").alias("r_words")))

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            if not batch.num_rows:
                continue
            places, offsets = (batch.column(c).to_numpy() for c in ("s", "o"))
            r_offsets, later = batch.column("r_o").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False)
            words, r_words = (_lists(batch.column(c)) for c in ("words", "r_words"))
            at, s, n, w = [], [], [], []
            for k in range(batch.num_rows):
                mine, o = words(k), int(offsets[k])
                low, high = agreeing(mine, o, r_words(k), int(r_offsets[k]), length)
                if later[k] and low < high:
                    at.append([k])
                    s.append([places[k] + low])
                    n.append([high - low])
                    w.append([0])
                # The windows of this stretch that the first place does not have.
                rest = np.concatenate([np.arange(low), np.arange(high, len(mine) - length + 1)])
                if len(rest):
                    at.append(np.full(len(rest), k))
                    s.append(places[k] + rest)
                    n.append(np.zeros(len(rest)))
                    w.append(powers.spans(powers.running(mine.astype(np.uint64)), rest, rest + length).astype(np.int64))
            if at:
                along = [batch.column(c).take(pa.array(np.concatenate(at).astype(np.int64))) for c in ("id", "t1")]
                yield pa.RecordBatch.from_arrays([*along, *(pa.array(np.concatenate(x).astype(t)) for x, t in ((s, np.int32), (n, np.int32), (w, np.int64)))], ["id", "t1", "s", "n", "w"])

    pairs = single.join(reps, "h").select("id", "t1", "s", "o", "words", "r_o", "r_words", (F.col("id") > F.col("r_id")).alias("later"))
    extended = durable(pairs.mapInArrow(extend, f"id {kind}, t1 long, s int, n int, w long"))
    rest = extended.where("n = 0")
    least = durable(rest.groupBy("w").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w", "low"))
    hits = rest.join(least, "w").where("id > low").select("id", "t1", "s", F.lit(1).alias("n"))
    hits = hits.unionByName(extended.where("n > 0").select("id", "t1", "s", "n"))

    spans = alike.unionByName(later).unionByName(hits).groupBy("id", "t1").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("hit"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, shas, repeats = [], [], []
            for text, hit in zip(strings(batch.column("text")), batch.column("hit").to_pylist(), strict=True):
                words = WORD.findall(text or "")
                runs = maximal([(h["s"], h["s"] + h["n"] + length - 1) for h in hit])
                kept, done = [], 0
                for a, b in runs:
                    kept += words[done:a]
                    done = b
                kept += words[done:]
                removed.append(len(words) - len(kept))
                shas.append(_sha(kept))
                repeats.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "t1", "t2")), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(repeats, span_type)], ["id", "t1", "t2", "n_removed", "new_sha", "removed"])

    changed = texts.join(spans, ["id", "t1"]).select("id", "t1", "t2", "text", "hit").mapInArrow(cut, f"id {kind}, t1 long, t2 long, n_removed long, new_sha string, removed array<struct<start: int, end: int>>").dropDuplicates(["id", "t1", "t2"])
    out = rows.join(firsts, ["t1", "t2"], "left").join(changed, ["id", "t1", "t2"], "left")
    copy = F.coalesce((F.col("id") > F.col("first_id")) & (F.col("n_words") >= length), F.lit(False))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        F.col("id").alias(id_column), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"), F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
    )


def _lists(column: pa.Array) -> Callable[[int], np.ndarray]:
    """The lists of a column of whole numbers, by row."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return lambda k: values[ends[k] : ends[k + 1]]


def agreeing(mine: np.ndarray, o: int, other: np.ndarray, p: int, length: int) -> tuple[int, int]:
    """Two stretches of word hashes with their seed at o and p: extended from the seed to the left and to the right as far as the words
    agree. The windows of ``mine`` within that, as (first, last + 1); (0, 0) if there is none."""
    left, right = min(o, p), min(len(mine) - o, len(other) - p)
    differ = np.flatnonzero(mine[o - left : o][::-1] != other[p - left : p][::-1])
    left = int(differ[0]) if len(differ) else left
    differ = np.flatnonzero(mine[o : o + right] != other[p : p + right])
    right = int(differ[0]) if len(differ) else right
    low, high = max(0, o - left), min(len(mine), o + right) - length + 1
    return (low, high) if low < high else (0, 0)


def maximal(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
