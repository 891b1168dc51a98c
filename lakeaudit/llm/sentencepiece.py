"""Operator 2: SentencePiece encoding with the N best segmentations of a whole text, and decoding.

A text is a chain of pre-tokens, so its lattice is a chain of their lattices. The forward pass gives each pre-token's best
and second best score. Only the N - 1 places where leaving the best path costs least can differ in one of the N best
segmentations of the text; there, backward A* over the piece lattice, with the forward scores as exact heuristic, lists the
pre-token's own N best, and merging those lists gives those of the text. One narrow pass, no shuffle.

Null text: null ids, no segmentations, 0 tokens, null decoding. Empty text: no ids, one empty segmentation, decoded as
empty. Ties: the best segmentation has fewer tokens, then the shorter last piece; the others follow by score, then by
place. Repeated rows give repeated rows. Of the input only the id and text columns are read, so that other columns may
have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.lattice import LONG, NEVER, SCALE, Lattice, Vocabulary, lattice_of, pretokens, spread
from lakeaudit.llm.text import slices, strings


#: Bytes of text at a time: all segmentations of a slice are held until it is sent.
SLICE = 500_000
#: The N best of so many words of up to ``LONG`` characters, about, are kept from slice to slice.
SEARCHED = 20_000


def merge_best(places: list[list[tuple[int, list[int]]]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best ways to take one entry of each list, as (loss against the best, entry numbers); lists are best first."""
    kept: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    for options in places:
        grown = ((loss + options[0][0] - score, (*pick, i)) for loss, pick in kept for i, (score, _) in enumerate(options))
        kept = heapq.nsmallest(n, grown)
    return kept


def encode(docs: DataFrame, vocabulary: Vocabulary, n_best: int = 4, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", all_ids: bool = False, verify: bool = True) -> DataFrame:
    """(id columns, n_tokens long, ids array<int>, nbest_scores array<double>, nbest_tokens array<long>, decoded_equal
    boolean if verify). ids is the best segmentation; the N best follow as natural-log scores and token counts, best first, fewer than
    N where a text has fewer segmentations. decoded_equal: the ids were decoded and gave the text back. all_ids adds
    nbest_ids array<array<int>>.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file, whatever the corpus
    keys = [f"k{i}" for i in range(len(id_columns))]
    columns = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "nbest_scores": (pa.list_(pa.float64()), "array<double>"), "nbest_tokens": (pa.list_(pa.int64()), "array<long>")}
    if verify:
        columns["decoded_equal"] = (pa.bool_(), "boolean")
    if all_ids:
        columns["nbest_ids"] = (pa.list_(pa.list_(pa.int32())), "array<array<int>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shared.value)
        for batch in slices(batches, chars=SLICE):
            got = _encode_slice(lattice, strings(batch.column("text")), n_best, all_ids, verify)
            made = [got[name] if isinstance(got[name], pa.Array) else pa.array(got[name], kind) for name, (kind, _) in columns.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], [*keys, *columns])

    slim = docs.select(*(F.col(c).alias(k) for c, k in zip(id_columns, keys, strict=True)), F.col(text_column).alias("text"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(id_columns, keys, strict=True))
    out = slim.mapInArrow(run, ", ".join([kinds, *(f"{name} {kind}" for name, (_, kind) in columns.items())]))
    return out.withColumnsRenamed(dict(zip(keys, id_columns, strict=True)))


def _encode_slice(lattice: Lattice, texts: list[str | None], n: int, all_ids: bool, verify: bool = True) -> dict:
    words = [pretokens(t) if t else [] for t in texts]
    distinct = list(dict.fromkeys(w for ws in words for w in ws))
    index = dict(zip(distinct, range(len(distinct)), strict=True))
    got = lattice.segment(distinct, want_ids=True)
    gaps = np.where(got.second > NEVER, got.best - got.second, 1 << 60)
    if len(lattice.searched) > SEARCHED:
        lattice.searched.clear()
    searched: dict[int, list[tuple[int, list[int]]]] = {}
    counts, flats, offsets, scores, tokens = [], [], [0], [], []
    ways, way_ends, text_ends = [], [0], [0]
    for text, ws in zip(texts, words, strict=True):
        at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
        lengths = got.counts[at]
        ids = got.ids[spread(got.starts[at], lengths)]
        flats.append(ids)
        offsets.append(offsets[-1] + len(ids))
        counts.append(len(ids))
        if text is None:
            scores.append([])
            tokens.append([])
            text_ends.append(text_ends[-1])
            continue
        gap = gaps[at]
        if len(gap) > n - 1:
            limit = np.partition(gap, n - 2)[n - 2]
            near = np.flatnonzero(gap <= limit)
            near = near[np.argsort(gap[near], kind="stable")][: n - 1]
        else:
            near = np.arange(len(gap))
        near = np.sort(near[gap[near] < 1 << 60])
        for j in near.tolist():
            if at[j] not in searched:
                ways_of = lattice.searched.get((ws[j], n))
                if ways_of is None:
                    ways_of = lattice.n_best(ws[j], n)
                    if len(ws[j]) <= LONG:
                        lattice.searched[ws[j], n] = ways_of
                searched[at[j]] = ways_of
        options = [searched[at[j]] for j in near.tolist()]
        merged = merge_best(options, n)
        best, size = int(got.best[at].sum()), len(ids)
        scores.append([(best - loss) / SCALE for loss, _ in merged])
        tokens.append([size + sum(len(o[i][1]) - len(o[0][1]) for o, i in zip(options, pick, strict=True)) for _, pick in merged])
        if all_ids:
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for _, pick in merged:
                pieces, done = [], 0
                for j, o, i in zip(near.tolist(), options, pick, strict=True):
                    pieces += [ids[done : starts[j]], np.array(o[i][1], np.int32)]
                    done = starts[j + 1]
                ways += [*pieces, ids[done:]]
                way_ends.append(way_ends[-1] + sum(map(len, pieces)) + len(ids) - done)
            text_ends.append(text_ends[-1] + len(merged))
    nulls = pa.array([t is None for t in texts], pa.bool_())
    join = lambda parts: pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32())
    out = {"n_tokens": counts, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), join(flats), mask=nulls), "nbest_scores": scores, "nbest_tokens": tokens}
    if verify:
        raw = lattice.decode_all(np.concatenate(flats) if flats else np.empty(0, np.int32), offsets)
        out["decoded_equal"] = [None if t is None else x == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") for t, x in zip(texts, raw, strict=True)]
    if all_ids:
        each = pa.ListArray.from_arrays(pa.array(way_ends, pa.int32()), join(ways))
        out["nbest_ids"] = pa.ListArray.from_arrays(pa.array(text_ends, pa.int32()), each)
    return out


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """The rows of encoded with the text that the ids stand for; null ids give null. ``output`` replaces a column of that name."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(ids):  # noqa: ANN001, ANN202
        lattice = lattice_of(shared.value)
        return ids.map(lambda x: None if x is None else lattice.decode(list(x)))

    return encoded.withColumn(output, text(F.col(ids_column)))
