"""Words, hashes and bounded slices of Arrow batches, shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but a space or the controls 9 to 13.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CLASS)

SLICE_CHARS = 2_000_000
GOLD = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Word to 64-bit hash. It is a cache: ``trim`` empties it when it has grown large."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words, in text order."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = ids[:n].copy()
    for j in range(1, k):
        out *= GOLD
        out += ids[j : j + n]
    return mix(out)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in pieces of about ``chars`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // chars)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def once(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches whose key (a long that is never null) has not come before in this task."""
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column(key).to_numpy()
        first = np.zeros(len(keys), bool)
        first[np.unique(keys, return_index=True)[1]] = True
        first &= ~np.fromiter(map(seen.__contains__, keys.tolist()), bool, len(keys))
        seen.update(keys[first].tolist())
        yield batch if first.all() else batch.filter(pa.array(first))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``: the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else batch.num_rows - int(np.argmax(keys[::-1] != keys[-1]))
        if last == 0:  # one group only; it may go on from the one before
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read again: a lost executor costs no recomputation, what numbers or
    lays out rows is done once, and plans do not grow. The tables go with the folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a local master,
    whose tasks run on this machine; on a cluster it is an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder
