"""A log of raw messages in files, and a stream over it that admits messages by offset.

A log has appends, numbered from 0. The messages of an append lie in pieces, each of one topic and partition and of a bounded span of offsets;
its index, which is written last, tells each piece's range and rows. The ranges of a partition join without a hole, whatever gaps the offsets
have inside them, so that a range which is missing is a loss. Planning reads the index alone; messages are read by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lakeaudit.sources.schemas import RAW_MESSAGE

FORMAT = "message_log"
#: Offsets that a piece spans at most, and messages in a batch that a task hands on.
PIECE_OFFSETS = 1_000_000
BATCH_ROWS = 1024
_STORED = ["key", "value", "topic", "partition", "offset", "micros"]


def append_log(rows: DataFrame, root: str, number: int, piece_offsets: int = PIECE_OFFSETS) -> None:
    """Append raw messages as append ``number``; readers see all of it or nothing. The same append again overwrites itself.

    A null topic, partition or offset, and an offset below the end of the append before, are errors. Gaps and repeated offsets are kept.
    A busy partition is spread over as many tasks as it has pieces.
    """
    spark, data = rows.sparkSession, f"{root}/data/append={number:020d}"
    place = [F.col(c) for c in ("topic", "partition", "offset")]
    whole = F.when(F.greatest(*(c.isNull().cast("int") for c in place)) == 1, F.raise_error(F.lit("a message lacks its topic, partition or offset")).cast("string"))
    piece = F.coalesce(whole, F.md5(F.to_json(F.struct("topic", "partition", F.expr(f"offset div {int(piece_offsets)}")))))
    rows = rows.withColumns({"piece": piece, "micros": F.unix_micros("timestamp")}).select(*_STORED, "piece")
    rows.repartition("piece").sortWithinPartitions("piece", "offset").write.mode("overwrite").partitionBy("piece").parquet(data)

    stored = StructType([f for f in rows.schema.fields if f.name in ("topic", "partition", "offset", "piece")])
    pieces = spark.read.schema(stored).parquet(data).groupBy("topic", "partition", "piece").agg(F.min("offset").alias("least"), (F.max("offset") + 1).alias("end"), F.count("*").alias("rows"))
    before = [(t, p, ranges[-1].end) for (t, p), ranges in read_index(root, below=number).items()]
    pieces = pieces.join(spark.createDataFrame(before, "topic string, partition int, last long"), ["topic", "partition"], "left")
    previous = F.coalesce(F.lag("end").over(Window.partitionBy("topic", "partition").orderBy("least")), "last", "least")
    begin = F.when(F.col("least") >= previous, previous).otherwise(F.raise_error(F.lit("an offset lies below the end of the log")).cast("long"))
    index = pieces.select("topic", "partition", "piece", begin.alias("begin"), "end", "rows")
    index.coalesce(1).write.mode("overwrite").parquet(f"{root}/index/append={number:020d}")


@dataclass(frozen=True)
class Piece(InputPartition):
    """The messages of one piece with an offset of at least ``begin`` and below ``end``; ``rows`` are those of the whole piece."""

    path: str
    begin: int
    end: int
    rows: int


def _files(path: str):  # noqa: ANN202
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def read_index(root: str, known: set[str] | None = None, below: int | None = None) -> dict[tuple[str, int], list[Piece]]:
    """The pieces of each topic and partition in order of offset, of complete appends that are not ``known`` yet (they become so)."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = _files(root)
    known, found = set() if known is None else known, {}
    appends = system.get_file_info(fs.FileSelector(f"{path}/index", allow_not_found=True))
    for name in sorted(i.base_name for i in appends if i.base_name.startswith("append=")):
        number = int(name.removeprefix("append="))
        if name in known or (below is not None and number >= below):
            continue
        if system.get_file_info(f"{path}/index/{name}/_SUCCESS").type != fs.FileType.File:
            continue
        known.add(name)
        for r in pq.read_table(f"{path}/index/{name}", filesystem=system, partitioning=None).to_pylist():
            piece = Piece(f"{root}/data/{name}/piece={r['piece']}", r["begin"], r["end"], r["rows"])
            found.setdefault((r["topic"], r["partition"]), []).append(piece)
    return {k: sorted(v, key=lambda p: p.begin) for k, v in found.items()}


def shares(backlog: dict[str, int], most: int) -> dict[str, int]:
    """``most`` offsets dealt to partitions by their backlog; what rounding leaves goes to the largest remainders. All of it, if it fits."""
    total = sum(backlog.values())
    if total <= most:
        return dict(backlog)
    out = {k: n * most // total for k, n in backlog.items()}
    left = most - sum(out.values())
    for k in sorted(backlog, key=lambda k: (-(backlog[k] * most % total), k))[:left]:
        out[k] += 1
    return out


class LogReader(DataSourceStreamReader):
    """Offsets are ``{"topic/partition": next offset}``. A batch takes at most ``most`` offsets (gaps count) over all partitions."""

    def __init__(self, root: str, most: int) -> None:
        self.root, self.most = root, most
        self.known: set[str] = set()
        self.pieces: dict[str, list[Piece]] = {}
        self.position: dict[str, int] = {}

    def _refresh(self) -> None:
        for (topic, partition), pieces in read_index(self.root, self.known).items():
            self.pieces.setdefault(f"{topic}/{partition}", []).extend(pieces)

    def initialOffset(self) -> dict:  # noqa: N802
        self._refresh()
        return {k: p[0].begin for k, p in self.pieces.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        """As far as the next batch may go. Spark tells where it stands by planning, on a restart too (an empty range)."""
        self._refresh()
        start = {k: p[0].begin for k, p in self.pieces.items()} | self.position
        ends = {k: p[-1].end for k, p in self.pieces.items()}
        for k, at in start.items():
            if at > ends.get(k, at):
                raise RuntimeError(f"data loss: {k} was read up to {at} and ends at {ends[k]}")
        admitted = shares({k: ends.get(k, at) - at for k, at in start.items()}, self.most)
        return {k: at + admitted[k] for k, at in start.items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self._refresh()
        out = []
        for k, until in end.items():
            pieces = self.pieces.get(k, [])
            at = start.get(k, pieces[0].begin if pieces else until)
            for p in pieces:
                if p.end <= at or at >= until:
                    continue
                if p.begin > at:
                    break
                out.append(Piece(p.path, at, min(p.end, until), p.rows))
                at = out[-1].end
            if at < until:
                raise RuntimeError(f"data loss: {k} lacks the offsets from {at}")
        self.position = dict(end)
        # What lies before this batch is needed no more, but for the last piece, which tells where the log ends.
        self.pieces = {k: [p for p in ps if p.end > start.get(k, 0)] or ps[-1:] for k, ps in self.pieces.items()}
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, path = _files(partition.path)
        try:
            files = ds.dataset(path, filesystem=system, format="parquet")
            rows = files.count_rows()
        except FileNotFoundError as e:
            raise RuntimeError(f"data loss: {path} is gone") from e
        if rows != partition.rows:
            raise RuntimeError(f"data loss: {path} has {rows} messages of {partition.rows}")
        inside = (ds.field("offset") >= partition.begin) & (ds.field("offset") < partition.end)
        for b in files.scanner(columns=_STORED, filter=inside, batch_size=BATCH_ROWS, batch_readahead=1, fragment_readahead=1).to_batches():
            if b.num_rows:
                when = b.column("micros").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in _STORED[:-1]), when], RAW_MESSAGE.fieldNames())


class MessageLog(DataSource):
    """Options: ``path``, the log; ``maxOffsetsPerTrigger``, 100 if not given."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return RAW_MESSAGE

    def streamReader(self, schema: StructType) -> LogReader:  # noqa: ARG002, N802
        most = int(self.options.get("maxOffsetsPerTrigger", 100))
        if most < 1:
            raise ValueError("maxOffsetsPerTrigger must be at least 1")
        return LogReader(self.options["path"], most)


def log_stream(spark: SparkSession, root: str, most: int = 100) -> DataFrame:
    """The messages of a log as a stream from its earliest offsets, ``most`` offsets for each trigger (S1, T4). Batches that were planned are
    planned alike after a restart; messages that are gone fail the query. The package must be importable by the workers."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(FORMAT).option("path", root).option("maxOffsetsPerTrigger", most).load()
