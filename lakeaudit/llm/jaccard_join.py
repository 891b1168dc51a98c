"""Operator 4: n-gram Jaccard self-join by chosen paths.

A text is the set of its 5-word shingles (a text of one to four words is one shingle). Texts with equal sets are one class. In
each of several independent runs a set starts at the root and, at every node of a shared random tree, goes on to those of its
shingles whose hash at that node is below 1 / (least * size), 1 / least of them on average; so similar sets choose common
paths. Sets that meet in a node of at most ``BUCKET`` sets are compared by brute force there (on sketches of 64 minhashes).
First all sets take the first step of ``RUNS`` runs: at the least similarity a pair meets in one with probability 1 - 1/e at
least, in ten with 0.99995. A larger node is dealt to blocks, each compared within itself and with some ``LEADERS`` sets of the
node, so that near copies hang together by then. A node that is all in one component is done. If no more than ``BUCKET`` sets
lie aside of its main component, these are compared with all of the node, and the rows grow with the node, not its square. Sets
of nodes that are still open go through further runs among themselves, whose open nodes are split again, down to ``DEPTH``
shingles, beyond which a node is compared in pairs of blocks. A pair that met in open nodes only is in them with both sets, and
the number of runs follows from the size of the sets (``deep_runs``), so that it meets on the last level with a probability of
``TARGET``: 33 runs at a size of 5, 22 at a large one. Pairs are thus found with 0.9999 on any level.

What was found alike makes candidate components; all pairs within one are verified exactly, in pairs of blocks of bounded
weight, so every link is true, and links within a component cannot be missed. A component of one block sends its sets once. In a
larger one a set goes to each pair of its block, and what is sent is its symmetric difference from the set of one member, the
reference: two differences differ just where the sets do, so the sizes and the differences give the similarity of the sets, and
near copies send the few shingles in which they differ. Tasks return a number of links and one edge for each set, not pairs.

Texts without a word (null too) link with nothing. Null ids: a row like any other; as the smallest id of a class it is null.
Repeated rows are documents with equal sets. Ties (several rows of one id): the smaller text hash comes first. Of the input
only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.embeddings import _links, local_roots
from lakeaudit.llm.graph import components
from lakeaudit.llm.text import GOLD, WORD, WordHash, durable, mix, once, shingle_hashes, slices, strings, whole_groups

SHINGLE = 5
LEAST = 0.8
RUNS = 10
DEPTH = 3
#: Sets of more shingles take the runs of one of so many; the number no longer changes there.
MANY = 1000
#: The least probability that a pair of the least similarity meets in the further runs.
TARGET = 0.99995
BUCKET = 1000
#: So many sets of a large bucket, about, are compared with all others of it at first.
LEADERS = 32
SKETCH = 64
#: Sketch entries that must agree: at a similarity of 0.8 fewer do with a probability under 1e-4.
AGREE = 37
BLOCK_SHINGLES = 1_000_000
BLOCK_SETS = 256
COLUMNS = 4096
#: Bits of the bitmap of members: so many for each, at most so many, and as they lie in the rows of ``bitmap_construct_agg``.
MARKS = 16
MOST_MARKS = 1 << 28
PIECE = 32_768

_odd = np.random.default_rng(20240229).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_salts(first: int, runs: int) -> np.ndarray:
    return mix(np.arange(first, first + runs, dtype=np.uint64) * GOLD)


def meeting(common: int, size: int, least: float, depth: int = DEPTH) -> float:
    """The probability that two sets, the larger of ``size``, with so many common shingles meet on level ``depth`` of a run."""
    p, q = min(1.0, 1 / (least * size)), 1.0
    for used in reversed(range(depth)):
        q = 1 - (1 - p * q) ** max(common - used, 0)
    return q


@functools.cache
def deep_runs(n: int, least: float) -> int:
    """So many runs that a set of n shingles meets each other one of the least similarity with ``TARGET`` on the last level.

    Of two sets the larger has fewer runs or as many, and both share those."""
    runs = 1
    for size in range(n, int(n / least + 1e-9) + 1):
        common = math.ceil(least * size - 1e-9)
        if common < size:  # else only equal sets are alike, and they are one class
            runs = max(runs, math.ceil(math.log(1 - TARGET) / math.log(1 - meeting(common, size, least))))
    return runs


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashes.ids(words), min(SHINGLE, len(words))))


def sketch(s: np.ndarray) -> bytes:
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        out = np.minimum(out, (s[None, a : a + 4096] * _odd[:, None]).min(1))
    return (mix(out) & np.uint64(255)).astype(np.uint8).tobytes()


def chosen(s: np.ndarray, nodes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, shingle) places: the shingles that the set chooses at each node."""
    bound = min((1 << 64) - 1, int((1 << 64) / (least * len(s))))
    at = [np.nonzero(mix(s[None] ^ nodes[i : i + step, None]) <= np.uint64(bound)) for step in [max(1, 2_000_000 // len(s))] for i in range(0, len(nodes), step)]
    step = max(1, 2_000_000 // len(s))
    return np.concatenate([a + i * step for i, (a, _) in enumerate(at)]), np.concatenate([b for _, b in at])


def first_steps(s: np.ndarray, least: float) -> list[int]:
    """The nodes of the first level in the first runs."""
    salts = run_salts(1, RUNS)
    n1, t1 = chosen(s, salts, least)
    return mix(salts[n1] * GOLD + s[t1]).astype(np.int64).tolist()


def paths(s: np.ndarray, least: float = LEAST) -> list[dict]:
    """The set's chosen paths in the further runs as a tree of depth 3: [{p, kids: [{p, kids: [p]}]}]."""
    signed = lambda x: x.astype(np.int64).tolist()
    salts = run_salts(RUNS + 1, deep_runs(min(len(s), MANY), least))
    n1, t1 = chosen(s, salts, least)
    p1 = mix(salts[n1] * GOLD + s[t1])
    tree = [{"p": p, "kids": []} for p in signed(p1)]
    if not len(p1):
        return tree
    n2, t2 = chosen(s, p1, least)
    keep = t2 != t1[n2]
    n2, t2 = n2[keep], t2[keep]
    p2 = mix(p1[n2] * GOLD + s[t2])
    second = [{"p": p, "kids": []} for p in signed(p2)]
    for n, x in zip(n2.tolist(), second, strict=True):
        tree[n]["kids"].append(x)
    if len(p2):
        n3, t3 = chosen(s, p2, least)
        keep = (t3 != t2[n3]) & (t3 != t1[n2[n3]])
        n3, t3 = n3[keep], t3[keep]
        for n, p in zip(n3.tolist(), signed(mix(p2[n3] * GOLD + s[t3])), strict=True):
            second[n]["kids"].append(p)
    return tree


_TREE = pa.list_(pa.struct([("p", pa.int64()), ("kids", pa.list_(pa.struct([("p", pa.int64()), ("kids", pa.list_(pa.int64()))])))]))
_TREE_SQL = "array<struct<p: bigint, kids: array<struct<p: bigint, kids: array<bigint>>>>>"


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """(id, text_hash, n_shingles, rep_id, n_copies, n_links, class_id, kept), a row for each row of docs.

    rep_id is the smallest id with an equal set and n_copies how many rows have it; n_links counts all other rows with a
    similarity of ``least`` or more; class_id is the smallest id that links lead to; kept marks one document of each class
    (id and text_hash are those of the class's first; only identical rows share both).
    """
    if least < LEAST:
        raise ValueError(f"sketches are set for similarities of {LEAST} or more")
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("th"))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            hashes.trim()
            f1, f2, n, sketches, steps = [], [], [], [], []
            for text in strings(batch.column("text")):
                s = shingle_set(text, hashes)
                n.append(len(s))
                f1.append(int(mix(s).sum().astype(np.int64)) if len(s) else 0)
                f2.append(int(mix(s ^ GOLD).sum().astype(np.int64)) if len(s) else 0)
                sketches.append(sketch(s) if len(s) else None)
                steps.append(first_steps(s, least) if len(s) else [])
            cols = [pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(steps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *cols], ["id", "th", "f1", "f2", "n", "sketch", "steps"])

    kind = docs.schema[id_column].dataType.simpleString()
    described = durable(slim.mapInArrow(describe, f"id {kind}, th long, f1 long, f2 long, n long, sketch binary, steps array<bigint>"))
    rows = described.select("id", "th", "f1", "f2", "n")
    first = F.min(F.struct("id", "th")).alias("rep")
    sets = described.where("n > 0").groupBy("f1", "f2", "n").agg(first, F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("steps").alias("steps"))
    classes = durable(sets.withColumn("node", F.monotonically_increasing_id()))

    parts = _candidates(slim, classes, least)
    found = _verified(slim, classes, parts, least)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # A component of one block was settled by the task that held it.
    groups = components(found.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b")))
    groups = groups.unionByName(found.where("whole").select("node", "root"))
    state = classes.select("f1", "f2", "n", "rep", "copies", "node").join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = state.groupBy("root").agg(F.min("rep").alias("class"))
    state = state.join(named, "root").select("f1", "f2", "n", "rep", "copies", "class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(state, ["f1", "f2", "n"], "left")
    alone = F.col("copies").isNull()
    own = F.struct("id", "th")
    return out.select(
        F.col("id").alias(id_column), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("rep.id")).alias("rep_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("class.id")).alias("class_id"),
        (alone | own.eqNullSafe(F.col("class"))).alias("kept"),
    )


def _texts(slim: DataFrame, members: DataFrame) -> DataFrame:
    """members(rep_id, rep_th, ...), which must be written, with the text. Identical rows of a document bring it more than once; whoever reads them takes the first
    in each task (``once``). Few documents are members of anything: ``_marked`` leaves the texts of most others where they are, and the join is exact."""
    return _marked(slim, members).join(members, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th")))


def _marked(rows: DataFrame, members: DataFrame, key: tuple[str, ...] = ("id", "th"), of: tuple[str, ...] = ("rep_id", "rep_th")) -> DataFrame:
    """The rows whose key may be among those of members, by its columns ``of``: the hash of the key is marked in a bitmap with ``MARKS`` bits for each member, in
    pieces of 32,768. At most ``MOST_MARKS`` bits (32 MB), which serve 16 million members; with more of them more rows are let through, and none is missed."""
    n = members.count()
    pieces = max(1, min(MARKS * n, MOST_MARKS) // PIECE)
    place = lambda *key: F.pmod(F.xxhash64(*key), F.lit(pieces * PIECE))
    at = members.select(place(*of).alias("at"))
    marks = durable(at.groupBy(F.expr(f"at div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(at % {PIECE})").alias("marks")))
    bit = F.expr(f"shiftright(cast(conv(hex(substring(marks, cast(at % {PIECE} div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1")
    return rows.withColumn("at", place(*key)).join(F.broadcast(marks), (F.expr(f"at div {PIECE}") == F.col("piece")) & bit, "left_semi").drop("at")


def _trees(slim: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(node, tree) of the further runs for each of members(node, rep_id, rep_th)."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(once(batches, "node")):
            hashes.trim()
            trees = [paths(shingle_set(text, hashes), least) for text in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(trees, _TREE)], ["node", "tree"])

    trees = _texts(slim, durable(members)).select("node", "text").mapInArrow(describe, f"node long, tree {_TREE_SQL}")
    return durable(trees.groupBy("node").agg(F.first("tree").alias("tree")))


def _candidates(slim: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(node, root) of the components of nodes whose sketches agree in some bucket."""
    steps = classes.select("node", F.explode("steps").alias("p"))
    # The sizes are written, so that both sides of the join are shuffles as they are, and a bucket of very many rows is split among
    # tasks at run time.
    sizes = durable(steps.groupBy("p").agg(F.count("*").alias("size")).where("size > 1"))
    # Most steps lead a set to a bucket of its own: these are left where they are.
    level = durable(_marked(steps, sizes, ("p",), ("p",)).join(sizes, "p"))
    known = components(durable(_compared(_sampled(level), classes)))
    large = level.where(F.col("size") > BUCKET).select("node", "p")
    if large.isEmpty():
        return known
    rooted = lambda rows: rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    level, _ = _judged(rooted(large))
    rows = _dealt(level)
    # A pair that met in open buckets only has both its sets in them: these go through the further runs, by themselves.
    again = durable(level.where("open").select("node").distinct())
    if not again.isEmpty():
        trees = _trees(slim, classes.join(again, "node").select("node", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")), least)
        tree = durable(rooted(trees).select("node", "root", F.explode("tree").alias("x")))
        level, opened = _judged(tree.select("node", "root", F.col("x.p").alias("p")))
        rows = rows.unionByName(_dealt(level))
        tree = durable(_kids(tree, opened))
        level, opened = _judged(tree.select("node", "root", F.col("x.p").alias("p")))
        rows = rows.unionByName(_dealt(level))
        level, _ = _judged(durable(_kids(tree, opened).withColumnRenamed("x", "p")))
        # No further split: what is still open is compared in pairs of blocks.
        pairs = level.where("open").withColumn("block", F.pmod(F.xxhash64("node", "p"), F.col("blocks")).cast("int"))
        pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.select("node", F.xxhash64("p", F.least("block", "other"), F.greatest("block", "other")).alias("p"))
        rows = rows.unionByName(_dealt(level)).unionByName(pairs)
    return components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_compared(rows, classes)))


def _sampled(level: DataFrame) -> DataFrame:
    """(node, p) groups to compare of level(node, p, size): a bucket that is not large is one; a large one is dealt to blocks, and some ``LEADERS``
    of its sets go to each, so that near copies hang together through those, whatever blocks they lie in."""
    blocks = F.ceil(F.col("size") / BUCKET).cast("int")
    leads = F.pmod(F.xxhash64(F.lit("lead"), "p", "node"), F.col("size")) < LEADERS
    places = F.when(leads, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "p"), blocks).cast("int")))
    return level.select("node", F.when(F.col("size") <= BUCKET, F.array("p")).otherwise(F.transform(places, lambda b: F.xxhash64("p", b))).alias("ps")).select("node", F.explode("ps").alias("p"))


def _kids(tree: DataFrame, opened: DataFrame) -> DataFrame:
    """(node, root, x), the next steps of tree(node, root, x) from the open buckets. Of opened(p) there is one for ``BUCKET`` rows of a level at most, so it is
    broadcast, and the trees, which are large, stay where they are."""
    return tree.join(F.broadcast(opened), F.col("x.p") == F.col("p"), "left_semi").select("node", "root", F.explode("x.kids").alias("x"))


def _judged(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of level(node, root, p) in buckets of several components, with the number of blocks of the bucket, whether the set lies
    aside of the component that most of the bucket is in, and whether the bucket is open: too many sets lie aside. A bucket of one component has nothing to find.
    Also (p) of the open buckets."""
    of = level.groupBy("p", "root").agg(F.count("*").alias("n")).groupBy("p").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("main"))
    aside = F.col("size") - F.col("main.n")
    sizes = durable(of.where(aside > 0).select("p", F.ceil(F.col("size") / BUCKET).cast("int").alias("blocks"), (aside > BUCKET).alias("open"), F.col("main.root").alias("main")))
    return durable(level.join(sizes, "p").withColumn("aside", F.col("root") != F.col("main")).drop("main")), sizes.where("open").select("p")


def _dealt(level: DataFrame) -> DataFrame:
    """(node, p) groups to compare of the buckets of ``_judged`` that are not open: a set of the main component goes to one block and one that lies
    aside to each, so that all pairs meet but those of the main component, which hang together. At most two rows for each set on average."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    places = F.when(F.col("aside"), every).otherwise(F.array(F.pmod(F.xxhash64("node", "p"), F.col("blocks")).cast("int")))
    return level.where("not open").select("node", "p", F.explode(places).alias("block")).select("node", F.xxhash64("p", "block").alias("p"))


def _compared(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of a group of groups(node, p) whose sketches agree."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "p"):
            keys, node, n = (table.column(c).to_numpy() for c in ("p", "node", "n"))
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            a, b = [], []
            # Small buckets together, by the distance of the rows; large ones in strips.
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            left = size - (np.arange(len(keys)) - np.repeat(cuts[:-1], np.diff(cuts)))
            for k in range(1, 16):
                i = np.flatnonzero((size <= 16) & (left > k))
                if not len(i):
                    break
                i = i[_alike(n[i], n[i + k])]
                i = i[(marks[i] == marks[i + k]).sum(1) >= AGREE]
                a.append(i)
                b.append(i + k)
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end - start <= 16:
                    continue
                for s in range(start, end, 64):
                    x = np.arange(s, min(s + 64, end))
                    hit = np.zeros((len(x), end - s), np.uint8)
                    for c in range(SKETCH):
                        hit += marks[x, c][:, None] == marks[s:end, c][None]
                    i, j = np.nonzero((hit >= AGREE) & _alike(n[x][:, None], n[s:end][None]))
                    i, j = i[i < j], j[i < j]
                    a.append(x[i])
                    b.append(s + j)
            if a and sum(map(len, a)):
                i, j = np.concatenate(a), np.concatenate(b)
                root = local_roots(i, j, len(keys))
                at = np.flatnonzero(root != np.arange(len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[root[at]])], ["a", "b"])

    rows = groups.join(classes.select("node", "n", "sketch"), "node")
    # In the order of nodes, so that the edges are stars around the least one.
    return rows.repartition("p").sortWithinPartitions("p", "node").mapInArrow(compare, "a long, b long")


def _alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the sizes leave room for the least similarity."""
    return np.minimum(n, m) >= LEAST * np.maximum(n, m) - 1e-9


def _verified(slim: DataFrame, classes: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """(node, links, root, whole) for each node with links, from each pair of blocks of each candidate component; root is the
    least node it hangs together with in the pair, and whole tells that the component has one block."""
    members = parts.join(classes.select("node", "rep", "copies", "n"), "node")
    weights = durable(members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks")))
    # One row for each component of several blocks. Both tables are written: Spark broadcasts them while their files are small.
    leaders = durable(weights.where("blocks > 1").join(classes, F.col("root") == F.col("node")).select("node", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")))
    references = _references(slim, leaders)
    members = durable(members.join(weights, "root").select("node", "root", "copies", "n", "blocks", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th")))
    # No reference has a negative key: sets of components of one block find none, and are dealt out by themselves.
    key = F.when(F.col("blocks") > 1, F.col("root")).otherwise(-1 - F.col("node")).alias("key")
    texts = _texts(slim, members).select("node", "root", "copies", "n", "blocks", "text", key).join(references, "key", "left")

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(once(batches, "node")):
            hashes.trim()
            got = [difference(shingle_set(t, hashes), r).tobytes() for t, r in zip(strings(batch.column("text")), batch.column("reference").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "copies", "n", "blocks")), pa.array(got, pa.binary())], ["node", "root", "copies", "n", "blocks", "set"])

    sets = texts.select("node", "root", "copies", "n", "blocks", "text", "reference").mapInArrow(to_sets, "node long, root long, copies long, n long, blocks int, set binary")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    sets = sets.withColumn("grp", F.xxhash64("root", "b1", "b2")).select("grp", "block", "b1", "b2", "blocks", "node", "copies", "n", "set")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp"):
            keys, node, copies, n, block, b1, b2, blocks = (table.column(c).to_numpy() for c in ("grp", "node", "copies", "n", "block", "b1", "b2", "blocks"))
            raw = table.column("set")
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                # Identical rows of a document bring its set once from each task that has some.
                at = a + np.sort(np.unique(node[a:b], return_index=True)[1])
                members = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in at]
                same = b1[a] == b2[a]
                left = np.arange(len(at)) if same else np.flatnonzero(block[at] == b1[a])
                right = left if same else np.flatnonzero(block[at] == b2[a])
                i, j = similar_pairs(members, left, right, least, n[at])
                if len(i):
                    rows = _links(i, j, 0, len(at), node[at], copies[at])
                    yield rows.append_column("whole", pa.array([bool(blocks[a] == 1)] * rows.num_rows))

    return durable(sets.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(verify, "node long, links long, root long, whole boolean"))


def _references(slim: DataFrame, leaders: DataFrame) -> DataFrame:
    """(key, reference) for each of leaders(node, rep_id, rep_th): the node and its set."""

    def to_set(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(once(batches, "node")):
            hashes.trim()
            got = [shingle_set(t, hashes).tobytes() for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(got, pa.binary())], ["key", "reference"])

    found = _texts(slim, leaders).select("node", "text").mapInArrow(to_set, "key long, reference binary")
    return durable(found.groupBy("key").agg(F.first("reference").alias("reference")))


def difference(s: np.ndarray, reference: bytes | None) -> np.ndarray:
    """What is in one of the two sets only; without a reference the set itself."""
    return s if reference is None else np.setxor1d(s, np.frombuffer(reference, np.uint64), assume_unique=True)


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (of left with right; each once if both are one list) whose exact Jaccard similarity is ``least`` or more.

    Where ``sizes`` is given, ``sets`` holds the symmetric differences of sets of these sizes from one reference, whichever it is."""
    none = np.empty(0, np.int64)
    if not len(left) or not len(right) or len(sets) < 2:
        return none, none
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(token, minlength=len(tokens))
    column = np.cumsum(often > 1) - 1
    use = often[token] > 1
    owner, token = owner[use], column[token[use]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    both = np.zeros((len(left), len(right)), np.float32)
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    width = int(token[-1]) + 1 if len(token) else 0
    for a in range(0, width, COLUMNS):
        s, e = np.searchsorted(token, [a, a + COLUMNS])
        o, t = owner[s:e], token[s:e] - a
        grids = []
        for side, rows in ((0, len(left)), (1, len(right))):
            grid = np.zeros((rows, min(COLUMNS, width - a)), np.float32)
            mine = place[side, o] >= 0
            grid[place[side, o[mine]], t[mine]] = 1
            grids.append(grid)
            if left is right:
                grids.append(grid)
                break
        both += grids[0] @ grids[1].T
    total = size if sizes is None else sizes
    # In so many shingles two sets differ, and all the rest of both is common.
    apart = size[left][:, None] + size[right][None] - 2 * both.astype(np.int64)
    common = (total[left][:, None] + total[right][None] - apart) // 2
    i, j = np.nonzero(common / np.maximum(common + apart, 1) >= least)
    if left is right:
        i, j = i[i < j], j[i < j]
    return left[i], right[j]
