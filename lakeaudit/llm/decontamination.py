"""Operator 12: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item is the set of its windows of ``window`` consecutive words (one window if it has fewer), a window the set of its shingles
of ``SHINGLE`` words. A text that contains a window contains all of its shingles: at a containment of 1 the necessary prefix of
a set is its one first shingle, whichever way shingles are ordered. They are ordered by rarity, counted over all texts, so the
prefix is the rarest; a window with a shingle that no text has is out. Every place of every text is looked up among the prefixes;
the place of the shingle in the window says where the window would begin, which must lie within the text (positional bound) with
room for all its words (length bound); then the words there are compared with the window's, as words and not as hashes.

Two passes over the texts, neither of which shuffles them: one counts the shingles that items have, one joins. The shingles and
windows of the items are broadcast up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes; beyond that the counts come from
a shuffled join, and the windows are taken in blocks of that size, one pass each. What is shuffled is one row for each text,
with what was found in it. Equal items are one class and equal windows one window, and which items belong to a set of windows is
found once for each set that occurs, not for each text.

Null and empty texts have no words and are not contaminated. Items without words have no windows; items with a null id hit words,
but are neither counted nor listed. Repeated items count once for each different id. Rows of one id and text are found once and
given as often as they come. A text may be of any length. Of the inputs only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import durable

#: Fixed value: the words of a text.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased: all of a word's letters are that if it has no others than ASCII."""
    plain = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_WORDS), F.lit(0)), lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def _shingle(at: Column, k: Column | int) -> Column:
    """The hash of the k words of the column ``words`` from place ``at`` (from 1) on; k is ``SHINGLE`` at most."""
    word = [F.get("words", at + (j - 1)) for j in range(SHINGLE)]
    return F.xxhash64(*(word[:k] if isinstance(k, int) else [F.when(k > j, w) for j, w in enumerate(word)]))


def _places(docs: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """(keys, words, n_words, at, h): for each text the place 0, and each of its places with the shingle of each size there."""
    rows = docs.withColumn("n_words", F.size("words")).select(*keys, "words", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("at"))
    if len(sizes) == 1:
        return rows.withColumn("h", _shingle(F.col("at"), sizes[0]))
    return rows.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).withColumn("h", _shingle(F.col("at"), F.col("k")))


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start int, end int>>), a
    row for each row of docs. spans are the places of all windows found, in words from 1, ends inclusive."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), "text").alias("h2"), words(F.col("text")).alias("words"))
    given = durable(items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")).where("size(words) > 0"))
    classes = durable(given.select("words").distinct().withColumn("cls", F.monotonically_increasing_id()))
    members = given.join(classes, "words").where("item is not null").select("cls", "item").distinct()

    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))), lambda i: F.slice("words", i, window))
    pieces = classes.select("cls", F.explode(cut).alias("words"))
    windows = durable(pieces.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    pairs = durable(pieces.join(windows, "words").select("cls", "win").distinct())

    found = _joined(texts, windows)
    return _counted(found, pairs, members).withColumnRenamed("id", id_column)


def _joined(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, n_words, copies, spans, wins) of each different text of each partition: how often it comes, where windows occur and which.
    The partition is part of the key so that a row of very many copies is spread as the input is."""
    keys = ["id", "h1", "h2"]
    k = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(r["k"] for r in windows.select(k.alias("k")).distinct().collect()) or [SHINGLE]  # SHINGLE rows at most
    places = windows.withColumn("k", k).select("win", "words", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
    places = durable(places.select("win", "at", _shingle(F.col("at"), F.col("k")).alias("h")))
    known = durable(places.select("h").distinct())
    hint = F.broadcast if known.count() <= BROADCAST_ROWS else (lambda df: df)
    everywhere = _places(texts, keys, sizes)
    counts = durable(everywhere.where("at > 0").select("h").join(hint(known), "h").groupBy("h").agg(F.count("*").alias("n")))
    # The rarest shingle of each window; of those as rare, the one of least hash, then the first.
    ordered = places.join(counts, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("prefix")).where("prefix.n > 0")
    prefixes = durable(ordered.join(windows, "win").select("win", F.col("prefix.h").alias("ph"), F.col("prefix.at").alias("off"), F.col("words").alias("win_words"), F.size("words").alias("len")))
    size = prefixes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("win_words", " "))), F.lit(0)).alias("b")).first()
    blocks = max(1, math.ceil(size["n"] / BROADCAST_ROWS), math.ceil(size["b"] / BROADCAST_BYTES))

    start = F.col("at") - F.col("off") + 1
    fits = (F.col("at") > 0) & (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
    same = F.slice("words", F.greatest(start, F.lit(1)), F.col("len")) == F.col("win_words")
    span = F.when(F.col("win").isNotNull(), F.struct(start.alias("start"), (start + F.col("len") - 1).alias("end")))
    parts = []
    for i in range(blocks):
        some = prefixes.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == i) if blocks > 1 else prefixes
        hits = everywhere.join(F.broadcast(some), (F.col("h") == F.col("ph")) & fits & same, "left").where("at = 0 or win is not null")
        # Rows of a text lie together, so that each task sends one for a text; the copies are counted in one pass, for one size of shingle.
        first = (F.col("at") == 0) & (F.lit(i == 0)) & (F.col("k") == sizes[0] if len(sizes) > 1 else F.lit(True))
        part = hits.groupBy(*keys, F.spark_partition_id().alias("part")).agg(F.max("n_words").alias("n_words"), F.count_if(first).alias("copies"), F.collect_set(span).alias("spans"), F.collect_set("win").alias("wins"))
        parts.append(durable(part))
    if blocks == 1:
        return parts[0]
    # What the blocks found comes together by text; how often a text comes in each partition, from the first of them.
    every, key = parts[0], F.struct(*keys).alias("key")
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    every = durable(every.groupBy(key).agg(merged("spans"), merged("wins")))
    return parts[0].select(key, "id", "n_words", "copies").join(every, "key")


def _counted(found: DataFrame, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each text as often as it comes, with the numbers of hit words and of items."""
    found = found.withColumns({"wins": F.array_sort("wins"), "spans": F.array_sort("spans")})
    sets = durable(found.where("size(wins) > 0").select("wins").distinct().withColumn("sid", F.monotonically_increasing_id()))
    own = sets.select("sid", F.explode("wins").alias("win")).join(pairs, "win").select("sid", "cls").distinct()
    own = own.join(members, "cls").select("sid", "item").distinct()
    # The ids of a set come together, as the digest is one of all of them.
    digests = own.groupBy("sid").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    sets = durable(sets.join(digests, "sid", "left").select("wins", "n_items", "items_sha256"))
    out = found.join(sets, "wins", "left")
    # How far the words before a span reach is carried along, so that a word in several windows counts once.
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"] - 1, acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    n_hit = F.aggregate("spans", zero, step)["n"].cast("long").alias("n_hit")
    out = out.select(
        "id", F.col("n_words").cast("long").alias("n_words"), n_hit, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))),
    )
    return out.drop("col")
