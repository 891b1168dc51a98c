"""Operator 6: secret scan, in DataFrame functions only.

Patterns find assignments, access keys and hexadecimal keys. Besides, what stands between assignments is searched for tokens of
``TOKEN_CHARS`` or more characters, and those that hold no access or hexadecimal key are scored by two character Markov models
(first order, over lower-cased letters, digits and one class for the rest): one of random strings and one of ordinary
identifiers. If the log-likelihood ratio speaks for a random string, the token is a span of kind ``markov``. Both models are
trained from labelled samples: random strings are the values that the patterns find in about ``RANDOM_DOCUMENTS`` documents,
ordinary identifiers the other tokens of about ``PLAIN_DOCUMENTS`` documents, chosen by a hash of the text (the documented bound
of the classifier). Every text is scanned whole. The work on a text grows with its length and, for placing n spans, with n**1.5:
running sums go by stretches of ``STRETCH``.

Positions are code points, ends exclusive. Null text: empty, no spans. Without values or identifiers to learn from there are
no markov spans. Repeated rows give repeated rows. Of the input only the id columns and the text are read for a scan;
``redact`` keeps all columns; the names it needs meanwhile are ones that the input lacks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs are matched whole, so a least length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
LEAST_VALUE = 6
TOKEN_CHARS = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"
#: An assignment, or a token that ends where an assignment begins; the possessive run needs no stack, however long it is.
ASSIGN_OR_TOKEN = rf"{ASSIGN}|(?=[A-Za-z0-9+/_=-]{{{TOKEN_CHARS}}})(?:(?!{ASSIGN})[A-Za-z0-9+/_=-]){{{TOKEN_CHARS},}}+"
PLAIN_TOKEN = r"[A-Za-z0-9+/_=-]{6,}"
STRETCH = 256

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
CLASSES = len(ALPHABET) + 1
RANDOM_DOCUMENTS = 40_000
PLAIN_DOCUMENTS = 3_000
#: The random model is half what the sample shows and half uniform, as random strings come in many alphabets.
UNIFORM_SHARE = 0.5
#: So is a tenth of the ordinary one: a pair that the sample lacks is no proof by itself.
PLAIN_UNIFORM_SHARE = 0.1
LEAST_RATIO = 12.0
LEAST_RATIO_PER_CHAR = 0.6


SPANS = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs begins with, in either case of its letters."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = f"_{name}"
    return name


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value found once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """For each of the values (an array of int that has one) what the values before it come to, from 0. Appending copies an array, so
    that is done within stretches, and for the stretches as a whole."""
    grow = lambda acc, x: F.array_append(acc, joined(F.element_at(acc, -1), x))
    within = lambda v: F.transform(_stretches(v), lambda part: F.aggregate(part, F.array(F.lit(0)), grow))

    def moved(inner: Column) -> Column:
        ahead = F.aggregate(inner, F.array(F.lit(0)), lambda acc, part: grow(acc, F.element_at(part, -1)))
        return F.flatten(F.zip_with(inner, F.slice(ahead, 1, F.size(inner)), lambda part, off: F.transform(F.slice(part, 1, F.size(part) - 1), lambda x: joined(off, x))))

    return _with(_with(values, within), moved)


def _stretches(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(items), F.lit(STRETCH)), lambda a: F.slice(items, a, STRETCH))


def _located(text: str, found: str, pattern: str, kind: Column | str, order: int) -> Column:
    """The matches in ``found`` (all matches of the pattern in the column text, in order) as structs with their places: what
    stands between matches tells how far apart they are."""
    name = F.lit(kind)
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), F.col(found), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    before = lambda p: _running(F.transform(p, lambda x: x["gap"] + F.length(x["hit"])), lambda a, b: a + b)

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), name.alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value"))

    return F.when(F.size(found) > 0, _with(pairs, lambda p: F.zip_with(p, before(p), span))).otherwise(_empty())


def _sampled(docs: DataFrame, text: str, most: int, total: int, salt: str) -> DataFrame:
    share = min(1.0, most / max(total, 1))
    return docs.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text, F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))).select(F.col(text).alias("t"))


def train(docs: DataFrame, text_column: str = "text", random_documents: int = RANDOM_DOCUMENTS, plain_documents: int = PLAIN_DOCUMENTS) -> list[float] | None:
    """Log-likelihood ratios (random over ordinary) of the CLASSES x CLASSES character pairs, or None if a sample is empty.

    The pairs are counted by Spark; at most CLASSES**2 numbers of either kind reach the driver.
    """
    total = docs.count()
    values = [F.filter(F.regexp_extract_all(F.col("t"), F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_VALUE)]
    values += [F.regexp_extract_all(F.col("t"), F.lit(p), F.lit(0)) for p in (ACCESS, HEX)]
    random = _sampled(docs, text_column, random_documents, total, "random").select(F.explode(F.concat(*values)).alias("token"), F.lit(1).alias("random"))
    bare = F.col("t")
    for _, p in KINDS:
        bare = F.regexp_replace(bare, p, " ")
    plain = _sampled(docs, text_column, plain_documents, total, "plain").select(F.explode(F.regexp_extract_all(bare, F.lit(PLAIN_TOKEN), F.lit(0))).alias("token"), F.lit(0).alias("random"))
    tokens = random.unionByName(plain).select(F.lower("token").alias("token"), "random")
    pairs = tokens.selectExpr("random", "explode(transform(sequence(1, greatest(length(token) - 1, 1)), i -> substring(token, i, 2))) pair")
    coded = pairs.where("length(pair) = 2").select("random", _code(F.substring("pair", 1, 1)).alias("a"), _code(F.substring("pair", 2, 1)).alias("b"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in coded.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    if len({k[0] for k in counts}) < 2:
        return None
    table = []
    for a in range(CLASSES):
        from_random = sum(counts.get((1, a, b), 0) for b in range(CLASSES))
        from_plain = sum(counts.get((0, a, b), 0) for b in range(CLASSES))
        for b in range(CLASSES):
            seen = (counts.get((1, a, b), 0) + 1 / CLASSES) / (from_random + 1)
            p = (1 - UNIFORM_SHARE) * seen + UNIFORM_SHARE / CLASSES
            q = (1 - PLAIN_UNIFORM_SHARE) * (counts.get((0, a, b), 0) + 1 / CLASSES) / (from_plain + 1) + PLAIN_UNIFORM_SHARE / CLASSES
            # What joins the parts of an identifier speaks for neither.
            table.append(math.log(p / q) if a and b else 0.0)
    return table


def _code(char: Column) -> Column:
    return F.call_function("locate", char, F.lit(ALPHABET))


def _ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token."""
    # Literals alone make one constant, so that a pair is looked up and not parsed.
    weights = F.array(*(F.lit(round(x, 6)) for x in table))
    codes = F.transform(F.split(F.lower(token), ""), _code)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        add = F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(weights, acc["last"] * CLASSES + code + 1))
        return F.struct(code.alias("last"), (acc["sum"] + add).alias("sum"))

    return F.aggregate(codes, start, step)["sum"]


def find_secrets(docs: DataFrame, table: list[float] | None, text_column: str = "text", output: str = "secrets") -> DataFrame:
    """docs with a column ``output``: struct<base, added>, arrays of struct<start, ord, kind, end, value> in order of start
    and kind; ``added`` are the markov spans. A column of that name is replaced."""
    own = _free(docs, f"__{output}")
    text = f"{own}_text"
    patterns = {"assign": ASSIGN_OR_TOKEN if table else ASSIGN, "access": ACCESS, "hex": HEX}
    found = {kind: f"{own}_{kind}" for kind in patterns}
    df = docs.withColumn(text, F.coalesce(F.col(text_column), F.lit("")))
    df = df.withColumns({found[kind]: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for kind, p in patterns.items()})
    mixed, base, added = f"{own}_mixed", f"{own}_base", f"{own}_added"
    df = df.withColumn(mixed, _located(text, found["assign"], patterns["assign"], "assign", 0))
    value = lambda s: F.regexp_extract(s["value"], f"^{ASSIGN}", 1)
    assigned = F.filter(mixed, lambda s: F.length(value(s)) >= LEAST_VALUE)
    spans = [assigned, *(_located(text, found[kind], patterns[kind], kind, i) for i, kind in ((1, "access"), (2, "hex")))]
    df = df.withColumn(base, F.array_sort(F.concat(*spans)))
    if table is None:
        df = df.withColumn(added, _empty())
    else:
        random = lambda t: _ratio(t, table) >= F.greatest(F.lit(LEAST_RATIO), F.length(t) * LEAST_RATIO_PER_CHAR)
        bare = lambda s: (F.length(value(s)) == 0) & ~s["value"].rlike(f"{ACCESS}|{HEX}")
        tokens = F.filter(mixed, lambda s: F.when(bare(s), random(s["value"])).otherwise(F.lit(False)))
        as_markov = lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), F.lit("markov").alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
        df = df.withColumn(added, F.when(F.size(mixed) > 0, F.transform(tokens, as_markov)).otherwise(_empty()))
    return df.withColumn(output, F.struct(F.col(base).alias("base"), F.col(added).alias("added"))).drop(text, mixed, base, added, *found.values())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, table: list[float] | None, text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, every secret in the text replaced by the mask; spans that overlap become one mask. Null text stays null."""
    found, places = _free(docs, "__secrets"), _free(docs, "__places")
    df = find_secrets(docs, table, text_column, found)
    spans = F.array_sort(F.transform(F.concat(F.col(f"{found}.base"), F.col(f"{found}.added")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    text, each = F.col(text_column), F.col(places)
    # What is masked up to each span; a span that begins before that belongs to the mask before it.
    done = _running(F.transform(each, lambda s: s["end"]), F.greatest)
    cuts = F.filter(F.zip_with(each, done, lambda s, d: F.struct(d.alias("a"), s["start"].alias("b"))), lambda c: c["b"] >= c["a"])
    # A piece is cut from a stretch of the text, so that no piece is looked for from the start of a long text.

    def piece(part: Column) -> Column:
        low = F.element_at(part, 1)["a"]
        some = F.struct(low.alias("low"), text.substr(low + 1, F.element_at(part, -1)["b"] - low).alias("some"))
        return _with(some, lambda x: F.array_join(F.transform(part, lambda c: F.concat(x["some"].substr(c["a"] - x["low"] + 1, c["b"] - c["a"]), F.lit(mask))), ""))

    end = F.array_max(F.transform(each, lambda s: s["end"]))
    whole = F.concat(_with(cuts, lambda every: F.array_join(F.transform(_stretches(every), piece), "")), text.substr(end + 1, F.length(text) - end))
    df = df.withColumn(places, spans).withColumn(text_column, F.when(F.size(places) > 0, whole).otherwise(text))
    return df.select(*docs.columns)
