"""Operator 3: quality rules, by labelling the lines of a text with a linear-chain conditional random field.

Each line gets a set of binary features (shape, symbols, case, repetition). A linear-chain CRF with the labels content and
boilerplate is decoded by Viterbi; the share of a text's word characters that stand in content lines decides whether it is
kept. The CRF is trained from labelled documents. At most about ``train_documents`` of either quality are taken, chosen by a
hash of their id (the bound of the sample; they are read whole, as are the texts in prediction); every ``HELD_OUT``-th label is
left for measuring. A line is labelled by the documents that hold it: boilerplate if a larger share of the bad ones of the sample
has it than of the good ones, content if a smaller one, and by its own document where both are equal. So labels change within a
text; besides, every good document is also shown with a bad one set within it. Without labelled documents of both kinds there
is no CRF, and the base rules alone decide.

Null text: no words, so ``base_failed``. Lines are cut at ``\\n``; a line without a word takes no part in labelling.
Repeated rows give repeated rows; ties of the Viterbi paths and a share of exactly the threshold go to content. Of the
input only the id and text columns are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import WORD, WordHash, shingle_hashes, slices, strings

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
TRAIN_DOCUMENTS = 1000
#: Labels of documents whose hash has this divisor train nothing.
HELD_OUT = 5
#: Longer label sequences are cut for training; every piece is used.
PIECE = 256
CONTENT_SHARE = 0.5

FEATURES = (
    "bias", "one or two words", "three to nine words", "ten words or more", "ends a sentence", "a symbol in 20 characters", "a symbol in 8 characters", "a pipe",
    "mostly upper case", "exclamation marks", "digits in 10 %", "a third of the words repeat", "two thirds of the words repeat", "the line was seen before", "short words", "long words",
)


def line_features(line: str, words: list[str], before: bool) -> int:
    """The features of a line with a word, as a bit mask in the order of FEATURES."""
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(line.count, SYMBOLS))
    upper, lower = 0, 0
    if not line.islower():
        upper = sum(map(str.isupper, words))
        lower = n - upper
    distinct = len(set(words))
    flags = (
        True, n <= 2, 3 <= n < 10, n >= 10, words[-1][-1] in ".!?:;\"'", symbols * 20 >= chars, symbols * 8 >= chars, "|" in line,
        upper > lower, line.count("!") * 4 >= n and "!" in line, any(map(str.isdigit, line)) and sum(map(str.isdigit, line)) * 10 >= chars, (n - distinct) * 3 >= n and n >= 6, (n - distinct) * 3 >= 2 * n and n >= 6, before, chars < 3 * n, chars > 12 * n,
    )
    return sum(1 << i for i, x in enumerate(flags) if x)


@dataclass(frozen=True)
class LineModel:
    """Weights of a linear-chain CRF over 0 (content) and 1 (boilerplate): a row of emissions a feature, and transitions."""

    emissions: tuple[tuple[float, float], ...]
    transitions: tuple[tuple[float, float], tuple[float, float]]

    def label(self, masks: list[int]) -> list[int]:
        """The Viterbi path."""
        scores = self.scores(masks)
        (aa, ab), (ba, bb) = self.transitions
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
        path = [0 if a >= b else 1]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def scores(self, masks: list[int]) -> list[tuple[float, float]]:
        """The emissions of each line; texts have few distinct masks."""
        known, out = self._known, []
        for m in masks:
            if (found := known.get(m)) is None:
                found = known[m] = tuple(sum(w[y] for i, w in enumerate(self.emissions) if m >> i & 1) for y in (0, 1))
            out.append(found)
        return out

    @cached_property
    def _known(self) -> dict[int, tuple[float, float]]:
        return {}


class Sequences:
    """Weighted label sequences, laid out by place: all first lines, then all second ones, the longest sequences first."""

    def __init__(self, given: list[tuple[tuple[int, ...], tuple[int, ...], float]]) -> None:
        given = sorted(given, key=lambda x: (-len(x[0]), x))
        length = np.array([len(m) for m, _, _ in given])
        self.active = [int((length > j).sum()) for j in range(int(length[0]))]
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        row = np.concatenate([np.arange(n) for n in self.active])
        masks = np.array([given[i][0][j] for j, n in enumerate(self.active) for i in range(n)])
        self.gold = np.array([given[i][1][j] for j, n in enumerate(self.active) for i in range(n)])
        kinds, self.kind = np.unique(masks, return_inverse=True)
        self.x = ((kinds[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)
        self.row, self.weight = row, np.array([w for _, _, w in given])[row]
        self.after = np.arange(self.active[0], len(row))  # every line but the first of a sequence
        self.before = self.start[:-1][np.repeat(np.arange(len(self.active)), self.active)[self.after] - 1] + row[self.after]
        self.last = self.start[length - 1] + np.arange(len(length))

    def slope(self, w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted log-likelihood of the labels given the lines, and its gradient by emissions and transitions."""
        e = (self.x @ w)[self.kind]
        alpha, beta = e.copy(), np.zeros_like(e)
        for j in range(1, len(self.active)):
            n = self.active[j]
            here, back = slice(self.start[j], self.start[j] + n), slice(self.start[j - 1], self.start[j - 1] + n)
            alpha[here] += np.logaddexp(alpha[back, :1] + t[0], alpha[back, 1:] + t[1])
        for j in range(len(self.active) - 1, 0, -1):
            n = self.active[j]
            here, back = slice(self.start[j], self.start[j] + n), slice(self.start[j - 1], self.start[j - 1] + n)
            ahead = e[here] + beta[here]
            beta[back] = np.logaddexp(t[:, 0] + ahead[:, :1], t[:, 1] + ahead[:, 1:])
        z = np.logaddexp(alpha[self.last, 0], alpha[self.last, 1])
        at = np.arange(len(e))
        p = np.exp(alpha + beta - z[self.row][:, None])
        value = float((self.weight * e[at, self.gold]).sum() - (self.weight[: self.active[0]] * z).sum())
        rest = -p * self.weight[:, None]
        rest[at, self.gold] += self.weight
        by_kind = np.stack([np.bincount(self.kind, rest[:, y], len(self.x)) for y in (0, 1)], 1)
        by_pair = np.zeros((2, 2))
        b, a, weight = self.before, self.after, self.weight[self.after]
        for x in (0, 1):
            for y in (0, 1):
                true = (self.gold[b] == x) & (self.gold[a] == y)
                joint = np.exp(alpha[b, x] + t[x, y] + e[a, y] + beta[a, y] - z[self.row[a]])
                by_pair[x, y] = (weight * (true - joint)).sum()
                value += float((weight * true).sum() * t[x, y])
        return value, self.x.T @ by_kind, by_pair


def fit(sequences: list[tuple[list[int], list[int], float]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    """Maximum conditional likelihood of weighted (features, labels) sequences, by Adam on the exact gradient (forward-backward)."""
    total: Counter = Counter()
    for masks, labels, weight in sequences:
        for a in range(0, len(masks), PIECE):
            total[tuple(masks[a : a + PIECE]), tuple(labels[a : a + PIECE])] += weight
    laid = Sequences([(m, y, w) for (m, y), w in total.items()])
    every = sum(total.values())
    w, t = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    moments = [np.zeros(w.size + 4), np.zeros(w.size + 4)]
    for step in range(1, rounds + 1):
        _, by_w, by_t = laid.slope(w, t)
        slope = np.concatenate([(by_w / every - decay * w).ravel(), (by_t / every - decay * t).ravel()])
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w += move[: w.size].reshape(w.shape)
        t += move[w.size :].reshape(2, 2)
    return LineModel(tuple(map(tuple, w.tolist())), tuple(map(tuple, t.tolist())))


def line_labels(lines: list[np.ndarray], quality: list[int]) -> list[list[int]]:
    """For each document (hashes of its lines, quality 1 or 0) the labels of its lines, by the documents that hold each line."""
    kinds, kind = np.unique(np.concatenate(lines), return_inverse=True)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    once = np.unique(np.stack([kind, owner]), axis=1)
    good = np.array(quality) == 1
    shares = [np.bincount(once[0, side[once[1]]], minlength=len(kinds)) / max(1, side.sum()) for side in (good, ~good)]
    label = np.where(shares[0] > shares[1], 0, np.where(shares[0] < shares[1], 1, -1))[kind]
    label = np.where(label < 0, np.where(good[owner], 0, 1), label)
    return [x.tolist() for x in np.split(label, np.cumsum([len(x) for x in lines])[:-1])]


def examples(masks: list[list[int]], labels: list[list[int]], quality: list[int]) -> list[tuple[list[int], list[int], float]]:
    """Training sequences with weights: the documents, either quality weighing the same in all, and each good one with a bad one within."""
    good, bad = ([i for i, q in enumerate(quality) if q == side] for side in (1, 0))
    out = [(masks[i], labels[i], 1 / len(side)) for side in (good, bad) for i in side]
    for n, i in enumerate(good):
        j, half = bad[n % len(bad)], (len(masks[i]) + 1) // 2
        out.append(tuple(x[i][:half] + x[j] + x[i][half:] for x in (masks, labels)) + (1 / len(good),))
    return out


def text_lines(text: str) -> tuple[list[int], list[int], int]:
    """Features and word characters of the lines with a word, and how many of them equal an earlier line."""
    masks, weights, seen, repeats = [], [], set(), 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        before = line in seen
        repeats += before
        seen.add(line)
        masks.append(line_features(line, words, before))
        weights.append(sum(map(len, words)))
    return masks, weights, repeats


def held_out() -> Column:
    """Whether the label of a doc_id is left for measuring."""
    return F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0


def train(docs: DataFrame, labels: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> LineModel | None:
    """The CRF from docs(doc_id, text) and labels(doc_id, quality 0 or 1); None where a kind is missing.

    A document is taken if its label is not held out and a hash of its id is below the share that makes ``train_documents`` of its
    kind expected, and never more than three times that number in all. What reaches the driver is bounded by that: two integers for
    each line of those documents.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).select("doc_id", "quality").distinct()
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("quality") == 0, F.lit(train_documents / sizes[0])).otherwise(F.lit(train_documents / sizes[1]))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # The limit bounds what is broadcast, however the ids hash; the texts stay where they are.
    taken = known.where(place < share).orderBy(place, "doc_id", "quality").limit(3 * train_documents)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks, lines = [], []
            for t in strings(batch.column("text")):
                masks.append(text_lines(t)[0])
                lines.append([xxhash.xxh64_intdigest(x.strip()) - (1 << 63) for x in t.split("\n") if WORD.search(x)])
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(masks, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.int64()))], ["quality", "masks", "lines"])

    pool = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(taken), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    rows = pool.mapInArrow(features, "quality int, masks array<long>, lines array<long>").toArrow().to_pylist()
    rows = sorted((r["quality"], r["masks"], r["lines"]) for r in rows if r["masks"])
    quality = [q for q, _, _ in rows]
    if len(set(quality)) < 2:
        return None
    masks = [m for _, m, _ in rows]
    return fit(examples(masks, line_labels([np.array(x) for _, _, x in rows], quality), quality))


def quality_rules(docs: DataFrame, model: LineModel | None, content_share: float = CONTENT_SHARE, id_columns: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """For each row: the id columns (any columns that are to go along), the text if ``keep_text``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), content_share (double, null without words or model), n_lines and n_boilerplate_lines (long)."""
    keys = [f"k{i}" for i in range(len(id_columns))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_boilerplate_lines"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in slices(batches):
            hashes.trim()
            rows = [judge_text(t, model, content_share, hashes) for t in strings(batch.column("text"))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            along = ["text"] if keep_text else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, *along]), *columns], [*keys, *along, *names])

    slim = docs.select(*(F.col(c).alias(k) for c, k in zip(id_columns, keys, strict=True)), "text")
    ids = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(id_columns, keys, strict=True))
    schema = f"{ids}{', text string' if keep_text else ''}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate_lines long"
    return slim.mapInArrow(judge, schema).withColumnsRenamed(dict(zip(keys, id_columns, strict=True)))


def judge_text(text: str | None, model: LineModel | None, least_share: float, hashes: WordHash) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    repeated = repeat_words(hashes.ids(words)) if n >= WINDOW else 0
    masks, weights, dup_lines = text_lines(text)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    share, junk = None, 0
    if model and masks:
        path = model.label(masks)
        junk = sum(path)
        share = sum(w for w, y in zip(weights, path, strict=True) if y == 0) / sum(weights)
    kept = not failed and (share is None or share >= least_share)
    return n, sum(weights), sum(map(text.count, SYMBOLS)), dup_lines, repeated, failed, kept, share, len(masks), junk


def repeat_words(ids: np.ndarray) -> int:
    """Words that a window found twice or more covers."""
    windows = shingle_hashes(ids, WINDOW)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())
