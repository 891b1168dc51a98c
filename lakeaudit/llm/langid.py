"""Operator 5: language identification by inferring each text's mixture of languages.

Training counts hashed character trigrams of the learning documents of each language (a sample of about ``TRAIN_DOCUMENTS``
documents a language, chosen by a hash of their id: the documented bound of the classifier). Prediction reads the whole
text: expectation-maximisation finds the proportions of the languages under which the text's trigrams are most likely, for
growing sets of languages (the likeliest of the full mixture first), and the set with the best penalised likelihood (BIC)
is taken. The predicted language is the one of the largest proportion, and the score is that proportion.

A null text, one without a letter, or a model without languages gives ``und`` with score 0 and an empty mixture. Ties go to
the first language by code point. Repeated rows give repeated rows. Of the input only the named columns are read, so that
other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import GOLD, mix, slices, strings

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
TRAIN_DOCUMENTS = 1500
ROUNDS = 20
UNDETERMINED = "und"


@cache
def letters() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the lower-cased text; what is no letter counts as one space; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    return (mix((c[:-2] * GOLD + c[1:-1]) * GOLD + c[2:]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_likelihoods: np.ndarray  # BUCKETS x languages

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first; empty if nothing can be said."""
        grams = trigrams(text) if text and self.languages else np.empty(0, np.int64)
        if not len(grams):
            return []
        kinds, times = np.unique(grams, return_counts=True)
        logs = self.log_likelihoods[kinds]
        n = float(times.sum())
        single = times @ logs
        floor = logs.max(1, keepdims=True)
        p, base = np.exp(logs - floor), float(times @ floor[:, 0])
        full = self._em(p, times, n) if len(self.languages) > 1 else np.ones(1)
        order = np.argsort(-full, kind="stable")
        best, cost = [(int(np.argmax(single)), 1.0)], -2 * float(single.max())
        for k in range(2, len(order) + 1):
            if full[order[k - 1]] * n < 1:
                break
            chosen = np.sort(order[:k])
            share = self._em(p[:, chosen], times, n)
            value = -2 * (base + float(times @ np.log(p[:, chosen] @ share + 1e-300))) + (k - 1) * math.log(n)
            if value >= cost:
                break
            cost, best = value, list(zip(chosen.tolist(), share.tolist(), strict=True))
        return [(self.languages[i], x) for i, x in sorted(best, key=lambda b: (-b[1], b[0]))]

    @staticmethod
    def _em(p: np.ndarray, times: np.ndarray, n: float) -> np.ndarray:
        share = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            joint = p * share
            total = joint.sum(1)
            now = (times / np.maximum(total, 1e-300)) @ joint / n
            done = np.abs(now - share).max() < 1e-4
            share = now
            if done:
                break
        return share


def train(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", train_documents: int = TRAIN_DOCUMENTS) -> LanguageModel:
    """The model of the rows for which ``learn`` is true and text and language are not null.

    Partial counts are made in the tasks and summed by Spark; the driver gets at most BUCKETS numbers a language.
    """
    pool = docs.where(learn & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    sizes = {r["lang"]: r["n"] for r in pool.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel((), np.zeros((BUCKETS, 0)))
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, train_documents / sizes[k]))), F.col(lang_column))
    sample = pool.where((F.pmod(F.xxhash64(id_column, F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)) < share)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for batch in slices(batches):
            for lang, text in zip(strings(batch.column("lang")), strings(batch.column("text")), strict=True):
                if lang not in tables:
                    tables[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(tables[lang], trigrams(text), 1)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(table[at])], ["lang", "gram", "n"])

    slim = sample.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    counts = slim.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), 0.1)
    place = {k: i for i, k in enumerate(languages)}
    if len(counts):
        table[counts["gram"].to_numpy(), counts["lang"].map(place).to_numpy()] += counts["n"].to_numpy()
    return LanguageModel(tuple(languages), np.log(table / table.sum(0)))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The kept columns, lang_pred string, score double and languages array<struct<lang, share>>, a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles a language
    keys = [f"k{i}" for i in range(len(keep))]
    mix_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [model.mixture(t) for t in strings(batch.column("text"))]
            pred = pa.array([m[0][0] if m else UNDETERMINED for m in found], pa.string())
            score = pa.array([min(1.0, max(0.0, m[0][1])) if m else 0.0 for m in found], pa.float64())
            parts = pa.array([[{"lang": a, "share": s} for a, s in m] for m in found], mix_type)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pred, score, parts], [*keys, "lang_pred", "score", "languages"])

    slim = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, keys, strict=True)), F.col(text_column).alias("text"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, keys, strict=True))
    out = slim.mapInArrow(predict, f"{kinds}, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    return out.withColumnsRenamed(dict(zip(keys, keep, strict=True)))
