"""Operator 1: how many tokens each text has under a unigram vocabulary, by trie-shared dynamic programming.

Within a slice of the texts the distinct pre-tokens are put in a trie; the forward score of a prefix is found once for all
pre-tokens that share it, and the count at the node where a pre-token ends is stored for it. The operator is one narrow
pass: no shuffle, memory bounded by a slice of texts and a cache of counts.

A null text has 0 pre-tokens and tokens, as has an empty one. Repeated rows give repeated rows. The result has the id
column and the two counts only, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.lattice import Vocabulary, lattice_of, pretokens
from lakeaudit.llm.text import slices, strings

#: Counts that a task keeps from slice to slice; beyond it the cache starts anew (counts are found again, none is lost).
CACHE = 300_000


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_pretokens long, n_tokens long), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file, whatever the corpus

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(shared.value)
        known: dict[str, int] = {}
        for batch in slices(batches):
            words = [pretokens(t) if t else [] for t in strings(batch.column("text"))]
            if len(known) > CACHE:
                known.clear()
            new = list(set().union(*words).difference(known))
            if new:
                known.update(zip(new, lattice.segment(new).counts.tolist(), strict=True))
            got = [sum(map(known.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, words), pa.int64()), pa.array(got, pa.int64())], ["id", "n_pretokens", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(count, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_column)
