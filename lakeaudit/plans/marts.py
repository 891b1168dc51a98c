"""The marts, each built once and read by all that follow."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators import canonical, contract, training
from lakeaudit.sources import zones

if TYPE_CHECKING:
    from lakeaudit.plans.queries import Lake


class Marts:
    """One build of the models over a lake. Staging and intermediate models are views, which Catalyst inlines; marts are tables: the
    first reader of one writes it, after those that it is made from, and every other reads what was written."""

    def __init__(self, lake: Lake, root: str | None = None) -> None:
        self.lake = lake
        self.root = root or f"{zones.shared_folder(lake.spark)}/marts-{uuid.uuid4().hex}"
        #: The marts in the order in which they were begun.
        self.built: list[str] = []

    def _table(self, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        self.built.append(name)
        return zones.materialized(rows(), f"{self.root}/{name}")

    @cached_property
    def committed(self) -> DataFrame:
        return self._table("committed_batches", self.lake.committed)

    @cached_property
    def labels(self) -> DataFrame:
        return self._table("fct_transaction_labels", lambda: canonical.label_facts(self.lake.dealt_rows("labels", self.committed), None, self.lake.deal))

    @cached_property
    def transactions(self) -> DataFrame:
        """The facts with their labels beside them, so that no reader joins the two again."""
        committed = self.committed
        return self._table("fct_transactions", lambda: training.labeled_facts(self.lake.dealt_rows("transactions", committed), None, self.labels, self.lake.deal))

    @property
    def labeled(self) -> DataFrame:
        return self.transactions

    @cached_property
    def candidates(self) -> DataFrame:
        labeled = self.labeled
        return self._table("ml_training_candidates", lambda: training.candidates(labeled))

    @property
    def training(self) -> DataFrame:
        return training.training_rows(self.candidates)

    @property
    def exclusions(self) -> DataFrame:
        return training.exclusion_summary(self.candidates)

    def violations(self, rules: contract.Contract) -> DataFrame:
        rules.check_schema(self.training)
        return rules.violations(rules.metrics(self.training, self.transactions))

    def report(self, rules: contract.Contract) -> DataFrame:
        """(model, name, value) of one build: rows of each mart, candidates by reason, metrics of the contract."""
        tables = {"fct_transactions": self.transactions, "fct_transaction_labels": self.labels, "ml_training_candidates": self.candidates}
        parts = [rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("model"), F.lit("rows").alias("name"), "value") for name, rows in tables.items()]
        parts.append(self.exclusions.select(F.lit("ml_training_exclusion_summary").alias("model"), F.col("training_exclusion_reason").alias("name"), F.col("row_count").alias("value")))
        parts.append(self.violations(rules).select(F.lit("contract").alias("model"), F.col("metric").alias("name"), "value"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
