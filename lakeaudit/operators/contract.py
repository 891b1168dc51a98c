"""The contract of the training table: exact schema, metrics, violations, report."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.operators.training import TRAINING_COLUMNS
from lakeaudit.sources import schemas

#: The transaction types.
TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
METRICS = ("duplicate_key_count", "empty_key_count", "null_count", "invalid_source_count", "invalid_type_count", "invalid_target_count", "invalid_formula_count", "missing_lineage_count")
#: None of the columns may be null, the derived ones included: a null one would pass the comparison with its formula.
REQUIRED = TRAINING_COLUMNS


class ContractError(ValueError):
    """The table breaks its contract."""


@dataclass(frozen=True)
class Contract:
    """What the table must be. The contract checks itself first (Q9): its names are identifiers and unique, its sets are parts of the
    table or apart from each other as they must be, and its epoch is in UTC."""

    source: str
    relation: str = "ml.training_transactions"
    lineage_relation: str = "core.fct_transactions"
    replay_epoch: str = "2026-01-01T00:00:00Z"
    schema: T.StructType = schemas.TRAINING
    types: tuple[str, ...] = TYPES
    key: tuple[str, ...] = ("source", "event_id")
    target: str = "is_fraud"
    prohibited: tuple[str, ...] = ("is_flagged_fraud", "origin_account", "destination_account")
    structural: tuple[str, ...] = ("source", "event_time", "step", "is_fraud", "transaction_type")
    non_features: tuple[str, ...] = ("source", "event_id", "event_time", "event_date", "step", "is_fraud")
    audit_candidates: tuple[str, ...] = ("origin_amount_residual", "destination_amount_residual")

    def __post_init__(self) -> None:
        names = self.schema.fieldNames()
        sets = {"columns": names, "types": self.types, "key": self.key, "prohibited columns": self.prohibited, "non-features": self.non_features, "audit candidates": self.audit_candidates}
        for what, values in sets.items():
            if len(set(values)) != len(values):
                raise ContractError(f"the {what} are not unique")
            if what != "types" and (bad := [n for n in values if not re.fullmatch(r"[a-z_][a-z0-9_]*", n)]):
                raise ContractError(f"no identifiers among the {what}: {bad}")
        for what in ("columns", "types", "key"):
            if not sets[what]:
                raise ContractError(f"the {what} are empty")
        for relation in (self.relation, self.lineage_relation):
            if not re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", relation, re.ASCII):
                raise ContractError(f"not database.table: {relation}")
        try:
            epoch = datetime.fromisoformat(self.replay_epoch)
        except ValueError as e:
            raise ContractError(f"no instant: {self.replay_epoch}") from e
        if epoch.utcoffset() != timedelta(0):
            raise ContractError("the replay epoch is not in UTC")
        within = {"key": self.key, "target": (self.target,), "structural columns": self.structural, "non-features": self.non_features, "audit candidates": self.audit_candidates}
        for what, values in within.items():
            if missing := set(values) - set(names):
                raise ContractError(f"{what} must be columns: {sorted(missing)}")
        for what, one, two in (("columns and prohibited columns", names, self.prohibited), ("prohibited columns and non-features", self.prohibited, self.non_features), ("non-features and audit candidates", self.non_features, self.audit_candidates)):
            if both := set(one) & set(two):
                raise ContractError(f"both {what}: {sorted(both)}")
        if features := {*self.key, self.target} - set(self.non_features):
            raise ContractError(f"key and target are no features: {sorted(features)}")
        if not self.source.strip():
            raise ContractError("a source is needed")

    def check_schema(self, rows: DataFrame) -> None:
        """Names, types and order must be exact; prohibited columns must be absent (Q7, Q10). Without time zone counts as UTC."""
        kind = lambda t: "timestamp" if t.simpleString() == "timestamp_ntz" else t.simpleString()
        want, have = ([(f.name, kind(f.dataType)) for f in s.fields] for s in (self.schema, rows.schema))
        if bad := set(self.prohibited) & set(rows.columns):
            raise ContractError(f"prohibited columns: {sorted(bad)}")
        if want != have:
            raise ContractError(f"expected schema {want}, found {have}")

    def metrics(self, rows: DataFrame, lineage: DataFrame) -> DataFrame:
        """One row of counts, in one pass over the join (A9, J7). A key that lineage has twice counts its rows twice."""
        facts = lineage.select(*(F.col(k).alias(f"of_{k}") for k in self.key), F.lit(1).alias("known"))
        on = [F.col(k) == F.col(f"of_{k}") for k in self.key]
        c = F.col
        formula = (
            (c("origin_balance_delta") != c("origin_balance_before") - c("origin_balance_after"))
            | (c("destination_balance_delta") != c("destination_balance_after") - c("destination_balance_before"))
            | (c("origin_amount_residual") != F.abs(c("origin_balance_delta") - c("amount")))
            | (c("destination_amount_residual") != F.abs(c("destination_balance_delta") - c("amount")))
        )
        null = c(REQUIRED[0]).isNull()
        for name in REQUIRED[1:]:
            null = null | c(name).isNull()
        return rows.join(facts, on, "left").agg(
            F.count("*").alias("row_count"), F.count_distinct(F.struct(*self.key)).alias("distinct_key_count"),
            F.count_if((F.trim("source") == "") | (F.trim("event_id") == "")).alias("empty_key_count"), F.count_if(null).alias("null_count"),
            F.count_if(c("source") != self.source).alias("invalid_source_count"), F.count_if(~c("transaction_type").isin(*self.types)).alias("invalid_type_count"),
            F.count_if(~c(self.target).isin(0, 1)).alias("invalid_target_count"), F.count_if(formula).alias("invalid_formula_count"),
            F.count_if(c("known").isNull()).alias("missing_lineage_count"),
        )

    def violations(self, metrics: DataFrame) -> DataFrame:
        """(metric, value, ok), a row for each rule; an empty table breaks the rule on row_count (Q8)."""
        counts = metrics.withColumn("duplicate_key_count", F.col("row_count") - F.col("distinct_key_count"))
        pairs = ", ".join(f"'{m}', {m}, {m} = 0" for m in METRICS)
        return counts.selectExpr(f"stack({len(METRICS) + 1}, {pairs}, 'row_count', row_count, row_count > 0) as (metric, value, ok)")

    def report(self, rows: DataFrame, lineage: DataFrame, dataset: str, relation: str) -> DataFrame:
        """The report's one row if the contract holds, else an error that names what is broken (Q11)."""
        self.check_schema(rows)
        metrics = self.metrics(rows, lineage)
        if failed := {r["metric"]: r["value"] for r in self.violations(metrics).where("not ok").collect()}:
            raise ContractError(f"broken: {failed}")
        shape = F.lit(rows.schema.simpleString()).alias("schema")
        return metrics.select(F.lit(dataset).alias("dataset"), F.lit(relation).alias("relation"), F.current_timestamp().alias("validated_at"), shape, "*")
