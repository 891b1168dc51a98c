"""From facts to the training set: label join, features, eligibility, split."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.values import money_minus
from lakeaudit.operators import canonical

ELIGIBLE = "eligible"
#: The first of these that holds is why a row is left out.
EXCLUSIONS = (
    ("missing_final_label", "not has_final_label"), ("transaction_payload_conflict", "has_payload_conflict"), ("label_payload_conflict", "has_label_payload_conflict"),
    ("invalid_amount", "has_invalid_amount"), ("invalid_balance", "has_invalid_balance"),
)
TRAINING_COLUMNS = [
    "source", "event_id", "event_time", "event_date", "step", "transaction_type", "amount", "origin_balance_before", "origin_balance_after",
    "destination_balance_before", "destination_balance_after", "origin_balance_delta", "destination_balance_delta", "origin_amount_residual",
    "destination_amount_residual", "is_fraud",
]


#: What a label adds to a transaction.
LABEL_COLUMNS = ["has_final_label", "is_fraud", "has_label_payload_conflict"]


def label_side(labels: DataFrame, *more: str) -> DataFrame:
    """What a transaction takes of its label."""
    return labels.select(*more, "source", "event_id", F.col("is_fraud").alias("label"), F.col("has_payload_conflict").alias("label_conflict"), F.lit(True).alias("found"))


def with_label(rows: DataFrame) -> DataFrame:
    """The final label of rows that have the columns of ``label_side``; without one is_fraud is 0 and has_final_label false."""
    out = rows.withColumns({
        "has_final_label": F.coalesce(F.col("found") & (F.col("event_id") != ""), F.lit(False)), "is_fraud": F.coalesce("label", F.lit(0)),
        "has_label_payload_conflict": F.coalesce("label_conflict", F.lit(False)),
    })
    return out.drop("label", "label_conflict", "found")


def labeled(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Each transaction with its final label, of facts that are written already."""
    return with_label(transactions.join(label_side(labels), ["source", "event_id"], "left"))


def labeled_facts(rows: DataFrame, committed: DataFrame | None, labels: DataFrame, deal: str | None = None) -> DataFrame:
    """The same from staged rows: the labels come to where the canonical rows lie, which are shuffled once, or not at all if they lie by ``deal``."""
    return with_label(canonical.transaction_facts(rows, committed, label_side(labels, *([deal] if deal else [])), deal))


def candidates(facts: DataFrame) -> DataFrame:
    """Features of the ledger and the reason to leave a row out."""
    delta = {"origin": money_minus(F.col("origin_balance_before"), F.col("origin_balance_after")), "destination": money_minus(F.col("destination_balance_after"), F.col("destination_balance_before"))}
    out = facts.withColumns({f"{side}_balance_delta": d for side, d in delta.items()})
    out = out.withColumns({f"{side}_amount_residual": F.abs(money_minus(F.col(f"{side}_balance_delta"), F.col("amount"))) for side in delta})
    reason = F.lit(ELIGIBLE)
    for name, rule in reversed(EXCLUSIONS):
        reason = F.when(F.expr(rule), name).otherwise(reason)
    out = out.withColumn("training_exclusion_reason", reason).withColumn("is_training_eligible", F.col("training_exclusion_reason") == ELIGIBLE)
    flags = ["has_final_label", "has_payload_conflict", "has_label_payload_conflict", "has_invalid_amount", "has_invalid_balance"]
    return out.select(*TRAINING_COLUMNS, *flags, "is_training_eligible", "training_exclusion_reason")


def training_rows(rows: DataFrame) -> DataFrame:
    return rows.where("is_training_eligible").select(*TRAINING_COLUMNS)


def exclusion_summary(rows: DataFrame) -> DataFrame:
    """Rows by reason; reasons that do not occur have no row."""
    return rows.groupBy("training_exclusion_reason").agg(F.count("*").alias("row_count"))


@dataclass(frozen=True)
class FeatureSet:
    """Columns that go into a model, with a guard against leakage (P20, M2)."""

    features: tuple[str, ...]
    ids: tuple[str, ...] = ("source", "event_id")
    split: tuple[str, ...] = ("event_time", "event_date", "step")
    target: str = "is_fraud"
    forbidden: frozenset[str] = field(default=frozenset({"source", "event_id", "event_time", "event_date", "step", "origin_account", "destination_account", "is_fraud", "is_flagged_fraud"}))

    def __post_init__(self) -> None:
        if bad := self.forbidden & set(self.features):
            raise ValueError(f"these columns may not be features: {sorted(bad)}")
        if len(set(self.features)) != len(self.features):
            raise ValueError("a feature is given twice")

    def select(self, rows: DataFrame) -> DataFrame:
        if missing := set(self.features) - set(rows.columns):
            raise ValueError(f"these features are missing: {sorted(missing)}")
        return rows.select(*self.ids, *self.split, *self.features, self.target)


BASELINE = FeatureSet(("transaction_type", "amount", "origin_balance_before", "destination_balance_before"))
CHALLENGER = FeatureSet((
    "transaction_type", "amount", "origin_balance_before", "origin_balance_after", "destination_balance_before", "destination_balance_after",
    "origin_balance_delta", "destination_balance_delta", "origin_amount_residual", "destination_amount_residual",
))
#: The ends of the three parts, each exclusive.
SPLIT_ENDS = (("train", "2026-01-21T20:00:00"), ("validation", "2026-01-26T20:00:00"), ("test", "2026-01-31T23:00:00"))


def temporal_split(rows: DataFrame, time: str = "event_time", ends: tuple[tuple[str, str], ...] = SPLIT_ENDS) -> DataFrame:
    """rows with ``split``: the first part whose end is after the time, else null (M1)."""
    part = F.lit(None).cast("string")
    for name, end in reversed(ends):
        part = F.when(F.col(time) < F.to_timestamp_ntz(F.lit(end)), name).otherwise(part)
    return rows.withColumn("split", part)
