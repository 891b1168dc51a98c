"""The declared column tests of the models, one aggregate a relation (Q1, Q2)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators import checks
from lakeaudit.operators.training import ELIGIBLE, EXCLUSIONS
from lakeaudit.plans.marts import Marts

#: What the declarations accept.
TYPES = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
FLAG = (0, 1)
PIPELINES = ("transactions", "labels")
STATES = ("success", "failed")
REASONS = (ELIGIBLE, *(name for name, _ in EXCLUSIONS))


@dataclass(frozen=True)
class Suite:
    """The tests of one relation: columns that are never null, and the values that a column may have."""

    not_null: tuple[str, ...]
    accepted: dict[str, tuple] = field(default_factory=dict)


def _columns(names: str) -> tuple[str, ...]:
    return tuple(names.split())


#: The declared tests, by relation.
SUITES: dict[str, Suite] = {
    "stg_transactions": Suite(_columns("source event_id event_time minio_batch_id kafka_offset")),
    "stg_transaction_labels": Suite(_columns("source event_id is_fraud is_flagged_fraud"), {"is_fraud": FLAG, "is_flagged_fraud": FLAG}),
    "stg_ingestion_batches": Suite(_columns("pipeline batch_id status"), {"pipeline": PIPELINES, "status": STATES}),
    "stg_ingestion_batch_quality": Suite(_columns("pipeline batch_id source input_rows valid_rows quarantine_rows")),
    "committed_batches": Suite(_columns("pipeline batch_id committed_at success_attempts")),
    "fct_transactions": Suite(
        _columns("source event_id event_time event_date step transaction_type amount physical_row_count replay_row_count payload_version_count has_payload_conflict has_invalid_amount has_invalid_balance"),
        {"transaction_type": TYPES},
    ),
    "fct_transaction_labels": Suite(_columns("source event_id is_fraud is_flagged_fraud physical_row_count replay_row_count payload_version_count has_payload_conflict"), {"is_fraud": FLAG, "is_flagged_fraud": FLAG}),
    "fct_transactions_labeled": Suite(
        _columns("source event_id event_time event_date step transaction_type amount has_payload_conflict has_invalid_amount has_invalid_balance has_final_label has_label_payload_conflict"),
        {"transaction_type": TYPES},
    ),
    "ml_training_candidates": Suite(
        _columns("source event_id event_time event_date step transaction_type amount has_final_label has_payload_conflict has_label_payload_conflict has_invalid_amount has_invalid_balance is_training_eligible training_exclusion_reason"),
        {"transaction_type": TYPES, "is_fraud": FLAG, "training_exclusion_reason": REASONS},
    ),
    "ml_training_transactions": Suite(_columns("source event_id event_time event_date step transaction_type amount is_fraud"), {"transaction_type": TYPES, "is_fraud": FLAG}),
    "ml_training_exclusion_summary": Suite(_columns("training_exclusion_reason row_count"), {"training_exclusion_reason": REASONS}),
}


def relations(marts: Marts) -> dict[str, Callable[[], DataFrame]]:
    """The relations of a build, each made when it is asked for; what is a mart is read where it was written."""
    lake = marts.lake
    return {
        "stg_transactions": lambda: lake.staged("transactions"), "stg_transaction_labels": lambda: lake.staged("labels"), "stg_ingestion_batches": lambda: lake.staged("batches"),
        "stg_ingestion_batch_quality": lambda: lake.staged("manifest"), "committed_batches": lambda: marts.committed, "fct_transactions": lambda: marts.transactions,
        "fct_transaction_labels": lambda: marts.labels, "fct_transactions_labeled": lambda: marts.labeled, "ml_training_candidates": lambda: marts.candidates,
        "ml_training_transactions": lambda: marts.training, "ml_training_exclusion_summary": lambda: marts.exclusions,
    }


def failures(marts: Marts, names: list[str] | None = None) -> DataFrame:
    """(relation_name, test, column_name, failures) of all declared tests, one pass over each relation."""
    found, out = relations(marts), None
    for name in names or SUITES:
        suite = SUITES[name]
        part = checks.suite(found[name](), list(suite.not_null), {c: list(v) for c, v in suite.accepted.items()}).select(F.lit(name).alias("relation_name"), "test", "column_name", "failures")
        out = part if out is None else out.unionByName(part)
    return out
