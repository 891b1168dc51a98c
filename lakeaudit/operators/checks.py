"""Data tests: each returns what fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators.training import ELIGIBLE, EXCLUSIONS


def not_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, failures) for each of the columns, found in one pass (Q1)."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, failures)")


def accepted_values(rows: DataFrame, column: str, values: list) -> DataFrame:
    """(value, failures) for each value that is not accepted; null is no failure."""
    return rows.where(~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("failures"))


def suite(rows: DataFrame, not_null: list[str], accepted: dict[str, list]) -> DataFrame:
    """(test, column_name, failures) for all tests of a relation, found in one aggregate (Q1, Q2). A null is no failure of the accepted
    values (N13)."""
    tests = [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null] + [("accepted_values", c, F.count_if(~F.col(c).isin(*v))) for c, v in accepted.items()]
    counts = rows.agg(*(count.alias(f"t{i}") for i, (_, _, count) in enumerate(tests)))
    triples = ", ".join(f"'{test}', '{column}', t{i}" for i, (test, column, _) in enumerate(tests))
    return counts.selectExpr(f"stack({len(tests)}, {triples}) as (test, column_name, failures)")


def blank_keys(**relations: DataFrame) -> DataFrame:
    """Rows of any relation with a blank key (Q3, U4)."""
    out = None
    for name, rows in relations.items():
        bad = rows.where("trim(source) = '' or trim(event_id) = ''").select(F.lit(name).alias("relation_name"), "source", "event_id")
        out = bad if out is None else out.unionByName(bad)
    return out


def unreconciled(manifest: DataFrame) -> DataFrame:
    return manifest.where("input_rows <> valid_rows + quarantine_rows")


def orphan_labels(labels: DataFrame, transactions: DataFrame) -> DataFrame:
    """Labels without a transaction."""
    return labels.select("source", "event_id").join(transactions, ["source", "event_id"], "left_anti")


def inconsistent_candidates(rows: DataFrame) -> DataFrame:
    """Rows whose flag and reason disagree, or whose reason is unknown (Q6)."""
    reason = F.col("training_exclusion_reason")
    known = [ELIGIBLE, *(name for name, _ in EXCLUSIONS)]
    return rows.where((F.col("is_training_eligible") != (reason == ELIGIBLE)) | ~reason.isin(*known))
