"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lakeaudit.plans import queries as plans
from tests.conftest import compare

@pytest.mark.parametrize("name", list(plans.queries()))
def test_against_sql(spark, sf, name):
    compare(spark, plans.queries(), plans.oracle_sql(), name, sf)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["source", "event_id"]


def test_absent_modules_are_left_out():
    assert entry._optional("lakeaudit.no_such_package.queries") is None and entry._optional("no_such_module") is None
    assert set(plans.queries()) <= set(entry.queries())


def test_invariants(spark, sf):
    q = plans.queries()
    facts, physical = q["fct_transactions"](spark, sf), q["transactions_ranked"](spark, sf)
    assert facts.count() == facts.select("source", "event_id").distinct().count()
    assert facts.selectExpr("sum(1 + replay_row_count) n").first()["n"] == physical.count()
    candidates = q["ml_training_candidates"](spark, sf).count()
    assert q["ml_training_exclusion_summary"](spark, sf).selectExpr("sum(row_count) n").first()["n"] == candidates
    # The one-pass canonical rows are those of rank 1.
    first = physical.where("canonical_rank = 1").selectExpr("event_id", "kafka_offset", "minio_batch_id")
    assert first.exceptAll(facts.selectExpr("event_id", "canonical_kafka_offset", "canonical_minio_batch_id")).isEmpty()


def test_replay_of_every_event(spark, sf):
    q = plans.queries()
    whole, window = (q[n](spark, sf).select("event_id") for n in ("replay_events_whole", "replay_events"))
    assert whole.distinct().count() == whole.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert window.exceptAll(whole).isEmpty() and whole.exceptAll(window).count() == 100
