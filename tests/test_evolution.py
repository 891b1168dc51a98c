"""Reading one schema version's records as another's, and the declared suites."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeaudit.functions import envelope, evolution
from lakeaudit.operators import checks, landing
from lakeaudit.plans import suites
from lakeaudit.plans.marts import Marts
from lakeaudit.plans.queries import VERSIONS, Lake
from lakeaudit.sources import fixtures, schemas


def record(*fields):
    return json.dumps({"type": "record", "name": "R", "fields": [{"name": n, "type": t, **more} for n, t, more in fields]})


def test_promotions(spark):
    names = list(evolution.PRIMITIVES)
    fits = {(a, b) for a in names for b in names if not evolution.problems(record(("x", a, {})), record(("x", b, {})))}
    assert fits == {(a, a) for a in names} | {("int", "long"), ("int", "float"), ("int", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "bytes"), ("bytes", "string")}
    writer = record(("i", "int", {}), ("l", "long", {}), ("f", "float", {}), ("s", "string", {}), ("b", "bytes", {}))
    reader = record(("i", "double", {}), ("l", "float", {}), ("f", "double", {}), ("s", "bytes", {}), ("b", "string", {}))
    row = spark.sql("select named_struct('i', 3, 'l', 5L, 'f', cast(0.5 as float), 's', 'é', 'b', cast('ü' as binary)) r")
    out = row.select(evolution.resolved(F.col("r"), writer, reader).alias("x")).select("x.*")
    assert [t for _, t in out.dtypes] == ["double", "float", "double", "binary", "string"] and tuple(out.first()) == (3.0, 5.0, 0.5, "é".encode(), "ü")


def test_defaults_aliases_and_dropped_fields(spark):
    writer = record(("id", "string", {}), ("gone", "int", {}), ("at", {"type": "long", "logicalType": "timestamp-micros"}, {}))
    reader = record(("key", "string", {"aliases": ["id"]}), ("n", ["null", "int"], {"default": None}), ("k", "long", {"default": 7}), ("at", ["null", {"type": "long", "logicalType": "timestamp-micros"}], {}))
    assert evolution.problems(writer, reader) == []
    rows = spark.sql("select named_struct('id', 'a', 'gone', 1, 'at', 1500000L) r union all select named_struct('id', null, 'gone', null, 'at', null)")
    out = rows.select(evolution.resolved(F.col("r"), writer, reader).alias("x"))
    found = [r["x"] for r in out.collect()]
    assert tuple(found[0])[:3] == ("a", None, 7) and found[0]["at"].microsecond == 500000 and found[1] is None  # a record of nulls did not decode


def test_schemas_that_do_not_fit(spark):
    assert evolution.problems(record(("a", "string", {})), record(("a", "int", {}), ("b", "int", {}))) == ["a: string cannot be read as int", "b: the writer lacks it and it has no default"]
    with pytest.raises(ValueError, match="does not fit"):
        evolution.resolved(F.col("r"), record(("a", "double", {})), record(("a", "int", {})))
    for bad in ('{"type": "enum", "name": "E", "symbols": []}', record(("a", ["int", "string"], {})), record(("a", {"type": "array", "items": "int"}, {}))):
        with pytest.raises(ValueError, match="record|type"):
            evolution.fields_of(bad)


def test_three_writers_land_in_one_reader(spark, sf):
    decoder = evolution.resolving_decoder(VERSIONS.writers[13], evolution.json_body)
    assert [evolution.problems(w, VERSIONS.writers[13]) for w in VERSIONS.writers.values()] == [[], [], []]
    config = landing.LandingConfig("transactions", schemas.TRANSACTION, landing.TRANSACTIONS.reason, "event_time", "event_date", decoder)
    landed = landing.land(fixtures.raw_versions(spark, sf), VERSIONS, config)
    valid = landed.valid()
    assert valid.schema["amount"].dataType == T.DoubleType() and {r[0] for r in valid.select("message_schema_id").distinct().collect()} == {12, 13}
    assert valid.where("oldbalanceOrg is null or nameOrig is null or type is null").isEmpty()
    assert landed.quarantine().where("quarantine_reason = 'MISSING_INGESTED_AT'").select("message_schema_id").distinct().first()[0] == 11
    # The body is decoded once for a message and writer, whatever the number of fields.
    assert landed.judged._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2 * len(VERSIONS.writers)


def test_a_writer_without_default_is_refused(spark):
    decoder = evolution.resolving_decoder(VERSIONS.writers[13], evolution.json_body)
    config = landing.LandingConfig("transactions", schemas.TRANSACTION, landing.TRANSACTIONS.reason, "event_time", "event_date", decoder)
    rows = spark.range(1).select(envelope.frame(F.lit("{}"), F.lit(13)).alias("value"))
    with pytest.raises(ValueError, match="step"):
        landing.land(rows, landing.SchemaCatalog({13: VERSIONS.writers[13], 14: record(("event_id", "string", {}), ("source", "string", {}), ("amount", "int", {}))}, 13), config)


def test_suite_counts_in_one_aggregate(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (9, "z")], "n int, s string")
    out = checks.suite(rows, ["n", "s"], {"n": [1, 2], "s": ["a", "b", "z"]})
    assert sorted(map(tuple, out.collect())) == [("accepted_values", "n", 1), ("accepted_values", "s", 0), ("not_null", "n", 1), ("not_null", "s", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_declared_suites_find_what_is_planted(spark, sf):
    marts = Marts(Lake(spark, sf))
    marts.transactions = marts.transactions.withColumn("amount", F.when(F.col("step") > 5, F.col("amount"))).withColumn("transaction_type", F.when(F.col("step") == 6, "OTHER").otherwise(F.col("transaction_type")))
    bad, other = (marts.transactions.where(c).count() for c in ("amount is null", "transaction_type = 'OTHER'"))
    found = {tuple(r)[:3]: r["failures"] for r in suites.failures(marts, ["fct_transactions", "fct_transactions_labeled"]).collect() if r["failures"]}
    assert bad and other and found == {(r, *t): n for r in ("fct_transactions", "fct_transactions_labeled") for t, n in ((("not_null", "amount"), bad), (("accepted_values", "transaction_type"), other))}
