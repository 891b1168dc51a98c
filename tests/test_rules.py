"""One case for each reason and each rule on values."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeaudit.functions import envelope, rules, values
from lakeaudit.operators import canonical, checks, contract, landing, loading, training
from lakeaudit.sources import schemas


def test_money_is_cut(spark):
    rows = spark.createDataFrame([(1.239,), (-1.239,), (1.234e7,), (None,), (0.005,)], "x double")
    got = [r[0] for r in rows.select(values.to_money(F.col("x"))).collect()]
    assert got == [Decimal("1.23"), Decimal("-1.23"), Decimal("12340000.00"), None, Decimal("0.00")]


def test_money_keeps_its_type(spark):
    df = spark.range(1).select(F.lit(Decimal("5.00")).cast("decimal(18,2)").alias("a"))
    assert df.select(values.money_minus(F.col("a"), F.col("a")).alias("d")).dtypes == [("d", "decimal(18,2)")]


def test_unsigned(spark):
    got = spark.createDataFrame([(70000,), (-1,)], "x long").select(values.unsigned(F.col("x"), 16), values.unsigned(F.col("x"), 32)).collect()
    assert [tuple(r) for r in got] == [(4464, 70000), (65535, 4294967295)]


def test_event_time(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (2, 2, 3), (0, 0, 1), (1, 3, 3)], "s int, o int, n int")
    got = [r[0] for r in rows.select(values.event_time_ms(F.col("s"), F.col("o"), F.col("n"))).collect()]
    assert got == [1767225600000, 1767225600000 + 1200000, 1767225600000 + 3600000 + 2400000, None, None]


@pytest.mark.parametrize(("value", "reason"), [
    (None, "NULL_KAFKA_VALUE"), (b"", "CONFLUENT_MESSAGE_TOO_SHORT"), (b"\0\0\0\0\1", "CONFLUENT_MESSAGE_TOO_SHORT"), (b"\1\0\0\0\1{", "INVALID_CONFLUENT_MAGIC_BYTE"),
    (b"\0\xff\xff\xff\xff{", "UNSUPPORTED_SCHEMA_ID"), (b"\0\0\0\0\1{", None),
])
def test_headers(spark, value, reason):
    row = envelope.inspect(spark.createDataFrame([(value,)], "value binary"), [1], 1).first()
    assert row["quarantine_reason"] == reason
    if value and value[1:5] == b"\xff" * 4:
        assert row["message_schema_id"] == 4294967295


T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


@pytest.mark.parametrize(("record", "reason"), [
    ((None, None, None, None), "AVRO_DECODE_FAILED"), (("e", None, T1, 1), "MISSING_EVENT_TIME"), (("e", T0, None, 1), "MISSING_INGESTED_AT"),
    (("e", T1, T0, 1), "EVENT_TIME_AFTER_INGESTED_AT"), (("e", T0, T1, 0), "INVALID_STEP"), (("e", T0, T0, 1), None), (("e", T0, T1, None), None),
])
def test_transaction_reasons(spark, record, reason):
    df = spark.createDataFrame([(record,)], "r struct<event_id string, event_time timestamp, ingested_at timestamp, step int>")
    assert df.select(rules.transaction_reason(F.col("r"))).first()[0] == reason


@pytest.mark.parametrize(("record", "reason"), [((None, 0, 0), "AVRO_DECODE_FAILED"), (("e", 2, 2), "INVALID_IS_FRAUD"), (("e", 1, 2), "INVALID_IS_FLAGGED_FRAUD"), (("e", None, 1), None), (("e", 1, 0), None)])
def test_label_reasons(spark, record, reason):
    df = spark.createDataFrame([(record,)], "r struct<event_id string, isFraud int, isFlaggedFraud int>")
    assert df.select(rules.label_reason(F.col("r"))).first()[0] == reason


def test_sources_stay_untrimmed(spark):
    df = spark.createDataFrame([(" a ",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(rules.known_source(F.col("s"))).collect()] == [" a ", "unknown", "unknown"]


def test_catalog(spark):
    versions = spark.createDataFrame([("s", 1, 7, "a"), ("s", 2, 3, "b"), ("t", 9, 9, "c")], "subject string, version int, id int, schema string")
    assert landing.SchemaCatalog.of(versions, "s") == landing.SchemaCatalog({7: "a", 3: "b"}, 3)
    with pytest.raises(ValueError, match="no schema"):
        landing.SchemaCatalog.of(versions, "u")
    with pytest.raises(ValueError, match="together"):
        landing.LandingConfig("x", schemas.LABEL, rules.label_reason, time_column="t")


def test_staging_casts_and_drops(spark):
    """What comes in other types and another order leaves in the declared ones; columns of no declaration stay behind, nulls stay null."""
    given = {name: loading.T.StructType.fromDDL(ddl) for name, ddl in loading.STAGED.items()}
    for name, want in given.items():
        texts = {f.name: {"timestamp_ntz": "2026-01-01 00:00:01", "date": "2026-01-02", "decimal(18,2)": "1.239", "string": "x"}.get(f.dataType.simpleString(), "7") for f in want}
        rows = spark.createDataFrame([tuple(texts[n] for n in reversed(texts)), (None,) * len(texts)], ", ".join(f"{n} string" for n in reversed(texts))).withColumn("extra", F.lit(1))
        got = loading.staged(rows, name)
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want]
        full, empty = got.collect()
        assert all(v is None for v in empty) and None not in full
        if name == "transactions":
            assert (full["amount"], full["step"], full["loaded_at"]) == (Decimal("1.24"), 7, datetime(2026, 1, 1, 0, 0, 1))


def test_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert canonical.with_hash(df, ["x", "y"]).select("payload_hash").distinct().count() == 2


def test_manifest_counts_null_dates(spark):
    rows = [("t", 1, None, "u", 2, 0, 2), ("t", 1, T0.date(), "a", 3, 3, 0)]
    summary = loading.manifest_summary(spark.createDataFrame(rows, schemas.MANIFEST), ["batch_id"], F.lit("t"), F.col("batch_id"))
    assert summary.select(loading.rejection_reason()).first()[0] == "OK"
    twice = loading.manifest_summary(spark.createDataFrame([rows[0], rows[0]], schemas.MANIFEST), ["batch_id"], F.lit("t"), F.col("batch_id"))
    assert twice.select(loading.rejection_reason()).first()[0] == "DUPLICATE_KEY"


def test_accepted_values_pass_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    assert [tuple(r) for r in checks.accepted_values(df, "x", ["a"]).collect()] == [("b", 1)]


def test_split_ends(spark):
    df = spark.sql("select timestamp_ntz '2026-01-21 19:59:59' event_time union all select timestamp_ntz '2026-01-21 20:00:00' union all select timestamp_ntz '2026-01-31 23:00:00'")
    assert [r["split"] for r in training.temporal_split(df).orderBy("event_time").collect()] == ["train", "validation", None]


def test_feature_guard(spark):
    with pytest.raises(ValueError, match="may not be"):
        training.FeatureSet(("amount", "is_fraud"))
    with pytest.raises(ValueError, match="missing"):
        training.FeatureSet(("amount",)).select(spark.range(1))


def _training(spark, n=3):
    money = Decimal("1.00")
    rows = [("tpch", f"e{i}", T0, T0.date(), 1, "DEBIT", money, money, Decimal("0.00"), money, money, money, Decimal("0.00"), Decimal("0.00"), money, 0) for i in range(n)]
    return spark.createDataFrame(rows, schemas.TRAINING)


def test_contract_holds(spark):
    rows = _training(spark)
    report = contract.Contract("tpch").report(rows, rows, "d", "r").first()
    assert (report["row_count"], report["distinct_key_count"], report["missing_lineage_count"]) == (3, 3, 0)


@pytest.mark.parametrize(("column", "value", "metric"), [
    ("event_id", "'e0'", "duplicate_key_count"), ("event_id", "' '", "empty_key_count"), ("event_time", "cast(null as timestamp)", "null_count"), ("source", "'x'", "invalid_source_count"),
    ("transaction_type", "'x'", "invalid_type_count"), ("is_fraud", "2", "invalid_target_count"), ("origin_balance_delta", "cast(9 as decimal(18,2))", "invalid_formula_count"),
    ("event_id", "'new'", "missing_lineage_count"), ("destination_amount_residual", "cast(null as decimal(18,2))", "null_count"), ("origin_balance_delta", "cast(null as decimal(18,2))", "null_count"),
])
def test_contract_violations(spark, column, value, metric):
    rows = _training(spark)
    with pytest.raises(contract.ContractError, match=metric):
        contract.Contract("tpch").report(rows.withColumn(column, F.expr(value)), rows, "d", "r")


def test_empty_table_breaks_the_contract(spark):
    with pytest.raises(contract.ContractError, match="row_count"):
        contract.Contract("tpch").report(_training(spark).limit(0), _training(spark), "d", "r")


def test_schema_must_be_exact(spark):
    rows, c = _training(spark), contract.Contract("tpch")
    names = rows.columns
    for bad in (rows.drop("step"), rows.withColumn("more", F.lit(1)), rows.select(names[1], names[0], *names[2:]), rows.withColumnRenamed("step", "steps"), rows.withColumn("is_flagged_fraud", F.lit(0)), rows.withColumn("step", F.col("step").cast("long"))):
        with pytest.raises(contract.ContractError):
            c.check_schema(bad)
    with pytest.raises(contract.ContractError):
        contract.Contract("tpch", types=("A", "A"))
    with pytest.raises(contract.ContractError):
        contract.Contract(" ")


@pytest.mark.parametrize("bad", [
    {"relation": "training"}, {"lineage_relation": "a.b.c"}, {"replay_epoch": "2026-01-01T00:00:00+01:00"}, {"replay_epoch": "soon"}, {"key": ()}, {"structural": ("source", "when")}, {"non_features": ("source", "event_id")},
    {"audit_candidates": ("source",)}, {"audit_candidates": ("nothing",)}, {"prohibited": ("step",)}, {"non_features": ("source", "event_id", "is_fraud", "is_flagged_fraud")}, {"key": ("source", "source")}, {"prohibited": ("No Name",)},
])
def test_the_contract_checks_itself(bad):
    with pytest.raises(contract.ContractError):
        contract.Contract("tpch", **bad)


def test_quality_rows_are_typed(spark):
    rows = spark.createDataFrame([("transactions", 1, None, "a", -1, 3, 0), ("labels", 1, None, "a", 1, 1, 0), ("transactions", 2, None, "a", 1, 1, 0)], schemas.MANIFEST)
    got = loading.typed_quality(rows, "transactions", F.lit(1), F.current_timestamp()).collect()
    assert [(int(r["batch_id"]), int(r["input_rows"]), int(r["valid_rows"])) for r in got] == [(1, 2**64 - 1, 3)]
