"""DuckDB SQL for the registered queries, written from the rules and the tables alone."""

from __future__ import annotations

from lakeaudit.plans.suites import SUITES
from lakeaudit.sources import fixtures as fx

_TX, _LB, _LEDGER, _MANIFEST = (fx.duckdb(s) for s in (fx.TRANSACTIONS, fx.LABELS, fx.LEDGER, fx.MANIFEST))

#: Events by the number that spoils them.
_RAW = """
raw as (
  select event_id n, ts, event_type, value,
    case when event_id % 97 = 5 then 'NULL_KAFKA_VALUE' when event_id % 89 = 5 then 'CONFLUENT_MESSAGE_TOO_SHORT' when event_id % 83 = 5 then 'INVALID_CONFLUENT_MAGIC_BYTE'
      when event_id % 79 = 5 then 'UNSUPPORTED_SCHEMA_ID' end header,
    event_id % 73 = 5 bad,
    case when event_id % 71 <> 5 then ts end event_time,
    case when event_id % 67 = 5 then null when event_id % 61 = 5 then ts - interval 1 hour else ts + interval 1 hour end taken,
    case when event_id % 7 = 0 then '  ' when event_id % 7 = 1 then null else event_type end source,
    case when event_id % 73 = 5 or event_id % 2 = 0 then 1 else 2 end schema_id
  from events),
judged as (
  select *, case when header is not null then header when bad then 'AVRO_DECODE_FAILED' when event_time is null then 'MISSING_EVENT_TIME' when taken is null then 'MISSING_INGESTED_AT'
      when event_time > taken then 'EVENT_TIME_AFTER_INGESTED_AT' when n % 53 < 1 then 'INVALID_STEP' else 'VALID' end reason
  from raw)
"""
_RAW_LABELS = """
judged as (
  select event_id n, event_type source, case when event_id % 73 = 5 then 'AVRO_DECODE_FAILED' when event_id % 11 % 3 > 1 then 'INVALID_IS_FRAUD' when event_id % 17 % 4 > 1 then 'INVALID_IS_FLAGGED_FRAUD' else 'VALID' end reason
  from events)
"""
_SUMMARY = f"""
m as ({_MANIFEST}),
summary as (
  select dir, count(*) manifest_rows, count(*) filter (where pipeline <> 'transactions' or batch_id <> dir) identity_errors,
    count(*) filter (where input_rows <> valid_rows + quarantine_rows) reconciliation_errors,
    count(*) filter (where input_rows < 0 or valid_rows < 0 or quarantine_rows < 0) negative_counts, count(*) - count(distinct row(event_date, source)) duplicate_keys,
    cast(sum(input_rows) as bigint) input_rows, cast(sum(valid_rows) as bigint) valid_rows, cast(sum(quarantine_rows) as bigint) quarantine_rows
  from m group by dir)
"""
#: The staged relations from the tables themselves, each column with the type that it is cast to.
_STG_TX = """
select cast('t-' || l_orderkey || '-' || l_linenumber as varchar) event_id, cast('tpch' as varchar) source, cast(l_shipdate as timestamp) event_time,
  cast(l_shipdate as timestamp) + to_hours(1) ingested_at, cast(l_orderkey % 743 + 1 as integer) step,
  list_extract(['CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER'], l_partkey % 5 + 1) transaction_type, cast(price as decimal(18,2)) amount,
  'C' || o_custkey origin_account, cast(c_acctbal as decimal(18,2)) origin_balance_before,
  cast(if(l_orderkey % 743 % 4 = 3, cast(c_acctbal as decimal(18,2)), cast(c_acctbal as decimal(18,2)) - price) as decimal(18,2)) origin_balance_after,
  'M' || s_suppkey destination_account, cast(s_acctbal as decimal(18,2)) destination_balance_before, cast(s_acctbal as decimal(18,2)) destination_balance_after,
  cast(if(l_linenumber % 2 = 0, 1, 2) as bigint) schema_id, cast('transactions' as varchar) kafka_topic, cast(s_suppkey % 3 as integer) kafka_partition,
  cast(1000000000 * again + 8 * l_orderkey + l_linenumber as bigint) kafka_offset, cast(l_partkey as bigint) minio_batch_id, 'part-' || l_partkey minio_object,
  cast(l_shipdate as timestamp) + to_hours(2) loaded_at
from (select *, cast(if(l_quantity = 50, -1, 1) * l_extendedprice as decimal(18,2)) price from lineitem)
join range(2) copies(again) on again = 0 or l_orderkey % 7 = 0
join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
"""
_STG_LB = """
with found as (
  select 't-' || l_orderkey || '-' || l_linenumber event_id, l_discount >= 0.09 fraud, l_quantity > 45 flagged, l_suppkey % 3 part, 8 * l_orderkey + l_linenumber place, l_partkey batch, l_orderkey from lineitem)
select event_id, cast('tpch' as varchar) source, cast(fraud as integer) is_fraud, cast(flagged as integer) is_flagged_fraud, cast(1 as bigint) schema_id, cast('labels' as varchar) kafka_topic,
  cast(part as integer) kafka_partition, cast(place as bigint) kafka_offset, cast(batch as bigint) minio_batch_id, 'part-' || batch minio_object, cast('2026-02-01' as timestamp) loaded_at
from (
  select event_id, fraud, flagged, part, place, batch from found where l_orderkey % 10 > 0
  union all select event_id, not fraud, false, part, place + 1000000000, batch from found where l_orderkey % 13 = 0
  union all select 'orphan-' || o_orderkey, false, false, 0, o_orderkey, o_custkey % 100 from orders where o_orderkey % 500 = 0)
"""
_STG_LEDGER = """
select pipeline, cast(p_partkey as bigint) batch_id, status, 'zone/' || p_partkey source_prefix, cast('run' as varchar) run_id,
  cast('2026-02-01' as timestamp) + to_seconds(attempt) finished_at, if(status = 'failed', 'timeout', '') error_message
from (
  select p_partkey, unnest(['transactions', 'labels']) pipeline, if(p_size > 40, 'failed', 'success') status, p_size attempt from part
  union all select p_partkey, 'transactions', 'success', 100 from part where p_partkey % 3 = 0)
"""
_STG_MANIFEST = """
with counted as (
  select event_id // 100 batch, cast(ts as date) event_date, event_type source, count(*) n, count(*) filter (where event_id % 9 = 0) bad from events group by all),
turned as (select *, case batch % 7 when 3 then -1 when 5 then 0 else 1 end turn, if(batch % 7 = 4, 2, 1) times from counted)
select if(batch % 7 = 1, 'labels', 'transactions') pipeline, cast(batch as bigint) batch_id, event_date, source, cast(turn * n + if(batch % 7 = 2, 1, 0) as bigint) input_rows,
  cast(turn * (n - bad) as bigint) valid_rows, cast(turn * bad as bigint) quarantine_rows
from turned join range(2) copies(again) on again < times
"""
_PAYLOAD = "event_time, step, transaction_type, amount, origin_account, origin_balance_before, origin_balance_after, destination_account, destination_balance_before, destination_balance_after"
_PLACE = "kafka_topic, kafka_partition, kafka_offset, minio_batch_id, minio_object, loaded_at"


def _ranked(name: str, rows: str, pipeline: str, payload: str) -> str:
    return f"""
{name}_c as (select * from ({rows}) where minio_batch_id in (select batch_id from ledger where status = 'success' and pipeline = '{pipeline}')),
{name}_r as (
  select c.*, row_number() over (partition by source, event_id order by {_PLACE}, {payload}) canonical_rank, s.physical_row_count, s.payload_version_count
  from {name}_c c join (select source, event_id, count(*) physical_row_count, count(distinct row({payload})) payload_version_count from {name}_c group by all) s using (source, event_id))
"""


_MARTS = f"""
with ledger as ({_LEDGER}),
{_ranked("t", _TX, "transactions", _PAYLOAD)},
{_ranked("l", _LB, "labels", "is_fraud, is_flagged_fraud")},
tx as (
  select *, cast(event_time as date) event_date, kafka_partition canonical_kafka_partition, kafka_offset canonical_kafka_offset, minio_batch_id canonical_minio_batch_id,
    physical_row_count - 1 replay_row_count, payload_version_count > 1 has_payload_conflict, amount < 0 has_invalid_amount,
    origin_balance_before < 0 or origin_balance_after < 0 or destination_balance_before < 0 or destination_balance_after < 0 has_invalid_balance
  from t_r where canonical_rank = 1),
lb as (
  select *, kafka_partition canonical_kafka_partition, kafka_offset canonical_kafka_offset, minio_batch_id canonical_minio_batch_id,
    physical_row_count - 1 replay_row_count, payload_version_count > 1 has_payload_conflict
  from l_r where canonical_rank = 1),
labeled as (
  select tx.*, coalesce(lb.is_fraud, 0) is_fraud, lb.event_id is not null has_final_label, coalesce(lb.has_payload_conflict, false) has_label_payload_conflict
  from tx left join lb on lb.source = tx.source and lb.event_id = tx.event_id),
delta as (
  select *, cast(origin_balance_before - origin_balance_after as decimal(18,2)) origin_balance_delta, cast(destination_balance_after - destination_balance_before as decimal(18,2)) destination_balance_delta
  from labeled),
cand as (
  select source, event_id, event_time, event_date, step, transaction_type, amount, origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after,
    origin_balance_delta, destination_balance_delta, cast(abs(origin_balance_delta - amount) as decimal(18,2)) origin_amount_residual,
    cast(abs(destination_balance_delta - amount) as decimal(18,2)) destination_amount_residual, is_fraud, has_final_label, has_payload_conflict, has_label_payload_conflict,
    has_invalid_amount, has_invalid_balance,
    case when not has_final_label then 'missing_final_label' when has_payload_conflict then 'transaction_payload_conflict' when has_label_payload_conflict then 'label_payload_conflict'
      when has_invalid_amount then 'invalid_amount' when has_invalid_balance then 'invalid_balance' else 'eligible' end training_exclusion_reason
  from delta),
candidates as (select *, training_exclusion_reason = 'eligible' is_training_eligible from cand),
training as (
  select source, event_id, event_time, event_date, step, transaction_type, amount, origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after,
    origin_balance_delta, destination_balance_delta, origin_amount_residual, destination_amount_residual, is_fraud
  from candidates where is_training_eligible)
"""
_FACT = "source, event_id, event_time, event_date, step, transaction_type, amount, origin_account, destination_account, origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after, canonical_kafka_partition, canonical_kafka_offset, canonical_minio_batch_id, physical_row_count, replay_row_count, payload_version_count, has_payload_conflict, has_invalid_amount, has_invalid_balance"
_LABEL_FACT = "source, event_id, is_fraud, is_flagged_fraud, canonical_kafka_partition, canonical_kafka_offset, canonical_minio_batch_id, physical_row_count, replay_row_count, payload_version_count, has_payload_conflict"
_RANKED = "source, event_id, kafka_partition, kafka_offset, minio_batch_id, canonical_rank, physical_row_count, payload_version_count"
_METRICS = """
metrics as (
  select count(*) row_count, count(distinct row(t.source, t.event_id)) distinct_key_count, count(*) filter (where trim(t.source) = '' or trim(t.event_id) = '') empty_key_count,
    count(*) filter (where t.source is null or t.event_id is null or t.event_time is null or t.event_date is null or t.step is null or t.transaction_type is null or t.amount is null
      or t.origin_balance_before is null or t.origin_balance_after is null or t.destination_balance_before is null or t.destination_balance_after is null or t.origin_balance_delta is null
      or t.destination_balance_delta is null or t.origin_amount_residual is null or t.destination_amount_residual is null or t.is_fraud is null) null_count,
    count(*) filter (where t.source <> 'tpch') invalid_source_count,
    count(*) filter (where t.transaction_type not in ('CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER')) invalid_type_count, count(*) filter (where t.is_fraud not in (0, 1)) invalid_target_count,
    count(*) filter (where origin_balance_delta <> t.origin_balance_before - t.origin_balance_after or destination_balance_delta <> t.destination_balance_after - t.destination_balance_before
      or origin_amount_residual <> abs(origin_balance_delta - t.amount) or destination_amount_residual <> abs(destination_balance_delta - t.amount)) invalid_formula_count,
    count(*) filter (where f.event_id is null) missing_lineage_count
  from training t left join tx f on f.source = t.source and f.event_id = t.event_id)
"""
_REPLAY = """
with r as (select event_id id, row_number() over (order by event_id) row_number, cast(1 + event_id % 743 as int) step, event_type, value from events),
timed as (
  select *, row_number() over (partition by step order by row_number) - 1 ordinal, count(*) over (partition by step) rows_in_step from r),
replayed as (select *, 1767225600000 + (step - 1) * 3600000::bigint + (ordinal * 3600000) // rows_in_step event_time_ms from timed)
"""


def _money(x: str) -> str:
    return f"cast(trunc(cast(cast({x} as varchar) as decimal(38,17)) * 100) / 100 as decimal(18,2))"


_NAME = "'paysim-' || lpad(cast(row_number as varchar), 10, '0') event_id"
_COUNTED = """select {head} case when header is not null or bad then null else cast(event_time as date) end event_date,
  case when header is not null or bad or source is null or trim(source) = '' then 'unknown' else source end source, count(*) input_rows,
  count(*) filter (where reason = 'VALID') valid_rows, count(*) filter (where reason <> 'VALID') quarantine_rows from judged group by all"""

_SUITE = f"""{_MARTS},
stg_transactions as ({_TX}), stg_transaction_labels as ({_LB}), stg_ingestion_batches as ({_LEDGER}), stg_ingestion_batch_quality as ({_MANIFEST}),
committed_batches as (select pipeline, batch_id, max(finished_at) committed_at, count(*) success_attempts from ledger where status = 'success' group by all),
fct_transactions as (select * from tx), fct_transaction_labels as (select * from lb), fct_transactions_labeled as (select * from labeled), ml_training_candidates as (select * from candidates),
ml_training_transactions as (select * from training), ml_training_exclusion_summary as (select training_exclusion_reason, count(*) row_count from candidates group by 1)
"""


def _suite(parts: list[tuple[str, str, str]]) -> str:
    """Failures of (relation, column, condition)."""
    return _SUITE + " union all ".join(f"select '{r}' relation_name, '{c}' column_name, count(*) filter (where {bad}) failures from {r}" for r, c, bad in parts)


def _values(values: tuple) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


ORACLES: dict[str, str] = {
    "envelope_inspect": f"""with {_RAW} select n "offset", case header when 'NULL_KAFKA_VALUE' then null when 'INVALID_CONFLUENT_MAGIC_BYTE' then 1 else 0 end::bigint magic_byte,
        case header when 'NULL_KAFKA_VALUE' then null when 'CONFLUENT_MESSAGE_TOO_SHORT' then 0 when 'INVALID_CONFLUENT_MAGIC_BYTE' then 1 when 'UNSUPPORTED_SCHEMA_ID' then 99 else schema_id end::bigint message_schema_id,
        case header when 'NULL_KAFKA_VALUE' then null when 'CONFLUENT_MESSAGE_TOO_SHORT' then 3 when 'INVALID_CONFLUENT_MAGIC_BYTE' then 7 when 'UNSUPPORTED_SCHEMA_ID' then 7 end::bigint value_size,
        coalesce(header, 'OK') reason from judged""",
    "validation_reasons": f'with {_RAW} select n "offset", reason from judged',
    "reason_counts": f"with {_RAW} select reason, count(*) row_count from judged group by 1",
    "label_validation": f'with {_RAW_LABELS} select n "offset", reason from judged',
    "quarantine_rows": f"with {_RAW} select reason quarantine_reason, cast(n % 3 as int) kafka_partition, n kafka_offset, base64(cast(n as varchar)::blob) kafka_key_base64, cast(ts as date) kafka_date from judged where reason <> 'VALID'",
    "schema_versions": """with e as (select event_id n, event_type, value, cast(floor(epoch_us(ts) / 1000.0) as bigint) ms, event_id % 50 = 7 bad, event_id % 3 v from events)
        select n "offset", v + 11 message_schema_id, case when bad then 'AVRO_DECODE_FAILED' when v = 0 then 'MISSING_INGESTED_AT' when n % 53 < 1 then 'INVALID_STEP' else 'VALID' end reason,
          case when not bad then cast(n as varchar) end event_id, case when not bad then event_type end source, case when not bad then cast(n % 53 as int) end step,
          case when bad then null when v = 0 then 'DEBIT' when v = 1 then 'PAYMENT' else 'TRANSFER' end "type",
          case when bad then null when v = 0 then cast(cast(value as float) as double) when v = 1 then floor(value) else value end amount,
          case when bad then null when v = 2 then 'C' else '-' end nameOrig, case when bad then null when v = 2 then value else 0.0 end oldbalanceOrg, case when bad then null when v = 2 then value else 0.0 end newbalanceDest,
          case when not bad then ms end event_time_ms, case when bad or v = 0 then null else ms + 1000 * v end ingested_at_ms from e""",
    "dq_suite_not_null": _suite([(r, c, f"{c} is null") for r, s in SUITES.items() for c in s.not_null]),
    "dq_suite_accepted_values": _suite([(r, c, f"{c} not in ({_values(v)})") for r, s in SUITES.items() for c, v in s.accepted.items()]),
    "quarantine_replay": f"with {_RAW} select reason, count(*) row_count from judged where reason <> 'VALID' group by 1",
    "quality_manifest": f"with {_RAW} " + _COUNTED.format(head="'transactions' pipeline, 7::bigint batch_id,"),
    "landing_stream": f"with {_RAW} " + _COUNTED.format(head=""),
    "landing_offsets": f"with {_RAW} " + _COUNTED.format(head=""),
    "label_manifest": f"""with {_RAW_LABELS} select 'labels' pipeline, 7::bigint batch_id, null::date event_date, case when reason = 'AVRO_DECODE_FAILED' then 'unknown' else source end source, count(*) input_rows,
        count(*) filter (where reason = 'VALID') valid_rows, count(*) filter (where reason <> 'VALID') quarantine_rows from judged group by all""",
    "valid_rows": f"with {_RAW} select cast(n as varchar) event_id, source, cast(n % 53 as int) step, value amount, cast(event_time as date) event_date, schema_id::bigint message_schema_id, n kafka_offset from judged where reason = 'VALID'",
    "manifest_reconcile": f"""with {_SUMMARY} select dir, case when manifest_rows = 0 or input_rows = 0 then 'EMPTY_MANIFEST' when identity_errors > 0 then 'IDENTITY_MISMATCH' when reconciliation_errors > 0 then 'ROW_NOT_RECONCILED'
        when negative_counts > 0 then 'NEGATIVE_COUNT' when duplicate_keys > 0 then 'DUPLICATE_KEY' when input_rows <> valid_rows + quarantine_rows then 'TOTALS_NOT_RECONCILED' else 'OK' end reason from summary""",
    "manifest_summary": f"with {_SUMMARY} select * from summary",
    "count_check": f"""with {_SUMMARY}, found as ({fx.duckdb(fx.FILE_COUNTS)}) select s.dir, s.valid_rows, coalesce(f.rows_found, 0) rows_found, s.valid_rows = 0 or s.valid_rows = coalesce(f.rows_found, 0) count_matches from summary s left join found f on f.dir = s.dir""",
    "loaded_batches": f"select pipeline, batch_id from ({_LEDGER}) group by all having count(*) filter (where status = 'success') > 0",
    "pending_batches": f"""select * from (select 'transactions' pipeline, p_partkey batch_id from part union all select 'labels', p_partkey from part) d
        where not exists (select 1 from ({_LEDGER}) l where l.pipeline = d.pipeline and l.batch_id = d.batch_id and l.status = 'success') order by pipeline, batch_id limit 200""",
    "typed_load_transactions": f"""select event_id, source, event_time, cast(step % 65536 as int) step, type transaction_type, {_money("amount")} amount, nameOrig origin_account, {_money("oldbalanceOrg")} origin_balance_before,
        {_money("newbalanceOrig")} origin_balance_after, nameDest destination_account, {_money("oldbalanceDest")} destination_balance_before, {_money("newbalanceDest")} destination_balance_after,
        message_schema_id schema_id, kafka_topic, kafka_partition, kafka_offset, batch minio_batch_id from ({fx.duckdb(fx.LANDED_TRANSACTIONS)})""",
    "typed_load_labels": f"select event_id, source, cast(isFraud % 256 as int) is_fraud, isFlaggedFraud is_flagged_fraud, message_schema_id schema_id, kafka_topic, kafka_partition, kafka_offset, batch minio_batch_id from ({fx.duckdb(fx.LANDED_LABELS)})",
    "stg_transactions": _STG_TX,
    "stg_transaction_labels": _STG_LB,
    "stg_ingestion_batches": _STG_LEDGER,
    "stg_ingestion_batch_quality": _STG_MANIFEST,
    "committed_batches": f"select pipeline, batch_id, max(finished_at) committed_at, count(*) success_attempts from ({_LEDGER}) where status = 'success' group by all",
    "transactions_ranked": f"{_MARTS} select {_RANKED} from t_r",
    "labels_ranked": f"{_MARTS} select {_RANKED} from l_r",
    "fct_transactions": f"{_MARTS} select {_FACT} from tx",
    "fct_transaction_labels": f"{_MARTS} select {_LABEL_FACT} from lb",
    "fct_transactions_labeled": f"{_MARTS} select {_FACT}, is_fraud, has_final_label, has_label_payload_conflict from labeled",
    "ml_training_candidates": f"{_MARTS} select * from candidates",
    "ml_training_transactions": f"{_MARTS} select * from training",
    "ml_training_exclusion_summary": f"{_MARTS} select training_exclusion_reason, count(*) row_count from candidates group by 1",
    "dq_not_null": f"""with {_RAW}, d as (select * from judged where header is null)
        select 'event_id' column_name, count(*) filter (where bad) failures from d union all select 'source', count(*) filter (where bad or source is null) from d
        union all select 'event_time', count(*) filter (where bad or event_time is null) from d union all select 'ingested_at', count(*) filter (where bad or taken is null) from d
        union all select 'step', count(*) filter (where bad) from d union all select 'amount', count(*) filter (where bad or value is null) from d""",
    "dq_accepted_values": f"select transaction_type \"value\", count(*) failures from ({_TX}) where transaction_type not in ('CASH_IN', 'DEBIT', 'PAYMENT') group by 1",
    "dq_business_keys": f"with {_RAW} select 'events' relation_name, source, cast(n as varchar) event_id from judged where header is null and not bad and trim(source) = ''",
    "dq_orphan_labels": f"{_MARTS} select source, event_id from lb where not exists (select 1 from tx where tx.source = lb.source and tx.event_id = lb.event_id)",
    "dq_reconciles": f"select pipeline, batch_id, event_date, source, input_rows, valid_rows, quarantine_rows from ({_MANIFEST}) where input_rows <> valid_rows + quarantine_rows",
    "dq_candidate_partition": f"{_MARTS} select source, event_id from candidates where step = 1",
    "contract_metrics": f"{_MARTS}, {_METRICS} select * from metrics",
    "contract_violations": f"""{_MARTS}, {_METRICS} select 'duplicate_key_count' metric, row_count - distinct_key_count "value", row_count = distinct_key_count ok from metrics"""
    + "".join(f" union all select '{m}', {m}, {m} = 0 from metrics" for m in ("empty_key_count", "null_count", "invalid_source_count", "invalid_type_count", "invalid_target_count", "invalid_formula_count", "missing_lineage_count"))
    + " union all select 'row_count', row_count, row_count > 0 from metrics",
    "replay_event_time": f"{_REPLAY} select id, row_number, step, ordinal, rows_in_step, event_time_ms from replayed",
    "replay_events": f"{_REPLAY} select {_NAME}, 'paysim' source, event_time_ms, step, event_type \"type\", value amount from replayed where row_number > 100 and row_number <= 100100",
    "replay_events_whole": f"{_REPLAY} select {_NAME}, 'paysim' source, event_time_ms, step, event_type \"type\", value amount from replayed",
    "replay_labels": f"{_REPLAY} select {_NAME}, 'paysim' source, cast(id % 2 as int) isFraud, 0 isFlaggedFraud from replayed",
    "replay_messages": f"{_REPLAY} select {_NAME}, step, event_time_ms, 2::bigint schema_id from replayed",
    "temporal_split": f"""{_REPLAY} select id, case when event_time_ms < 1769025600000 then 'train' when event_time_ms < 1769457600000 then 'validation' when event_time_ms < 1769900400000 then 'test' end split from replayed""",
    "feature_set_baseline": f"{_MARTS} select source, event_id, event_time, event_date, step, transaction_type, amount, origin_balance_before, destination_balance_before, is_fraud from training",
    "feature_set_challenger": f"{_MARTS} select source, event_id, event_time, event_date, step, transaction_type, amount, origin_balance_before, origin_balance_after, destination_balance_before, destination_balance_after, origin_balance_delta, destination_balance_delta, origin_amount_residual, destination_amount_residual, is_fraud from training",
    "warehouse_buckets": f"{_MARTS} select {_FACT}, is_fraud, has_final_label, has_label_payload_conflict from labeled",
    "warehouse_months": f"""select strftime(event_time, '%Y%m') event_month, count(*) row_count, cast(sum(amount) as decimal(28,2)) amount, count(*) filter (where amount < 0) negative from ({_TX})
        where strftime(event_time, '%Y%m') between '199512' and '199602' and (strftime(event_time, '%Y%m') <> '199601' or amount >= 0) group by 1""",
    "mart_build": f"""{_MARTS}, {_METRICS} select 'fct_transactions' model, 'rows' "name", count(*) "value" from tx union all select 'fct_transaction_labels', 'rows', count(*) from lb
        union all select 'ml_training_candidates', 'rows', count(*) from candidates union all select 'ml_training_exclusion_summary', training_exclusion_reason, count(*) from candidates group by 2
        union all select 'contract', 'duplicate_key_count', row_count - distinct_key_count from metrics"""
    + "".join(f" union all select 'contract', '{m}', {m} from metrics" for m in ("row_count", "empty_key_count", "null_count", "invalid_source_count", "invalid_type_count", "invalid_target_count", "invalid_formula_count", "missing_lineage_count")),
    "warehouse_partition_layout": f"select strftime(event_time, '%Y%m') event_month, count(*) row_count, count(distinct row(source, event_id)) \"keys\" from ({_TX}) group by 1",
}
# The length of a framed record is known to Spark only; it is left out where the record is whole.
