"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import centroids, decontamination, embeddings, hard_negatives, jaccard_join, langid, licenses, mixing, quality, secrets, sentencepiece, substring, token_counts
from lakeaudit.llm.lattice import Vocabulary

#: The vocabulary that the queries use.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Of the ids, those with this remainder of crc32 modulo FOLDS are held out.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), Vocabulary.load(MODEL))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load(MODEL)
    # Each text is decoded where it was encoded, so that its ids go through Python once.
    encoded = sentencepiece.encode(table(spark, sf_dir, "documents"), vocabulary, all_ids=True)
    return encoded.select("doc_id", "n_tokens", "ids", "nbest_scores", "nbest_tokens", "nbest_ids", "decoded_equal")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
    return quality.quality_rules(docs, model).select(*base)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "rep_id", "n_copies", "n_links", "class_id", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    model = langid.train(docs, F.coalesce(remainder != 0, F.lit(False)))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: x["lang"]).alias("languages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs))
    base, added = F.col("secrets.base"), F.col("secrets.added")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.array_sort(F.concat(base, added))).alias("spans"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    parts = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string")))
    return found.withColumn("spans", F.concat_ws(",", parts))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
with recursive w as (select doc_id, {_WORDS} w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[])
      when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) s
  from w),
sets as (select doc_id, len(s) n, s, md5(array_to_string(list_sort(s), '|')) k from s),
cls as (select k, n, min(doc_id) rep, count(*) copies, any_value(s) s from sets where n > 0 group by k, n),
t as (select rep, n, unnest(s) g from cls),
common as (select a.rep a, b.rep b, a.n na, b.n nb, count(*) c from t a join t b on a.g = b.g and a.rep < b.rep group by all),
pairs as (select a, b from common where c / (na + nb - c) >= 0.8),
both_ways as (select a, b from pairs union all select b, a from pairs),
reach as (select rep a, rep b from cls union select r.a, p.b from reach r join both_ways p on r.b = p.a),
comp as (select a, min(b) class_id from reach group by a),
links as (select p.a, sum(c.copies) l from both_ways p join cls c on c.rep = p.b group by p.a)
select x.doc_id, cast(x.n as bigint) n_shingles, coalesce(c.rep, x.doc_id) rep_id, cast(coalesce(c.copies, 1) as bigint) n_copies,
  cast(coalesce(c.copies - 1 + coalesce(l.l, 0), 0) as bigint) n_links, coalesce(m.class_id, x.doc_id) class_id, coalesce(m.class_id, x.doc_id) = x.doc_id kept
from sets x left join cls c on c.k = x.k and c.n = x.n left join links l on l.a = c.rep left join comp m on m.a = c.rep
"""

OP7_SQL = r"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
src as (
  select source, cast(sum(size) as bigint) source_size, 1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 weight,
    row_number() over (order by encode(source) nulls last) o
  from d group by source),
capped as (select *, 3.0 * source_size cap, 3.0 * source_size / weight stop from src),
levels as (
  select *, (sum(source_size) over () - (sum(cap) over up - cap)) / (sum(weight) over () - sum(weight) over up + weight) level
  from capped window up as (order by stop, o rows unbounded preceding)),
goal as (
  select source, source_size, o, cast(case when stop <= (select max(level) from levels) then cap
      else weight * (select max(level) from levels) end as double) target from levels),
e as (
  select d.*, g.source_size, g.target, g.o,
    cast(case when g.source_size > 0 then round(g.target / g.source_size * 4294967296.0) else 0 end as bigint) expected,
    cast(('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8)) as bigint) off
  from d join goal g on d.source is not distinct from g.source),
r as (select *, cast(sum(expected) over (partition by o order by size, md5(cast(doc_id as varchar)), doc_id rows unbounded preceding) as hugeint) + off upto from e)
select doc_id, size, source_size, target, cast((upto // 4294967296 - (upto - expected) // 4294967296) * size as bigint) taken from r
"""

OP9_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) e, row_number() over () r from embeddings),
good as (
  select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
u as (select vec_id, r, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) e from good),
pairs as (select a.vec_id a, b.vec_id b from u a join u b on a.r <> b.r where list_dot_product(a.e, b.e) >= 0.9),
reach as (select vec_id a, vec_id b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
comp as (select a, min(b) component_id from reach group by a),
n as (select a, count(*) n from pairs group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) n_links, c.component_id, v.vec_id = c.component_id kept
from v join comp c on c.a = v.vec_id left join n on n.a = v.vec_id
"""

OP10_SQL = rf"""
with w as (select doc_id, {_WORDS} w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i+49], ' ')) h from w, unnest(range(1, len(w) - 48)) t(i) where len(w) >= 50),
low as (select h, min(doc_id) d from win group by h),
hit as (select win.doc_id, win.i from win join low using (h) where low.d < win.doc_id),
gone as (select distinct doc_id, i + k p from hit, unnest(range(0, 50)) t(k)),
words as (select doc_id, i p, w[i] x from w, unnest(range(1, len(w) + 1)) t(i)),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) t, count(*) n from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id)
select w.doc_id, cast(len(w.w) as bigint) n_words, cast(len(w.w) - coalesce(kept.n, 0) as bigint) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""


def _moved(i: int) -> str:
    """The centroids after a round, from those before: floor division of sums, which SQL truncates."""
    return f"""
a{i} as (select v.vec_id, v.q, v.r, arg_min(c.n, (list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.n)) n from v cross join c{i} c group by all),
s{i} as (select n, p, sum(x) s, count(*) k from (select n, unnest(q) x, generate_subscripts(q, 1) p from a{i}) group by n, p),
m{i} as (select n, list(cast((s - ((s % k) + k) % k) // k as bigint) order by p) c from s{i} group by n),
c{i + 1} as (select c.n, coalesce(m.c, c.c) c from c{i} c left join m{i} m on m.n = c.n)"""


OP11_SQL = f"""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) x, row_number() over () r from embeddings),
v as (select vec_id, r, list_transform(x, lambda y: cast(floor(64 * y) as bigint)) q from e where len(x) = 64 and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0),
c0 as (select row_number() over (order by sha256('1:' || cast(vec_id as varchar)), q) - 1 n, q c from v qualify n < 16),
{_moved(0)},{_moved(1)},{_moved(2)},
d as (select v.vec_id, v.r, c.n, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v cross join c3 c),
b as (select vec_id, r, arg_min(n, (d, n)) n, min(d) d from d group by vec_id, r)
select vec_id, cast(b.n as int) "cluster", cast(d as bigint) distance, cast(sum(d) over (partition by b.n) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: cast(x as varchar)), ',')) centroid_sha256
from b join c3 c on c.n = b.n
"""

_LOWER_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = rf"""
with i as (select item_id, {_LOWER_WORDS} w from benchmark),
win as (select distinct item_id, least(len(w), 10) n, array_to_string(w[k:k+9], ' ') t from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) x(k) where len(w) > 0),
d as (select doc_id, row_number() over () r, {_LOWER_WORDS} w from documents),
places as (select r, k, n, array_to_string(w[k:k+n-1], ' ') t from d, (select distinct n from win) l, unnest(range(1, len(w) - n + 2)) x(k) where len(w) >= n),
hit as (select r, k, places.n, item_id from places join win on win.n = places.n and win.t = places.t),
covered as (select r, count(distinct k + j) n_hit from hit, unnest(range(0, n)) x(j) group by r),
listed as (select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct r, cast(item_id as varchar) item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered on covered.r = d.r left join listed on listed.r = d.r
"""

OP13_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(x as double)) x, row_number() over () r from embeddings where label is not null and embedding is not null),
v as (select vec_id, label, r, list_transform(x, lambda y: cast(floor(256 * y) as bigint)) q from e where len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0),
s as (
  select a.r ar, a.vec_id anchor_id, a.label = b.label same, b.vec_id, b.r, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) score
  from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r),
p as (select ar, anchor_id, vec_id positive_id, r pr, score positive_score from s where same qualify row_number() over (partition by ar order by score desc, vec_id, r) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as int) "rank", s.vec_id negative_id, positive_score, s.score negative_score
from p join s on s.ar = p.ar and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
window w as (partition by p.ar, p.pr order by s.score desc, s.vec_id, s.r)
qualify row_number() over w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_quality_rules, op4_jaccard_join, op5_language_id, op6_secret_scan, op7_mix_sources, op8_license_scan, op9_near_vectors, op10_substring_dedup, op11_centroid_clusters, op12_decontaminate, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4_SQL, "op7_mix_sources": OP7_SQL, "op9_near_vectors": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_centroid_clusters": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_hard_negatives": OP13_SQL}
