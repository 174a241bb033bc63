"""Queries of uploads, page windows, sinks and the smaller monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators import aggregates as A
from docgauge.plans.catalog import query
from docgauge.sources import tables as S
from docgauge.sources.scratch import shared_folder
from docgauge.sources.tables import table

# an order is an archive, a line item an entry of it; the name cycles through what archives hold
ENTRY = (
    "case (k + n) % 9 when 0 then concat('Appraisal/a', cast(n as varchar(9)), '.pdf') when 1 then concat('Engagement/e', cast(n as varchar(9)), '.PDF') when 2 then '__MACOSX/appraisal/._a.pdf' when 3 then 'contract/c.pdf' "
    "when 4 then 'eagagement/' when 5 then 'notes/readme.txt' when 6 then 'other/x.pdf' when 7 then case when k % 5 = 0 then '../appraisal/a.pdf' else 'order/o.pdf' end else 'appraisal/.DS_Store' end"
)
ENTRIES = f"with e as (select k as path, {ENTRY} as entry from (select l_orderkey as k, l_linenumber as n from lineitem)), t as (select path, entry, entry[-1:] = '/' as is_folder, (entry like '__MACOSX%' or entry like '%.DS_Store') as debris from e)"
KIND = "case when not debris and not is_folder and lower(entry) like '%.pdf' then case when lower(entry) like '%appraisal%' then 'APPRAISAL' when lower(entry) like '%engagement%' or lower(entry) like '%order%' then 'ENGAGEMENT' when entry like 'contract%' then 'CONTRACT' end end"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return rows.select(F.col("k").alias("path"), F.expr(ENTRY).alias("entry")).withColumn("is_folder", F.endswith("entry", F.lit("/")))


@query(f"""{ENTRIES}, v as (select path, count(*) as entries, count({KIND}) as files, bool_or(contains(entry, '..')) as climbs, bool_or(coalesce({KIND} = 'APPRAISAL', false)) as a, bool_or(coalesce({KIND} = 'ENGAGEMENT', false) or entry = 'eagagement/') as g from t group by 1),
 r as (select *, case when entries > 6 then 'too many entries' when climbs then 'invalid path' when not (a and g) then 'requires appraisal and engagement folders' when files = 0 then 'no valid PDF files' end as error from v)
 select path, entries, files, case when error is null then 'UPLOADED' else 'VALIDATION_FAILED' end as status, error from r""")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that are taken, and why others are not."""
    return S.upload_verdicts(entries(spark, sf_dir), most=6)


@query(f"{ENTRIES} select path, entry, regexp_extract(entry, '[^/]*$') as filename, {KIND} as file_type from t where {KIND} is not null")
def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of known type in all archives."""
    return S.upload_files(entries(spark, sf_dir))


@query("""with p as (select conv_id, turn, text from conversations), w as (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as text from p where turn between 1 and 2 group by 1),
 b as (select conv_id, sum(case when turn < 1 then length(coalesce(text, '')) + 1 else 0 end) as n from p group by 1)
 select conv_id, md5(coalesce(w.text, '')) as text_md5, case when w.text is null then 0 else cast(n as bigint) end as start from b left join w using (conv_id)""")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's second and third turn as one text, and where it begins."""
    w = S.page_window(table(spark, sf_dir, "conversations"), 1, 2, "conv_id", "turn")
    return w.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("offset").cast("long").alias("start"))


@query("select conv_id, count(*) as n from conversations where turn <= 2 group by 1")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns up to the third of every conversation."""
    return S.first_pages(table(spark, sf_dir, "conversations"), 2, "turn").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("select doc_id, md5(coalesce(text, '')) as text_md5 from documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as bytes with broken ones among them, decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    broken = F.concat(F.unhex(F.lit("FF")), F.col("b"), F.unhex(F.lit("C3")))
    return docs.select("doc_id", F.md5(S.decoded(broken).cast("binary")).alias("text_md5"))


@query("""select p_partkey, unnest([{'field_name': 'zip_code', 'field_value': p_brand, 'confidence': round(least(1e0, m + 1e-1), 3)}, {'field_name': 'legal_description', 'field_value': case when p_size > 20 then p_name end, 'confidence': case when p_size > 20 then round(greatest(0e0, m - 1e-1), 3) else 0e0 end},
 {'field_name': 'county', 'field_value': p_type, 'confidence': round(m, 3)}], recursive := true) from (select *, case when p_size % 3 = 0 then 7e-1 else p_size / 5e1 end as m from part)""")
def fields_with_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every part with the confidence of their class."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("zip_code"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("legal_description"), F.col("p_type").alias("county"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / F.lit(50.0)).alias("m"))
    return S.fields_with_confidence(p, "p_partkey", ["zip_code", "legal_description", "county"], "m").drop("method")


@query("select doc_id, quality, toxic from labels")
def training_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels after a way through csv."""
    path = f"{shared_folder(spark)}/labels.csv"
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    S.write_training(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(path)


@query("""select '| status | files |' as line union all select '|---|---|' union all select concat('| ', o_orderstatus, ' | ', count(*), ' |') from orders group by o_orderstatus""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per status as a Markdown table."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("files"))
    return S.markdown_table(rows, ["status", "files"], ["status"])


@query("select count(*) as created_today, count_if(event_type = 'purchase') as processed_today from events where cast(ts as date) = date '2024-01-30'")
def counts_of_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one as-of day and those among them that were processed."""
    e = table(spark, sf_dir, "events").where(A.on_day(F.col("ts"), "2024-01-30 12:00:00"))
    return A.conditional_counts(e, created_today=F.lit(True), processed_today=F.col("event_type") == "purchase")


@query("select nullif(event_type, 'error') as version, round(avg(value), 6) as avg_value, count(*) as n from events where event_type <> 'error' group by 1")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per model version; errors have none."""
    e = table(spark, sf_dir, "events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("version"), "value")
    return A.version_stats(e, "version", "value").withColumn("avg_value", F.round("avg_value", 6))


@query("""select count(*) as total, count_if(o_orderstatus = 'O') as running, count_if(o_orderstatus = 'F') as completed from (select o_orderstatus from orders order by o_totalprice desc, o_orderkey limit 50 offset 100)""")
def batch_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the third page of batches."""
    s = F.col("o_orderstatus")
    return A.page_stats(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 50, running=s == "O", completed=s == "F")


@query("""with a as (select user_id, count_if(event_type = 'purchase') as ok, count_if(event_type = 'error') as bad, count_if(event_type = 'click') as fixed, max(case when event_type <> 'click' then ts end) as last, bool_or(event_type not in ('purchase', 'error', 'click')) as act from events group by 1)
 select c_custkey, 1 + coalesce(ok, 0) as files_processed, coalesce(bad, 0) as files_failed, coalesce(fixed, 0) as corrections_made, greatest(timestamp '2024-01-01 00:00:00', last) as last_active_at, case when act then 'ACTIVE' else 'IDLE' end as status
 from customer left join a on user_id = c_custkey""")
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's session with what the events of a user of its number add."""
    kinds = F.when(F.col("event_type") == "purchase", "FILE_OK").when(F.col("event_type") == "error", "FILE_FAILED").when(F.col("event_type") == "click", "CORRECTION").otherwise("ACTIVITY")
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_token"), "ts", kinds.alias("action"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("last_active_at")
    zero = F.lit(0).cast("long")
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_token"), F.lit(1).cast("long").alias("files_processed"), zero.alias("files_failed"), F.lit(None).cast("long").alias("corrections_made"), start, F.lit("IDLE").alias("status"))
    return A.session_counters(sessions, actions).withColumnRenamed("session_token", "c_custkey")
