"""Queries of what is kept: boxes of a page, a buffer of the latest rows, learned corrections, stored models and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators import boxes as B
from docgauge.plans import models, training
from docgauge.plans.catalog import query
from docgauge.sources import tables
from docgauge.sources.scratch import dropped, shared_folder, written
from docgauge.sources.tables import spread, table
from docgauge.streaming import learning

BOX = "l_orderkey, l_linenumber, cast(l_partkey % 30 * 3 as double) as x, cast(l_suppkey % 30 * 3 as double) as y, 20e0 as w, 2e1 + l_linenumber as h, cast(l_quantity % 5 as double) as score"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order, a box per line number; of a line's repeats the least box by corner, then score, counts."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[c.strip() for c in BOX.split(",")])
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("x", "y", "score", "w", "h")).alias("b")).select("l_orderkey", "l_linenumber", *[f"b.{c}" for c in ("x", "y", "w", "h", "score")])


def _loop(order: str, near: str) -> str:
    """SQL of a plain loop over each page's boxes in order."""
    return f"""with recursive boxes as (select distinct on (l_orderkey, l_linenumber) {BOX} from lineitem order by l_orderkey, l_linenumber, x, y, score
), placed as (select *, row_number() over (partition by l_orderkey order by {order}, l_linenumber) as i from boxes
), loop as (
  select l_orderkey, 0::bigint as i, []::struct(x double, y double, w double, h double)[] as kept, null::integer as line, null::boolean as keep from (select distinct l_orderkey from boxes)
  union all
  select p.l_orderkey, p.i, case when len(list_filter(l.kept, lambda b: {near})) = 0 then list_append(l.kept, {{'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h}}) else l.kept end, p.l_linenumber, len(list_filter(l.kept, lambda b: {near})) = 0
  from loop l join placed p on p.l_orderkey = l.l_orderkey and p.i = l.i + 1
) select l_orderkey, line as l_linenumber, keep as kept from loop where i > 0"""


SHARED = "greatest(0e0, least(b.x + b.w, p.x + p.w) - greatest(b.x, p.x)) * greatest(0e0, least(b.y + b.h, p.y + p.h) - greatest(b.y, p.y))"


@query(_loop("score desc", f"{SHARED} / (b.w * b.h + p.w * p.h - {SHARED}) > 3e-1"))
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every page that survive those of higher score."""
    return B.suppressed(boxes(spark, sf_dir), ["l_orderkey"], "l_linenumber", ["score"]).select("l_orderkey", "l_linenumber", "kept")


@query(_loop("x * 10000 + y", "abs(b.x - p.x) < 15 and abs(b.y - p.y) < 15"))
def distinct_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every page that don't begin where another one does."""
    return B.distinct_boxes(boxes(spark, sf_dir), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "kept")


@query("select event_id, ts, value from events order by ts desc, event_id desc limit 1000")
def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of all events through a buffer of the latest thousand."""
    root = shared_folder(spark)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "ts", "value")
    learning.ring_buffer(stream, f"{root}/buffer", f"{root}/checkpoint", 1000).awaitTermination()
    return learning.buffered(spark, f"{root}/buffer")


@query("""with learned as (select event_type as wrong, max_by(cast(event_id as varchar), event_id) as correction from events group by 1)
 select o_orderkey, replace(o_orderpriority || ' view of a click', 'view', (select correction from learned where wrong = 'view')) as half,
 replace(replace(o_orderpriority || ' view of a click', 'view', (select correction from learned where wrong = 'view')), 'click', (select correction from learned where wrong = 'click')) as text from orders""")
def learned_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after the corrections that people reported; events are reports that a text of their kind should be their id."""
    e = table(spark, sf_dir, "events")
    told = e.select(F.col("event_id").alias("id"), F.lit("OCR_ERROR").alias("original_status"), F.col("event_type").alias("original_value"), F.col("event_id").cast("string").alias("corrected_value"))
    pairs = [(r["wrong"], r["right"]) for r in learning.learned(told).orderBy("place").limit(learning.MOST_CORRECTIONS).collect()]
    text = F.concat("o_orderpriority", F.lit(" view of a click"))
    return table(spark, sf_dir, "orders").select("o_orderkey", learning.corrected(text, [p for p in pairs if p[0] == "view"]).alias("half"), learning.corrected(text, pairs).alias("text"))


@query()
def stored_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a stored commentary classifier: fitted on the whole texts of all with a quality label but a held-out fifth, saved, found again, loaded."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = docs.join(labels, "doc_id").where("quality is not null").select("doc_id", "text", F.when(F.col("quality") == 0, "CANNED").otherwise("SPECIFIC").alias("label"))
    # stored, as fitting reads the rows some eight times
    rows = written(spread(labelled, "doc_id").select("text", "label"))
    model, _ = training.commentary_classifier(rows)
    dropped(rows)
    path = f"{shared_folder(spark)}/commentary"
    if model is not None:
        models.save(spark, model, path)
    return models.scored(spread(docs.select("doc_id", "text"), "doc_id"), path).groupBy("label", "model_version").agg(F.count("*").alias("n"))


@query("""select 'results' as sink, o_orderkey % 7 as batch_id, count(*) as n, count_if(l_returnflag <> 'N') as looks from orders join lineitem on l_orderkey = o_orderkey group by 2
 union all select 'audit', o_orderkey % 7, count(distinct o_orderkey), 0 from orders join lineitem on l_orderkey = o_orderkey group by 2""")
def replaced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and audit rows of every order, stored batch by batch, and one batch stored again."""
    o, path = table(spark, sf_dir, "orders"), f"{shared_folder(spark)}/store"
    status = F.when(F.col("l_returnflag") == "N", "pass").when(F.col("l_returnflag") == "R", "manual pass").otherwise("fail")
    one = F.struct(F.col("l_linenumber").cast("string").alias("rule_id"), status.alias("status"), F.lit(None).cast("string").alias("severity"), F.lit("field").alias("field"), F.col("l_linestatus").alias("value"), F.col("l_tax").alias("confidence"), F.col("l_linenumber").alias("page"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(one).alias("results"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("batch_id"), F.col("o_orderdate").alias("finished_at")).join(lines, "doc_id")
    tables.store_documents(docs, path)
    tables.store_documents(docs.where("batch_id = 3"), path)
    results, audit = (spark.read.parquet(f"{path}/{n}") for n in ("results", "audit"))
    count = lambda df, n, looks: df.groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count("*").alias("n"), looks.alias("looks")).select(F.lit(n).alias("sink"), "batch_id", "n", "looks")
    return count(results, "results", F.count_if("needs_verification")).unionByName(count(audit, "audit", F.lit(0).cast("long")))
