"""The library's queries over the stand-in tables, each with the DuckDB SQL that must give the same rows.

Stand-ins: events are processing metrics, sessions and audit rows; orders are batches, lineitem rows their files and rule
results; customers and nations are clients; suppliers are reviewers; documents and conversations are page texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions import commentary, numeric
from docgauge.functions import text as T
from docgauge.functions.dates import parse_date
from docgauge.functions.documents import address_parts, ladder
from docgauge.operators import aggregates as A
from docgauge.operators import decisions as D
from docgauge.operators import ordered as O
from docgauge.operators import relational as R
from docgauge.operators import tables as P
from docgauge.operators import transitions as X
from docgauge.plans import fields, rules
from docgauge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"


def now() -> Column:
    """The queries' fixed as-of time; a function, as columns need a session."""
    return F.expr(f"timestamp_ntz'{AS_OF}'")


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


# ---- dashboards and monitoring


@query(f"""select cast(ts as date) as day, floor(avg(value) * 1e1 + 5e-1) / 1e1 as avg_value,
 floor(count_if(event_type = 'purchase') * 1e2 / count(*) * 1e1 + 5e-1) / 1e1 as hit_pct, count(*) as n
 from events where ts >= timestamp '{AS_OF}' - interval 30 day group by 1""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_trend(A.since(table(spark, sf_dir, "events"), "ts", AS_OF, 30), "ts", "value", F.col("event_type") == "purchase")


@query(f"""select count(*) as files, coalesce(floor(avg(value) / 1e3 * 1e1 + 5e-1) / 1e1, 0e0) as avg_seconds,
 floor(count_if(event_type = 'click') * 1e2 / count(*) * 1e1 + 5e-1) / 1e1 as cache_hit_pct,
 floor(count_if(event_type = 'purchase') * 1e2 / count(*) * 1e1 + 5e-1) / 1e1 as pass_pct
 from events where ts >= timestamp '{AS_OF}' - interval 20 day""")
def overview_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(A.since(table(spark, sf_dir, "events"), "ts", AS_OF, 20), "value", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query("select coalesce(event_type, 'unknown') as event_type, count(*) as n from events group by 1")
def method_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(table(spark, sf_dir, "events"), "event_type")


@query("""with c as (select count_if(o_orderstatus = 'P') p, count_if(o_orderstatus = 'O') o, count_if(o_orderstatus = 'F') f from orders)
 select p as n_p, o as n_o, f as n_f, floor(p * 1e2 / (p + o + f) * 1e1 + 5e-1) / 1e1 as pct_p, floor(o * 1e2 / (p + o + f) * 1e1 + 5e-1) / 1e1 as pct_o, floor(f * 1e2 / (p + o + f) * 1e1 + 5e-1) / 1e1 as pct_f from c""")
def decision_breakdown_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.breakdown(table(spark, sf_dir, "orders"), "o_orderstatus", ["P", "O", "F"])


@query("select user_id, round(avg(value), 4) as avg_latency, count(*) as decisions from events where event_type = 'click' group by 1 having count(*) >= 10")
def latency_by_user_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.latency_by_actor(table(spark, sf_dir, "events").where("event_type = 'click'"), "user_id", "value", 10)
    return out.withColumn("avg_latency", F.round("avg_latency", 4))


@query("select user_id, round(avg(value), 4) as avg_latency, count(*) as decisions from events group by 1 having count(*) >= 10 and avg(value) < 50")
def fast_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latency_by_actor(table(spark, sf_dir, "events"), "user_id", "value", 10, 50.0).withColumn("avg_latency", F.round("avg_latency", 4))


@query("select user_id, count(*) as n from events where event_type = 'error' group by 1 having count(*) >= 3")
def overrides_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counts_by_actor(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 3)


@query("select c_custkey, n, c_name as name from (select o_custkey as c_custkey, count(*) as n from orders group by 1 having count(*) >= 12) join customer using (c_custkey)")
def named_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.counts_by_actor(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", 12)
    return A.named(n, table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", T.display_name(F.col("c_name"), F.col("c_custkey").cast("string")))


@query("select user_id, round(sum(value), 2) as sum_value from events group by 1")
def operator_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals_by_actor(table(spark, sf_dir, "events"), "user_id", ["value"]).withColumn("sum_value", F.round("sum_value", 2))


@query("""select count(*) as total, count_if(o_orderstatus = 'P') as pending, count_if(o_orderstatus = 'F') as failed,
 count_if(o_orderpriority = '1-URGENT') as urgent, count_if(o_orderdate >= timestamp '2000-01-01') as recent from orders""")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return A.conditional_counts(table(spark, sf_dir, "orders"), total=F.lit(True), pending=status == "P", failed=status == "F", urgent=F.col("o_orderpriority") == "1-URGENT", recent=F.col("o_orderdate") >= F.expr("timestamp_ntz'2000-01-01 00:00:00'"))


@query("""select c_nationkey, count(*) as batches, count_if(o_orderstatus = 'P') as pending, count_if(o_orderstatus = 'O') as open_,
 count_if(o_orderstatus = 'F') as done from orders join customer on o_custkey = c_custkey group by 1""")
def client_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return both.groupBy("c_nationkey").agg(F.count("*").alias("batches"), is_("P").alias("pending"), is_("O").alias("open_"), is_("F").alias("done"))


@query("""select s_suppkey, s_name, coalesce(n, 0) as open_items from supplier left join
 (select l_suppkey, count(*) n from lineitem where l_returnflag = 'R' and l_quantity > 45 group by 1) on s_suppkey = l_suppkey""")
def workload_with_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return A.workload(people, table(spark, sf_dir, "lineitem"), "s_suppkey", "l_suppkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


@query("""select l_suppkey, count(distinct l_orderkey) as batches, count(*) as files, count_if(l_linestatus = 'O') as pending from lineitem group by 1""")
def reviewer_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("batches"), F.count("*").alias("files"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))


@query("select l_orderkey, l_returnflag as status, count(*) as n from lineitem group by 1, 2")
def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("select l_linenumber, count(*) as total, count_if(l_returnflag = 'R') as n_r, count_if(l_returnflag = 'A') as n_a, count_if(l_returnflag = 'N') as n_n from lineitem group by 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_pivot(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", ["R", "A", "N"])


@query("""select l_orderkey, count(*) as total, count_if(l_returnflag = 'R') as to_verify, count_if(l_returnflag = 'R' and l_linestatus = 'O') as pending from lineitem group by 1""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.progress_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


@query("""select l_orderkey, case when count_if(l_returnflag = 'R') > 2 then 'TO_VERIFY' when count_if(l_returnflag = 'A') > 1 then 'AUTO_FAIL' else 'AUTO_PASS' end as qc_decision from lineitem group by 1""")
def qc_decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("v"), F.count_if(F.col("l_returnflag") == "A").alias("f"))
    return n.select("l_orderkey", A.decision_fold(F.col("v") - 2, F.col("f") - 1).alias("qc_decision"))


@query("""select l_orderkey, count(*) as files, case when count_if(l_returnflag = 'R') = count(*) then 'ERROR' when count_if(l_linestatus = 'F') = count(*) then 'COMPLETED' else 'REVIEW_PENDING' end as batch_status from lineitem group by 1""")
def batch_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_fold(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query("""select l_orderkey, case when coalesce(bool_or(case when l_returnflag = 'R' then null else l_quantity > 48 end), false) then 'FAIL' else 'PASS' end as final_decision from lineitem group by 1""")
def final_decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.final_decision(table(spark, sf_dir, "lineitem"), "l_orderkey", F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_quantity") <= 48))


@query("""select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) as items, count(*) as n from lineitem where l_returnflag in ('R', 'A') group by 1""")
def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.action_items(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", ["R", "A"])


@query("""select l_suppkey, arg_min(l_returnflag, (-n, l_returnflag)) as mode, max(n) as n from (select l_suppkey, l_returnflag, count(*) n from lineitem group by 1, 2) group by 1""")
def most_frequent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.most_frequent(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("select p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1 order by n desc, 1")
def hotspot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return hit.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query("select count(*) as n, round(avg(value), 4) as mean, min(value) as least, max(value) as most, round(avg(case when event_type = 'view' then 1e0 else 0e0 end), 4) as hit_rate from events")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(table(spark, sf_dir, "events"), "value", F.col("event_type") == "view")


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r, count(*) over (partition by user_id) as n from events),
 h as (select user_id, max(n) n, avg(value) m, avg(case when r <= n // 2 then value end) a, avg(case when r > n // 2 then value end) b from r group by 1)
 select user_id, n, round(m, 3) as mean, case when m >= 85 then 'high' when m >= 70 then 'medium' else 'low' end as level,
 case when n < 10 then 'insufficient' when b - a > 2 then 'improving' when a - b > 2 then 'declining' else 'stable' end as trend from h""")
def half_split_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.half_trend(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("""select count(*) as items, cast(sum(l_linenumber) as bigint) as to_verify, arg_min(l_orderkey, (l_shipdate, l_orderkey)) as oldest from lineitem where l_returnflag = 'R'""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").agg(F.count("*").alias("items"), F.sum("l_linenumber").alias("to_verify"), F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("oldest"))


@query("""select p_brand as category, round(100 * avg(case when p_type = 'ECONOMY' then 1e0 when p_type in ('STANDARD', 'SMALL') then 5e-1 else 0e0 end), 2) as score,
 case when 100 * avg(case when p_type = 'ECONOMY' then 1e0 when p_type in ('STANDARD', 'SMALL') then 5e-1 else 0e0 end) >= 80 then 'good'
 when 100 * avg(case when p_type = 'ECONOMY' then 1e0 when p_type in ('STANDARD', 'SMALL') then 5e-1 else 0e0 end) >= 50 then 'fair' else 'poor' end as label from part group by 1""")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    status = F.when(F.col("p_type") == "ECONOMY", "passed").when(F.col("p_type").isin("STANDARD", "SMALL"), "partial").otherwise("failed")
    return A.weighted_score(part.select(F.col("p_brand").alias("category"), status.alias("status")), "category", "status")


# ---- finders, joins, sets, paging


@query("select o_orderkey, o_orderstatus, coalesce(n, 0) as files from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on o_orderkey = l_orderkey")
def file_count_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.with_count(orders, table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "files")


@query("select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING' and (lower(c_name) like '%00001%' or lower(cast(c_nationkey as varchar)) like '%00001%') order by c_custkey desc limit 10 offset 10")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.search(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey"], "00001", c_mktsegment="BUILDING")
    return R.page(found.select("c_custkey", "c_name", "c_mktsegment"), [F.desc("c_custkey")], 1, 10)


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 10")
def top10_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)


@query("select event_id, user_id from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-09 12:00:00' and event_type = 'view'")
def audit_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.between(R.find(table(spark, sf_dir, "events"), event_type="view"), "ts", "2024-01-05 00:00:00", "2024-01-09 12:00:00").select("event_id", "user_id")


@query(f"""select count_if(ts < timestamp '{AS_OF}' - interval 96 hour) as over_96h, count_if(ts < timestamp '{AS_OF}' - interval 240 hour) as over_240h from events where event_type = 'error'""")
def sla_overdue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overdue(R.find(table(spark, sf_dir, "events"), event_type="error"), "ts", AS_OF, (96, 240))


@query(f"select event_id, ts from events where event_type = 'error' and ts < timestamp '{AS_OF}' - interval 96 hour order by ts, event_id limit 50")
def sla_overdue_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = R.find(table(spark, sf_dir, "events"), event_type="error").where(F.col("ts") < now() - F.expr("interval 96 hours"))
    return R.top(late.select("event_id", "ts"), [F.asc("ts"), F.asc("event_id")], 50)


@query("""select distinct o_orderkey, o_orderdate, f, v from orders join (select l_orderkey, count_if(l_returnflag = 'R') f, count_if(l_linestatus = 'O') v from lineitem group by 1) on o_orderkey = l_orderkey where o_orderstatus = 'P'""")
def pending_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("v"))
    both = R.find(table(spark, sf_dir, "orders"), o_orderstatus="P").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "f", "v")
    return R.pending_queue(both, "o_orderkey", "f", "v", "o_orderdate")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.existing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), R.find(table(spark, sf_dir, "orders"), o_orderstatus="P"), "c_custkey", "o_custkey")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deleted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), R.find(table(spark, sf_dir, "lineitem"), l_returnflag="R"), "o_orderkey", "l_orderkey")


@query("select doc_id, md5(text) as hash, row_number() over (partition by md5(text) order by doc_id) > 1 as duplicate from documents")
def duplicate_hash_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return R.later_copies(docs, ["hash"], ["doc_id"])


@query("select doc_id, sha256('qc::' || text) as cache_key from documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("qc::"), "text"), 256).alias("cache_key"))


@query("select n_nationkey, side from (select n_nationkey, case when a.k is not null and b.k is not null then 'both' when a.k is not null then 'left' else 'right' end as side from (select distinct c_nationkey k from customer where c_acctbal > 9000) a full join (select distinct s_nationkey k from supplier) b using (k) join nation on n_nationkey = k)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return R.set_table(left, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@query("select c_nationkey as nationkey, 'client' as kind, c_name as name from customer where c_acctbal < 0 union all select s_nationkey, 'reviewer', s_name from supplier where s_acctbal < 1000")
def union_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"), F.lit("client").alias("kind"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_nationkey").alias("nationkey"), F.lit("reviewer").alias("kind"), F.col("s_name").alias("name"))
    return R.union_all(a, b)


@query("""with new as (select distinct case when l_returnflag = 'R' then -l_orderkey else l_orderkey end as k from lineitem)
 select o_orderkey, o_orderstatus from orders where o_orderkey not in (select k from new) union all select k, 'X' from new""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items replace the batches that they name and add those of negated keys."""
    key = F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    new = table(spark, sf_dir, "lineitem").select(key.alias("o_orderkey"), F.lit("X").alias("o_orderstatus")).distinct()
    return R.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), new, ["o_orderkey"])


@query("""select n_nationkey, s_suppkey, same, rank from (select n_nationkey, s_suppkey, s_nationkey = n_nationkey as same,
 row_number() over (partition by n_nationkey order by s_nationkey = n_nationkey desc, s_acctbal desc, s_suppkey) as rank from nation, supplier) where rank <= 3""")
def reviewer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, people = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return R.recommended(items, people, "n_nationkey", "n_nationkey", "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 3).select("n_nationkey", "s_suppkey", "same", "rank")


# ---- order and neighbourhood


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) r from events where event_type = 'signup') where r = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_of(R.find(table(spark, sf_dir, "events"), event_type="signup"), [F.col("user_id")], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "ts")


@query("select event_id, user_id, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events")
def next_event_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.next_value(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", "next_type").select("event_id", "user_id", "next_type")


@query("select event_id, user_id, lag(event_id) over (partition by user_id order by ts, event_id) as previous_id from events")
def previous_event_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.previous_value(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", "previous_id").select("event_id", "user_id", "previous_id")


@query("select conv_id, turn, cast(coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start from conversations")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.page_starts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start")


@query("""with s as (select conv_id, turn, cast(coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start from conversations),
 p as (select conv_id, cast(sum(length(text) + 2) // 2 as bigint) as pos from conversations group by 1)
 select p.conv_id, p.pos, max(s.turn) as turn from p join s on p.conv_id = s.conv_id and s.start <= p.pos group by 1, 2""")
def asof_page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations")
    asks = pages.groupBy("conv_id").agg(F.floor(F.sum(F.length("text") + 2) / 2).cast("long").alias("pos"))
    return O.page_of(asks, O.page_starts(pages, "conv_id", "turn", "text"), "conv_id", "pos", "turn")


@query("""with f as (select user_id, event_id, sum(value) over w as total, count(value) over w as n from events window w as (partition by user_id order by event_id rows between current row and 4 following)),
 h as (select user_id, min(event_id) as start from f where n = 5 and abs(total - 250) <= 20 group by 1)
 select h.user_id, h.start, round(f.total, 4) as total from h join f on h.user_id = f.user_id and h.start = f.event_id""")
def sliding_sum_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.frame_hit(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 5, 250.0, 20.0).withColumn("total", F.round("total", 4))


@query("""select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as last_signup from events""")
def carried_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("last_signup"))
    return O.carried_forward(e, "user_id", "event_id", "last_signup")


# ---- text, numbers, dates


@query(r"""select page_id, regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '^.*_', '') as order_id from pages""")
def order_id_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.order_id_backfill(F.col("url")).alias("order_id"))


def _key_sql(c: str) -> str:
    """DuckDB's spelling of text.match_key, from the same word lists."""
    word = lambda ws: r"\b(" + "|".join(ws) + r")\b"
    out = rf"regexp_replace(regexp_replace(lower({c}), '\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g')"
    out = f"regexp_replace({out}, '{word(T.KEY_WORDS)}', ' ', 'g')"
    for short, long in T.REWRITES.items():
        out = f"regexp_replace({out}, '{word(long.split())}', '{short}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '{word(T.DROPPED)}', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select page_id, {_key_sql('url')} as match_key from pages")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.match_key(F.col("url")).alias("match_key"))


@query("""select p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split('red small blue widget', ' ')))) as overlap from part""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(T.tokens(F.col("p_name")), T.tokens(F.lit("red small blue widget")))).alias("overlap"))


@query("select o_orderkey, try_cast(replace(replace('$' || cast(cast(floor(o_totalprice) as bigint) as varchar), '$', ''), ',', '') as double) as amount from orders")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.parse_money(shown).alias("amount"))


@query("select o_orderkey, cast(o_orderdate as date) as parsed from orders")
def date_parse_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "M/d/yy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(shown, pivot=70).alias("parsed"))


@query("""select o_orderkey, case when b = 0 then case when a = 0 then 1e0 else 0e0 end when abs(a - b) / abs(b) <= 1e-2 then 1e0 else round(greatest(0e0, 1e0 - abs(a - b) / abs(b)), 6) end as score,
 case when o >= 98e-2 then 'PASS' when o >= 7e-1 then 'VERIFY' else 'FAIL' end as outcome from
 (select o_orderkey, a, b, least(1e0, greatest(0e0, case when abs(a - b) / abs(b) <= 1e-2 then 1e0 else greatest(0e0, 1e0 - abs(a - b) / abs(b)) end * 99e-2)) as o from
 (select o_orderkey, o_totalprice a, s b from orders join (select l_orderkey, sum(l_extendedprice) s from lineitem group by 1) on o_orderkey = l_orderkey))""")
def numeric_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("b"))
    both = table(spark, sf_dir, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    score = numeric.numeric_match(F.col("o_totalprice"), F.col("b"))
    return both.select("o_orderkey", F.round(score, 6).alias("score"), numeric.outcome(score, F.lit(0.99)).alias("outcome"))


PHRASES, FACTS, WHYS = ["the ", "of ", "licensed under", "que "], [r"[0-9]{4}", r"@", r"\+[0-9]"], ["and", "with", "from", "para"]
_hit = lambda ps: " + ".join(f"cast(regexp_matches(text, '(?i){p}') as int)" for p in ps)


@query(f"""select doc_id, case when trim(text) = '' then true when s >= 2 or r >= 3 then false when c >= 2 then true else 3e-1 * c - 2e-1 * s - 1e-1 * r > 2e-1 end as canned,
 case when trim(text) = '' then 9e-1 when s >= 2 or r >= 3 then 8e-1 when c >= 2 then 75e-2 else 5e-1 end as confidence
 from (select doc_id, text, {_hit(PHRASES)} as c, {_hit(FACTS)} as s, {_hit(WHYS)} as r from documents)""")
def canned_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", commentary.canned(F.col("text"), PHRASES, FACTS, WHYS).alias("x")).select("doc_id", "x.*")


@query(f"select doc_id, {_hit(FACTS)} as facts from documents")
def specificity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", commentary.hits(F.col("text"), FACTS).alias("facts"))


@query(r"""select doc_id, nullif(trim(regexp_extract(text, 'token = "([0-9a-f]+)"', 1)), '') as first_token, coalesce(nullif(trim(regexp_extract(text, '([0-9]{2,3}\.[0-9.]+)', 1)), ''), nullif(trim(regexp_extract(text, '([0-9]{16})', 1)), '')) as first_number from documents""")
def first_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.first_match(t, ['token = "([0-9a-f]+)"']).alias("first_token"), T.first_match(t, [r"([0-9]{2,3}\.[0-9.]+)", "([0-9]{16})"]).alias("first_number"))


@query(r"""select doc_id, nullif(v, '') as value, case when v <> '' then i else 0e0 end as confidence, case when v = '' then 'not_found' when i > 8e-1 then 'regex_primary' else 'regex_fallback' end as method from
 (select doc_id, case when a <> '' then a else b end as v, case when a <> '' then 88e-2 else 78e-2 end as i from
 (select doc_id, trim(regexp_extract(text, '\+1 \(([0-9]{3})\)', 1)) as a, trim(regexp_extract(text, '([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})', 1)) as b from documents))""")
def field_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ladder(F.col("text"), [r"\+1 \(([0-9]{3})\)", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"])
    return table(spark, sf_dir, "documents").select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query("select c_custkey, cast(c_custkey as varchar) || ' Main St' as street, c_name as city, 'TX' as state, lpad(cast(c_nationkey as varchar), 5, '7') as zip from customer")
def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(" Main St, "), F.col("c_name"), F.lit(", TX "), F.lpad(F.col("c_nationkey").cast("string"), 5, "7"))
    return table(spark, sf_dir, "customer").select("c_custkey", address_parts(line).alias("a")).select("c_custkey", "a.*")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("select user_id, count_if(event_type = 'click') as click, count_if(event_type = 'error') as error, count_if(event_type = 'view') as view from events group by 1")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count()
    return wide.na.fill(0)


@query("""select o_orderkey, unnest(['status', 'priority']) as field_name, unnest([o_orderstatus, o_orderpriority]) as field_value from orders""")
def eav_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("field_name", "field_value"))


# ---- state


@query("""select o_orderkey, case when o_orderstatus in ('P', 'O') then 'Q' else o_orderstatus end as status, case when o_orderstatus in ('P', 'O') then 2 else 1 end as version from orders""")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    return X.changed(orders, F.col("status").isin("P", "O"), version=F.col("version") + 1, status=F.lit("Q"))


@query("""select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'HIGH' when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 'LOW' else o_orderpriority end as o_orderpriority from orders""")
def status_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.collapsed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"HIGH": ["1-URGENT", "2-HIGH"], "LOW": ["4-NOT SPECIFIED", "5-LOW"]})


@query(f"""select user_id, case when max(ts) < timestamp '{AS_OF}' - interval 2160 minute then 'IDLE' else 'ACTIVE' end as status from events group by 1""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_active_at")).withColumn("status", F.lit("ACTIVE"))
    return X.idle(s, now(), 2160).select("user_id", "status")


@query("""select o_orderkey, case when o_orderstatus = 'P' and o_orderdate < timestamp '2001-01-01' - interval 500000 minute then 'ERROR' when o_orderstatus = 'P' and o_orderdate < timestamp '2001-01-01' - interval 90000 minute then 'RETRY' else 'NONE' end as action from orders""")
def stuck_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("updated_at"), F.when(F.col("o_orderstatus") == "P", "QC_PROCESSING").otherwise("COMPLETED").alias("status"))
    return X.reconciled(b, F.expr("timestamp_ntz'2001-01-01 00:00:00'"), True, 90000, 500000).select("o_orderkey", "action")


@query(f"""select user_id, arg_max(event_id, (ts, event_id)) as event_id, min(ts) as started_at from events group by 1 having max(ts) >= timestamp '{AS_OF}' - interval 172800 second""")
def ttl_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.live(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", now(), 172800).select("user_id", "event_id", "started_at")


# ---- rules

TEXT_RULE_IDS = ("DOC-3", "SIG-4", "SIG-1", "FHA-12", "SK-3", "PH-5", "MF-2", "FHA-11", "SCA-19", "R-1")


@query("""select doc_id, unnest([
 {'rule_id': 'SCA-19', 'status': case when regexp_matches(text, '(?i)Functional\\s+Utility|Average') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'R-1', 'status': case when regexp_matches(text, '(?i)reconciliation|indicated value by sales comparison|sales comparison approach')
   and regexp_matches(text, '(?i)weight|weighted|most reliable|best indicator|given.*consideration|supportive and reasonable conclusion|opinion of market value') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'DOC-3', 'status': case when regexp_matches(text, '(?i)\\bUAD\\b|Uniform Appraisal Dataset') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'SIG-1', 'status': case when regexp_matches(text, '(?i)(?s)signature of appraiser|appraiser signature|APPRAISER\\s+.*Signature|Date of Signature|Date Signed|signed')
   and regexp_matches(text, '\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'SIG-4', 'status': case when regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'PH-5', 'status': 'VERIFY'},
 {'rule_id': 'SK-3', 'status': case when regexp_matches(text, '(?i)\\d+(\\.\\d+)?\\s*x\\s*\\d|\\d+''\\s*-\\s*\\d+"|measured per ANSI|ANSI standards') then 'PASS' else 'VERIFY' end},
 {'rule_id': 'FHA-11', 'status': 'PASS'}, {'rule_id': 'FHA-12', 'status': 'PASS'},
 {'rule_id': 'MF-2', 'status': case when regexp_matches(text, '(?i)form\\s*216|operating income statement') then 'PASS' else 'VERIFY' end}
 ], recursive := true) from documents""")
def rule_engine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rules on the text alone; those for FHA loans pass documents without a loan type."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return rules.evaluate(docs, 2024, rules=list(TEXT_RULE_IDS), cross=False).select("doc_id", "rule_id", "status")


@query()
def rules_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and active rules per category."""
    return A.category_listing(rules.config(spark), "rule_id", F.col("is_active"))


# ---- fields, reviews, caches


@query("""select c_custkey as doc_id, 'A' || c_custkey as mls_number from customer where c_custkey % 3 = 0""")
def field_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field over texts that name it, that have a label of the form in its place, and that lack it."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Listed, MLS # A"), k, F.lit(" today"))).when(k % 3 == 1, "MLS: price").otherwise("no listing")
    docs = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))
    found = fields.field(F.col("text"), fields.SUBJECT["mls_number"])["value"]
    return docs.select("doc_id", found.alias("mls_number")).where("mls_number is not null")


@query("""select o_orderkey, case when o_orderstatus = 'O' and o_custkey % 7 <> 3 then 'BLOCKED' when o_orderstatus <> 'O' and o_orderkey % 4 > 0 then 'CONFIRM' else 'GRANTED' end as lock_state from orders""")
def review_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("by"), F.when(F.col("o_orderstatus") == "O", now() + F.expr("interval 1 minute")).otherwise(now()).alias("till"), (F.col("o_orderkey") % 4).alias("prior"))
    return orders.select("o_orderkey", D.lock_state(F.col("by"), F.col("till"), F.lit(3), now(), F.col("prior"), F.lit(False)).alias("lock_state"))


@query("""select user_id, event_id, lead(ts) over (partition by user_id order by ts, event_id) as ended_at, case when lead(ts) over (partition by user_id order by ts, event_id) is null then 'ACTIVE' else 'ENDED' end as status
 from events where event_type = 'signup'""")
def session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("session_token"), "ts")
    none = logins.limit(0).select("user_id", "session_token", F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.lit("").alias("status"))
    return D.sessions_started(none, logins).select("user_id", F.col("session_token").alias("event_id"), "ended_at", "status")


@query("""select md5(event_type || '::' || props) as cache_key, count(*) as asked, count_if(event_type in ('click', 'view')) as cached from events group by 1 having count_if(event_type in ('click', 'view')) = 0""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the cache lacks; it holds those of clicks and views."""
    asked = table(spark, sf_dir, "events").select(F.md5(F.concat_ws("::", "event_type", "props").cast("binary")).alias("cache_key"), "event_type")
    cache = asked.where("event_type in ('click', 'view')").select("cache_key").distinct()
    _, misses = D.cache_lookup(asked, cache)
    return asked.join(misses.select("cache_key"), "cache_key").groupBy("cache_key").agg(F.count("*").alias("asked"), F.lit(0).cast("long").alias("cached"))


@query()
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checked items, events as decisions on them, spread over all items and folded in order."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("verify").alias("status"), F.when(F.col("l_linestatus") == "O", "BLOCKING").otherwise("STANDARD").alias("severity"), F.lit(None).cast("timestamp_ntz").alias("first_presented_at"))
    e = table(spark, sf_dir, "events")
    last = items.agg(F.max("id")).first()[0] or 1
    events = e.select(
        (F.pmod(F.floor(F.col("event_id") / 2), F.lit(last)) + 1).alias("rule_result_id"), F.col("event_id").alias("event_seq"), "ts", F.col("user_id").alias("reviewer_id"), F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("decision"),
        F.col("props").alias("comment"), (F.col("user_id") % 3).cast("string").alias("session_token"), (F.col("value") * 1000).cast("long").alias("latency_ms"), (F.col("event_id") % 2 == 0).alias("acknowledged"),
    )
    return D.decided(items, events).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""with s as (select conv_id, turn, contains(lower(text), 'the')::int + contains(lower(text), 'sch')::int + contains(lower(text), 'ent')::int as score from conversations)
 select conv_id, turn, score from s where score >= 1 qualify row_number() over (partition by conv_id order by score desc, turn) <= 2""")
def page_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages_with(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", ["THE", "sch", "ent"], 2)


@query("""with s as (select conv_id, turn, len(regexp_extract_all(text, '(?i)[a-z]+ing')) as score from conversations)
 select conv_id, turn, score from s where score > 0 qualify row_number() over (partition by conv_id order by score desc, turn) <= 10""")
def page_pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages_matching(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "[a-z]+ing")


@query("""with e as (select l_orderkey, 7 as n from lineitem group by 1), g as (select l_orderkey, unnest(range(1, n + 1)) as p from e)
 select l_orderkey, string_agg(cast(p as varchar), ',' order by p) as missing from g where not exists (select 1 from lineitem l where l.l_orderkey = g.l_orderkey and l.l_linenumber = p) group by 1""")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    expected = lines.select("l_orderkey").distinct().withColumn("page_count", F.lit(7))
    out = P.missing_pages(lines, expected, "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("""select p_partkey, case when regexp_matches(p_size::varchar, '^[0-9]+$') then p_size * 43560.0 else 0.0 end as square_feet from part""")
def area_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.area_square_feet(F.concat(F.col("p_size").cast("string"), F.lit(" acres"))).alias("square_feet"))


@query("""select l_orderkey, bool_or(l_returnflag = 'N') as pending from lineitem group by 1""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "N")


@query("""select o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as files from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber < 4 group by 1""")
def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber < 4")
    both = R.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["l_linenumber", "l_returnflag"], "f")
    return both.select("o_orderkey", F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",").alias("files"))
