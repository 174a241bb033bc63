"""Queries over evidence, review lists and detections, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.operators import evidence as E
from docgauge.plans.catalog import query
from docgauge.sources.tables import table


@query("""with m as (select o_orderkey, case o_orderkey % 4 when 0 then 'exact' when 1 then 'checkbox' when 2 then 'date' else 'blank' end as kind,
 case o_orderkey % 4 when 1 then case when o_orderkey % 3 = 0 then 'true' else 'false' end when 2 then strftime(o_orderdate, '%Y-%m-%d') else o_orderpriority end as a,
 case o_orderkey % 4 when 0 then case when o_orderkey % 3 = 0 then ' 1urgent' else 'x' end when 1 then case when o_orderkey % 5 = 0 then 'yes' else 'no' end when 2 then case when o_orderkey % 7 = 0 then '' else strftime(o_orderdate, '%m/%d/%Y') end else o_orderpriority end as b from orders)
 select o_orderkey, kind, cast(case kind when 'exact' then regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') when 'checkbox' then (a = 'true') = (b = 'yes') when 'date' then b <> '' else false end as double) as score from m""")
def match_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day, level = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderpriority")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("exact", "checkbox", "date", "blank")]), (k % 4 + 1).cast("int"))
    a = F.when(kind == "checkbox", F.when(k % 3 == 0, "true").otherwise("false")).when(kind == "date", F.date_format(day, "yyyy-MM-dd")).otherwise(level)
    b = F.when(kind == "exact", F.when(k % 3 == 0, " 1urgent").otherwise("x")).when(kind == "checkbox", F.when(k % 5 == 0, "yes").otherwise("no")).when(kind == "date", F.when(k % 7 == 0, "").otherwise(F.date_format(day, "MM/dd/yyyy"))).otherwise(level)
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), E.match_of_kind(kind, a, b).alias("score"))


@query("""select c_custkey, case when l then c_name when c_custkey % 2 = 0 then 'letter' end as borrower_name, case when l then coalesce(case when c_custkey % 9 = 0 then 'Purchase' end, 'Refinance') when c_custkey % 5 = 0 then 'Purchase' end as assignment_type
 from (select *, c_custkey % 2 <> 0 and c_custkey % 5 <> 0 as l from customer)""")
def proxy_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    letter = {"borrower_name": F.when(k % 2 == 0, "letter"), "assignment_type": F.when(k % 5 == 0, "Purchase")}
    return table(spark, sf_dir, "customer").select("c_custkey", *E.proxy_letter(letter, {"borrower_name": F.col("c_name"), "assignment_type": F.when(k % 9 == 0, "Purchase")}))


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 2 = 0 then c_mktsegment end as value, case when c_custkey % 7 = 0 then 0.9e0 when c_custkey % 3 = 0 then 0.7e0 else 0e0 end as confidence from customer""")
def candidate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    values = F.create_map(F.lit("a"), F.when(k % 3 == 0, F.col("c_name")), F.lit("blank"), F.lit(" "), F.lit("b"), F.when(k % 2 == 0, F.col("c_mktsegment")))
    confidences = F.create_map(F.lit("a"), F.when(k % 7 == 0, 0.9))
    return table(spark, sf_dir, "customer").select("c_custkey", E.first_candidate(values, ["none", "a", "blank", "b"]).alias("value"), E.value_confidence(values, confidences, "a").alias("confidence"))


@query("""with hits as (select conv_id, turn, unnest([{'r': 0, 't': 'QUX', 'in': contains(lower(text), 'qux')}, {'r': 1, 't': 'and', 'in': contains(lower(text), 'and')}, {'r': 2, 't': 'e', 'in': contains(lower(text), 'e')}], recursive := true) from conversations)
 select conv_id, t as term, turn from hits where "in" qualify row_number() over (partition by conv_id order by r, turn) = 1""")
def first_evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_page_with(table(spark, sf_dir, "conversations"), ["QUX", "and", "e"], "conv_id", "turn", "text")


@query("""with w as (select doc_id, string_split_regex(lower(text), '\\s+') as ws from documents), v as (select doc_id, ws, ws[7] as a, ws[8] as b from w where len(ws) >= 8 and ws[7] <> '' and ws[8] <> ''),
 hits as (select doc_id, min(i) as first from (select doc_id, a, b, unnest(ws) as x, unnest(list_append(ws[2:], null)) as y, generate_subscripts(ws, 1) as i from v) where x = a and y = b group by 1)
 select doc_id, cast(first as int) as first, cast(first + 1 as int) as last from hits""")
def value_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each document's seventh and eighth word among all its words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("ws")).where("size(ws) >= 8 and ws[6] <> '' and ws[7] <> ''")
    return words.select("doc_id", E.word_span(F.col("ws"), F.concat_ws(" ", F.col("ws")[6], F.col("ws")[7])).alias("s")).select("doc_id", "s.first", "s.last")


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_name when c_custkey % 3 = 1 then c_name || ' Jr' else c_name end as value, case when c_custkey % 3 = 2 then 0.5e0 when c_custkey % 2 = 0 then 0.9e0 else 0.78e0 end as confidence from customer""")
def trimmed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    given = F.when(k % 3 == 0, F.concat("c_name", F.lit(" - Owner of Public Record X"))).when(k % 3 == 1, F.concat(F.lit(": "), "c_name", F.lit("  Jr County Y"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", *E.boundary_trim(given, F.when(k % 3 == 2, 0.5).when(k % 2 == 0, 0.9).otherwise(0.5)))


@query("""select p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ' ,;  ' || p_type, '[,;]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') as items, '! ' || p_brand || '|! ' || p_type as flags from part""")
def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.split_items(F.concat("p_name", F.lit(" ,;  "), "p_type")), "|").alias("items"), F.array_join(E.flag_lines(F.concat("p_brand", F.lit("\n \n "), "p_type"), "! "), "|").alias("flags"))


@query("""select c_custkey, row_number() over (order by case c_mktsegment when 'MACHINERY' then 0 when 'BUILDING' then 1 else 99 end, coalesce(case when c_custkey % 5 <> 0 then c_name end, ''), c_custkey) as place from customer order by place limit 100""")
def documents_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 100 in the order of kinds and names."""
    rows = table(spark, sf_dir, "customer").orderBy(*E.by_kind_then_name(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"], F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))), "c_custkey").limit(100)
    return rows.select(F.collect_list("c_custkey").alias("ids")).select(F.posexplode("ids").alias("p", "c_custkey")).select("c_custkey", (F.col("p") + 1).cast("long").alias("place"))


@query("""select event_type, n from (select event_type, count_if(value > 60 and event_type <> 'click') as n from events group by 1) where n > 0 order by event_type limit 1""")
def next_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.next_action(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.when((F.col("value") > 60) & (F.col("event_type") != "click"), 1)).alias("n")), "n", "event_type")


@query("""select count(*) as jobs, count_if(event_type <> 'error') as completed, avg(value) filter (event_type <> 'error') as avg_s, min(value) filter (event_type <> 'error') as min_s, max(value) filter (event_type <> 'error') as max_s, count_if(event_type <> 'error') * 1e2 / count(*) as success_pct from events""")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_summary(table(spark, sf_dir, "events"), F.col("event_type") != "error", F.col("value"))


@query("""select c_custkey as user_id, u.v as sub_progress from customer left join (select user_id, arg_max(value, struct_pack(ts := ts, e := event_id)) as v from events group by 1) u on u.user_id = c_custkey""")
def sub_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "value", F.struct("ts", "event_id").alias("at"))
    return E.with_sub_progress(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), events, "user_id", "value", "at")


@query("""select user_id, event_type from events where event_id % 3 = 0 and value > 0 qualify row_number() over (partition by user_id order by value desc, event_type) = 1""")
def checked_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.checked_option(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("event_id") % 3 == 0, "value")


@query("""select c_custkey, case c_custkey % 4 when 0 then c_acctbal >= 0 and c_acctbal <= 5000 when 1 then c_custkey % 3 = 0 when 2 then c_custkey % 5 <> 0 else true end as valid from customer""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("currency", "year", "date", "enum")]), (k % 4 + 1).cast("int"))
    value = F.when(kind == "currency", F.concat(F.lit("$ "), F.col("c_acctbal").cast("string"))).when(kind == "year", F.when(k % 3 == 0, "1999").otherwise("3999")).when(kind == "date", F.when(k % 5 == 0, "soon").otherwise("1/2/2024")).otherwise("x")
    return table(spark, sf_dir, "customer").select("c_custkey", E.typed_valid(kind, value, F.lit(0.0), F.lit(5000.0)).alias("valid"))


@query("""select p_partkey, case p_partkey % 5 when 0 then 'Suburban' when 1 then 'Suburban' when 2 then 'Urban' when 3 then 'Suburbannn' else ' ' end as name from part""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(x) for x in (" suburban ", "5uburb4n", "urban", "Suburbannn", " ")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", E.canonical(given, ["Urban", "Suburban", "Rural"]).alias("name"))


@query("""select count(*) as n, count_if(l_tax < 5e-2) as valid, count_if(l_tax < 5e-2) * 1e2 / count(*) as overall_pct, count_if(l_tax < 5e-2 and l_returnflag = 'R') * 1e2 / count_if(l_returnflag = 'R') as critical_pct from lineitem""")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy(table(spark, sf_dir, "lineitem"), F.col("l_tax") < 0.05, F.col("l_returnflag") == "R")


@query("""select l_orderkey, l_linenumber, case when w < 0 or h < 0 then 0e0 else w * h / (200e0 - w * h) end > 3e-1 as overlaps from (select l_orderkey, l_linenumber, 1e1 - abs(l_quantity % 7 - l_linenumber) as w, 1e1 - abs(l_quantity % 5 - l_linenumber) as h from lineitem)""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (E.overlap(box(q % 7, q % 5), box(n, n)) > 0.3).alias("overlaps"))


@query("""select conv_id, turn, x, y, greatest(4e-2, round(least(9e-1 - x, least(7e-1, greatest(8e-2, n / 95e0))), 4)) as w, 8e-2 as h from (select conv_id, turn, round(least(92e-2, greatest(2e-2, n / 1e2)), 4) as x, 5e-1 as y, n from (select conv_id, turn, turn % 50 + 1 as n from conversations))""")
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.repeat(F.lit("x"), (F.col("turn") % 50 + 1).cast("int"))
    before = F.concat(F.lit("a line\n"), line)
    box = E.text_box(before, F.concat(before, F.lit(" and more")), line)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", box.alias("b")).select("conv_id", "turn", "b.x", "b.y", "b.w", "b.h")


@query("""select l_orderkey, l_linenumber from lineitem where l_linestatus || ' ' || l_returnflag ilike '%o n%' and l_linenumber % 3 < 2""")
def rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("PASS"), F.lit("MANUAL_PASS"), F.lit("FAIL")), F.col("l_linenumber") % 3 + 1)
    return E.rule_rows(table(spark, sf_dir, "lineitem"), "O N", ["l_linestatus", "l_returnflag"], status, "pass").select("l_orderkey", "l_linenumber")
