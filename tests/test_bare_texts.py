"""The query over all texts and its SQL state the same rules, whatever part of a rule's wording a text has."""

import duckdb

from docgauge.plans import catalog, rule_queries

# a line per text; each has a wording that no stand-in document has
TEXTS = """Q4
q3 c3
Q3
C5
all utilities in here were on
additional  features
none
window bar
release latch
central  air
heating/cooling
proposed construction
new construction
Dimensions 'x'
Dimensions x60
Highest and best use as improved: No, yes
highest and best use (yes)
There are 2 comparable sales and There are 9 comparable properties currently offered
There are 12 comparable sales and There are 1 comparable properties  currently offered
there are 3 comparable  sales; there are 99999999999 comparable properties currently offered
There are 7 comparable sales, there are 8 comparable properties currently offered
sales comparison approach with a best indicator
indicated value by sales comparison, given due consideration
final opinion of value: $350,000
APPRAISED VALUE OF SUBJECT PROPERTY $99
operating income statement
comments; no adverse conditions were noted
see attached addendum
uniform appraisal dataset
Date signed 1/2/24
appraiser Bob: signature 10/12/2024
SUPERVISORY APPRAISER Signature of X
supervisory appraiser
front exterior, subject  rear, subject street
kitchen, subject living room, bedroom and subject bath
kitchen, living room, bedrooms, bathroom
damage by an external factor
the subject and its comparables
comparable sales map
satellite
aerial map
sketch
measured per ANSI
12' - 3"
12.5 X 9
FHA 123-1234567 remaining economic life: 20 years
FHA remaining economic life (years) 45
FHA remaining economic life about 5 due to age""".split("\n")


def test_sql_states_the_rules_that_run_on_texts(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate([None, "", " ", *TEXTS])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.rule_id, r.status): r.n for r in rule_queries.rule_engine_all(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    duck.execute("create view customer as select * from '/root/testdata/sf0.001/customer.parquet'")
    want = {(i, s): n for i, s, n in duck.execute(catalog.ORACLE_SQL["rule_engine_all"]).fetchall()}
    assert got == want
