"""Uploaded archives, decoded bytes, page windows and sinks at their edges."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docgauge.operators import aggregates as A
from docgauge.sources import tables as S


def archive(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "" if n.endswith("/") else "%PDF-1")
    return bytearray(out.getvalue())


def test_archives(spark):
    rows = [
        ("whole", archive("Appraisal/a.pdf", "orders/o.PDF", "contract.pdf", "x.pdf")),
        ("folders", archive("appraisal/", "eagagement/", "contract/c.pdf")),
        ("empty folders", archive("appraisal/", "engagement/")),
        ("half", archive("appraisal/a.pdf", "__MACOSX/engagement/._e.pdf", "engagement/.DS_Store")),
        ("climbs", archive("../appraisal/a.pdf", "order.pdf")),
        ("many", archive("appraisal/a.pdf", "order.pdf", "1.pdf", "2.pdf", "3.pdf")),
        ("none", bytearray(b"not an archive")),
    ]
    listing = S.zip_listing(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["path"]: (r["files"], r["error"]) for r in S.upload_verdicts(listing, most=4).collect()}
    assert got == {
        "whole": (3, None), "folders": (1, None), "empty folders": (0, "no valid PDF files"), "half": (1, "requires appraisal and engagement folders"),
        "climbs": (2, "invalid path"), "many": (2, "too many entries"),
    }
    assert {(r["filename"], r["file_type"]) for r in S.upload_files(listing).where("path = 'whole'").collect()} == {("a.pdf", "APPRAISAL"), ("o.PDF", "ENGAGEMENT"), ("contract.pdf", "CONTRACT")}
    assert S.upload_verdicts(listing.limit(0)).count() == 0


def test_decoded_and_refused(spark):
    rows = [(b"a\xffb", 1), ("é�z".encode() + b"\xe2\x82", 9), (b"%PDF-1", 2), (b"%PDF-1", 9), (b"%PDF-1" * 9, 1), (None, None), (b"%PDF-1", None)]
    df = spark.createDataFrame([(None if b is None else bytearray(b), n) for b, n in rows], "content binary, pages int").coalesce(1)
    got = df.select(S.decoded(F.col("content")).alias("t"), S.upload_problem(F.col("content"), F.col("pages"), 5, 20).alias("p")).collect()
    assert [r["t"] for r in got[:3]] == ["ab", "é�z", "%PDF-1"] and got[5]["t"] is None
    assert [r["p"] for r in got] == ["not a PDF", "not a PDF", None, "too many pages", "too large", "not a PDF", None]


def test_page_windows(spark):
    pages = spark.createDataFrame([(1, 1, "ab"), (1, 2, None), (1, 3, "c"), (1, 4, "dd"), (2, 9, "x"), (3, 2, "q"), (3, 2, "p")], "doc_id long, page int, text string")
    got = {r["doc_id"]: (r["text"], r["offset"]) for r in S.page_window(pages, 2, 3).collect()}
    assert got == {1: ("\nc", 3), 2: ("", 0), 3: ("p\nq", 0)}
    whole = "\n".join(["ab", "", "c", "dd"])
    assert whole[3 : 3 + len(got[1][0])] == got[1][0] and S.page_window(pages.limit(0), 1, 2).count() == 0


@pytest.mark.parametrize("end", ["csv", "json", "parquet"])
def test_training_files(spark, tmp_path, end):
    rows = [("a \"quoted\", text", "GOOD"), ("two words", "BAD"), ("it\\s", "BAD")]
    path = f"{tmp_path}/rows.{end}"
    S.write_training(spark.createDataFrame(rows, "text string, label string"), path)
    reader = spark.read.schema("text string, label string").format(end)
    back = (reader.option("header", "true").option("escape", '"') if end == "csv" else reader).load(path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    with pytest.raises(ValueError):
        S.write_training(back, f"{tmp_path}/rows.xml")


def test_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x|y", None), (1, "two\nlines", 3.5)], "n int, a string, b double")
    S.write_markdown(rows, ["a", "b"], ["n"], f"{tmp_path}/report")
    lines = [r["value"] for f in sorted((tmp_path / "report").glob("part-*")) for r in [{"value": x} for x in f.read_text().splitlines()]]
    assert lines == ["| a | b |", "|---|---|", "| two lines | 3.5 |", "| x\\|y |  |"]


def test_counters_and_page_stats(spark):
    ts = lambda s: F.to_timestamp_ntz(F.lit(s))
    sessions = spark.createDataFrame([("a", 1, None, 0, "IDLE"), ("b", 0, 0, 0, "ENDED")], "session_token string, files_processed long, files_failed long, corrections_made long, status string").withColumn("last_active_at", ts("2024-01-02 00:00:00"))
    acts = spark.createDataFrame([("a", "FILE_OK"), ("a", "FILE_OK"), ("a", "CORRECTION"), ("z", "FILE_OK"), ("b", None), (None, "ACTIVITY")], "session_token string, action string").withColumn("ts", ts("2024-01-03 00:00:00"))
    got = {r["session_token"]: (r["files_processed"], r["files_failed"], r["corrections_made"], r["status"], r["last_active_at"].day) for r in A.session_counters(sessions, acts).collect()}
    assert got == {"a": (3, 0, 1, "IDLE", 3), "b": (0, 0, 0, "ENDED", 2)}
    assert [tuple(r) for r in A.page_stats(sessions, [F.asc("session_token")], 1, 1, ended=F.col("status") == "ENDED").collect()] == [(1, 1)]
