"""Retraining jobs: what they skip, what they learn, what they deploy; and the readers."""

import io
import zipfile

from pyspark.sql import functions as F

from docgauge.plans import training
from docgauge.sources import tables


def test_classifier_learns_or_skips(spark):
    rows = spark.createDataFrame([(f"{'canned typical stable' if i % 2 else 'sold 12 homes'} {i}", "ab"[i % 2]) for i in range(40)] + [(None, "a")], "text string, label string")
    model, said = training.commentary_classifier(rows)
    assert not said["skipped"] and said["accuracy"] > 0.9 and said["deployed"] and model.transform(rows.na.drop()).count() == 40
    assert not training.commentary_classifier(rows, previous=1.1)[1]["deployed"]
    assert training.commentary_classifier(rows.limit(5))[1] == {"skipped": True}


def test_forest(spark):
    rows = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") > 100).cast("double").alias("z"))
    assert training.assessment(rows, ["x"], "y", classify=False, trees=10)[1] > 0.9
    assert training.assessment(rows, ["x"], "z", classify=True, trees=10)[1] > 0.9


def test_feedback_is_marked(spark):
    f = spark.createDataFrame([(1, False), (2, False)], "id long, used_for_training boolean")
    assert {tuple(r) for r in training.mark_used(f, f.where("id = 1")).collect()} == {(1, True), (2, False)}


def test_archives(spark, tmp_path):
    def archive(name, entries):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for n, c in entries.items():
                z.writestr(n, c)
        (tmp_path / name).write_bytes(raw.getvalue())

    archive("good.zip", {"appraisal/a.pdf": b"%PDF-1", "engagement/b.pdf": b"%PDF-2", "__MACOSX/a.pdf": b"", "appraisal/._a.pdf": b"", "notes.txt": b"x"})
    archive("bad.zip", {"../a.pdf": b"x"})
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    out = tables.zip_entries(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip")).withColumn("kind", tables.entry_type(F.col("entry"))).collect()
    assert sorted((r.entry or "", r.kind or "", r.error or "") for r in out) == [("", "", "not an archive"), ("", "", "rejected"), ("appraisal/a.pdf", "APPRAISAL", ""), ("engagement/b.pdf", "ENGAGEMENT", "")]
