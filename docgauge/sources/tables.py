"""Typed readers and writers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "batch": "id long, parent_batch_id string, client_id long, status string, assigned_reviewer_id long, file_hash string, version long, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "batch_file": "id long, batch_id long, file_type string, filename string, order_id string, content_hash string, content_version long, document_quality_flags string, status string",
    "qc_result": "id long, batch_file_id long, qc_decision string, final_decision string, total_rules int, passed_count int, failed_count int, verify_count int, manual_pass_count int, reviewed_by long, updated_at timestamp_ntz",
    "qc_rule_result": "id long, qc_result_id long, rule_id string, status string, severity string, needs_verification boolean, reviewer_verified boolean, override_pending boolean, override_requested_by long, override_requested_at timestamp_ntz, first_presented_at timestamp_ntz, decision_latency_ms long, verified_at timestamp_ntz, confidence_score double",
    "processing_metrics": "id long, qc_result_id long, total_processing_ms long, ocr_confidence_avg double, rule_pass_rate double, extraction_method string, model_version string, cache_hit boolean, created_at timestamp_ntz",
    "operator_session": "id long, user_id long, session_token string, started_at timestamp_ntz, last_active_at timestamp_ntz, ended_at timestamp_ntz, files_processed int, corrections_made int, active_minutes int, status string",
    "page_text": "doc_id string, page int, text string, method string, word_count int, confidence double, has_tables boolean",
    "words": "doc_id string, page int, text string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double",
    "decision_event": "rule_result_id long, event_seq long, ts timestamp_ntz, reviewer_id long, decision string, comment string, session_token string, latency_ms long, acknowledged boolean",
}

MAX_ENTRIES, MAX_BYTES = 1000, 50 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core that ``spread`` deals rows to.
TASKS = 4


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to all cores by a key of many values, before work that takes long per row.

    A narrow table of a million rows is often one row group, which one task would read and work on alone.
    """
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, key)


def typed(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A domain table under its declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(path)


def training_rows(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    """Training examples from csv, json or parquet; rows without text are dropped."""
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path).na.drop(subset=["text"])


def entry_type(path: Column) -> Column:
    """File type of an upload entry by its path, null for others."""
    p = F.lower(path)
    return F.when(p.contains("appraisal"), "APPRAISAL").when(p.rlike("engagement|eagagement|order"), "ENGAGEMENT").when(p.rlike("contract|purchase|agreement"), "CONTRACT")


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, entry, size, content) of the PDFs in uploaded archives, from a binaryFile scan.

    Archives over the size limit, with too many entries or with a path that climbs out yield one row with ``error`` set.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        if len(content) > MAX_BYTES or len(infos) > MAX_ENTRIES or any(".." in i.filename.split("/") for i in infos):
                            rows.append((path, None, None, None, "rejected"))
                            continue
                        for i in infos:
                            name = i.filename.rsplit("/", 1)[-1]
                            if not i.is_dir() and not i.filename.startswith("__MACOSX/") and not name.startswith("._") and name != ".DS_Store" and name.lower().endswith(".pdf"):
                                rows.append((path, i.filename, i.file_size, z.read(i), None))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "not an archive"))
            yield pd.DataFrame(rows, columns=["path", "entry", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(unpack, "path string, entry string, size long, content binary, error string")


def zip_listing(files: DataFrame) -> DataFrame:
    """(path, entry, is_folder) of every entry of uploaded archives, without contents; files that are no archives have none."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        yield pd.DataFrame([(path, i.filename, i.is_dir()) for i in z.infolist()], columns=["path", "entry", "is_folder"])
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(names, "path string, entry string, is_folder boolean")


def is_debris(entry: Column) -> Column:
    """What an operating system leaves in archives."""
    name = F.substring_index(entry, "/", -1)
    return F.startswith(F.lower(entry), F.lit("__macosx/")) | (name == ".DS_Store") | F.startswith(name, F.lit("._"))


def upload_files(listing: DataFrame) -> DataFrame:
    """(path, entry, filename, file_type) of the PDFs of a known type; those of others are left out."""
    pdf = F.endswith(F.lower("entry"), F.lit(".pdf")) & ~F.col("is_folder") & ~is_debris(F.col("entry"))
    named = listing.where(pdf).select("path", "entry", F.substring_index("entry", "/", -1).alias("filename"), entry_type(F.col("entry")).alias("file_type"))
    return named.where(F.col("file_type").isNotNull())


def upload_verdicts(listing: DataFrame, most: int = MAX_ENTRIES) -> DataFrame:
    """(path, entries, files, status, error) of every archive: UPLOADED, or VALIDATION_FAILED with the first reason.

    Reasons: too many entries, a path with "..", no appraisal or no engagement part, no file. A part is there by a folder
    of its name or a file of its type. One aggregation with partial sums, so archives of any size do.
    """
    entry = F.lower("entry")
    real, folder = ~is_debris(F.col("entry")), F.col("is_folder")
    kind = F.when(real & ~folder & F.endswith(entry, F.lit(".pdf")), entry_type(F.col("entry")))
    has = lambda kind_, *words: F.max(F.coalesce((kind == kind_) | (real & folder & entry.rlike("|".join(words))), F.lit(False)))
    one = listing.groupBy("path").agg(
        F.count("*").alias("entries"), F.count(kind).alias("files"), F.max(F.contains("entry", F.lit(".."))).alias("_climbs"),
        has("APPRAISAL", "appraisal").alias("_appraisal"), has("ENGAGEMENT", "engagement", "eagagement").alias("_engagement"),
    )
    error = F.when(F.col("entries") > most, "too many entries").when(F.col("_climbs"), "invalid path").when(~F.col("_appraisal") | ~F.col("_engagement"), "requires appraisal and engagement folders").when(F.col("files") == 0, "no valid PDF files")
    return one.select("path", "entries", "files", F.when(error.isNull(), "UPLOADED").otherwise("VALIDATION_FAILED").alias("status"), error.alias("error"))


def upload_problem(content: Column, page_count: Column, most_pages: int, limit: int = MAX_BYTES) -> Column:
    """Why a file is refused: too large, not a PDF, too many pages; null if it is not. An unknown page count passes."""
    return F.when(F.length(content) > limit, "too large").when(~F.coalesce(valid_pdf(content, limit), F.lit(False)), "not a PDF").when(page_count > most_pages, "too many pages")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text without the bytes that are none; null stays null. A written U+FFFD stays, U+FDD0 becomes one."""
    kept = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0"))
    return F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))


def page_window(pages: DataFrame, first: int, last: int, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, text, offset): a document's text from page ``first`` to ``last``, pages parted by line breaks, and the signs before it.

    Null texts are empty; pages of equal number follow each other by text. A document without such a page has an empty
    text at 0. Only the window's pages are gathered.
    """
    inside, t = F.col(page).between(first, last), F.coalesce(F.col(text), F.lit(""))
    one = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.when(inside, F.struct(F.col(page).alias("p"), t.alias("t"))))).alias("w"), F.sum(F.when(F.col(page) < first, F.length(t) + 1).otherwise(0)).alias("before"))
    return one.select(doc, F.array_join(F.col("w.t"), "\n").alias("text"), F.when(F.size("w") > 0, F.col("before")).otherwise(0).alias("offset"))


def first_pages(pages: DataFrame, most: int, page: str = "page") -> DataFrame:
    """Pages 1 to ``most``; the filter reaches the scan."""
    return pages.where(F.col(page) <= most)


def valid_pdf(content: Column, limit: int = MAX_BYTES) -> Column:
    return (F.length(content) <= limit) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def better_page_text(pages: DataFrame) -> DataFrame:
    """One text per page of pre-extracted candidates (embedded, scanned): 100 embedded words are enough, else more words win."""
    best = F.max_by(F.struct("method", "text", "word_count"), F.struct(F.when((F.col("method") == "embedded") & (F.col("word_count") >= 100), 1).otherwise(0), F.col("word_count"), F.col("method")))
    return pages.groupBy("doc_id", "page").agg(best.alias("b")).select("doc_id", "page", "b.*")


def cached_documents(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Pages of documents whose cache is complete: as many rows as the document has pages."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = n.join(expected, "doc_id").where("n = page_count").select("doc_id")
    return pages.join(whole, "doc_id", "left_semi")


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "append") -> None:
    """One directory per value; rows of a value are spread by AQE's rebalancing, not gathered in one task."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON line per row, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_training(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training rows as csv with a header, JSON lines or Parquet, by the path's ending."""
    fmt = path.rsplit(".", 1)[-1].lower()
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"not a training format: {fmt}")
    writer = df.write.mode(mode).format(fmt)
    # quotes inside a value are doubled, as other readers expect
    (writer.option("header", "true").option("escape", '"') if fmt == "csv" else writer).save(path)


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(place, line): a Markdown table, its head first; bars in values are escaped, line breaks become spaces, null is empty."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    bar = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "kind int, line string")
    body = rows.select(F.lit(2).alias("kind"), *order, bar([cell(c) for c in columns]).alias("line"))
    return head.unionByName(body, allowMissingColumns=True).orderBy("kind", *order).select("line")


def write_markdown(rows: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """The table as text files whose names follow its order."""
    markdown_table(rows, columns, order).write.mode("overwrite").text(path)


# fixed values: fields that are trusted more and less than their document's pages
TRUSTED = ["zip_code", "census_tract", "assessors_parcel_number", "tax_year"]
DOUBTED = ["neighborhood_name", "legal_description", "owner_of_public_record"]


def class_confidence(name: Column, value: Column, pages: Column) -> Column:
    """Confidence of a field that has none of its own: the pages' mean (0.7 if unknown), 0.10 more or less by its class; 0 for null."""
    mean = F.coalesce(pages, F.lit(0.7))
    own = F.when(name.isin(TRUSTED), F.least(F.lit(1.0), mean + 0.10)).when(name.isin(DOUBTED), F.greatest(F.lit(0.0), mean - 0.10)).otherwise(mean)
    return F.when(value.isNull(), 0.0).otherwise(F.round(own, 3))


def fields_with_confidence(df: DataFrame, id_col: str, fields: list[str], pages: str) -> DataFrame:
    """One row per field, null ones too: (id, field_name, field_value, confidence, method)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("field_value")) for f in fields])
    long = df.select(id_col, F.col(pages).alias("_pages"), F.explode(cells).alias("f")).select(id_col, "_pages", "f.*")
    return long.select(id_col, "field_name", "field_value", class_confidence(F.col("field_name"), F.col("field_value"), F.col("_pages")).alias("confidence"), F.lit("regex").alias("method"))


def fields_long(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Entity, attribute, value: one row per field that is not null."""
    cells = F.explode(F.map_entries(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]))).alias("e")
    return df.select(id_col, cells).select(id_col, F.col("e.key").alias("field_name"), F.col("e.value").alias("field_value")).where("field_value is not null")


# schemas of what a finished document leaves behind
RESULTS = "batch_id long, doc_id long, rule_id string, status string, severity string, needs_verification boolean, field string, value string, confidence double, page int"
AUDIT = "batch_id long, doc_id long, action string, detail string, at timestamp_ntz"


def result_rows(documents: DataFrame) -> DataFrame:
    """One row per rule of documents that carry an array ``results``: statuses in the stored spelling, a look where asked.

    manual passes and errors are looked at as well as failures; an unknown status is stored as it came, in capitals.
    """
    r = F.col("r")
    status = F.upper(F.replace(F.trim(r["status"]), F.lit(" "), F.lit("_")))
    flat = documents.select("batch_id", "doc_id", F.explode("results").alias("r"))
    look = F.coalesce(status.isin("FAIL", "VERIFY", "ERROR", "MANUAL_PASS"), F.lit(True))
    return flat.select("batch_id", "doc_id", r["rule_id"].alias("rule_id"), status.alias("status"), F.coalesce(r["severity"], F.lit("STANDARD")).alias("severity"), look.alias("needs_verification"), r["field"].alias("field"), r["value"].alias("value"), r["confidence"].alias("confidence"), r["page"].alias("page"))


def audit_rows(documents: DataFrame) -> DataFrame:
    """One row per document: how many of its rules passed, failed and need a look."""
    count = lambda *s: F.size(F.filter("results", lambda r: F.upper(r["status"]).isin(*s))).cast("string")
    detail = F.concat_ws(", ", F.concat(F.lit("passed "), count("PASS")), F.concat(F.lit("failed "), count("FAIL")), F.concat(F.lit("verify "), count("VERIFY")))
    return documents.select("batch_id", "doc_id", F.lit("QC_COMPLETED").alias("action"), detail.alias("detail"), F.col("finished_at").alias("at"))


def replace_batches(rows: DataFrame, path: str, by: str = "batch_id") -> None:
    """Write rows so that each batch among them is replaced whole and all others stay: a repeated batch leaves no second copy.

    The new partitions take the old ones' places only when all tasks are done, so a write that fails halfway changes nothing.
    """
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def store_documents(documents: DataFrame, path: str) -> None:
    """The results and the audit rows of finished documents (batch_id, doc_id, finished_at, results), batch by batch."""
    replace_batches(result_rows(documents), f"{path}/results")
    replace_batches(audit_rows(documents), f"{path}/audit")
