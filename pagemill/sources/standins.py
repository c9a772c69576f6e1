"""Engine entities derived from the generic test tables.

Each function reads whole tables and maps columns; nothing is sampled or cut.
The SQL twins used by the checks are in ``pagemill.plans.oracle_views``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.times import moment
from pagemill.operators.mutations import upsert
from pagemill.session import scratch_dir

EPOCH = datetime(2024, 1, 1)
PAGE_VERSION = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table. Times in it are naive UTC, so the session is set to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files, be it one file or a folder of them.

    A file source takes a folder or a pattern, but no single file; the pattern here fits both, and nothing else.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def micro_batches(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """A stream that brings the rows of each frame in turn, in micro-batches of as many files as there are cores.

    The frames are staged one after the other, each as at most so many files, dealt by ``keys`` so that all tasks write; a file source takes the oldest
    first. The rows of a key lie in one file of a frame, so they come in the order of the frames wherever a micro-batch ends.
    """
    spark = parts[0].sparkSession
    path = scratch_dir(spark, "micro-batches")
    files = spark.sparkContext.defaultParallelism
    for part in parts:
        part.repartition(files, *keys).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def split_rows(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """A stream that brings the rows in ``n`` micro-batches, dealt by a hash of columns. The frame is computed and staged once."""
    spark = df.sparkSession
    path = scratch_dir(spark, "micro-batches")
    files = spark.sparkContext.defaultParallelism
    df.repartition(n * files, *by).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("email"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: owner from the source, type from the language."""
    lang = F.col("lang")
    ext = (
        F.when(lang == "en", ".pdf").when(lang == "fr", ".PNG").when(lang == "de", ".jpeg").otherwise(".docx")
    )
    uploaded = moment(EPOCH) + F.make_dt_interval(mins=F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("user_id"),
        F.col("source").alias("storage_bucket"),
        F.concat(F.lit("scan_"), F.col("doc_id"), ext).alias("filename"),
        F.when(lang == "de", F.lit("image/jpeg")).when(lang == "es", F.lit("text/plain")).alias("content_type"),
        F.col("n_chars").alias("size_bytes"),
        uploaded.alias("uploaded_at"),
    )
    return rows.select(
        "*",
        (F.col("uploaded_at") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"),
        F.when(F.col("size_bytes") < 100, F.col("uploaded_at") + F.expr("INTERVAL 1 HOUR")).alias("deleted_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs; the file is picked by the order key among the documents."""
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "processing")
        .when(F.col("o_orderpriority").startswith("1"), "failed")
        .otherwise("queued")
    )
    rows = table(spark, sf_dir, "orders").withColumn("status", status)
    s, priority = F.col("status"), F.col("o_orderpriority")
    price_cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return rows.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_custkey").alias("parent_batch_id"),
        (F.col("o_orderkey") % n_docs).alias("file_id"),
        "status",
        F.col("o_orderdate").alias("created_at"),
        F.when(s != "queued", F.col("o_orderdate")).alias("started_at"),
        F.when(
            s.isin("completed", "failed"),
            F.col("o_orderdate") + F.make_dt_interval(secs=F.floor("o_totalprice").cast("decimal(18,6)")),
        ).alias("completed_at"),
        F.when(s == "completed", F.lit(100.0))
        .when(s == "processing", (price_cents % 10000) / 100.0)
        .otherwise(F.lit(0.0))
        .alias("progress_pct"),
        F.when(s == "failed", F.lit("extraction failed")).alias("error_message"),
        F.when(priority == "1-URGENT", F.lit("qwen3-vl-8b"))
        .when(priority == "2-HIGH", F.lit("qwen3-vl-4b"))
        .otherwise(F.lit("deepseek-ocr"))
        .alias("model"),
        F.when(priority == "5-LOW", F.lit("text")).otherwise(F.lit("markdown")).alias("output_format"),
        F.when(priority != "4-NOT SPECIFIED", F.substring(priority, 1, 1).cast("int") * 100).alias("dpi"),
        F.when(priority == "3-MEDIUM", F.lit("hybrid")).alias("method"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as batches, with the status of a finished roll-up."""
    done, total = F.count_if(F.col("status") == "completed"), F.count("job_id")
    open_jobs = F.count_if(F.col("status").isin("processing", "queued"))
    return (
        jobs(spark, sf_dir)
        .groupBy(F.col("parent_batch_id").alias("batch_job_id"))
        .agg(
            F.min("created_at").alias("created_at"),
            F.when(open_jobs > 0, "processing").when(done > 0, "completed").otherwise("failed").alias("status"),
            total.alias("total_documents"),
        )
    )


def page_changes(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Line items as page writes: repeated keys and null fields are intended."""
    flag = F.col("l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("page_num"),
        F.when(flag == "A", "ocr").when(flag == "N", "hybrid").otherwise("embedded").alias("method"),
        F.col("l_quantity").alias("processing_time"),
        F.col("l_shipdate").alias("completed_at"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("ocr "), F.col("l_partkey"))).alias("ocr_text"),
        F.when(flag == "N", F.concat(F.lit("merge "), F.col("l_suppkey"))).alias("merge_text"),
        (F.col("l_linestatus") == "F").alias("is_done"),
        F.struct(*PAGE_VERSION).alias("version"),
    )


PAGE_COLUMNS = ["method", "processing_time", "completed_at", "ocr_text", "merge_text", "is_done"]


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (job_id, page_num): the upsert of all page writes."""
    return upsert(None, page_changes(spark, sf_dir), ["job_id", "page_num"], F.col("version"), PAGE_COLUMNS)


def document_pages(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Lines of the documents as pages of text."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        "source",
        "lang",
        F.posexplode(F.split("text", "\n", -1)).alias("__pos", "text"),
    ).select("job_id", (F.col("__pos") + 1).alias("page_num"), "source", "lang", "text")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with the columns assembly needs; method and time follow from the text."""
    n = F.length("text")
    return document_pages(spark, sf_dir).select(
        "job_id",
        "page_num",
        F.when(n < 10, "ocr").when(n < 300, "hybrid").otherwise("embedded").alias("method"),
        (n / 4).alias("processing_time"),
        "text",
    )


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with embedded text and an OCR twin: every fifth line lost, one line gained."""
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: (i + 1) % 5 != 0)
    extra = F.concat(F.lit("scanned copy "), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"),
        F.lit(1).alias("page_num"),
        F.array_join(kept, "\n").alias("embedded_text"),
        F.array_join(F.array_append(lines, extra), "\n").alias("ocr_text"),
    )


def log(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as monitoring log rows."""
    kind = F.col("event_type")
    value = F.col("value")
    pct = F.round(value * 100).cast("bigint") % 10000 / 100.0
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.col("ts").alias("timestamp"),
        F.when(kind == "click", "metric")
        .when(kind.isin("view", "purchase"), "page_completion")
        .when(kind == "signup", "stage_transition")
        .otherwise("error")
        .alias("event_type"),
        F.when(kind == "view", "ocr").when(kind == "purchase", "merge").alias("stage"),
        F.get_json_object("props", "$.k").cast("int").alias("page_number"),
        value.alias("page_duration_s"),
        pct.alias("cpu_percent"),
        (F.round(value * 200).cast("bigint") % 10000 / 100.0).alias("ram_percent"),
        (F.col("event_id") % 2).cast("int").alias("gpu_id"),
        value.alias("memory_used_mb"),
        F.lit(512.0).alias("memory_total_mb"),
        pct.alias("progress_pct"),
    )


def chunks(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Conversation turns as text chunks of one page per conversation."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.lit(1).alias("page_num"),
        F.col("turn").alias("chunk_sequence"),
        F.col("text").alias("chunk_text"),
        (moment(EPOCH) + F.make_dt_interval(secs=(F.col("turn") * 0.04).cast("decimal(18,6)"))).alias(
            "created_at"
        ),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as chat commands."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def prompt_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as named prompts."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("prompt "), F.col("item_id")).alias("name"), "text"
    )


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as layout blocks, 40 to a page, placed by their position and length."""
    pos = F.col("page_num") - 1
    n = F.length("text")
    row = pos % 40
    return document_pages(spark, sf_dir).select(
        "job_id",
        (F.floor(pos / 40) + 1).cast("int").alias("page_num"),
        row.alias("block_no"),
        F.when(n < 100, 10.0).otherwise(50.0).alias("x0"),
        (row * 25.0).alias("y0"),
        (row * 25.0 + 20.0).alias("y1"),
        F.when(n < 100, (n % 30).cast("string")).otherwise(F.col("text")).alias("text"),
        F.when(n % 7 == 0, 18.0).otherwise(12.0).alias("font_size"),
    )


def line_chunks(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Document lines as text chunks that arrive 0 to 79 ms apart; the last line is final."""
    n = F.length("text")
    offset_ms = F.col("page_num") * 30 + n % 50
    # Counted ahead of the explode, that is once per document and not once per line.
    counted = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"), "text", F.size(F.split("text", "\n", -1)).alias("lines")
    )
    lines = counted.select("job_id", "lines", F.posexplode(F.split("text", "\n", -1)).alias("__pos", "text"))
    return lines.withColumn("page_num", F.col("__pos") + 1).select(
        "job_id",
        F.lit(1).alias("page_num"),
        F.col("page_num").cast("bigint").alias("chunk_sequence"),
        F.col("text").alias("chunk_text"),
        (moment(EPOCH) + F.make_dt_interval(secs=(offset_ms / 1000).cast("decimal(18,6)"))).alias("created_at"),
        (F.col("page_num") == F.col("lines")).alias("is_final"),
    )


def stream_commands(spark: SparkSession, sf_dir: str, read=table) -> DataFrame:
    """Events as commands on stream rows: one page per device and tens digit."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 25).cast("int").alias("page_num"),
        F.col("event_id").alias("order_no"),
        F.when(kind == "click", "snapshot")
        .when(kind.isin("view", "signup"), "stage")
        .when(kind == "purchase", "complete")
        .otherwise("failed")
        .alias("kind"),
        F.when(kind == "click", "merge").when(kind == "view", "ocr").when(kind == "signup", "merge").alias("stage"),
        F.when(kind.isin("click", "purchase"), F.concat(F.lit("text "), "event_id")).alias("snapshot_text"),
        F.when(kind == "click", F.col("value") > 100).alias("is_final"),
        F.when(kind == "error", F.concat(F.lit("error "), "event_id")).alias("error"),
        F.col("ts").alias("updated_at"),
    )
