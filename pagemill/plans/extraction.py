"""The document job: one DataFrame over all pages of all jobs instead of a loop over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import documents as od
from pagemill.operators.jobs import choose_model
from pagemill.operators.mutations import upsert
from pagemill.operators.prompts import resolve_prompts
from pagemill.operators.scoring import LoadFn, score_pages
from pagemill.session import path_exists
from pagemill.sources.cache import KEYS, last_run, only_run, read_ocr_cache, write_ocr_cache


def _given() -> Column:
    """Where a model gave a text that can be joined to its page."""
    return F.col("success") & F.col("job_id").isNotNull() & F.col("page_num").isNotNull()


def _passed(run_path: str, pages: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``pages`` with ``values`` where the model succeeded, from the run that scored them: its table has their columns, so nothing is joined."""
    given = pages.sparkSession.read.parquet(run_path)
    return given.select(*pages.columns, *[F.when(_given(), value).alias(name) for name, value in values.items()])


def stage_one(
    pages: DataFrame,
    load_ocr: LoadFn,
    cache_path: str,
    method: str = "auto",
    force_ocr: bool = False,
    start: int | None = None,
    end: int | None = None,
    run: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Range, routing, scoring and stage table: pages with their stored text, and those still without one.

    The stage table at ``cache_path`` is the barrier between the stages and the
    point of recovery: a call with a higher ``run`` scores only pages without a
    success in an earlier run, and repeating a call gives the same again. It keeps
    the columns of the pages too: those of the last run are read from it together
    with their texts, and only the texts of earlier runs are joined. The pages
    without a text are then those that failed in the last run.
    """
    spark = pages.sparkSession
    routed = od.route_pages(
        od.with_has_text(od.select_page_range(pages, start, end)), method, force_ocr
    )
    scored = routed.where("route <> 'embedded'")
    given = ["ocr_text", "processing_time"]
    if run > 1:
        done = read_ocr_cache(spark, cache_path, before_run=run).where("success").select(*KEYS, *given)
        scored = od.pages_to_do(scored, done)
    results = score_pages(scored, load_ocr).select(
        *scored.columns,
        F.col("text").alias("ocr_text"),
        F.col("seconds").alias("processing_time"),
        "success",
        "error",
    )
    write_ocr_cache(results, cache_path, run)
    if last_run(spark, cache_path, run):
        now = _passed(f"{cache_path}/run={run}", scored, {c: F.col(c) for c in given})
        if run == 1:
            rest = routed.where("route = 'embedded'")
        else:
            rest = routed.join(done.withColumn("__done", F.lit(True)), KEYS, "left").where("route = 'embedded' OR __done").drop("__done")
        return now.unionByName(rest, allowMissingColumns=True), now.where("ocr_text IS NULL").select(*KEYS)
    stage1 = read_ocr_cache(spark, cache_path).where("success").select(*KEYS, *given)
    merged = routed.join(stage1, KEYS, "left")
    return merged, merged.where("route <> 'embedded' AND ocr_text IS NULL").select(*KEYS)


def stage_texts(
    pages: DataFrame, inputs: list[str], load: LoadFn, prompt_type: str, path: str, run: int, name: str, spare: Sequence[str] = ()
) -> DataFrame:
    """``pages`` with the model's text as ``name``, null where the model failed, by way of a stage table at ``path``.

    The table is a barrier: each page meets the model once, however many results are read from here, and a job that fails later keeps what the
    model gave. A call with a higher ``run`` leaves out pages with a success in an earlier run on the same ``inputs``. It keeps the columns of the
    pages too: while there is one run, pages and texts are read from it together. Columns named in ``spare`` are wanted only where the
    model failed, and may come back as null elsewhere.
    """
    spark = pages.sparkSession
    asked = pages.withColumn("__asked", F.xxhash64(*inputs))
    keys = [*KEYS, "__asked"]
    to_do = asked
    if run > 1 and path_exists(spark, path):
        done = read_ocr_cache(spark, path, before_run=run).where("success")
        to_do = asked.join(done.select(keys), keys, "left_anti")
    given = score_pages(to_do, load, prompt_type)
    wanted = [F.when(~_given(), F.col(c)).alias(c) if c in spare else F.col(c) for c in asked.columns]
    write_ocr_cache(given.select(*wanted, "text", "success", "error"), path, run)
    if run == 1 and only_run(spark, path, run):
        return _passed(f"{path}/run={run}", pages, {name: F.col("text")})
    texts = read_ocr_cache(spark, path).where("success").select(*keys, F.col("text").alias(name))
    return asked.join(texts, keys, "left").drop("__asked")


def _by_rule() -> Column:
    return (
        F.when(F.col("route") == "ocr", F.coalesce("ocr_text", F.lit("")))
        .when(F.col("route") == "embedded", F.col("embedded_text"))
        .otherwise(od.rule_merge(F.col("embedded_text"), F.col("ocr_text")))
    )


def _assembled(pages: DataFrame, missing: DataFrame) -> DataFrame:
    """Document parts; those of documents with missing pages have ``is_complete`` false (J1: a caller fails these jobs)."""
    incomplete = missing.select("job_id").distinct().withColumn("__missing", F.lit(True))
    docs = od.assemble_documents(pages).join(incomplete, "job_id", "left")
    return docs.withColumn("is_complete", F.col("__missing").isNull()).drop("__missing")


def extract_documents(
    pages: DataFrame,
    load_ocr: LoadFn,
    cache_path: str,
    method: str = "auto",
    force_ocr: bool = False,
    start: int | None = None,
    end: int | None = None,
    run: int = 1,
    timed: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Stage one, rule merge, assembly.

    ``pages`` is (job_id, page_num, embedded_text). Returns the document parts
    and the pages still without a result.
    """
    merged, missing = stage_one(pages, load_ocr, cache_path, method, force_ocr, start, end, run)
    seconds = F.coalesce("processing_time", F.lit(0.0)) if timed else F.lit(0.0)
    texts = merged.select(
        "job_id",
        "page_num",
        F.col("route").alias("method"),
        seconds.alias("processing_time"),
        _by_rule().alias("text"),
    )
    return _assembled(texts, missing), missing


def two_stage_documents(
    pages: DataFrame,
    jobs: DataFrame,
    catalog: DataFrame,
    load_ocr: LoadFn,
    load_merge: LoadFn,
    load_format: LoadFn,
    cache_path: str,
    current: DataFrame | None = None,
    run: int = 1,
    timed: bool = True,
    **routing,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole document job: stage one, model merge, format, upsert, assembly.

    ``jobs`` has job_id, prefer_quality, strategy, custom_prompt and
    output_format; each page meets its job's merge model and prompt. Pages with
    both texts go to the merge model, which gets merge_model, prompt, embedded_text
    and ocr_text; where it fails the rule merge stands in. Formats other than
    text go to the format model, and keep the merged text where that fails. Both models write stage tables beside ``cache_path``, so
    that each page meets them once and a resumed job does not ask them again.
    Returns document parts, the page results upserted into ``current`` and the
    pages without a result.
    """
    merged, missing = stage_one(pages, load_ocr, cache_path, run=run, **routing)
    chosen = choose_model(jobs, F.coalesce("prefer_quality", F.lit(True)), F.col("strategy"))
    asked = resolve_prompts(
        chosen.withColumnRenamed("merge_model", "model").withColumn("prompt_type", F.lit("merge")), catalog
    ).select("job_id", F.col("model").alias("merge_model"), "prompt", "output_format")
    ready = merged.join(asked, "job_id")

    # Every page takes one way through each stage, and the ways are put together again by union: no text is joined to its page a second time.
    kept = [*KEYS, "route", "processing_time", "ocr_text", "output_format"]
    to_merge = ready.where("route = 'hybrid'").select(*kept, "merge_model", "prompt", "embedded_text")
    merged_texts = stage_texts(
        to_merge, ["merge_model", "prompt", "embedded_text", "ocr_text"], load_merge, "merge", f"{cache_path}-merge", run, "merged",
        spare=["merge_model", "prompt", "embedded_text"],
    ).select(*kept, F.coalesce("merged", _by_rule()).alias("merged"))
    second = merged_texts.unionByName(ready.where("route <> 'hybrid'").select(*kept, _by_rule().alias("merged")))
    to_format = second.where("output_format IS DISTINCT FROM 'text'")
    formatted = stage_texts(to_format, ["output_format", "merged"], load_format, "format", f"{cache_path}-format", run, "formatted", spare=["merged"])
    shaped = formatted.unionByName(second.where("output_format = 'text'"), allowMissingColumns=True)
    final = shaped.select(
        "job_id",
        "page_num",
        F.col("route").alias("method"),
        (F.coalesce("processing_time", F.lit(0.0)) if timed else F.lit(0.0)).alias("processing_time"),
        "ocr_text",
        F.coalesce("formatted", "merged").alias("merge_text"),
    )
    # The pages are those of known jobs by their join above; only stored ones have to be looked up.
    results = upsert(
        None if current is None else current.join(jobs.select("job_id"), "job_id", "left_semi"),
        final.where("page_num IS NOT NULL").withColumn("run", F.lit(run)),
        KEYS,
        F.col("run"),
        ["method", "processing_time", "ocr_text", "merge_text"],
    )
    docs = _assembled(results.withColumn("text", F.coalesce("merge_text", F.lit(""))), missing)
    return docs, results, missing
