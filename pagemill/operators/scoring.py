"""Model scoring as Spark jobs. The model is a function the caller supplies.

``load_fn()`` runs once per task and returns the scorer, so weights are loaded
once and reused for all rows of the task. Rows stream through in Arrow batches;
input columns are passed on as they came, so no type changes on the way.
Partitions are those of the input, nothing is shuffled unless a batch has to
stay together. A failing row is a result, not an exception.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import progress as fp
from pagemill.operators.documents import first_pages, page_batches, union_calibrated
from pagemill.session import ensure_checkpoint_dir

Scorer = Callable[[dict], str]
BatchScorer = Callable[[list[dict]], Sequence]
LoadFn = Callable[[], Scorer | BatchScorer]
SLICE_BYTES = 4 << 20
RESULT_DDL = "text string, model string, success boolean, error string, attempts int, scale double, seconds double"
RESULTS = {
    "text": pa.string(),
    "model": pa.string(),
    "success": pa.bool_(),
    "error": pa.string(),
    "attempts": pa.int32(),
    "scale": pa.float64(),
    "seconds": pa.float64(),
}


class Scored(str):
    """A text that also says which model gave it, after how many attempts and at what scale."""

    model: str | None = None
    attempts: int = 1
    scale: float = 1.0

    @classmethod
    def of(cls, text: str, model: str | None = None, attempts: int = 1, scale: float = 1.0) -> "Scored":
        out = cls(text)
        out.model, out.attempts, out.scale = model, attempts, scale
        return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _outcome(text: object, seconds: float) -> tuple:
    """The result columns of a text, or of the exception that stands in for it."""
    attempts, scale = getattr(text, "attempts", 1), float(getattr(text, "scale", 1.0))
    if isinstance(text, Exception):
        return "", None, False, str(text), attempts, scale, seconds
    return str(text), getattr(text, "model", None), True, None, attempts, scale, seconds


def _result(scorer: Scorer, row: dict) -> tuple:
    start = time.perf_counter()
    try:
        text = scorer(row)
    except Exception as e:  # noqa: BLE001 - the page fails, the job goes on
        text = e
    return _outcome(text, time.perf_counter() - start)


def _batch_results(scorer: BatchScorer, rows: list[dict]) -> list[tuple]:
    """Results of a scorer of lists; what it raises, or leaves out, is the failure of those rows."""
    start = time.perf_counter()
    try:
        given = list(scorer(rows))
    except Exception as e:  # noqa: BLE001
        given = [e] * len(rows)
    given += [ValueError("no result")] * (len(rows) - len(given))
    seconds = (time.perf_counter() - start) / max(1, len(rows))
    return [_outcome(text, seconds) for text in given[: len(rows)]]


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added, its own untouched."""
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)


def _columns(results: list[tuple]) -> dict[str, pa.Array]:
    return {name: pa.array([r[i] for r in results], kind) for i, (name, kind) in enumerate(RESULTS.items())}


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes, by the mean row of each batch, and at least one row."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def score_pages(pages: DataFrame, load_fn: LoadFn, prompt_type: str = "ocr", batched: bool = False) -> DataFrame:
    """M1: adds the result columns; a failed page has empty text and its error.

    With ``batched`` the loaded scorer takes the rows of an Arrow batch as a
    list and returns as many texts, or exceptions, in order.
    """
    if clash := {"prompt_type", *RESULTS} & set(pages.columns):
        raise ValueError(f"rename the columns {sorted(clash)}: scoring adds columns of these names")
    schema = f"{_ddl(pages)}, prompt_type string, {RESULT_DDL}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load_fn()
        # A scorer of lists gets whole Arrow batches; rows are taken a slice at a time, so that long texts are not all copied at once.
        for batch in batches if batched else _slices(batches):
            rows = [{**r, "prompt_type": prompt_type} for r in batch.to_pylist()]
            results = _batch_results(scorer, rows) if batched else [_result(scorer, r) for r in rows]
            yield _with(batch, {"prompt_type": pa.array([prompt_type] * len(rows), pa.string()), **_columns(results)})

    return pages.mapInArrow(score, schema)


def score_batches(pages: DataFrame, load_fn: Callable[[], Callable], size: int = 8) -> DataFrame:
    """M2: scores consecutive pages of a job in batches of ``size`` (1 to 16).

    The scorer takes a list of rows and returns a list of dicts with text,
    success and error, in order; a missing entry is a failure. When it raises
    NotImplementedError the rows are scored one by one. ``batch_success`` is
    false for every item of a batch with a failure.
    """
    batched = page_batches(pages, size)
    keys = ["job_id", "batch_no"]
    schema = (
        f"{_ddl(batched)}, text string, success boolean, error string, batch_size int, batch_success boolean"
    )

    def one_by_one(scorer: Callable, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            try:
                out.append(scorer([row], single=True)[0])
            except Exception as e:  # noqa: BLE001
                out.append({"text": "", "success": False, "error": str(e)})
        return out

    def run(scorer: Callable, rows: list[dict]) -> list[dict]:
        try:
            given = scorer(rows)
        except NotImplementedError:
            given = one_by_one(scorer, rows)
        except Exception as e:  # noqa: BLE001
            given = [{"text": "", "success": False, "error": str(e)}] * len(rows)
        return [given[i] if i < len(given) else {} for i in range(len(rows))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load_fn()
        held: list[pa.RecordBatch] = []  # slices of the batch under way

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            results = run(scorer, whole.to_pylist())
            ok = [bool(r.get("success", False)) for r in results]
            return _with(
                whole,
                {
                    "text": pa.array([r.get("text") or "" for r in results], pa.string()),
                    "success": pa.array(ok, pa.bool_()),
                    "error": pa.array([r.get("error") for r in results], pa.string()),
                    "batch_size": pa.array([len(ok)] * len(ok), pa.int32()),
                    "batch_success": pa.array([all(ok)] * len(ok), pa.bool_()),
                },
            )

        last = None
        for batch in batches:
            at = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            start = 0
            for i, key in enumerate(at):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield flush()
                    held, start, last = [], i, key
            if start < len(at):
                held.append(batch.slice(start))
        if held:
            yield flush()

    together = batched.repartition(*keys).sortWithinPartitions(*keys, "batch_index")
    return together.mapInArrow(score, schema)


def with_retry(
    fn: Callable[[dict, float], str],
    ladder: Sequence[float],
    is_oom: Callable[[Exception], bool],
    max_attempts: int | None = None,
) -> Scorer:
    """M4: a scorer that retries memory-class errors down a ladder of scales or sizes.

    Other errors are raised at once. The last error is raised when the ladder
    runs out; a ladder of more steps than ``max_attempts`` is refused.
    """
    steps = list(ladder)
    if max_attempts is not None and len(steps) > max_attempts:
        raise ValueError(f"the ladder has {len(steps)} steps, but only {max_attempts} attempts are allowed")

    def scorer(row: dict) -> str:
        for attempt, scale in enumerate(steps, 1):
            try:
                text = fn(row, scale)
            except Exception as e:  # noqa: BLE001
                if not is_oom(e) or attempt == len(steps):
                    e.attempts, e.scale = attempt, float(scale)
                    raise
            else:
                return Scored.of(text, getattr(text, "model", None), attempt, float(scale))
        raise ValueError("the ladder of scales is empty")

    return scorer


def is_oom_error(e: Exception, wide: bool = True) -> bool:
    """X28 for exceptions inside a task."""
    words = ("out of memory", "cuda", "oom") if wide else ("out of memory", "cuda")
    return any(w in str(e).lower() for w in words)


def with_fallback(
    fns: Sequence[tuple[str, Scorer]],
    delay_ms: int = 1000,
    multiplier: float = 2.0,
    retries: int = 0,
    sleep: Callable[[float], None] = time.sleep,
) -> Scorer:
    """M5: tries named scorers in order; each may be retried after a growing delay."""

    def scorer(row: dict) -> str:
        attempts, last = 0, None
        for name, fn in fns:
            for n in range(retries + 1):
                if n:
                    sleep(delay_ms * multiplier ** (n - 1) / 1000)
                attempts += 1
                try:
                    return Scored.of(fn(row), name, attempts)
                except Exception as e:  # noqa: BLE001
                    last = e
        if last is None:
            raise ValueError("no scorers given")
        last.attempts = attempts
        raise last

    return scorer


def merge_with_model(pages: DataFrame, load_fn: LoadFn) -> DataFrame:
    """M3 with a model: its text becomes ``merge_text``; rows carry embedded_text and ocr_text."""
    scored = score_pages(pages, load_fn, "merge")
    return scored.withColumnRenamed("text", "merge_text")


def validate_and_refine(
    pages: DataFrame, validators: Sequence[Callable[[dict], tuple[bool, str]]], load_refine: LoadFn
) -> DataFrame:
    """M6: validates ``text`` with all validators and refines the rows found invalid.

    Rows out carry valid, issues (of the validation) and refined. Without
    validators every row counts as valid. A failed refinement keeps the text.
    """
    checks = list(validators)
    verdict = pa.list_(pa.struct([("valid", pa.bool_()), ("issues", pa.string())]))
    verdict_ddl = "array<struct<valid:boolean,issues:string>>"

    def validate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [[dict(zip(("valid", "issues"), check(r))) for check in checks] for r in rows]
            yield _with(batch, {"__verdicts": pa.array(found, verdict)})

    judged = (
        pages.mapInArrow(validate, f"{_ddl(pages)}, __verdicts {verdict_ddl}")
        .withColumn("__v", fp.ensemble_verdict(F.col("__verdicts")))
        .select(*pages.columns, "__v.valid", "__v.issues")
    )

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, done = batch.column(at).to_pylist(), [False] * batch.num_rows
            for i, row in enumerate(batch.to_pylist()):
                if row["valid"]:
                    continue
                scorer = scorer or load_refine()
                result = _result(scorer, row)
                if result[2]:
                    texts[i], done[i] = result[0], True
            out = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield _with(out, {"refined": pa.array(done, pa.bool_())})

    # One pass over the rows: splitting by verdict would run the validators twice.
    return judged.mapInArrow(refine, f"{_ddl(judged)}, refined boolean")


def score_with_calibration(pages: DataFrame, load_fn: LoadFn, n: int = 3) -> DataFrame:
    """M7: scores the first ``n`` pages of each document, then the rest with those as ``context``.

    ``pages`` has job_id, page_num, text; the calibration result becomes the
    context of the later pages of the same document. The calibrated pages are
    checkpointed: they are used twice and must not be scored twice.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    source = pages.withColumnRenamed("text", "input_text")
    columns = source.columns
    first = score_pages(
        source.where(F.col("page_num") <= n).withColumn("context", F.lit(None).cast("string")), load_fn
    ).checkpoint()
    # One context row per document meets its pages; the pages with it are not shuffled again.
    rest = source.where(F.col("page_num") > n)
    with_context = rest.join(first_pages(first, n), "job_id", "left").select(*columns, "context")
    return union_calibrated(first, score_pages(with_context, load_fn))


def format_pages(pages: DataFrame, load_fn: LoadFn, fmt: str) -> DataFrame:
    """M8: formats ``text`` with the model unless the output is plain text."""
    if fmt == "text":
        return pages
    scored = score_pages(pages.withColumnRenamed("text", "input_text"), load_fn, fmt)
    text = F.when(F.col("success"), F.col("text")).otherwise(F.col("input_text"))
    return scored.withColumn("text", text).select(*pages.columns)
