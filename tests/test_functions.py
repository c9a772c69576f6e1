"""Column functions on the edge rows of FIXTURES.md."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill.functions import commands, files, layout, messages, progress, prompts, text
from pagemill.functions.times import moment
from pagemill.operators import documents as od


def one(spark, column, **values):
    ddl = {str: "string", int: "bigint", float: "double", bool: "boolean", datetime: "timestamp_ntz"}
    schema = ", ".join(f"{k} {ddl.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "value, want",
    [("", False), ("a" * 9, False), ("a" * 10, True), ("a" * 11, True), (" " * 20, False),
     ("\t" + "a" * 10 + " ", True), (" " * 12, False), (None, False)],
)
def test_has_embedded_text(spark, value, want):
    assert one(spark, text.has_embedded_text(F.col("t")), t=value) is want


@pytest.mark.parametrize("method", ["auto", "hybrid", "extract", "ocr"])
@pytest.mark.parametrize("force", [True, False])
@pytest.mark.parametrize("has", [True, False])
@pytest.mark.parametrize("long", [True, False])
def test_routing(spark, method, force, has, long):
    body = "x" * (20 if long else 3)
    route = od.page_route(F.lit(method), F.lit(force), F.lit(has), F.col("t"))
    if force or method == "ocr" or not has or not long:
        want = "ocr"
    else:
        want = "embedded" if method == "extract" else "hybrid"
    assert one(spark, route, t=body) == want


def test_page_marker(spark):
    block = text.page_block(F.lit(3), F.lit("hybrid"), F.lit(1.5), F.col("t"))
    assert one(spark, block, t="ab\nc") == "<!-- Page 3 | Method: HYBRID | Time: 1.50s | Chars: 4 -->\nab\nc\n\n"


@pytest.mark.parametrize(
    "x0, y0, y1, t, size, want",
    [
        (10.0, 200.0, 210.0, "1", 10.0, "line_number"),
        (10.0, 200.0, 210.0, "26", 10.0, "body"),
        (10.0, 200.0, 210.0, "long text", 10.0, "body"),
        (100.0, 200.0, 210.0, "1", 10.0, "body"),
        (60.0, 50.0, 60.0, "Title", 18.0, "header"),
        (60.0, 50.0, 60.0, "Title", 10.0, "body"),
        (60.0, 200.0, 210.0, "Q", 10.0, "qa_marker"),
        (60.0, 200.0, 210.0, " A ", 10.0, "qa_marker"),
        (60.0, 200.0, 210.0, "Q   where", 10.0, "qa_marker"),
        (60.0, 690.0, 701.0, "foot", 10.0, "footer"),
    ],
)
def test_block_type(spark, x0, y0, y1, t, size, want):
    kind = layout.block_type(F.col("x0"), F.col("y0"), F.col("y1"), F.col("t"), F.col("size"))
    assert one(spark, kind, x0=x0, y0=y0, y1=y1, t=t, size=size) == want


@pytest.mark.parametrize(
    "typed, want",
    [
        ("Parse pages 3-7", ("parse_range", None, 3, 7, None)),
        ("parse page 0", ("parse_page", 0, None, None, None)),
        ("parse pages 9 to 2", ("parse_range", None, 9, 2, None)),
        ("parse pages 12", ("parse_range", None, 1, 2, None)),
        ("parse pages 1 to 10", ("parse_range", None, 1, 10, None)),
        ("parse page 5", ("parse_page", 5, None, None, None)),
        ("Parse the whole document", ("parse_all", None, None, None, None)),
        ("parse the entire batch", ("parse_directory", None, None, None, None)),
        ("show as yaml", ("unknown", None, None, None, None)),
        ("show as JSON", ("change_format", None, None, None, "json")),
        ("show status", ("check_status", None, None, None, None)),
        ("get the results", ("get_results", None, None, None, None)),
        ("stop", ("cancel", None, None, None, None)),
        ("", ("unknown", None, None, None, None)),
    ],
)
def test_commands(spark, typed, want):
    assert tuple(one(spark, commands.parse_command(F.col("t")), t=typed)) == want


@pytest.mark.parametrize(
    "typed, want",
    [("parse page 0", "Page number must be a positive integer"), ("parse page 4", None),
     ("parse pages 9 to 2", "Start page must be less than or equal to end page"),
     ("parse pages 0-2", "Page numbers must be positive integers"), ("stop", None)],
)
def test_command_errors(spark, typed, want):
    assert one(spark, commands.command_error(commands.parse_command(F.col("t"))), t=typed) == want


def test_suggestions(spark):
    assert one(spark, commands.suggestions(F.col("t")), t=" DIRECTORY") == ["Parse the whole directory", "Parse directory"]
    assert len(one(spark, commands.suggestions(F.col("t")), t="")) == 10


def test_prompt_variables_and_warnings(spark):
    t = F.col("t")
    assert one(spark, prompts.template_variables(t), t="Text {image") == []
    assert one(spark, prompts.template_variables(t), t="{image} {unknown}") == ["image", "unknown"]
    assert one(spark, prompts.missing_variables(t, F.lit("merge")), t="{image}") == ["embedded_text", "ocr_text"]

    def warned(template, model="other"):
        return one(spark, prompts.prompt_warnings(t, F.lit("ocr"), F.lit(model)), t=template)

    assert warned("{image}" + "x" * 12) == [prompts.SHORT_WARNING]
    assert warned("{image}" + "x" * 13) == []
    assert warned("{image}" + "x" * 1993) == []
    assert warned("{image}" + "x" * 1994) == [prompts.LONG_WARNING]
    assert warned("{image}" + "x" * 20, "qwen3") == [prompts.QWEN_WARNING]
    assert warned("{image}" + "x" * 20, "deepseek-ocr") == [prompts.DEEPSEEK_WARNING]
    assert warned("x") == ["Missing required variables: image"]


def test_template_is_filled_once(spark):
    filled = prompts.fill_template(
        F.lit("A {embedded_text} B {ocr_text} {other} {embedded_text}"),
        {"embedded_text": F.col("e"), "ocr_text": F.col("o")},
    )
    assert one(spark, filled, e="$1 {ocr_text}", o=None) == "A $1 {ocr_text} B  {other} $1 {ocr_text}"


@pytest.mark.parametrize("value, kind", [(84.9, None), (85.0, "warning"), (94.9, "warning"), (95.0, "error")])
def test_percent_alerts(spark, value, kind):
    got = one(spark, progress.percent_alert(F.col("v"), F.lit("CPU usage")), v=value)
    assert (got and got["type"]) == kind


def test_gpu_alerts(spark):
    gpus = F.from_json(F.col("j"), "array<struct<id:int,memory_used_mb:double,memory_total_mb:double,temperature_c:double>>")
    got = one(
        spark,
        progress.gpu_alerts(gpus),
        j='[{"id":0,"memory_used_mb":96,"memory_total_mb":100,"temperature_c":80},'
        '{"id":1,"memory_used_mb":1,"memory_total_mb":100,"temperature_c":79},'
        '{"id":2,"memory_used_mb":86,"memory_total_mb":100},'
        '{"id":3,"memory_used_mb":0,"memory_total_mb":0,"temperature_c":90.5}]',
    )
    assert [(a["type"], a["message"]) for a in got] == [
        ("error", "GPU 0 memory critical: 96.0%"),
        ("warning", "GPU 0 temperature high: 80°C"),
        ("warning", "GPU 2 memory high: 86.0%"),
        ("error", "GPU 3 temperature critical: 90.5°C"),
    ]


@pytest.mark.parametrize(
    "status, pct, started, want",
    [("processing", 0.0, True, None), ("processing", 100.0, True, 0), ("processing", 50.0, False, None),
     ("queued", 50.0, True, None), ("processing", 25.0, True, 300)],
)
def test_eta(spark, status, pct, started, want):
    start = moment(datetime(2024, 1, 1)) if started else F.lit(None).cast("timestamp_ntz")
    eta = progress.eta_seconds(F.col("s"), F.col("p"), start, moment(datetime(2024, 1, 1, 0, 1, 40)))
    assert one(spark, eta, s=status, p=pct) == want


def test_percent_scale(spark):
    assert one(spark, progress.percent(F.col("v")), v=0.87) == pytest.approx(87)
    assert one(spark, progress.percent(F.col("v")), v=87.0) == 87
    assert one(spark, progress.fraction(F.col("v")), v=87.0) == pytest.approx(0.87)
    assert one(spark, progress.stage_percent(F.lit(0), F.lit(3))) == 33.3
    assert one(spark, progress.stage_percent(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize(
    "size, want",
    [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024**2, "5 MB"),
     (3 * 1024**4, "3072 GB"), (102400, "100 KB")],
)
def test_format_bytes(spark, size, want):
    assert one(spark, text.format_bytes(F.col("n")), n=size) == want


@pytest.mark.parametrize("s, want", [(1.25, "1.3s"), (59.0, "59.0s"), (60.0, "1m 0s"), (245.9, "4m 5s"), (7620.0, "2h 7m")])
def test_format_duration(spark, s, want):
    assert one(spark, text.format_duration(F.col("s")), s=s) == want


def test_text_helpers(spark):
    assert one(spark, text.truncate(F.col("t"), 5), t="abcdef") == "ab..."
    assert one(spark, text.truncate(F.col("t"), 5), t="abcde") == "abcde"
    assert one(spark, text.word_count(F.col("t")), t="  a\tb c \n") == 3
    assert one(spark, text.estimated_text_tokens(F.col("t")), t="abc") == 1
    assert one(spark, text.compression_ratio(F.col("t"), F.lit("nope")), t="x" * 512) == 0.5
    assert one(spark, text.batch_status_label(F.lit("processing"), F.lit(2), F.lit(5))) == "Processing (2/5)"
    assert one(spark, text.batch_status_label(F.lit("odd"), F.lit(2), F.lit(5))) == "odd"


def test_file_names(spark):
    p = F.col("p")
    assert one(spark, files.extension(p), p="/a.b/Scan.PDF") == ".pdf"
    assert one(spark, files.extension(p), p="/a.b/noext") == ""
    assert one(spark, files.extension(p), p=".hidden") == ""
    assert one(spark, files.file_stem(p), p="/a.b/scan.v2.pdf") == "scan.v2"
    assert one(spark, files.format_of_path(p), p="out.MD") == "markdown"
    assert one(spark, files.format_mismatch(F.lit("json"), p), p="out.json") is None
    assert "Expected extension '.json'" in one(spark, files.format_mismatch(F.lit("json"), p), p="out.txt")
    assert one(spark, files.effective_mime(F.lit(None).cast("string"), p), p="x.unknown") == files.DEFAULT_MIME


def test_expiry_is_strict(spark):
    at = moment(datetime(2024, 1, 1, 6))
    expiry = files.expires_at(moment(datetime(2024, 1, 1)), 6)
    assert one(spark, files.is_expired(expiry, at)) is False
    assert one(spark, files.is_expired(expiry, moment(datetime(2024, 1, 1, 6, 0, 1)))) is True


def test_geometry(spark):
    fit = layout.fit_within(F.lit(2481), F.lit(3508))
    assert tuple(one(spark, fit)) == (724, 1024)
    assert tuple(one(spark, layout.fit_within(F.lit(10), F.lit(20)))) == (10, 20)
    assert tuple(one(spark, layout.resize_longest(F.lit(100), F.lit(200)))) == (2048, 4096)
    assert one(spark, layout.dpi_ladder(F.lit(250), 72)) == [200, 150, 100, 72]
    assert one(spark, layout.dpi_ladder(F.lit(160), 90)) == [150, 100, 90]
    assert one(spark, layout.aspect_ratio(F.lit(4), F.lit(3))) == 1.33


def test_verdicts(spark):
    def verdict(*pairs):
        array = F.array(*[F.struct(F.lit(v).alias("valid"), F.lit(i).alias("issues")) for v, i in pairs])
        return tuple(one(spark, progress.ensemble_verdict(array)))

    assert verdict((True, ""), (True, "x")) == (True, "")
    assert verdict((False, "a"), (False, "b")) == (False, "a | b")
    assert verdict((False, ""), (False, "b")) == (False, "b")
    assert verdict((True, ""), (False, "b")) == (False, "b")


def test_messages(spark):
    lines = F.array(*[F.lit(x) for x in ("data: {\"a\":1}", "x", "data: {bad", "data: [DONE]", "data: {\"a\":2}")])
    assert one(spark, messages.sse_chunks(lines)) == ['{"a":1}']
    unended = F.array(F.lit('data: {"a":1}'), F.lit('data: {"a":2}'))
    assert one(spark, messages.sse_chunks(unended)) == ['{"a":1}', '{"a":2}']
    assert one(spark, messages.sse_chunks(F.array(F.lit("data: [DONE]"), F.lit('data: {"a":2}')))) == []
    chunk = '{"choices":[{"delta":{"content":"hi"}}]}'
    assert one(spark, messages.chunk_text(F.col("c")), c=chunk) == "hi"
    assert one(spark, messages.chunk_text(F.col("c")), c='{"choices":[{"delta":{"content":""}}]}') is None
    assert one(spark, messages.json_option(F.col("j"), "dpi", "int", 300), j="{bad") == 300
    assert one(spark, messages.json_option(F.col("j"), "dpi", "int", 300), j='{"dpi":150}') == 150


def test_rule_merge(spark):
    merged = od.rule_merge(F.col("e"), F.col("o"))
    assert one(spark, merged, e="Alpha\nbeta  x", o="ALPHA\n\nnew one\nBeta x\nnew one") == "Alpha\nbeta  x\nnew one\nnew one"
    assert one(spark, merged, e=None, o="a\nb") == "a\nb"
    assert one(spark, merged, e="  ", o="a") == "a"
    assert one(spark, merged, e="a", o=None) == "a"
    assert one(spark, merged, e=None, o=None) == ""
