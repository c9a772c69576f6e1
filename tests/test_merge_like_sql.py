"""rule_merged_text and its SQL on documents with odd white space and letters, blank texts, ids given twice or missing, and no text."""

import duckdb
import pytest

from pagemill.functions import text as ft
from pagemill.operators import documents as od
from pagemill.plans import all_queries
from pyspark.sql import functions as F
from tests.oracle_check import compare

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = {
    "empty": [(1, ""), (2, "a\nb")],
    "blank": [(1, "   "), (2, "\n"), (3, "\n\n\n\nfifth"), (4, " \n \n"), (5, "\u3000\n\u00a0")],
    "tabs": [(1, "\t"), (2, "a\tb\nc\nd\ne\nA  b"), (3, "a\nb\nc\nd\n\t\nf"), (4, "a\n\nc\nd\n\t\nf")],
    "line ends": [(1, "a\r\nb\r\nc\r\nd\r\nA\r\n"), (2, "a\r\nb\r\nc\r\nd\r\n\r\ne"), (3, "a\nb\nc\nd\n \u2028\ne\x0b")],
    "spaces": [(1, "a\u00a0b\nc\nd\ne\na b"), (2, "a\nb\nc\nd\n\u2003a\u00a0"), (3, "a\nb\nc\nd\n\u3000"), (4, "a\x0bb\nc\nd\ne\na b"), (5, "a\nb\nc\nd\n\x85")],
    "letters": [(1, "\u039f\u03a3\nb\nc\nd\n\u03bf\u03c2"), (2, "\u03bf\u03c3\nb\nc\nd\n\u039f\u03a3"), (3, "\u0130\nb\nc\nd\ni"), (4, "i\u0307\nb\nc\nd\n\u0130"), (5, "\u1e9e x\nb\nc\nd\n\u00df  X")],
    "one id twice": [(1, "a\nb\nc\nd\ne\nf"), (1, "a\nb\nc\nd\ne\nf"), (2, "x\ny")],
    "known to the other": [(1, "a"), (1, "a\nb\nc\nd\nA\nf"), (2, "a\nb\nc\nd\nA"), (2, "a\nb\nc\nd\nE\ne")],
    "no id": [(None, "a\nb\nc\nd\ne\nf"), (None, "a\nb\nc\nd\ne\nf"), (3, "a")],
    "one without id": [(None, "a\nb\nc\nd\ne\nf"), (3, "a")],
    "no text": [(1, None), (2, "a"), (3, None), (3, "a"), (None, None)],
}


def _documents(rows, tmp_path, texts):
    path = f"{tmp_path}/documents.parquet"
    rows([(i, t, "en", "src0", 0) for i, t in texts], DOCUMENTS).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_merged_as_in_sql(spark, rows, tmp_path, kind):
    q = all_queries()["rule_merged_text"]
    con = _documents(rows, tmp_path, TEXTS[kind])
    assert compare(q.build(spark, str(tmp_path)), con, q.sql) == []


def test_lines_of_one_number_go_by_their_text(spark, rows, tmp_path):
    """Two texts under one id leave the order of lines of the same number open in SQL; here it is that of the lines."""
    _documents(rows, tmp_path, [(1, "b\nx\ny\nz\nlost"), (1, "a\n"), (2, "a")])
    got = {r.job_id: r.merge_text for r in all_queries()["rule_merged_text"].build(spark, str(tmp_path)).collect()}
    assert got == {1: "a\nb\n\nx\ny\nz\nscanned copy 1\nlost\nscanned copy 1", 2: "a\nscanned copy 2"}


def test_texts_of_ids_given_once_are_not_shuffled(spark, rows, tmp_path):
    _documents(rows, tmp_path, [(n, f"a\nb {n}") for n in range(20)])
    plan = all_queries()["rule_merged_text"].build(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_keys_of_several_columns(spark, rows):
    pages = rows(
        [(1, 1, "a", "A\nb"), (1, 2, "a", "c"), (1, 2, "C", "c\nd"), (1, None, None, "x"), (1, None, "y", None), (2, 1, None, " \n"), (2, 2, None, None)],
        "job_id int, page_num int, embedded_text string, ocr_text string",
    )
    assert sorted(map(tuple, od.merge_by_key(pages).collect()), key=str) == [(1, 1, "a\nb"), (1, 2, "C\na\nd"), (1, None, "y\nx")]


def test_the_rule_of_pages_is_as_it_was(spark, rows):
    merged = od.rule_merge(F.col("e"), F.col("o"))
    frame = rows([(" ", "a\u00a0b\nA B\n\t", "a\u00a0b\nA B"), ("a\u00a0b", "A B\nc", "a\u00a0b\nc")], "e string, o string, want string")
    assert [tuple(r) for r in frame.where(~merged.eqNullSafe(F.col("want"))).select(merged, "want").collect()] == []


def test_every_letter_is_lowered_as_in_sql(spark, rows):
    letters = "".join(c for c in map(chr, range(1, 0x1C89)) if c.isalpha())
    got = rows([(letters,)], "t string").select(ft.lower_each(F.col("t"))).first()[0]
    assert got == duckdb.connect().execute("SELECT lower(?)", [letters]).fetchone()[0]
