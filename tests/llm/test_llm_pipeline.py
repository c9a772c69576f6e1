import corpus_pipeline
from collections import Counter

import pytest

import __spark_entry__ as entry
from pagemill.llm import queries
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert entry.queries()[name] is queries.QUERIES[name]
    df = queries.QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    if name in queries.ORACLE_SQL:
        assert [p for p in compare(df, connect(SF_DIR), queries.ORACLE_SQL[name]) if not p.startswith("note")] == []
        return
    id_col, table = {"op6": ("page_id", "pages"), "op10": ("vec_id", "embeddings")}.get(name.split("_")[0], ("doc_id", "documents"))
    want = Counter(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(id_col).collect())
    assert Counter(r[id_col] for r in df.collect()) == want


def test_stages_on_a_small_folder(spark, docs, tmp_path):
    good = "the river runs past the old stone bridge and the market where people buy bread and letters are sent home every day"
    rows = [(k, f"{good} number {k} " + " ".join(f"w{k * 31 + j}" for j in range(40)), f"s{k % 3}") for k in range(120)]
    rows += [(200 + k, " ".join(f"&&&{k}{j}###" for j in range(60)), "s0") for k in range(60)]
    rows += [(300 + k, f"{good} you bozo and twit, bozo {k} " + " ".join(f"v{k * 31 + j}" for j in range(40)), "s1") for k in range(60)]
    rows += [(400 + k, rows[k][1], "s2") for k in range(10)] + [(500, None, None), (501, "", "s1")]
    marks = [(k, 1, 0) for k in range(120)] + [(200 + k, 0, 0) for k in range(60)] + [(300 + k, 1, 1) for k in range(60)]
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "encoding":
            assert out.columns == frame.columns
        path = str(tmp_path / f"{name}.out")
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        kept[name] = [r.doc_id for r in frame.select("doc_id").collect()]
    clean = set(range(120))
    assert not {k for k in kept["toxicity"] if 300 <= k < 400} and clean <= set(kept["toxicity"])
    assert not {k for k in kept["quality"] if 200 <= k < 300} and clean <= set(kept["quality"])
    assert not {k for k in kept["near duplicates"] if 400 <= k < 500} and clean <= set(kept["near duplicates"])
    assert set(kept["mixing"]) <= set(kept["near duplicates"]) and max(Counter(kept["mixing"]).values()) <= 3
    assert Counter(kept["encoding"]) == Counter(kept["mixing"])
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(kept["encoding"])
