"""The registered query of every operator of this package, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import collision_dedup, collocations, dom_marginals, flow_mix, forest_jaccard, ftrl_toxicity, lattice_lm, page_labels, prefix_bpe
from pagemill.llm import rule_ledger, source_audit, url_intervals, whole_tokens, zstd_quality
from pagemill.llm.common import fold, table

Build = Callable[[SparkSession, str], DataFrame]

#: The sentencepiece model that the tokenising query and the language model use.
PIECES_MODEL = "piece_bpe_32k.model"

QUERIES: dict[str, Build] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def _judged(spark: SparkSession, sf_dir: str, trainer, threshold: float) -> DataFrame:
    """Scores of all documents by a model that learned from the rows outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = trainer(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return zstd_quality.score_texts(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query()
def op1_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression classifier over all documents."""
    return _judged(spark, sf_dir, zstd_quality.train, 0.3)


@query()
def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTRL classifier over all documents."""
    return _judged(spark, sf_dir, ftrl_toxicity.train, 0.5)


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES_MODEL)


@query()
def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, as digests."""
    return prefix_bpe.encoding_digests(table(spark, sf_dir, "documents"), pieces_path())


@query()
def op4_forest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all documents at a Jaccard similarity of 0.8 on five-word shingles."""
    found = forest_jaccard.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_links", "component_id", "kept")


@query()
def op5_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed, sources = flow_mix.mix_by_source(docs)
    known = sources.select(F.col("source").alias("name"), F.col("words").alias("source_size"), "target")
    return mixed.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id",
        "source",
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("__size") * F.col("__copies")).cast("bigint").alias("taken"),
    )


@query()
def op6_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    model = dom_marginals.train(page_labels.labelled_pages())
    found = dom_marginals.extract(table(spark, sf_dir, "pages"), model)
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: host, path and verdict of the rules of operator 7's query.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query(r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k(h, b, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, h || b AS rule, v, row_number() OVER (
    PARTITION BY page_id, host, path ORDER BY length(h || b) DESC NULLS LAST) AS n
  FROM p LEFT JOIN k ON (host = h OR host LIKE '%.' || h) AND starts_with(path, b))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1""")
def op7_url_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest fitting rule for every page."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_intervals.judge(table(spark, sf_dir, "pages"), rules)


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
spots AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  upper(t) = t AND lower(t) <> t AS no_lower,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(spots.n, 0) AS n_repeat_words FROM w LEFT JOIN spots USING (r)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
  + 4 * (5 * n_symbols > n_words)::INT + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT
  + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::INT
  + 32 * (n_words >= 20 AND no_lower)::INT AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits,
  (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM f""")
def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger over all documents, judged by the newest policy."""
    found = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "failed_bits",
        (~rule_ledger.passes(F.col("failed_bits"), rule_ledger.POLICIES["base"])).alias("base_failed"),
        rule_ledger.passes(F.col("failed_bits"), rule_ledger.POLICIES["v2"]).alias("kept"),
    )


@query()
def op10_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return collision_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and lattice likelihoods of all documents, learned from the rows outside fold 2 of 7."""
    docs = table(spark, sf_dir, "documents")
    return lattice_lm.score_documents(docs, pieces_path(), fold(F.col("doc_id"), 7) == 2)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), {_LETTERS}) AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(v, 0)::HUGEINT AS v, coalesce(t, 0)::HUGEINT AS t FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS t FROM c GROUP BY 1, 2) USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang)
  JOIN (SELECT lang, sum(n) AS t FROM c GROUP BY 1) USING (lang) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // (t + 5 * v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a
  JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a
  JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
  PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x
QUALIFY part = 'pair' OR rank <= 50""")
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and their most outstanding terms, over all documents."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op12_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    return whole_tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query(rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_LETTERS}) AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
x AS (SELECT c.*, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c),
s AS (SELECT x.lang, x.k, x.phrase, x.a, x.j, l.a AS l, r.a AS r, n, CAST((1000 * x.a::HUGEINT * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.k = j AND l.phrase = array_to_string(ws[1 : j], ' ')
  JOIN f r ON r.lang = x.lang AND r.k = x.k - j AND r.phrase = array_to_string(ws[j + 1 :], ' ') JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
QUALIFY rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of each language over all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))
