"""Quality rules as a ledger of failure bits (operator 8), in DataFrame functions only.

Every rule is evaluated once. The ledger keeps, for each document, the measurements and one integer whose
bit k says that rule k failed. A policy is a mask over these bits, so applying another version of a policy, or asking
what a rule alone removes, is bitwise arithmetic over the ledger and never touches a text again.

Cases: a null or empty text has no words and zero for every measurement; it fails ``few_words`` alone. Repeated
rows are judged each for itself. An empty table gives an empty ledger. Only the id column is carried over, so
other columns of any name do no harm. A text of any length is judged whole: repeated windows are found by
sorting the windows of a text, not by comparing pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD_BREAK, let

SYMBOLS = "#*$%&|<>"
A_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


#: Their order gives the bits, so new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule("no_lower_case", "n_words >= 20 AND no_lower"),
)

#: Versions of the policy: the rules each applies.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v2": tuple(r.name for r in RULES),
}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules; an unknown name is an error."""
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _repeated_words(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Each window is one integer, its hash above and its place in the low bits, so equal windows are neighbours once
    sorted. Neighbours count as equal only if their words are, so a clash of hashes adds nothing.
    """
    n = F.size(ws)
    width = F.ceil(F.log2(F.size(ws).cast("double"))).cast("int")

    def windows(low: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
            .bitwiseAND(F.bitwise_not(low))
            .bitwiseOR(i.cast("bigint")),
        )

    def place(x: Column, low: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def same(x: Column, y: Column, low: Column) -> Column:
        i, j = place(x, low), place(y, low)
        words = [F.get(ws, i + k) == F.get(ws, j + k) for k in range(3)]
        return (x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0) & words[0] & words[1] & words[2]

    def covered(s: Column, low: Column) -> Column:
        pairs = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: same(F.get(s, j - 1), F.get(s, j), low))

        def both(j: Column) -> Column:
            starts = [place(F.get(s, j - 1), low), place(F.get(s, j), low)]
            return F.array(*(i + k for i in starts for k in range(3)))

        return F.size(F.array_distinct(F.flatten(F.transform(pairs, both))))

    def sorted_windows(low: Column) -> Column:
        return let(F.sort_array(windows(low)), lambda s: covered(s, low))

    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1
    return F.when(n < 4, F.lit(0)).otherwise(let(low, sorted_windows)).cast("bigint")


def measurements(text: Column) -> Column:
    """A struct of the counts that the rules use."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(A_WORD)))

    def counted(ws: Column, ls: Column) -> Column:
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            ((F.upper(t) == t) & (F.lower(t) != t)).alias("no_lower"),
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            _repeated_words(ws).alias("n_repeat_words"),
        )

    return let(words, lambda ws: let(lines, lambda ls: counted(ws, ls)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: the id, the measurements and ``failed_bits``."""
    measured = docs.select(docs[id_col].alias("id"), measurements(docs[text_col]).alias("m")).select("id", "m.*")
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measured.withColumn("failed_bits", bits).withColumnRenamed("id", id_col)


def passes(bits: Column, policy: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) == 0


def ablations(
    ledger_df: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, those that only this rule removes, and those kept.

    The ledger is reduced to one row per bit pattern first, at most 2 ** rules of them, so no rule rescans documents.
    """
    patterns = ledger_df.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("policy"),
                F.lit(rule).alias("rule"),
                F.lit(mask([rule], rules)).cast("bigint").alias("bit"),
                F.lit(mask(names, rules)).cast("bigint").alias("mask"),
            )
            for name, names in policies.items()
            for rule in names
        )
    )
    hit = F.col("failed_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.select("failed_bits", "n", F.explode(cells).alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
