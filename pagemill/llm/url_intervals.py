"""URL rules by a sort-merge range join (operator 7).

A rule is a host and the beginning of a path. It fits its host and all subdomains of it. The key of a host is
its labels in reverse order, so a host and its subdomains are neighbours; host and path together make one key,

    com NUL example NUL SOH /fr/

in which a rule is a prefix, that is an interval of keys. As a rule for ``com/fr/`` also fits ``blog.example.com/fr/1``, an address asks once for
each of its parent hosts (the number of labels of its host, never more). Such intervals are nested or apart, so one sweep over
the sorted keys with a stack of the rules that are still open finds, at each address, the longest rule of that
host, and the most specific of all its hosts wins in the end.

Distribution: addresses are made distinct, then cut into ranges of keys at quantiles of a random sample of bounded
size (which only balances the load). A rule goes to every range its interval meets; only rules open at a border go to more than one, and there are as many of these
as rules are nested. Where the sample shows one key so often that it spans several ranges, its addresses are
spread over these ranges, and its rules go to all. No range has to fit in memory: the sweep holds the open rules and one batch.

Longest: the number of characters of host and path together; on ties the longer host, then ``block``, then the smaller text.

Cases: a null address, or one without ``://``, has an empty host and an empty path, and no rule fits it unless the rule's
host is empty. A rule with a null host or path counts as having the empty one there. Repeated rules act once, repeated
addresses each get the same verdict. Without rules every address gets the default. Hosts are lower-cased for A to Z only. Only the id
and the address are carried over.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import partitions

LABEL_END, HOST_END = "\x00", "\x01"
SAMPLE_KEYS = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of an address."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({u}, instr({u}, '://') + 3)".format(u="__url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def interval_key(host: Column, path: Column) -> Column:
    """The key of a host and a path."""
    reversed_host = F.array_join(F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(x, F.lit(LABEL_END))), "")
    return F.concat(reversed_host, F.lit(HOST_END), path)


def parent_hosts(host: Column) -> Column:
    """The host itself and every host it is a subdomain of; the empty host too."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    own = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.array_distinct(F.concat(own, F.array(F.lit(""))))


def _ranges(keys: DataFrame, n: int) -> list[str]:
    """n - 1 borders; a key may stand several times. Balance only: results do not depend on them."""
    sample = sorted(r["key"] for r in keys.orderBy(F.rand(11)).limit(SAMPLE_KEYS).collect())
    return [sample[len(sample) * k // n] for k in range(1, n)] if sample else []


def _assigned(frame: DataFrame, borders: list[str], as_rules: bool) -> DataFrame:
    """Adds ``part``: for rules all ranges they meet, for addresses one of those where the key lies."""
    if not borders:
        return frame.withColumn("part", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            keys = b.column("key").to_pylist()
            spread = None if as_rules else b.column("spread").to_pylist()
            for row, key in enumerate(keys):
                lo = bisect_left(borders, key)
                hi = bisect_right(borders, key + "\U0010ffff") if as_rules else bisect_right(borders, key)
                own = range(lo, hi + 1) if as_rules else (lo + spread[row] % (hi - lo + 1),)
                rows.extend([row] * len(own))
                parts.extend(own)
            yield b.take(pa.array(rows, pa.int64())).append_column("part", pa.array(parts, pa.int32()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + ", part int"
    return frame.mapInArrow(run, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, key and rules first. Emits each address with the innermost open rule."""
    part, stack = None, []
    for b in batches:
        parts, keys = b.column("part").to_pylist(), b.column("key").to_pylist()
        rules, verdicts = b.column("rule").to_pylist(), b.column("verdict").to_pylist()
        hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
        out: list[tuple] = []
        for k, key in enumerate(keys):
            if parts[k] != part:
                part, stack = parts[k], []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rules[k] is not None:
                stack.append((key, rules[k], verdicts[k], hosts[k]))
            elif stack:
                top = stack[-1]
                out.append((hosts[k], paths[k], top[1], top[2], len(top[1]), len(top[3])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(_SWEPT_TYPES)], names=list(_SWEPT)
        )


_SWEPT = ("host", "path", "rule", "verdict", "size", "host_size")
_SWEPT_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """id, host, path, rule and verdict of every row. ``rules`` has host, path and verdict, all text."""
    spark = pages.sparkSession
    n = partitions(spark)
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    named = named.select("id", host.alias("host"), path.alias("path"))

    text = F.concat(F.col("host"), F.col("path"))
    known = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.coalesce("verdict", F.lit(default)).alias("verdict"),
        )
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
        .select(
            F.when(F.col("host") == "", F.concat(F.lit(HOST_END), F.col("path")))
            .otherwise(interval_key(F.col("host"), F.col("path")))
            .alias("key"),
            text.alias("rule"),
            "verdict",
            "host",
            "path",
        )
    )
    asked = F.explode(parent_hosts(F.col("host")))
    points = (
        named.select("host", "path")
        .distinct()
        .select("host", "path", asked.alias("parent"))
        .select(
            F.when(F.col("parent") == "", F.concat(F.lit(HOST_END), F.col("path")))
            .otherwise(interval_key(F.col("parent"), F.col("path")))
            .alias("key"),
            F.lit(None).cast("string").alias("rule"),
            F.lit(None).cast("string").alias("verdict"),
            "host",
            "path",
            F.pmod(F.hash("host", "path"), F.lit(1 << 20)).alias("spread"),
        )
    )
    borders = _ranges(points.select("key"), n)
    both = _assigned(points, borders, False).drop("spread").unionByName(_assigned(known, borders, True))
    swept = (
        both.repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "key", F.col("rule").isNull())
        .mapInArrow(_sweep, "host string, path string, rule string, verdict string, size int, host_size int")
    )
    order = F.struct("size", "host_size", F.col("verdict") == "block", "rule", "verdict")
    best = swept.groupBy("host", "path").agg(F.max(order).alias("best"))
    return named.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
