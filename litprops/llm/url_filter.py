"""URL filters by a sort-merge range join.

A rule of host and path fits the host, all its subdomains, and paths that start with its path. A url gets one canonical key for its host
and one for each domain above it: the labels in reverse order, a separator, the path. A rule's canonical key is then a prefix of the key
exactly when the rule fits, so the rule is the interval of keys that start with it, and intervals nest or are apart.

Keys and rules are dealt into ranges of keys and sorted; one sweep over a range keeps the stack of rules that are open at the current key,
and the top of the stack is the longest rule. A rule whose interval reaches into further ranges is sent to each of them. The borders come
from :data:`BORDER_SAMPLE` hashed keys; they only balance the work. Every different url is swept once, so a frequent url or host weighs no
more than a rare one; only domains that some rule names are swept at all.

Defined results: null or no ``://`` gives empty host and path; of the rules of all domains the longest text wins, then the longer host,
then the first by text; where no rule fits the verdict is ``default``; equal rules with different verdicts block; repeated rows are judged
alike and all stay; other columns are ignored; an empty table gives an empty table, and no rules give the default.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.llm.store import Scratch

BORDER_SAMPLE = 20_000
SEPARATOR = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    rest = F.substr(url, F.locate("://", url) + 3)
    found = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(found, F.translate(host, UPPER, LOWER)).otherwise(empty), F.when(found, path).otherwise(empty)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEPARATOR), path)


def _domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _sweep(iterator):
    """Over rows sorted by range, key and kind (rules first): the longest open rule at each url key."""
    part, stack = None, []
    for batch in iterator:
        got = [[] for _ in range(5)]
        for p, key, is_url, rule, action, host, path in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule, action, host))
            elif stack:
                for out, value in zip(got, (host, path, *stack[-1][1:])):
                    out.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in got], names=["host", "path", "rule", "action", "rule_host"])


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``page_id, url``; ``rules`` has ``host, path, action``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    rules = scratch.put(rules.select("host", F.concat("host", "path").alias("rule"), "action", canonical(F.col("host"), F.col("path")).alias("key")), "rules")
    urls = split.filter("host <> ''").distinct().select("host", "path", F.explode(_domains(F.col("host"))).alias("domain"))
    named = rules.select(F.col("host").alias("domain")).distinct()
    keys = urls.join(named, "domain", "left_semi").select(canonical(F.col("domain"), F.col("path")).alias("key"), "host", "path")
    keys = scratch.put(keys, "keys")
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = sorted(r.key for r in keys.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(BORDER_SAMPLE).collect())
    borders = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []

    def place(iterator):
        for batch in iterator:
            at = [bisect_right(borders, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    def spread(iterator):
        for batch in iterator:
            rows, at = [], []
            for i, k in enumerate(batch.column(0).to_pylist()):
                reach = range(bisect_right(borders, k), bisect_left(borders, k + "\U0010ffff") + 1)
                rows += [i] * len(reach)
                at += reach
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *taken.columns], names=["part", *batch.schema.names])

    schema = "part int, key string, is_url boolean, rule string, action string, host string, path string"
    none = F.lit(None).cast("string")
    url_rows = keys.select("key", F.lit(True).alias("is_url"), none.alias("rule"), none.alias("action"), "host", "path").mapInArrow(place, schema)
    rule_rows = rules.select("key", F.lit(False).alias("is_url"), "rule", "action", "host", none.alias("path")).mapInArrow(spread, schema)
    swept = url_rows.unionByName(rule_rows).repartition("part").sortWithinPartitions("part", "key", "is_url")
    hits = swept.mapInArrow(_sweep, "host string, path string, rule string, action string, rule_host string")
    order = F.struct(-F.length("rule"), -F.length("rule_host"), F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
