"""Building blocks that keep hot keys and global orders off single tasks.

* :func:`lookup_join`   many rows per key against a table that is unique by key; heavy keys are salted.
* :func:`running_total`, :func:`contiguous_index` prefix sums and numbers over an order, cut into ranges, so no window ever holds the whole table
  or a whole group.
* :func:`grouped_median` exact median by selection: count per bucket, then sort only the bucket that holds the middle.

Bucket borders are literals found in one approximate-quantile pass, so every branch of a plan, and every retry, sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litprops.session import settle

HEAVY_ROWS = 2_000_000  # rows of one key that a single task may take
HEAVY_KEYS = 10_000  # most keys ever salted; a key below the cut holds less than 1/10,000 of the rows


def _any_null(cols: Sequence[str]) -> Column:
    flag = F.lit(False)
    for c in cols:
        flag = flag | F.col(c).isNull()
    return flag


def _can_hash(kind: T.DataType) -> bool:
    """Whether Spark hashes values of this type: no map and no VARIANT at any depth."""
    if isinstance(kind, T.ArrayType):
        return _can_hash(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_can_hash(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def hashable(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in skip and _can_hash(f.dataType)]


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys appear once, from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on])


def heavy_keys(counts: DataFrame, on: Sequence[str], n: str = "_n", heavy_rows: int | None = None) -> list[Row]:
    """``(on..., _fan)`` of the keys above ``heavy_rows``, heaviest first, from a table of key counts. At most ``HEAVY_KEYS`` rows,
    so they may come to the driver and be broadcast. A NULL key is listed like any other."""
    heavy_rows = heavy_rows or HEAVY_ROWS
    fan = F.ceil(F.col(n) / F.lit(heavy_rows)).cast("int").alias("_fan")
    return counts.filter(F.col(n) > heavy_rows).orderBy(F.desc(n)).limit(HEAVY_KEYS).select(*on, fan).collect()


def key_counts(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the fullest ``by`` key; one pass over the key columns, one number to the driver."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    heavy_rows: int | None = None,
    spread_by: Sequence[str] | None = None,
    heavy: list[Row] | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` (unique by ``on``).

    The keys of ``rows`` are counted first (a pass over the key columns; ``heavy`` takes the answer of :func:`heavy_keys` from a
    caller that has counted already). Without a heavy key this is a plain join, and adaptive execution broadcasts ``table`` when its
    measured size allows. Otherwise rows of a heavy key are dealt over ``ceil(count / heavy_rows)`` salts by a hash of their other
    columns, only the matching table rows are copied that often, and rows with a NULL key, which match nothing, are dealt over tasks
    as well.
    """
    on = list(on)
    if heavy is None:
        heavy = heavy_keys(key_counts(rows, on), on, heavy_rows=heavy_rows)
    if not heavy:
        return rows.join(table, on, how)
    spread = list(spread_by) if spread_by is not None else hashable(rows, on)
    dice = F.xxhash64(*[F.col(c) for c in (spread or on)])
    schema = T.StructType([*[rows.schema[c] for c in on], T.StructField("_fan", T.IntegerType())])
    fans = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in heavy], _nullable(schema)))
    salt = F.when(_any_null(on), F.pmod(dice, F.lit(4096))).otherwise(F.pmod(dice, F.coalesce("_fan", F.lit(1)))).cast("int")
    salted = rows.join(fans, on, "left").withColumn("_salt", salt).drop("_fan")
    copies = table.join(fans, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    return salted.join(copies, on + ["_salt"], how).drop("_salt")


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def split_heavy(df: DataFrame, by: Sequence[str], heavy: list[Row]) -> tuple[DataFrame, DataFrame]:
    """``(cold rows, rows of the heavy keys with their _fan)``; the listed keys are few and broadcast."""
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("_fan", T.IntegerType())])
    fans = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in heavy], _nullable(schema)))
    marked = null_safe_join(df, fans, by, "left")
    return marked.filter("_fan IS NULL").drop("_fan"), marked.filter("_fan IS NOT NULL")


SMALL_ROWS = 10_000  # a table up to this many rows may be broadcast


def attach_small(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", most: int = SMALL_ROWS) -> DataFrame:
    """Join a table expected to be tiny (one row per dataset, split, scaler ...) whose keys are therefore all heavy.

    Its rows are fetched once, no more than ``most``; if that is all of them they are broadcast and ``rows`` does not shuffle.
    A larger table goes through :func:`lookup_join`.
    """
    found = table.limit(most + 1).collect()
    if len(found) > most:
        return lookup_join(rows, table, on, how)
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, table.schema)), list(on), how)


def bucket_count(df: DataFrame, n: int | None = None) -> int:
    """Buckets to cut an order into: four per shuffle partition unless given."""
    return n or max(2, min(16384, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def borders(df: DataFrame, order: str, n: int | None = None) -> list[float]:
    """Inner borders that cut ``order`` (numeric) into about ``n`` even buckets. One pass; the driver gets at most ``n`` numbers."""
    n = bucket_count(df, n)
    probs = [i / n for i in range(1, n)]
    values = df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", probs, 1.0 / (2 * n))
    return sorted({v for v in values if v == v})


def with_bucket(df: DataFrame, order: str, cuts: list[float], name: str = "_bucket") -> DataFrame:
    """Bucket number of ``order``; the same for the same value everywhere."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    marked = df.withColumn("_x", F.col(order).cast("double"))
    out = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_x", outputCol=name, handleInvalid="keep").transform(marked)
    return out.withColumn(name, F.col(name).cast("int")).drop("_x")


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` cut into ranges of ``order`` and written to the shared folder: ``_part`` numbers the ranges in order, ``_at`` the rows of a range.

    Spark samples the borders, so ranges are even whatever the size and the skew of the table; equal rows of ``order`` share a range.
    Written once, every later step and every retry sees the same numbers.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    numbered = placed.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    return settle(numbered.drop("_id"), "ranges")


def placed_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """0, 1, 2, ... in ``order``: the number of a range's first row plus the place in the range, see :func:`in_order`; no window over rows."""
    rows = in_order(df, order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    firsts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(firsts), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_total(
    df: DataFrame,
    order: str,
    value,
    out: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    cuts: list[float] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Inclusive prefix sum of ``value`` by ``order`` (then ``ties``), restarted for each ``by`` key.

    One plan at all sizes: rows meet only inside ``(by, range)``, see :func:`in_order`, and the totals of ranges (a small table) give the
    offset, so neither the whole table nor a heavy key is one window. ``bucket`` replaces the ranges by any expression that does not fall as
    ``order`` rises, which saves the sort where such an expression is known; ``cuts`` gives borders of it.
    """
    by = list(by)
    df = df.withColumn("_v", F.col(value) if isinstance(value, str) else value)
    inner = [order, *ties]
    if bucket is not None:
        cut = df.withColumn("_bucket", bucket)
    elif cuts is not None:
        cut = with_bucket(df, order, cuts)
    else:
        cut, inner = in_order(df, [*by, *inner]).withColumnRenamed("_part", "_bucket"), ["_at"]
    keys = by + ["_bucket"]
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys)
        .agg(F.sum("_v").alias("_t"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .drop("_t")
    )
    inside = Window.partitionBy(*keys).orderBy(*inner).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("_run", F.sum("_v").over(inside))
    return null_safe_join(local, offsets, keys).withColumn(out, F.col("_run") + F.col("_off")).drop("_v", "_run", "_off", "_bucket", "_at")


def contiguous_index(df: DataFrame, order: str, out: str = "idx", by: Sequence[str] = (), ties: Sequence[str] = (), **kw) -> DataFrame:
    """0, 1, 2, ... in ``order``, without a single-task window.

    See :func:`placed_index`. With ``by`` the least number of the key is taken off. ``bucket`` or ``cuts`` take the way of :func:`running_total`.
    """
    if kw:
        return running_total(df, order, F.lit(1).cast("bigint"), out, by, ties, **kw).withColumn(out, F.col(out) - 1)
    by = list(by)
    numbered = placed_index(df, [*by, order, *ties], "_g")
    if not by:
        return numbered.withColumnRenamed("_g", out)
    least = numbered.groupBy(*by).agg(F.min("_g").alias("_least"))
    return null_safe_join(numbered, least, by).withColumn(out, F.col("_g") - F.col("_least")).drop("_g", "_least")


def rank_in_group(df: DataFrame, by: Sequence[str], fraction: Column, out: str, ties: Sequence[str] = (), target_rows: int | None = None) -> DataFrame:
    """0-based rank inside each ``by`` key by a uniform ``fraction`` in [0, 1).

    Keys of up to ``target_rows`` rows take one window; a larger key is cut into as many even buckets as it needs.
    """
    by = list(by)

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(fraction, *ties)
        return rows.withColumn(out, (F.row_number().over(order) - 1).cast("bigint"))

    heavy = heavy_keys(key_counts(df, by), by, heavy_rows=target_rows)
    if not heavy:
        return ranked(df)
    cold, hot = split_heavy(df, by, heavy)
    cut = contiguous_index(hot.withColumn("_u", fraction), "_u", out, by, ties, bucket=F.floor(F.col("_u") * F.col("_fan")).cast("int"))
    return ranked(cold).unionByName(cut.drop("_u", "_fan"))


def mark_middle(df: DataFrame, by: Sequence[str], value: str, out: str = "_mid") -> DataFrame:
    """Flag the one or two middle rows of each key. The sort spills and later aggregates by the same key need no second shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    marked = df.withColumn("_rank", rank).withColumn("_all", n)
    return marked.withColumn(out, F.col("_rank").isin(F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2))).drop("_rank", "_all")


def grouped_median(
    df: DataFrame, by: Sequence[str], value: str, out: str = "median", cuts: list[float] | None = None, most: int | None = None
) -> DataFrame:
    """Exact median (mean of the middle pair) per ``by`` key, however many rows one key holds.

    Keys of up to ``HEAVY_ROWS`` rows take one sort each. For the heavy ones the median is selected: 1. equal ``(by, value)`` rows
    are counted before the shuffle; 2. per ``(by, bucket)`` counts tell which bucket holds each middle position; 3. only those buckets
    are sorted, so no task sees more than one bucket of a key. ``most``: rows of the fullest key, where known. ``cuts`` gives the
    bucket borders and sends every key through the selection.
    """
    by = list(by)
    clean = df.select(*by, F.col(value).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    if cuts is not None:
        return _selected_median(clean, by, out, cuts)

    def sorted_median(rows: DataFrame) -> DataFrame:
        return mark_middle(rows, by, "_y").groupBy(*by).agg(F.avg(F.when(F.col("_mid"), F.col("_y"))).alias(out))

    heavy = [] if most is not None and most <= HEAVY_ROWS else heavy_keys(key_counts(clean, by), by)
    if not heavy:
        return sorted_median(clean)
    if not by:
        return _selected_median(clean, by, out, borders(clean, "_y"))
    cold, hot = split_heavy(clean, by, heavy)
    hot = hot.drop("_fan")
    return sorted_median(cold).unionByName(_selected_median(hot, by, out, borders(hot, "_y")))


def _selected_median(clean: DataFrame, by: list[str], out: str, cuts: list[float]) -> DataFrame:
    counted = with_bucket(clean.groupBy(*by, "_y").agg(F.count(F.lit(1)).alias("_c")), "_y", cuts)
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    buckets = (
        counted.groupBy(*by, "_bucket")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_hi", F.sum("_n").over(upto))
        .withColumn("_all", F.sum("_n").over(whole))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn("_a", F.floor((F.col("_all") - 1) / 2))
        .withColumn("_b", F.floor(F.col("_all") / 2))
        .filter((F.col("_a").between(F.col("_lo"), F.col("_hi") - 1)) | (F.col("_b").between(F.col("_lo"), F.col("_hi") - 1)))
        .select(*by, "_bucket", "_lo", "_a", "_b")
    )
    keys = [*by, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("_y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        null_safe_join(counted, buckets, keys)
        .withColumn("_to", F.col("_lo") + F.sum("_c").over(inside) - 1)
        .withColumn("_from", F.col("_to") - F.col("_c") + 1)
    )
    low = F.max(F.when(F.col("_a").between(F.col("_from"), F.col("_to")), F.col("_y")))
    high = F.max(F.when(F.col("_b").between(F.col("_from"), F.col("_to")), F.col("_y")))
    return placed.groupBy(*by).agg(((low + high) / 2.0).alias(out))


WIDE_ROWS = 200_000  # rows that a task of heavy per-row work may take


def widen(df: DataFrame, least: int | None = None, most_rows: int | None = None) -> DataFrame:
    """Spread the rows of a scan that has fewer partitions than the cluster has slots, or more than ``most_rows`` rows in a partition, before
    heavy per-row work: a split is cut by its bytes, and 128 MB of short rows are millions.

    Only for a plain scan with projections: asking for its partitions then runs nothing, and its rows are counted from the files' footers.
    Inputs in enough partitions come back unchanged.
    """
    n = max(least or df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (most_rows or WIDE_ROWS)))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


TASK_ROWS = 500_000  # short rows that a task may sort or group


def deal(df: DataFrame, on: Sequence[str], rows: int, most_rows: int | None = None) -> DataFrame:
    """``df`` by ``on`` in as many tasks as ``rows`` need. Left alone while the cluster's slots are enough.

    Adaptive execution joins partitions up to a number of bytes as written. Short rows of small numbers shrink so far in a shuffle that such a
    partition holds millions of them, and sorting and grouping them takes gigabytes; a number of partitions that is given stays.
    """
    n = -(-rows // (most_rows or TASK_ROWS))
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *on)
