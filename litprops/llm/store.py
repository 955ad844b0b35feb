"""Tables in the shared folder, ids from large tables, and connected components.

Every intermediate table that more than one later step reads is written to the folder of ``spark.checkpoint.dir`` and read back, so that a
lost executor repeats one step at most. A :class:`Scratch` deletes its tables when the operator has written its result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.session import shared_dir

#: Ids that are sent to every task at most (8 bytes each); with more, the join shuffles both sides instead.
MAX_BROADCAST_IDS = 2_000_000


class Scratch:
    """A folder of tables, one per call of an operator."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def only_ids(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``column`` is (``left_semi``) or is not (``left_anti``) in the one-column table ``ids``.

    Few ids go to every task, so that wide rows stay where they are; above :data:`MAX_BROADCAST_IDS` Spark shuffles both sides.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, how)


#: Ids from here on are reserved for rows without one.
UNNAMED = 1 << 62


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` as long, rows without an id under a key of their own: a hash of the text, above all ids in use, so that such a row is
    examined like any other and is never the earlier one. Rows without an id and with equal texts share a key, like repeated rows of one id."""
    key = F.lit(UNNAMED) + F.pmod(F.xxhash64(F.lit(13), F.col("text")), F.lit(UNNAMED))
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), key))


def unnamed(rows: DataFrame, column: str = "doc_id") -> DataFrame:
    """Takes back the keys that :func:`named` gave."""
    return rows.withColumn(column, F.when(F.col(column) < UNNAMED, F.col(column)))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b``; the component is its smallest node.

    Alternating large-star and small-star steps. Each is one aggregate with partial sums and one join, so a node with very many links is
    no hot key for the aggregate and is split by Spark's skew join. Ends when a round changes nothing.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.put(pairs, f"{name}-0")
    mark = _mark(pairs)
    step = 0
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.put(large, f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        step += 1
        new = scratch.put(small.filter("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-large-{step - 1}", f"{name}-{step - 1}")
        pairs, old, mark = new, mark, _mark(new)
        if mark == old:
            break
    roots = pairs.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return pairs.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
