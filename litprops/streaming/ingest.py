"""Resumable ingest: every file is taken once, results arrive with the batch that made them.

The checkpoint tells the stream which files are new; the commit table (source file, batch) beside the output tells which are done. The second
survives the loss of the first: a stream that starts over with an empty checkpoint leaves out what is committed, and numbers its batches on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.functions.text import file_stem
from litprops.functions.variants import lenient_json_array
from litprops.functions.text import strip_fences
from litprops.operators.validate import validate


def stream_articles(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Markdown files as ``filename, text, source``."""
    lines = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return lines.select(file_stem(F.col("_metadata.file_name")).alias("filename"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))


def stream_responses(spark: SparkSession, folder: str, schema: str = "filename STRING, content STRING, reasoning STRING") -> DataFrame:
    """Model responses as they land in ``folder`` (Parquet), with the file each came in as ``source``."""
    return spark.readStream.schema(schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("source"))


def validated_entries(responses: DataFrame, prop: str) -> DataFrame:
    """Parse, explode and validate; row-wise, so it runs the same on a stream and on a table.

    ``route`` tells where a row belongs: ``extracted`` and ``format_errors`` are entries; ``no_data`` (an empty answer) and ``failed`` (an
    answer that does not parse) are files, one row each without entry, errors and verdict.
    """
    parsed = responses.select("filename", lenient_json_array(strip_fences("content")).alias("entries"))
    rows = parsed.select("filename", F.col("entries").isNull().alias("failed"), F.posexplode_outer("entries").alias("pos", "entry"))
    file_row = F.col("pos").isNull()
    checked = validate(rows, "entry", prop)
    checked = checked.withColumns({c: F.when(~file_row, F.col(c)) for c in ("errors", "is_valid")})
    route = F.when(F.col("failed"), "failed").when(file_row, "no_data").when(F.col("is_valid"), "extracted").otherwise("format_errors")
    return checked.withColumn("route", route).drop("failed")


def commits(spark: SparkSession, out: str) -> DataFrame:
    """``source, batch``: which source file was written by which batch."""
    schema = "source STRING, batch BIGINT"
    try:
        return spark.read.schema(schema).parquet(f"{out}-commits")
    except AnalysisException:  # nothing committed yet
        return spark.createDataFrame([], schema)


def committed(step: Callable[[DataFrame, str], None], out: str) -> Callable[[DataFrame, int], None]:
    """A sink that hands ``step`` the rows of files that are not committed yet and the folder to overwrite, then commits the files.

    The folder is the batch after the last committed one. A batch that fails before its commit is taken again into the same folder, one that
    was committed is never overwritten, whatever the checkpoint says. Needs the column ``source``; one stream writes to ``out`` at a time.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = commits(spark, out)
        number = (done.agg(F.max("batch")).first()[0] + 1) if not done.isEmpty() else 0
        fresh = batch.join(done.select("source"), "source", "left_anti")
        files = [r.source for r in fresh.select("source").distinct().collect()]  # of one micro-batch, which is as many as a trigger takes
        if not files:
            return
        step(fresh.drop("source"), f"{out}/batch_id={number}")
        spark.createDataFrame([(f, number) for f in files], "source STRING, batch BIGINT").coalesce(1).write.mode("append").parquet(f"{out}-commits")

    return sink


def run_routed(stream: DataFrame, prop: str, out: str, checkpoint: str) -> None:
    """Drain what has arrived into ``out``, partitioned by ``route``; every source file once, see :func:`committed`."""

    def step(batch: DataFrame, folder: str) -> None:
        rows = validated_entries(batch, prop).withColumn("entry", F.to_json("entry"))
        rows.write.mode("overwrite").partitionBy("route").parquet(folder)

    drain(stream, committed(step, out), checkpoint)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available once and stop; call again when more has arrived."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_articles(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run a batch step (prompt, model, parse ...) over new articles. A file whose step fails to give entries is done all the same."""
    drain(stream, committed(lambda batch, folder: step(batch).write.mode("overwrite").parquet(folder), out), checkpoint)
