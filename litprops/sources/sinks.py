"""Writers. All append or overwrite through Spark's commit protocol; nothing reads a file back to extend it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litprops.operators.spread import attach_small, placed_index


def write_routed(validated: DataFrame, folder: str, entry: str = "entry", source_file: str = "filename") -> None:
    """Valid entries to ``folder/route=extracted``, error rows with their errors and ``source_file`` to ``folder/route=format_errors``.

    One write and one commit for both: a run that fails leaves nothing, so running it again doubles nothing.
    """
    bad = ~F.col("is_valid")
    rows = validated.withColumns({entry: F.to_json(entry), "errors": F.when(bad, F.col("errors")), "source_file": F.col(source_file)})
    rows = rows.withColumn("route", F.when(bad, "format_errors").otherwise("extracted")).drop("is_valid")
    rows.write.mode("append").partitionBy("route").json(folder)


def write_no_data(files: DataFrame, folder: str) -> None:
    files.write.mode("append").json(f"{folder}/no_data")


def mark_done(keys: DataFrame, folder: str) -> None:
    """Append finished keys to the progress table; call it after the results are committed."""
    keys.distinct().write.mode("append").parquet(f"{folder}/done")


def write_trace(stage: DataFrame, folder: str) -> None:
    """Test mode: what each stage made of each file, with the model's reasoning."""
    cols = ["stage1_entries", "stage2_entries", "final_entries"]
    stage.select("filename", *[F.to_json(c).alias(c) for c in cols], "stage1_reasoning", "stage2_reasoning", "error").write.mode("append").json(f"{folder}/trace")


def write_dataset(records: DataFrame, folder: str) -> None:
    """Final dataset as JSON lines partitioned by ``dataset``; the temporary ``filename`` is dropped, nulls are kept."""
    out = records.drop("filename")
    writer = out.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy("dataset") if "dataset" in out.columns else writer).json(folder)


def write_json_arrays(records: DataFrame, folder: str, order: str, fields: Sequence[str], dataset: str = "dataset") -> None:
    """Records of each dataset as one JSON array in one file, in ``order``, under ``folder/dataset=...``; a record without a dataset has no file.

    A file is one task's, so every dataset has a number and its rows go to the task of that number. A repartition by the name would be left out
    of the plan after a join by the name, and the joined rows may lie anywhere once adaptive execution has turned that join into a broadcast.
    Before that, rows stay in their ranges of the order, and the lines are made there: tasks by the name would be as few as the datasets, and what
    each of them sends to a file a single block that the file's task fetches whole.
    """
    rows = placed_index(records.select(*dict.fromkeys([*fields, dataset, order])), [dataset, order], "_row")
    sizes = rows.groupBy(dataset).agg(F.min("_row").alias("_first"), F.max("_row").alias("_last")).filter(F.col(dataset).isNotNull())
    numbered = sizes.withColumn("_file", F.row_number().over(Window.orderBy(dataset)) - 1)  # over one row per dataset
    start, end = F.when(F.col("_row") == F.col("_first"), "[").otherwise(" ,"), F.when(F.col("_row") == F.col("_last"), "]").otherwise("")
    line = F.concat(start, F.to_json(F.struct(*fields)), end)
    lines = attach_small(rows, numbered, [dataset], "inner").select(dataset, "_row", "_file", line.alias("line"))
    placed = lines.repartitionById(max(1, numbered.count()), "_file").sortWithinPartitions(dataset, "_row")
    placed.select(dataset, "line").write.partitionBy(dataset).text(folder)


def write_splits(split: DataFrame, folder: str) -> None:
    split.write.mode("overwrite").partitionBy("dataset", "split_name").parquet(folder)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Metric rows as CSV with a header. Doubles are written so that they read back unchanged."""
    metrics.write.mode("overwrite").option("header", True).csv(folder)


def write_predictions(preds: DataFrame, folder: str, stage: str | None = None) -> None:
    """Prediction rows as JSON lines, one folder per stage when a stage column is given."""
    writer = preds.write.mode("overwrite")
    (writer.partitionBy(stage) if stage else writer).json(folder)


def write_token_weights(weights: DataFrame, folder: str) -> None:
    weights.write.mode("overwrite").json(folder)
