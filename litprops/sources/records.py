"""Readers of datasets, articles, splits and file lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litprops.functions.text import dataset_name, file_stem, h1_title
from litprops.operators.validate import RECORD_WITH_ANALYSES as STORED
from litprops.sources.json_arrays import read_json_arrays


def read_record_arrays(spark: SparkSession, path: str, schema: str = STORED) -> DataFrame:
    """JSON-array files: one row per record with ``dataset`` (from the file name) and ``row_idx`` (list position).

    ``schema`` is the one that valid entries are typed with, so every entry the validator accepts can be read; a value that does not fit
    it is an error. A file may be as large as it likes: it is cut into splits, see :mod:`litprops.sources.json_arrays`.
    """
    record = F.variant_get("entry", "$", f"STRUCT<{schema}>")
    return read_record_json(spark, path).select("dataset", "row_idx", record.alias("r")).select("dataset", "row_idx", "r.*")


def read_record_json(spark: SparkSession, path: str) -> DataFrame:
    """Each record as VARIANT ``entry`` (nothing typed yet). A file that is not one JSON array of objects is an error that names the file."""
    return read_json_arrays(spark, path).select(dataset_name(F.col("name")).alias("dataset"), F.col("position").alias("row_idx"), "entry")


def read_records(spark: SparkSession, path: str, schema: str = STORED) -> DataFrame:
    """Splittable JSON lines partitioned by ``dataset`` that carry their ``row_idx``."""
    return spark.read.schema(f"{schema}, row_idx BIGINT, dataset STRING").json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Articles: ``filename`` (stem) and whole ``text``."""
    return spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_name")).alias("filename"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Names of files below ``path``; only paths are selected, so no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    return files.select(file_stem("path").alias("filename")).distinct()


def pending_files(spark: SparkSession, pdf_path: str, md_path: str) -> DataFrame:
    """PDF files without a Markdown file of the same stem, by name."""
    return list_files(spark, pdf_path, ".pdf").join(list_files(spark, md_path, ".md"), "filename", "left_anti").orderBy("filename")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return read_markdown(spark, path).select("filename", h1_title("text").alias("title"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Long split table in Parquet: ``dataset, split_name, part, pos, row_idx``."""
    return spark.read.parquet(path)


def test_file_pattern(dataset: str) -> str:
    """Names of a domain's held-out files; ``E`` never takes those of ``E_article``."""
    return rf"\Aval_{re.escape(dataset)}_\d+\.json\z"


def domain_test_files(names: DataFrame, dataset: str, name: str = "file_name") -> DataFrame:
    return names.filter(F.col(name).rlike(test_file_pattern(dataset))).orderBy(name)


def domain_namespace(dataset: str, test_file: str | None = None) -> str:
    """Key under which a domain pool, or one of its held-out files, keeps its own cached vectors."""
    return f"domain/{dataset}/pool" if test_file is None else f"domain/{dataset}/test/{test_file}"
