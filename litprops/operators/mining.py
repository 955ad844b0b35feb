"""Extraction, review, titles and run counters: the mining stages between files and final records."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.functions.hashing import hash_text
from litprops.functions.text import h1_title, strip_fences
from litprops.functions.variants import lenient_json_array
from litprops.operators.spread import lookup_join


def pending(work: DataFrame, done: DataFrame, key: str, ignore_progress: bool = False) -> DataFrame:
    """Work not yet in the progress table. ``done`` may name a key many times; an anti-join does not mind."""
    return work if ignore_progress else work.join(done.select(key), key, "left_anti")


def map_model(
    df: DataFrame,
    prompt: str,
    key: list[str],
    make_model: Callable[[], Callable[[list[str]], list[tuple[str, str]]]],
    batch_rows: int = 32,
    tries: int = 3,
    wait: float = 0.0,
) -> DataFrame:
    """Send each prompt through a user's model; adds ``content`` and ``reasoning``.

    ``make_model`` runs once per task and returns a callable over a short list of prompts. If a list fails, its prompts are sent one by
    one, each up to ``tries`` times with ``wait * 2^k`` seconds in between; only a prompt that keeps failing gets empty strings, and no
    row is lost. No shuffle: prompts stay where they are.
    """
    keep = df.select(*key, prompt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name != prompt) + ", content string, reasoning string"

    def ask(model, prompts: list[str], attempts: int) -> list[tuple[str, str]] | None:
        for k in range(attempts):
            if k and wait:
                time.sleep(wait * 2 ** (k - 1))
            try:
                answers = list(model(prompts))
                if len(answers) == len(prompts):
                    return answers
            except Exception:  # noqa: BLE001 - a model may fail in any way; the contract is an empty answer
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows]
                prompts = part[prompt].tolist()
                answers = ask(model, prompts, 1)
                if answers is None:
                    answers = [(ask(model, [p], tries) or [("", "")])[0] for p in prompts]
                yield part[key].assign(content=[a[0] for a in answers], reasoning=[a[1] for a in answers])

    return keep.mapInPandas(run, schema)


def stage_entries(responses: DataFrame, out: str = "entries") -> DataFrame:
    """Parsed entries of each response (NULL when nothing usable came back)."""
    return responses.withColumn(out, lenient_json_array(strip_fences("content")))


def review_override(draft: DataFrame, review: DataFrame, key: str = "filename") -> DataFrame:
    """Per file: the draft, the review, and the final entries. A non-empty review replaces the draft, anything else keeps it."""
    joined = draft.select(key, F.col("entries").alias("stage1_entries"), F.col("reasoning").alias("stage1_reasoning")).join(
        review.select(key, F.col("entries").alias("stage2_entries"), F.col("reasoning").alias("stage2_reasoning")), key, "left"
    )
    use_review = F.coalesce(F.size("stage2_entries"), F.lit(0)) > 0
    return joined.withColumn("final_entries", F.when(use_review, F.col("stage2_entries")).otherwise(F.col("stage1_entries"))).withColumn(
        "error", F.col("stage1_entries").isNull()
    )


def explode_entries(stage: DataFrame, key: str = "filename") -> DataFrame:
    """One row per final entry, with its position."""
    return stage.select(key, F.posexplode("final_entries").alias("pos", "entry"))


def no_data(stage: DataFrame, key: str = "filename") -> DataFrame:
    """Files whose extraction worked but found nothing."""
    return stage.filter(~F.col("error") & (F.size("final_entries") == 0)).select(key)


def run_counters(stage: DataFrame, validated: DataFrame) -> DataFrame:
    """One row: files with an error, files without data, valid and invalid entries."""
    names = ("files", "error", "no_data", "valid", "invalid")
    files = stage.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("error").alias("error"),
        F.count_if(~F.col("error") & (F.size("final_entries") == 0)).alias("no_data"),
    )
    entries = validated.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))
    return files.unionByName(entries, allowMissingColumns=True).agg(*[F.sum(n).alias(n) for n in names])


def titles(articles: DataFrame, key: str = "filename", text: str = "text") -> DataFrame:
    """Title of each article, worked out once per article and not once per record."""
    return articles.select(key, h1_title(text).alias("title"))


def add_titles(records: DataFrame, title_table: DataFrame, key: str = "filename") -> DataFrame:
    """Left join of titles; records of one very large article are salted."""
    return lookup_join(records.drop("title"), title_table, [key])


def title_coverage(records: DataFrame, by: list[str]) -> DataFrame:
    has = F.col("title").isNotNull() & (F.col("title") != "")
    return records.groupBy(*by).agg(F.count_if(has).alias("with_title"), F.count_if(~has).alias("without_title"))


def insert_after(df: DataFrame, column: str, after: str) -> DataFrame:
    """Move ``column`` right behind ``after``; to the end when there is no ``after``."""
    others = [c for c in df.columns if c != column]
    at = others.index(after) + 1 if after in others else len(others)
    return df.select(*others[:at], column, *others[at:])


def sample_rows(df: DataFrame, key: str, seed: int | str, n: int = 3, random: bool = True) -> DataFrame:
    """Test mode: ``n`` random rows (md5 order) or the first ``n`` by key."""
    order = [hash_text(seed, key), F.col(key)] if random else [F.col(key)]
    return df.orderBy(*order).limit(n)
