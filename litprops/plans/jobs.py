"""End-to-end jobs composed from the operators. Each takes and returns DataFrames; writing is the caller's choice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litprops.operators import articles, baseline, curation, mining, splits
from litprops.operators.article_metrics import LOSSES, batch_losses
from litprops.operators.batches import article_batches
from litprops.operators.metrics import epoch_loss
from litprops.operators.prompts import default_extraction_template, extraction_prompt, review_prompt
from litprops.operators.regress import evaluate
from litprops.operators.spread import largest_group
from litprops.operators.validate import route, validate
from litprops.session import settle


def extract(articles_df: DataFrame, prop: str, model: Callable, review_model: Callable | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Articles (``filename, text``) through extraction and optional review: one stage row per file with the final entries.

    Both model steps are maps, so the only shuffle is the 1:1 join of drafts and reviews on ``filename``. Responses are written to the
    shared folder as they come: a lost executor or a second look at the result never asks the model again.
    """
    spark = articles_df.sparkSession
    templates = templates if templates is not None else spark.createDataFrame([(prop, default_extraction_template(prop))], "property string, template string")
    asked = extraction_prompt(articles_df.withColumn("property", F.lit(prop)), templates)
    draft = mining.stage_entries(settle(mining.map_model(asked, "prompt", ["filename"], model), "drafts"))
    if review_model is None:
        empty = draft.select("filename", F.lit(None).cast("array<variant>").alias("entries"), F.lit(None).cast("string").alias("reasoning"))
        return mining.review_override(draft, empty)
    template = F.lit("Review the extracted {PROP_FULL_NAME} data.\n{RULES}\n# Data\n{EXTRACTED_DATA}\n# Paper\n{MD_TEXT}\n")
    shown = draft.filter("entries IS NOT NULL").join(articles_df, "filename").withColumn(
        "prompt", review_prompt(template, F.lit(prop), F.lit("Answer [] when all is right, else the full corrected array."), F.to_json("entries"), F.col("text"))
    )
    review = mining.stage_entries(settle(mining.map_model(shown, "prompt", ["filename"], review_model), "reviews"))
    return mining.review_override(draft, review)


def validate_and_route(stage: DataFrame, prop: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(valid entries, error rows, counters)`` of a stage table; the checked entries are written once for the three of them."""
    checked = settle(validate(mining.explode_entries(stage), "entry", prop), "checked")
    valid, errors = route(checked)
    return valid, errors, mining.run_counters(stage, checked)


def curate(records: DataFrame, content: Sequence[str], prop: str = "property", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clean records and a split table (random and article-disjoint), which is made from the records as written."""
    clean = settle(curation.drop_duplicates(records, content), "clean")
    random = clean.select("dataset", F.lit("split_random").alias("split_name"), splits.assign_parts("row_idx", seed).alias("part"), F.col("row_idx").alias("pos"), "row_idx")
    disjoint = clean.select(
        "dataset", F.lit("split_article").alias("split_name"), splits.assign_parts("article_key", seed).alias("part"), F.col("row_idx").alias("pos"), "row_idx"
    )
    return clean, random.unionByName(disjoint)


def memorisation_baseline(records: DataFrame, split: DataFrame) -> DataFrame:
    """Baseline of every (dataset, split) and both strategies. ``records``: ``dataset, row_idx, article_key, y``."""
    rows = splits.gather(records, split)
    most = largest_group(split.filter("part = 'train'"), ["dataset", "split_name"])  # from the index table alone
    return baseline.article_baseline(rows.select("dataset", "split_name", "part", "article_key", "y", "row_idx"), most=most)


def evaluate_predictions(preds: DataFrame, train: DataFrame, by: Sequence[str], batch_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Scores per ``by`` key, and the size-weighted losses over article-grouped batches of the whole table (one row)."""
    batched = article_batches(preds, "article_key", "row_idx", batch_size, seed)
    return evaluate(preds, train, by), epoch_loss(batch_losses(batched), losses=LOSSES)


def number_articles(records: DataFrame) -> DataFrame:
    return articles.article_ids(records.withColumn("article_key", articles.training_key()), "article_key")
