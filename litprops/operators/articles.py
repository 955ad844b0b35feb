"""Article keys and article numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litprops.functions.text import strip
from litprops.operators.spread import contiguous_index, lookup_join


def _text(c: str) -> Column:
    return F.coalesce(strip(F.col(c).cast("string")), F.lit(""))


def baseline_key(doi: str = "doi", title: str = "title", mode: str = "doi") -> Column:
    """Key of the memorisation baseline: ``doi:<lower>`` else ``title:<title>`` else NULL (``mode='title'`` skips the DOI)."""
    if mode not in ("doi", "title"):
        raise ValueError("mode must be 'doi' or 'title'")
    by_title = F.when(_text(title) != "", F.concat(F.lit("title:"), _text(title)))
    if mode == "title":
        return by_title
    return F.when(_text(doi) != "", F.concat(F.lit("doi:"), F.lower(_text(doi)))).otherwise(by_title)


def training_key(doi: str = "doi", title: str = "title", row_idx: str = "row_idx") -> Column:
    """Key of the training code: DOI or title in one name space; a record with neither is an article of its own."""
    named = F.when(_text(doi) != "", F.lower(_text(doi))).when(_text(title) != "", _text(title))
    return F.coalesce(named, F.concat(F.lit("__singleton_"), F.col(row_idx).cast("string"), F.lit("__")))


def article_ids(records: DataFrame, key: str, row_idx: str = "row_idx", out: str = "article_id") -> DataFrame:
    """Number the articles 0, 1, 2, ... by first appearance."""
    first = records.groupBy(key).agg(F.min(row_idx).alias("_first"))
    numbered = contiguous_index(first, "_first", out).select(key, out)
    return lookup_join(records, numbered, [key], spread_by=[row_idx])
