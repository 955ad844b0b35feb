"""Model inputs: pick the streams a configuration asks for, join them per record, keep the wanted split part."""

from __future__ import annotations

from pyspark.sql import DataFrame

from litprops.operators import vectors
from litprops.operators.splits import gather

STREAMS = ("text", "structure", "hybrid")


def pooled_streams(
    rows: DataFrame,
    text_tokens: DataFrame | None = None,
    structure_tokens: DataFrame | None = None,
    text_pooling: str = "mean_pooling",
    structure_pooling: str = "mean_pooling",
    on: tuple[str, ...] = ("dataset", "row_idx"),
) -> DataFrame:
    """Rows with ``text_vec`` and / or ``struct_vec``. Each stream is pooled first, so the joins move one vector per record and
    both run on the record key."""
    out, on = rows, list(on)
    if text_tokens is not None:
        out = out.join(vectors.pool(text_pooling, text_tokens, on, out="text_vec"), on)
    if structure_tokens is not None:
        out = out.join(vectors.pool(structure_pooling, structure_tokens, on, structure=True, out="struct_vec"), on)
    return out


def model_inputs(
    records: DataFrame, split: DataFrame, config: dict, text_tokens: DataFrame | None = None, structure_tokens: DataFrame | None = None
) -> DataFrame:
    """Train / val / test inputs of one configuration: ``stream`` is text, structure or hybrid, with a pooling per stream."""
    stream = config.get("stream", "text")
    if stream not in STREAMS:
        raise ValueError(f"unknown stream: {stream!r}")
    wants_text, wants_structure = stream != "structure", stream != "text"
    if (wants_text and text_tokens is None) or (wants_structure and structure_tokens is None):
        raise ValueError(f"stream {stream!r} lacks its token table")
    rows = gather(records, split)
    return pooled_streams(
        rows,
        text_tokens if wants_text else None,
        structure_tokens if wants_structure else None,
        config.get("text_pooling", "mean_pooling"),
        config.get("structure_pooling", "mean_pooling"),
    )
