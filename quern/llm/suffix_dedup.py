"""Suffix-array deduplication: bytes covered by long strings that occur twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import remove_repeats


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400, gram: int = 100) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept (binary).  All occurrences go, also the first; matches
    never cross documents; strings are judged on the input.  A null or empty
    text gives zeros and empty ``kept``; texts shorter than ``length`` stay
    whole; repeated rows are repeats of each other; an empty table gives no
    rows; other columns are ignored, whatever their names.  ``gram`` (under
    ``length``) is the anchor's width: it changes cost, not the result.
    """
    out = remove_repeats(docs, text, doc_id, "bytes", length, gram)
    return out.select(out.id.alias("doc_id"), out.n.alias("n_bytes"), out.gone.alias("n_removed"), out.spans.alias("n_spans"), "kept")
