"""Substring deduplication: words covered by word sequences that occur twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import remove_repeats


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 35, gram: int = 16) -> DataFrame:
    """Remove every word covered by a window of ``words`` words that also starts anywhere else.

    One row per row of ``docs``: doc_id, n_words, n_removed, n_spans (maximal
    removed runs), kept (binary: words left, joined by one space).  Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged.  All occurrences go, also the first;
    windows are judged on the input.  A null or blank text has no words;
    shorter texts stay whole; repeated rows are repeats of each other; an empty
    table gives no rows; other columns are ignored.  ``gram`` (under ``words``)
    is the anchor's width: it changes cost, not the result.
    """
    out = remove_repeats(docs, text, doc_id, "words", words, gram)
    return out.select(out.id.alias("doc_id"), out.n.alias("n_words"), out.gone.alias("n_removed"), out.spans.alias("n_spans"), "kept")
