"""Token counts: pieces are counted once per distinct pre-token and summed by frequency.

A pre-token is a run of spaces (U+2581 or U+0020) and what follows up to the
next one.  No piece of the vocabulary crosses such a border, so a text's count
is the sum over its pre-tokens.  Pre-tokens within ``HEAD`` of the most
widespread ones are looked up while a text is cut; the rest are joined by
content, so nothing grows with the vocabulary of the corpus but shuffled rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, spread, stored

#: Pre-tokens broadcast at most (their lengths are bounded too: about 10 MB in all).
HEAD = 100_000
HEAD_BYTES = 48

_PIECES = re.compile("▁+[^▁]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of ``text`` after the dummy prefix; none of an empty text."""
    return _PIECES.findall("▁" + text.replace(" ", "▁")) if text else []


def _message(data: bytes):
    """(field, value) of a protocol buffers message: numbers, or the bytes of what has a length."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


def check_model(model: str) -> None:
    """ValueError unless counts of pre-tokens add up under ``model``.

    Its normaliser must be the identity with a space put in front, spaces kept
    and written as U+2581, and no piece may go on after a word and a space.
    """
    with open(model, "rb") as f:
        fields = list(_message(f.read()))
    # Field numbers of the model file (pieces 1, training 2, normaliser 3) and inside them
    pieces = [dict(_message(v)) for k, v in fields if k == 1]
    trainer = dict(x for k, v in fields if k == 2 for x in _message(v))
    rules = dict(x for k, v in fields if k == 3 for x in _message(v))
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model changes texts before it cuts them")
    if any(re.search("[^▁]▁", p.get(1, b"").decode("utf-8", "replace")) for p in pieces):
        raise ValueError("a piece of the model crosses a space")


def _distinct(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            if text:
                seen.update(set(pre_tokens(text)))
        if len(seen) > 200_000:
            yield pa.RecordBatch.from_pydict({"p": list(seen), "df": list(seen.values())})
            seen = Counter()
    if seen:
        yield pa.RecordBatch.from_pydict({"p": list(seen), "df": list(seen.values())})


def _pieces(model: str):
    def count(batches):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            # the library adds the first space itself
            ids = library.encode([p[1:] if len(p) > 1 else "" for p in batch["p"].to_pylist()], num_threads=1)
            n = [len(x) if x else 1 for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    return count


def _sums(head):
    """Rows of a text: one with its bytes and the tokens of known pre-tokens, one for each other pre-token."""

    def scan(batches):
        known = head.value
        for batch in batches:
            rows, ids, size, tokens, rest, times = [], [], [], [], [], []
            for row, doc, text in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                total, other = 0, []
                for p, n in Counter(pre_tokens(text or "")).items():
                    if (c := known.get(p)) is None:
                        other.append((p, n))
                    else:
                        total += c * n
                rows += [row] * (1 + len(other))
                ids += [doc] * (1 + len(other))
                size += [len((text or "").encode())] + [None] * len(other)
                tokens += [total] + [None] * len(other)
                rest += [None] + [p for p, _ in other]
                times += [None] + [n for _, n in other]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=["row", "id", "n_bytes", "n", "p", "f"])

    return scan


def token_counts(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """Tokens of every row of ``docs`` under the SentencePiece file ``model``: doc_id, n_bytes, n_tokens.

    No begin, end or other special tokens are added; their strings in a text
    are ordinary text.  Null and empty texts have 0 bytes and 0 tokens; a blank
    text has the tokens of its spaces; repeated rows are rows of their own; an
    empty table gives no rows; other columns are ignored.  ``model`` must be
    readable at the same path on every executor (it belongs to an installed
    package).  ``check_model`` says which models will do; others are refused.
    """
    check_model(model)
    spark = session_of(docs)
    rows = spread(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")))
    words = stored(rows.select("text").mapInArrow(_distinct, "p string, df long").groupBy("p").agg(F.sum("df").alias("df")).mapInArrow(_pieces(model), "p string, df long, n long"))
    short = words.where(F.octet_length("p") <= HEAD_BYTES)
    # the least document frequency (to an eighth of a doubling) that at most ``head`` pre-tokens reach
    step = F.floor(F.log2("df") * 8)
    least, left = None, head
    for at, count in sorted(((r[0], r[1]) for r in short.groupBy(step.alias("b")).count().collect()), reverse=True):
        if count > left:
            break
        least, left = at, left - count
    chosen = short.where(step >= least).select("p", "n").collect() if least is not None else []
    known = spark.sparkContext.broadcast({r.p: r.n for r in chosen})
    counted = rows.mapInArrow(_sums(known), "row long, id long, n_bytes long, n long, p string, f long")
    # a row without a pre-token gets a key of its own, which no pre-token equals: one pass, nothing stored
    keyed = counted.withColumn("p", F.coalesce("p", F.concat(F.lit("#"), F.col("row"))))
    both = keyed.join(words.select("p", F.col("n").alias("each")), "p", "left").select("row", "id", "n_bytes", F.coalesce(F.col("each") * F.col("f"), "n").alias("n"))
    return both.groupBy("row", "id").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens")
