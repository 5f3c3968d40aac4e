"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, spread, stored

#: Buckets that n-grams are hashed into (16 bits), and the n-grams' lengths.
BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
#: Characters hashed at once: bounds memory for very long texts and batches.
CHUNK = 300_000
#: Languages that one pass scores: bounds its broadcast to BUCKETS x LANGUAGES x 4 bytes; more take several passes.
LANGUAGES = 256

_PAD = np.full(max(LENGTHS) - 1, 32, np.uint32)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter; is it a letter or a mark on one."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    return letter, letter | np.array([k == "M" for k in kinds])


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """(lower-case code points with every run of others as one space, has a letter)."""
    letter, word = _letters()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word[codes]
    some = bool(letter[codes].any())
    codes = np.where(inside, codes, np.uint32(32))
    return codes[inside | np.r_[False, inside[:-1]]], some


def _chunks(texts: list[str | None]):
    """((codes, start of each piece, end, its text's index), indexes of texts with a letter so far)."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        codes, some = _codes(text)
        if not some:
            continue
        for at in range(0, len(codes), CHUNK):
            parts += [_PAD, codes[at : at + CHUNK]]
            owners.append(i)
            size += min(CHUNK, len(codes) - at)
            if size >= CHUNK:
                yield _laid(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _laid(parts, owners)


def _laid(parts: list[np.ndarray], owners: list[int]):
    sizes = np.array([len(x) for x in parts])
    end = np.cumsum(sizes)[1::2]
    # a piece begins with its pad; grams that reach the next piece's pad see spaces only
    return np.concatenate([*parts, _PAD]), end - sizes[1::2] - len(_PAD), end, np.array(owners)


def _grams(codes: np.ndarray, lengths: tuple[int, ...]):
    """For each length: bucket of the n-gram at every place."""
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(lengths) + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in lengths:
            yield (h * np.uint32(0x85EBCA77)) >> np.uint32(16)


def _counts(lengths):
    """(lang, bucket, n) over a partition; (lang, -1, documents)."""

    def scan(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch["text"].to_pylist(), batch["lang"].to_pylist()
            names = sorted(set(langs))
            for x in names:
                total.setdefault(x, np.zeros(BUCKETS, np.int64))
                docs[x] = docs.get(x, 0) + langs.count(x)
            place = np.array([names.index(x) for x in langs])
            for codes, start, end, owner in _chunks(texts):
                of = np.repeat(place[owner], end - start)
                for g in _grams(codes, lengths):
                    n = np.bincount(of * BUCKETS + g[: len(of)], minlength=len(names) * BUCKETS)
                    for k, x in enumerate(names):
                        total[x] += n[k * BUCKETS : (k + 1) * BUCKETS]
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(used) + 1), "bucket": np.r_[-1, used], "n": np.r_[docs[lang], n[used]]})

    return scan


def _columns(table: pa.Table) -> pa.Table:
    """One row a language: its documents, and its log probabilities by bucket as raw floats."""
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    counts = np.zeros(BUCKETS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    log = np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)).astype(np.float32)
    return pa.table({"lang": table["lang"].slice(0, 1), "docs": pa.array([int(n[bucket < 0].sum())]), "log": pa.array([log.tobytes()], pa.binary())})


def train(docs: DataFrame, text: str, lang: str, lengths: tuple[int, ...] = LENGTHS) -> tuple[list[str], DataFrame]:
    """(languages by code point, (lang, log, prior)) from all rows with a non-null ``lang``.

    Tasks send one count per language and used bucket.  ``log`` holds a
    language's log probabilities by bucket as float32.
    """
    session_of(docs)
    rows = spread(docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")))
    sums = rows.mapInArrow(_counts(lengths), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = stored(sums.groupBy("lang").applyInArrow(_columns, "lang string, docs long, log binary"))
    facts = model.select("lang", "docs").collect()
    total = max(sum(r.docs for r in facts), 1)
    return sorted(r.lang for r in facts), model.select("lang", "log", F.log(F.col("docs") / total).alias("prior"))


def _block(model: DataFrame, langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [language, bucket], log priors) of the given languages."""
    rows = {r.lang: r for r in model.where(F.col("lang").isin(langs)).collect()}
    log = np.stack([np.frombuffer(rows[x].log, np.float32) for x in langs]) if langs else np.zeros((0, BUCKETS), np.float32)
    return langs, log, np.array([rows[x].prior for x in langs])


def _predict(model, lengths):
    """Score one block of languages: the best so far, its log posterior, and the log of the sum of all."""

    def scan(batches):
        langs, log, priors = model.value
        for batch in batches:
            texts = batch["_text"].to_pylist()
            total = np.tile(priors.astype(float), (len(texts), 1))
            known = np.zeros(len(texts), bool)
            for codes, start, end, owner in _chunks(texts):
                known[owner] = True
                for g in _grams(codes, lengths):
                    for k, column in enumerate(log):
                        total[:, k] += np.bincount(owner, np.add.reduceat(column[g[: end[-1]]], start, dtype=np.float64), len(texts))
            best, top = total.argmax(1), total.max(1)
            had, before = batch["_best"].to_numpy(zero_copy_only=False), batch["_sum"].to_numpy(zero_copy_only=False)
            better = top > had
            names = [langs[k] if b else x for k, b, x in zip(best.tolist(), better.tolist(), batch["lang_pred"].to_pylist(), strict=True)]
            names = [x if y else "und" for x, y in zip(names, known.tolist(), strict=True)]
            # sums of exponentials from the larger of both sides
            high = np.maximum(top, before)
            both = high + np.log(np.exp(total - high[:, None]).sum(1) + np.exp(before - high))
            new = {"lang_pred": pa.array(names, pa.string()), "_best": pa.array(np.maximum(top, had)), "_sum": pa.array(both)}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch[x] for x in batch.schema.names], names=batch.schema.names)

    return scan


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with lang_pred and score (posterior probability).

    Learns from the rows of ``training`` with a non-null ``lang``; predictions
    see only the text.  A text that is null, empty or without a letter is
    ``und`` with score 0, and so is every text if there is nothing to learn
    from.  Equal posteriors go to the first language by code point.  Other
    columns are ignored; repeated rows are rows of their own.
    """
    spark = session_of(docs)
    langs, model = train(training, text, lang, lengths)
    low = F.lit(float("-inf"))
    rows = spread(docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text")))
    rows = rows.select("*", F.lit("und").alias("lang_pred"), low.alias("_best"), low.alias("_sum"))
    for at in range(0, len(langs), LANGUAGES):
        block = spark.sparkContext.broadcast(_block(model, langs[at : at + LANGUAGES]))
        rows = rows.mapInArrow(_predict(block, lengths), rows.schema)
        if at + LANGUAGES < len(langs):
            rows = stored(rows)
            block.destroy()
    score = F.when(F.col("lang_pred") == "und", 0.0).otherwise(F.least(F.exp(F.col("_best") - F.col("_sum")), F.lit(1.0)))
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", score.alias("score"))
