"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every text."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, spread, stored
from .winnow import Hashes, mix

#: Bytes of benchmark text whose windows one broadcast may hold (about ten times that in memory); larger benchmarks go in several passes.
BLOCK_BYTES = 16_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)).translate(bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)))


def words(text: bytes) -> list[bytes]:
    """Maximal runs of letters a-z (A-Z lowered), digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Windows:
    """All windows of a block of items as sorted hashes; a hit is verified word by word.

    About 20 bytes a window beside the vocabulary.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items if item is not None})
        place = {name: k for k, name in enumerate(self.names)}
        ids, starts, owners = [], {}, {}
        at = 0
        for item, text in items:
            own = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)), np.int32)
            size = min(n, len(own))
            if size:
                ids.append(own)
                starts.setdefault(size, []).append(np.arange(at, at + len(own) - size + 1))
                owners.setdefault(size, []).append(np.full(len(own) - size + 1, place.get(item, -1), np.int32))
                at += len(own)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        for self.which in range(2):
            self.sizes = {size: self._table(size, np.concatenate(starts[size]), np.concatenate(owners[size])) for size in starts}
            if None not in self.sizes.values():
                return
        raise ValueError("windows of this block share hashes")

    def _hashes(self, ids: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return Hashes(mix(ids.astype(np.uint64)), self.which).of(start, start + size)

    def _table(self, size: int, start: np.ndarray, owner: np.ndarray):
        """(hashes, a place of each in ``ids``, owners, where each one's begin), or nothing if two windows share a hash."""
        h = self._hashes(self.ids, start, size)
        order = np.lexsort((owner, h))
        h, start, owner = h[order], start[order], owner[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)
        lead = start[first][np.cumsum(new) - 1]
        for k in range(size):
            if (self.ids[start + k] != self.ids[lead + k]).any():
                return None
        once = (owner >= 0) & (new | np.r_[True, owner[1:] != owner[:-1]])
        count = np.add.reduceat(once, first)
        return h[first], start[first], owner[once], np.r_[0, np.cumsum(count)]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """([start, end) word spans of hit windows, items that own them)."""
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.int32, len(tokens))
        known = np.r_[0, np.cumsum(ids > 0)]
        spans, items = [], set()
        for size, (hashes, place, owner, begin) in self.sizes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = self._hashes(ids, at, size)
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[found] == h
            at, found = at[hit], found[hit]
            for k in range(size):
                same = ids[at + k] == self.ids[place[found] + k]
                at, found = at[same], found[same]
            spans += [(x, x + size) for x in at.tolist()]
            for f in np.unique(found).tolist():
                items.update(self.names[o] for o in owner[begin[f] : begin[f + 1]].tolist())
        return spans, items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_OUT = "array<struct<s:int,e:int>>"


def _pass(block):
    """Add the hits of one block of the benchmark to the columns _n, _spans and _items."""

    def scan(batches):
        windows = block.value
        for batch in batches:
            n, spans, items = [], [], []
            for text, had, owned in zip(batch["_text"].to_pylist(), batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True):
                tokens = words(text or b"")
                hit, own = windows.scan(tokens)
                n.append(len(tokens))
                spans.append([{"s": s, "e": e} for s, e in union(hit + [(x["s"], x["e"]) for x in had])])
                items.append(sorted(own | set(owned)))
            new = {"_n": pa.array(n, pa.int64()), "_spans": pa.array(spans, _SPANS), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch[x] for x in batch.schema.names], names=batch.schema.names)

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of ``docs`` inside any occurrence of a benchmark window.

    Returns the columns ``keep`` of every row, n_words, spans (disjoint
    [s, e) word ranges hit), items (sorted ids, as strings, of the items with an
    occurring window).  A window is ``n`` consecutive words of an item; an item
    of fewer words, but not none, is one window.  Null and empty texts have no
    words; rows of one item_id count as one item; a null item_id marks words but
    is counted as no item; an empty benchmark hits nothing.

    The benchmark is collected in blocks of about ``block_bytes``: each block
    is one broadcast and one map over the documents.  What a pass has found is
    stored before the next, so that only one block is in memory at a time,
    however large the benchmark.  No shuffle.
    """
    hits = _hits(docs, benchmark, text, item_id, item_text, n, keep, block_bytes)
    return hits.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def _hits(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, n: int, keep: tuple[str, ...], block_bytes: int) -> DataFrame:
    """The columns ``keep`` as _k0, _k1, ... with _text, _n, _spans and _items."""
    spark = session_of(docs)
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    source = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    out = spread(docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).cast("binary").alias("_text")))
    out = out.select("*", F.lit(0).cast("long").alias("_n"), F.array().cast(_OUT).alias("_spans"), F.array().cast("array<string>").alias("_items"))
    for b in range(blocks):
        rows = source.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).where("t is not null").collect()
        block = spark.sparkContext.broadcast(Windows([(r.i, bytes(r.t)) for r in rows], n))
        del rows
        out = out.mapInArrow(_pass(block), out.schema)
        if b < blocks - 1:
            out = stored(out)
            block.destroy()
    return out


def _cut(which: int):
    """Column ``which`` without the characters from the first to the last word of each span."""

    def cut(batches):
        for batch in batches:
            texts = []
            for raw, spans in zip(batch["_text"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
                if spans:
                    at = [(m.start(), m.end()) for m in _WORD.finditer(raw.lower())]
                    edges = [0, *(x for span in spans for x in (at[span["s"]][0], at[span["e"] - 1][1])), len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                texts.append(raw)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            keep = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([text if i == which else batch[x] for i, x in enumerate(keep)], names=keep)

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 8, drop_items: int = 2, short_items: bool = False) -> DataFrame:
    """``docs`` without rows that hit ``drop_items`` items or more; the others lose the spans they hit.

    Same columns and types as ``docs``; texts without a hit are unchanged.
    With ``short_items``, items of fewer than ``n`` words, but not none, are one
    window each, as in ``benchmark_hits``; else they are left out.  Null and
    empty texts have no hits and stay; repeated rows go or stay alike; an empty
    table stays empty, an empty benchmark changes nothing.
    """
    items = benchmark if short_items else benchmark.where(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) >= n)
    hits = _hits(docs, items, text, "item_id", "text", n, tuple(docs.columns), BLOCK_BYTES).where(F.size("_items") < drop_items)
    own = [f"_k{i}" for i in range(len(docs.columns))]
    rows = hits.select(*own, "_text", "_spans")
    cut = rows.mapInArrow(_cut(docs.columns.index(text)), rows.select(*own).schema)
    return cut.select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)])
