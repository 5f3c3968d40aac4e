"""Repeated windows of a corpus, in bytes or words, without pairs and without moving unaffected text twice.

Both operators find every window of ``n`` symbols whose content also starts
anywhere else and remove the symbols that such windows cover.

1. Anchors (``winnow``) cut each text into runs of windows.  A run's gram is
   counted over the corpus; a run whose gram occurs once holds no repeat.
2. If all runs of a repeated gram have one context, all their windows repeat.
   Otherwise equal contexts are counted; those that occur twice repeat too.
3. Contexts that stay single beside others of their gram are the ends of
   repeats.  One copy of each distinct context is resolved exactly: byte
   contexts by suffix arrays (``suffix``), word contexts by extending the
   anchor both ways.

All counts use partial aggregation and all joins are equi-joins on (hashed)
content, so a passage in every document costs one row per task.  Texts are
read twice, under row numbers that no change of executors between the two
reads can shift (``common.numbered``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix, winnow
from .common import free, numbered, session_of, spread, stored

#: Bytes of context text in one suffix-array shard, contexts of one gram that a shard may hold, and shards of a task.
SHARD_BYTES = 600_000
SHARD_CONTEXTS = 800
TASK_SHARDS = 6

_SPAN = "array<struct<s:int,e:int>>"


def _values(text: bytes, unit: str) -> np.ndarray:
    return winnow.byte_values(text) if unit == "bytes" else winnow.word_values(text)


def _runs(unit: str, n: int, k: int):
    def scan(batches):
        for batch in batches:
            cols = [[] for _ in range(6)]
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text is None or len(text) < n:
                    continue
                first, last, anchor, gram, context = winnow.runs(_values(text, unit), n, k)
                for c, x in zip(cols, (np.full(len(first), row), first.astype(np.int32), last.astype(np.int32), anchor.astype(np.int32), gram, context), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["row", "s", "e", "a", "g", "c"])

    return scan


def merged(starts: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of symbols covered by windows of ``n`` that start in the inclusive ranges."""
    out: list[list[int]] = []
    for s, e in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + n)
        else:
            out.append([s, e + n])
    return [tuple(x) for x in out]


def spans_of_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = ~winnow._SPACE[raw]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cut(text: bytes | None, starts: list[tuple[int, int]], unit: str, n: int) -> tuple[int, int, int, bytes]:
    """(symbols, symbols removed, maximal removed runs, what is left)."""
    text = text or b""
    spans = merged(starts, n)
    gone = sum(e - s for s, e in spans)
    if unit == "bytes":
        edges = [0, *(x for span in spans for x in span), len(text)]
        return len(text), gone, len(spans), b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    words = text.split()
    edges = [0, *(x for span in spans for x in span), len(words)]
    return len(words), gone, len(spans), b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])


def _first_look(unit: str, n: int):
    """Per document: its result if no context of it is open, else the text for later; and the contexts it lends."""

    def look(batches):
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("row", "id", "n", "gone", "spans", "kept", "text", "known", "g", "c", "single", "s", "windows", "left", "right", "context")}

            def put(_out=out, **x):
                for key, values in _out.items():
                    values.append(x.get(key))

            for x in batch.to_pylist():
                text = x["text"] or b""
                known = [(y["s"], y["e"]) for y in x["known"] or []]
                lent = x["lent"] or []
                if any(y["single"] for y in lent):
                    put(row=x["row"], id=x["id"], text=text, known=[{"s": s, "e": e} for s, e in known])
                else:
                    put(row=x["row"], id=x["id"], **dict(zip(("n", "gone", "spans", "kept"), cut(text, known, unit, n), strict=True)))
                if lent and unit == "bytes":
                    for y in lent:
                        put(row=x["row"], g=y["g"], c=y["c"], single=y["single"], s=y["s"], windows=y["e"] - y["s"] + 1, context=text[y["s"] : y["e"] + n])
                elif lent:
                    values = winnow.word_values(text)
                    one, two = winnow.Hashes(values, 0), winnow.Hashes(values, 1)
                    for y in lent:
                        # the seed extended left to each window's start, and right to its end
                        at = np.arange(y["s"], y["e"] + 1)
                        left, right = one.of(at, y["a"]).view(np.int64), two.of(y["a"], at + n).view(np.int64)
                        for s, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                            put(row=x["row"], g=y["g"], single=y["single"], s=s, left=a, right=b)
            yield pa.RecordBatch.from_pydict(out, schema=_LOOK)

    return look


_LOOK = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("gone", pa.int64()), ("spans", pa.int64()), ("kept", pa.binary()), ("text", pa.binary()), ("known", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("g", pa.int64()), ("c", pa.int64()), ("single", pa.bool_()), ("s", pa.int32()), ("windows", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("context", pa.binary())]
)
_LOOK_DDL = f"row long, id long, n long, gone long, spans long, kept binary, text binary, known {_SPAN}, g long, c long, single boolean, s int, windows int, left long, right long, context binary"


def _shard(n: int):
    """Windows of one shard's contexts: repeated inside it, or one of each content if its gram has other shards."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["g", "c", "row", "s"], ignore_index=True)
        size = pdf["context"].map(len).to_numpy()
        # whole grams per suffix array, as long as they fit in one
        edges = np.flatnonzero(np.r_[True, pdf["g"].to_numpy()[1:] != pdf["g"].to_numpy()[:-1]])
        bulks, taken = [0], 0
        for a, b in zip(edges, [*edges[1:], len(pdf)], strict=True):
            more = int(size[a:b].sum())
            if taken and taken + more > SHARD_BYTES * 2:
                bulks.append(int(a))
                taken = 0
            taken += more
        for a, b in zip(bulks, [*bulks[1:], len(pdf)], strict=True):
            part = pdf.iloc[a:b]
            text = np.frombuffer(b"".join(part["context"]), np.uint8)
            length = size[a:b]
            base = np.cumsum(length) - length
            owner = np.repeat(np.arange(len(part)), length)
            inside = np.arange(len(text)) - base[owner]
            at, kind = suffix.repeated(text, inside < part["windows"].to_numpy()[owner], n)
            if not len(at):
                continue
            new = np.r_[True, kind[1:] != kind[:-1]]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            own = owner[at]
            single = part["single"].to_numpy()[own]
            row, s = part["row"].to_numpy()[own], part["s"].to_numpy()[own] + inside[at]
            hit = many & single
            out.append(pd.DataFrame({"row": row[hit], "s": s[hit], "f1": 0, "f2": 0, "open": False}))
            lone = new & part["split"].to_numpy()[own]
            if lone.any():
                digests = [hashlib.blake2b(text[p : p + n].tobytes(), digest_size=16).digest() for p in at[lone]]
                f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                # resolved contents go along as partners only
                out.append(pd.DataFrame({"row": np.where(single & ~many, row, -1)[lone], "s": s[lone], "f1": f[:, 0], "f2": f[:, 1], "open": True}))
        return pd.concat(out, ignore_index=True).astype({"s": "int32"}) if out else pd.DataFrame({"row": [], "s": [], "f1": [], "f2": [], "open": []}).astype({"row": "int64", "s": "int32", "f1": "int64", "f2": "int64", "open": bool})

    return resolve


def _merge_sorted(frames):
    """Contents that several shards hold, by binary search of each in the sorted run of the range."""
    frames = list(frames)
    if not frames:
        return
    pdf = pd.concat(frames, ignore_index=True)
    f = pdf["f1"].to_numpy()
    order = np.lexsort((pdf["f2"].to_numpy(), f))
    pair = np.empty(len(f), [("a", "<i8"), ("b", "<i8")])
    pair["a"], pair["b"] = f, pdf["f2"].to_numpy()
    run = pair[order]
    low = np.searchsorted(run["a"], f, "left")
    high = np.searchsorted(run["a"], f, "right")
    several = high - low > 1
    for x in np.flatnonzero(several):
        several[x] = np.count_nonzero(run["b"][low[x] : high[x]] == pair["b"][x]) > 1
    found = pdf[several & (pdf["row"].to_numpy() >= 0)]
    yield found[["row", "s"]]


def _by_suffix_arrays(contexts: DataFrame, n: int) -> DataFrame:
    """(row, s): windows of single contexts whose content occurs in another place."""
    total = contexts.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = stored(contexts.groupBy("g").count().where(F.col("count") > SHARD_CONTEXTS))
    parts = F.ceil(F.col("count") / SHARD_CONTEXTS)
    placed = contexts.join(hot, "g", "left").select(
        "g", "c", "row", "s", "windows", "single", "context",
        F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"),
        F.when(F.col("count").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("c", "row", "s"), parts)).alias("sub"),
        F.col("count").isNotNull().alias("split"),
    )
    key = [F.col("shard"), F.col("sub"), F.when(F.col("split"), F.col("g")).alias("hot")]
    # a fixed share of shards for each task, whatever the input
    placed = placed.repartition(-(-shards // TASK_SHARDS), *key)
    found = stored(placed.groupBy(*key).applyInPandas(_shard(n), "row long, s int, f1 long, f2 long, open boolean"))
    across = found.where("open").repartitionByRange("f1").mapInPandas(_merge_sorted, "row long, s int")
    return found.where("not open").select("row", "s").union(across)


def _by_extension(windows: DataFrame) -> DataFrame:
    """(row, s): word windows of single contexts that another distinct context holds too."""
    twice = stored(windows.groupBy("left", "right").agg(F.count("*").alias("m")).where("m > 1").select("left", "right"))
    return windows.where("single").join(twice, ["left", "right"]).select("row", "s")


def remove_repeats(docs: DataFrame, text: str, doc_id: str, unit: str, n: int, k: int) -> DataFrame:
    """(id, n, gone, spans, kept): one row per row of ``docs``; see the module."""
    session_of(docs)
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")))
    rows = spread(rows)
    found = stored(rows.select("row", "text").mapInArrow(_runs(unit, n, k), "row long, s int, e int, a int, g long, c long"))
    grams = found.groupBy("g").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("m > 1")
    # stored, so that both sides of the join are plain exchanges whose skewed partitions can be split
    grams = stored(grams.select("g", (F.col("low") != F.col("high")).alias("mixed")))
    again = stored(found.join(grams, "g"))
    free(found, grams)
    mixed = again.where("mixed")
    distinct = mixed.groupBy("g", "c").agg(F.count("*").alias("m"), F.min(F.struct("row", "s", "e", "a")).alias("one"))
    distinct = stored(distinct)
    sure = again.where("not mixed").select("row", "s", "e").union(mixed.join(distinct.where("m > 1").select("g", "c"), ["g", "c"]).select("row", "s", "e"))
    known = sure.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("known"))
    lent = distinct.select("one.row", F.struct("one.s", "one.e", "one.a", "g", "c", (F.col("m") == 1).alias("single")).alias("x")).groupBy("row").agg(F.collect_list("x").alias("lent"))
    about = known.join(lent, "row", "full")
    looked = stored(rows.join(about, "row", "left").select("row", "id", "text", "known", "lent").mapInArrow(_first_look(unit, n), _LOOK_DDL))
    free(again, distinct)
    open_ = looked.where("text is not null")
    parts = looked.where("g is not null")
    late = (_by_suffix_arrays(parts.select("g", "c", "row", "s", "windows", "single", "context"), n) if unit == "bytes" else _by_extension(parts.select("left", "right", "row", "s", "single")))
    late = late.groupBy("row").agg(F.collect_list("s").alias("late"))

    def close(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                starts = [(y["s"], y["e"]) for y in x["known"] or []] + [(s, s) for s in x["late"] or []]
                out.append((x["id"], *cut(x["text"], starts, unit, n)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "n", "gone", "spans", "kept"])

    closed = open_.select("row", "id", "text", "known").join(late, "row", "left").mapInArrow(close, "id long, n long, gone long, spans long, kept binary")
    done = looked.where("n is not null").select("id", "n", "gone", "spans", "kept")
    return done.union(closed)
