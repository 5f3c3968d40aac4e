"""Personal data: exact base patterns, and further spans that boosted trees accept.

Base spans follow fixed patterns.  High-recall generators propose further,
overlapping candidates: parts of failed base matches, numbers without a plus
sign, obfuscated addresses.  Trees learn from format and context what separates
valid base spans from candidates that break their kind's rule; the documents of
a third of the sample are held out and calibrate one threshold a kind.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import session_of, spread, stored

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the driver gathers to fit the trees, and the precision a threshold must keep.
SAMPLE = 20_000
PRECISION = 0.99

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PART = re.compile(r"[0-9]+")
#: Candidate generators: every one is linear in the text or bounded in length.
_MORE = (
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])")),
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| at |@)[A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}")),
)
#: What every match of the e-mail generator holds after its local part.
_ADDRESS = re.compile(r"(?:[\[(] ?at ?[\])] ?| at |@)[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}")
_HINT = {k: frozenset(v.split()) for k, v in {"email": "mail email e-mail contact write", "ip": "ip host server address client", "card": "card visa credit debit account", "phone": "call phone tel mobile fax dial"}.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_PART.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: leftmost non-overlapping matches of each kind that pass its rule."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts = [(p.start(), p.end()) for p in _PART.finditer(text, m.start(), m.end())]
            for i in range(0, len(parts) - 3, 4):
                if all(b - a <= 3 + _zeros(text, a, b) and int(text[max(a, b - 4) : b]) <= 255 for a, b in parts[i : i + 4]):
                    out.append(("ip", parts[i][0], parts[i + 3][1]))
    for m in _NUMBER.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _zeros(text: str, a: int, b: int) -> int:
    """Leading zeros of text[a:b]."""
    n = 0
    while a + n < b and text[a + n] == "0":
        n += 1
    return n


def valid(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    return kind == "email" or all(int(p) <= 255 for p in _PART.findall(s))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans, base spans of their kind included; they may overlap."""
    found = set(base)
    digits = any(c in text for c in "0123456789")
    for kind, pattern in _MORE:
        if kind == "email":
            if ("@" in text or "at" in text) and _ADDRESS.search(text):
                found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
        elif digits:
            found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    s, d = text[start:end], _digits(text[start:end])
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    context = text[max(0, start - 40) : start].lower().replace(":", " ").split()[-3:]
    parts = _PART.findall(s)
    around = text[max(0, start - 24) : start] + text[end : end + 24]
    return [
        *(float(kind == k) for k in KINDS), float(len(s)), float(len(d)), float(len(parts)), float(sum(not c.isalnum() for c in s)),
        float(12 <= len(d) <= 19 and luhn(d)), float(max((len(p) for p in parts), default=0)), float(max((min(int(p[:6]), 99999) for p in parts), default=0)),
        float(s[:1] == "+"), float("(" in s), float("@" in s), float(before.isalnum()), float(after.isalnum()), float(before in ".-_/" and before != ""),
        float(any(x in _HINT[kind] for x in context)), sum(c.isdigit() for c in around) / (len(around) + 1),
    ]


_CANDIDATE = "h long, doc long, kind string, ok boolean, x array<float>"


def _propose(batches):
    """The candidates of a partition with their weak labels."""
    for batch in batches:
        h, of, kinds, ok, x = [], [], [], [], []
        for key, text in zip(batch["h"].to_pylist(), batch["_text"].to_pylist(), strict=True):
            if not text:
                continue
            base = base_spans(text)
            sure = set(base)
            for n, (kind, s, e) in enumerate(candidates(text, base)):
                # a proposal of valid form outside the base spans is what the trees shall judge
                if (kind, s, e) in sure or not valid(kind, text[s:e]):
                    h.append((key + n * 0x9E3779B97F4A7C15) % 2**63)
                    of.append(key)
                    kinds.append(kind)
                    ok.append((kind, s, e) in sure)
                    x.append(features(text, kind, s, e))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(of, pa.int64()), pa.array(kinds, pa.string()), pa.array(ok, pa.bool_()), pa.array(x, pa.list_(pa.float32()))], names=["h", "doc", "kind", "ok", "x"])


def train(docs: DataFrame, text: str, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[gbdt.Trees | None, dict[str, float]]:
    """(trees, margin threshold of each kind) from a hash sample of at most about ``sample`` candidates."""
    session_of(docs)
    proposed = stored(spread(docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("_text"))).mapInArrow(_propose, _CANDIDATE))
    total = proposed.count()
    part = proposed if total <= sample else proposed.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    rows = part.orderBy("h", "doc", "kind", "ok", "x").limit(2 * sample).toPandas()
    if len(rows) < 50 or rows["ok"].nunique() < 2:
        return None, {}
    x, y = np.stack(rows["x"].to_numpy()), rows["ok"].to_numpy().astype(float)
    held = rows["doc"].to_numpy() % 3 == 0
    trees = gbdt.fit(x[~held], y[~held])
    margin, limits = trees.margin(x[held]), {}
    for kind in KINDS:
        own = rows["kind"].to_numpy()[held] == kind
        m, t = margin[own], y[held][own]
        order = np.argsort(-m, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        if len(good):
            # the lowest margin that keeps the precision, at least even odds
            limits[kind] = max(0.0, float(m[order][good[-1]]))
    return trees, limits


def all_spans(text: str, trees: gbdt.Trees | None, limits: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans): accepted candidates join where they overlap no chosen span, the longest first."""
    base = base_spans(text)
    if trees is None:
        return base, base
    extra = [c for c in candidates(text, base) if c[0] in limits and c not in base and not any(s < c[2] and c[1] < e for _, s, e in base)]
    chosen = list(base)
    if extra:
        margin = trees.margin(np.array([features(text, *c) for c in extra], np.float32))
        for m, c in sorted(zip(margin.tolist(), extra, strict=True), key=lambda z: (z[1][1] - z[1][2], -z[0], z[1])):
            if m >= limits[c[0]] and valid(c[0], text[c[1] : c[2]]) and not any(s < c[2] and c[1] < e for _, s, e in chosen):
                chosen.append(c)
    return base, sorted(chosen, key=lambda x: (x[1], KINDS.index(x[0])))


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(model):
    def find(batches):
        trees, limits = model.value
        for batch in batches:
            out: dict[str, list] = {x: [] for x in (*KINDS, "base", "spans")}
            for text in batch["_text"].to_pylist():
                base, spans = all_spans(text or "", trees, limits)
                for k in KINDS:
                    out[k].append(sum(x[0] == k for x in base))
                out["base"].append(_written(base))
                out["spans"].append(_written(spans))
            keep = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in keep], *[pa.array(out[k], pa.int64()) for k in KINDS], pa.array(out["base"], pa.string()), pa.array(out["spans"], pa.string())], names=[*keep, *[f"n_{k}" for k in KINDS], "base", "spans"])

    return find


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """Spans of personal data: the columns ``keep``, n_<kind> (base spans), base and spans.

    base and spans list kind:start:end by start, then kind, comma-joined;
    offsets are code points, the end exclusive.  spans has all base spans and
    those the trees add.  Null and empty texts have none; repeated rows are
    rows of their own; if there is too little to learn from, nothing is added.
    """
    spark = session_of(docs)
    model = spark.sparkContext.broadcast(train(docs, text, sample))
    rows = spread(docs.select(*keep, F.col(text).alias("_text")))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + "".join(f", n_{k} long" for k in KINDS) + ", base string, spans string"
    return rows.mapInArrow(_find(model), out)


def _redact(model, column: str):
    def redact(batches):
        trees, limits = model.value
        for batch in batches:
            texts = []
            for text in batch[column].to_pylist():
                if text:
                    out, last = [], 0
                    for kind, s, e in all_spans(text, trees, limits)[1]:
                        if s >= last:
                            out += [text[last:s], f"[{kind.upper()}]"]
                        last = max(last, e)
                    text = "".join([*out, text[last:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == column else batch[x] for x in batch.schema.names], names=batch.schema.names)

    return redact


def redact_pii(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span of personal data replaced by [KIND]; other columns and clean texts are unchanged.

    Null and empty texts stay; texts of any length are read whole; repeated rows
    are changed alike; an empty table stays empty.
    """
    spark = session_of(docs)
    model = spark.sparkContext.broadcast(train(docs, text, sample))
    return spread(docs).mapInArrow(_redact(model, text), docs.schema)
