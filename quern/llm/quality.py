"""Quality classifier: heuristic labellers weighed by expectation-maximisation train a hashed linear scorer.

Two properties are modelled apart: low quality and toxicity.  Labellers vote
bad, good or nothing on each document; EM over the counts of vote patterns (at
most 3 to the number of labellers, however large the corpus) estimates how each
labeller votes on bad and good documents.  The posterior of a pattern is the
soft label of the documents that show it, and a logistic scorer over hashed
words, stems and shapes learns from a bounded hash sample of them.  The scorer
sees only the text.  Toxicity has two labellers beside the labels, a list of
insults and a lexicon of words and stems that labelled documents teach.
"""

from __future__ import annotations

import sys
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small, spread, stored
from .winnow import Hashes, mix

#: Documents that fit the scorer, and labelled ones that teach the lexicon, at most; hashed features.
SAMPLE = 8_000
LABELLED = 20_000
FEATURES = 1 << 18
#: Entries of the lexicon at most; how many labelled documents, how large a share of toxic ones and how many standard deviations above chance an entry needs.
LEXICON = 2_000
LEAST, SHARE, DEVIATIONS = 5, 0.8, 8.0
#: Letters of a word's beginning that are a feature of their own: stems of words that vary.
STEM = 5
#: Scores from which a document is rejected; to miss a toxic one costs more than to lose a clean one.
REJECT_LOW = 0.5
REJECT_TOXIC = 0.25

# Insults that mark toxic text.
INSULTS = frozenset("idiot moron stupid worthless disgusting pathetic trash clown scum loser dumb jerk fool imbecile bastard idiota imbécil estúpido basura idiote imbécile stupide ordure dummkopf trottel abschaum blödmann".split())

GOOD, BAD, NONE = 0, 1, 2


SPACE, WORD, ALNUM, UPPER, LOWER = 1, 2, 4, 8, 16


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: flags (white space, part of a word, letter or digit, capital, other cased letter), and a hash."""
    size, step = sys.maxunicode + 1, 1 << 16
    flags, hashes = np.zeros(size, np.uint8), np.arange(1, size + 1, dtype=np.uint64)
    lower = lambda c: c.islower() or c.istitle() and not c.isupper()
    # a part at a time: a million strings at once would stay with the worker
    for at in range(0, size, step):
        for flag, f in ((SPACE, str.isspace), (WORD | ALNUM, str.isalnum), (UPPER, str.isupper), (LOWER, lower)):
            flags[at : at + step] |= np.fromiter(map(f, map(chr, range(at, at + step))), bool, step) * np.uint8(flag)
        hashes[at : at + step] = mix(hashes[at : at + step])
    flags[ord("_")] |= WORD
    return flags, hashes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the runs of true."""
    step = np.diff(np.r_[0, inside.view(np.int8), 0])
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashes(points: np.ndarray) -> Hashes:
    return Hashes(_classes()[1][points])


def _kinds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the hashes, which of the ordered ones are new)."""
    order = np.argsort(h)
    h = h[order]
    return order, np.r_[True, h[1:] != h[:-1]]


def shape(text: str) -> dict[str, float]:
    """Statistics of a text that the labellers and the scorer look at; words are what white space parts."""
    points = _points(text)
    flags = _classes()[0][points]
    start, end = _runs(flags & SPACE == 0)
    total = len(start)
    n = max(total, 1)
    visible = max(int((end - start).sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    top, pairs, shouted, short = 0, 0, 0, 0
    if total:
        h = _hashes(points).of(start, end)
        first = np.flatnonzero(_kinds(h)[1])
        top = int(np.diff(np.r_[first, total]).max())
        pairs = int(_kinds(mix(h[:-1]) + h[1:])[1].sum()) if total > 1 else 0
        # only words that begin with a capital, or with no letter, can be all capitals
        some = flags[start] & LOWER == 0
        a, b = start[some], end[some]
        ups, lows = (np.r_[0, np.cumsum(flags & k != 0)] for k in (UPPER, LOWER)) if len(a) else (np.zeros(1, int),) * 2
        shouted = int(((ups[b] > ups[a]) & (lows[b] == lows[a])).sum()) if len(a) else 0
        short = int((flags[start[end - start == 1]] & ALNUM == 0).sum())
    return {
        "n": float(total),
        "top": top / n,
        "distinct": (pairs + 1) / n,
        "short": short / n,
        "marks": int(np.count_nonzero(flags & (SPACE | WORD) == 0)) / visible,
        "upper": shouted / n,
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
        "long": visible / n,
    }


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct lower-case words of a text, hashes of their stems in the same order)."""
    points = _points(text.lower())
    start, end = _runs(_classes()[0][points] & WORD != 0)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = _hashes(points)
    h = sums.of(start, end)
    order, new = _kinds(h)
    at = order[new]
    stems = mix(sums.of(start[at], np.minimum(end[at], start[at] + STEM)) + np.uint64(1))
    return h[at].view(np.int64), stems.view(np.int64)


def among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``table``."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)


@cache
def _insults() -> np.ndarray:
    return np.sort(terms(" ".join(INSULTS))[0])


def quality_votes(s: dict[str, float], label: int | None = None) -> list[int]:
    """Each labeller knows one kind of junk and is silent on all others; one knows ordinary prose."""
    some = s["n"] >= 8
    prose = s["marks"] < 0.1 and s["short"] < 0.05 and s["upper"] < 0.2 and s["lines"] < 0.3 and (not some or s["top"] < 0.2) and (s["n"] < 20 or s["distinct"] > 0.5)
    return [
        BAD if s["marks"] > 0.2 and s["n"] > 2 else NONE,
        BAD if s["short"] > 0.1 and some else NONE,
        BAD if some and s["top"] > 0.3 else NONE,
        BAD if some and s["upper"] > 0.5 else NONE,
        BAD if s["lines"] > 0.5 else NONE,
        BAD if s["n"] >= 20 and s["distinct"] < 0.3 else NONE,
        BAD if some and s["long"] > 14 else NONE,
        GOOD if prose else NONE,
        NONE if label is None else GOOD if label == 1 else BAD,
    ]


NO_TERMS = np.zeros(0, np.int64)


def toxic_votes(words: np.ndarray, stems: np.ndarray, lexicon: np.ndarray = NO_TERMS, label: int | None = None) -> list[int]:
    """A list of insults, a lexicon learned from labelled documents (one hit in a long text is chance), and the label."""
    hits = int((among(words, lexicon) | among(stems, lexicon)).sum())
    return [
        BAD if among(words, _insults()).any() else GOOD,
        NONE if not len(lexicon) else BAD if hits > max(1, 0.004 * len(words)) else NONE if hits else GOOD,
        NONE if label is None else BAD if label == 1 else GOOD,
    ]


def weigh(patterns: np.ndarray, counts: np.ndarray, rate: float, rounds: int = 100) -> np.ndarray:
    """Posterior of "bad" for each vote pattern (rows of 0, 1, 2), by EM with conditionally independent labellers.

    Starts from votes that are right four times in five; a labeller's table is
    smoothed by one vote of each kind.
    """
    k = patterns.shape[1]
    table = np.zeros((2, k, 3))
    table[0], table[1] = (0.5, 0.1, 0.4), (0.1, 0.5, 0.4)
    hot = np.eye(3)[patterns]
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        log = np.stack([np.log(p) + (hot * np.log(table[c])).sum((1, 2)) for c, p in ((0, 1 - rate), (1, rate))], 1)
        log -= log.max(1, keepdims=True)
        new = np.exp(log[:, 1]) / np.exp(log).sum(1)
        for c, w in ((0, 1 - new), (1, new)):
            votes = np.einsum("n,nkv->kv", w * counts, hot) + 1
            table[c] = votes / votes.sum(1, keepdims=True)
        rate = float(np.clip((new * counts).sum() / counts.sum(), 1e-3, 0.9))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return new


@cache
def _levels(key: str) -> np.ndarray:
    return np.array([crc32(f"{key}>{i}".encode()) % FEATURES for i in range(41)])


def hashed(words: np.ndarray, stems: np.ndarray, s: dict[str, float]) -> np.ndarray:
    """Feature numbers of a text: its distinct words and stems, and every level that its shape reaches."""
    stems = np.sort(stems)
    parts = [words & (FEATURES - 1), stems[np.r_[True, stems[1:] != stems[:-1]]] & (FEATURES - 1)] if len(words) else []
    for k, v in s.items():
        level = int(np.log2(v + 1) * 2) if k in ("n", "long") else int(v * 20)
        parts.append(_levels(k)[: min(level, 40) + 1])
    return np.concatenate(parts).astype(np.int32)


def _distinct(batches):
    """(term, toxic, documents) of the distinct words and stems of labelled texts, summed over a batch."""
    for batch in batches:
        own = [np.unique(np.concatenate(terms(t or ""))) for t in batch["text"].to_pylist()]
        if not own:
            continue
        toxic = np.repeat(batch["toxic"].to_numpy(), [len(x) for x in own])
        term, of = np.unique(np.concatenate(own), return_inverse=True)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int64()), "t": pa.array(np.bincount(of, toxic, len(term)).astype(np.int64)), "n": pa.array(np.bincount(of, minlength=len(term)).astype(np.int64))})


def learn_lexicon(docs: DataFrame, labels: DataFrame | None, text: str, doc_id: str) -> np.ndarray:
    """Sorted terms of labelled documents that are toxic far more often than chance; from about LABELLED documents at most."""
    if labels is None:
        return NO_TERMS
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = stored(own)
    total = own.count()
    if total > LABELLED:
        own = own.where(F.pmod(F.xxhash64("_doc"), F.lit(1_000_000)) < int(1_000_000 * LABELLED / total))
    own = own.limit(2 * LABELLED)
    seen = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(own), F.col("_id") == F.col("_doc")).select("text", "toxic")
    size, bad = seen.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == size:
        return NO_TERMS
    rate = bad / size
    counts = seen.mapInArrow(_distinct, "term long, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    beyond = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    good = counts.where(f"t >= {LEAST} and t >= {SHARE} * n").withColumn("z", beyond).where(f"z >= {DEVIATIONS}")
    return np.sort(np.array([r.term for r in good.orderBy(F.desc("z"), "term").limit(LEXICON).collect()], np.int64))


def _scan(threshold: int | None, lexicon: np.ndarray):
    """Vote patterns of every document before its labels are known; hashed features of the sampled ones (h below ``threshold``)."""

    def scan(batches):
        for batch in batches:
            q, t, x = [], [], []
            for h, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                words, s = terms(text), shape(text)
                q.append("".join(map(str, quality_votes(s))))
                t.append("".join(map(str, toxic_votes(*words, lexicon))))
                x.append(hashed(*words, s) if threshold is None or h < threshold else None)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["h"], pa.array(q, pa.string()), pa.array(t, pa.string()), pa.array(x, pa.list_(pa.int32()))], names=["id", "h", "q", "t", "x"])

    return scan


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(index: np.ndarray, size: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.3, sparse: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer over present features: full-batch AdaGrad with an L1 proximal step.

    ``index`` lists the features of each document, ``size`` many of them.  The
    L1 term keeps the many neutral words of a long text at zero, and what is too
    rare ever to leave zero is left out from the start.
    """
    count = np.bincount(index, minlength=FEATURES)
    own = np.flatnonzero(count > sparse * len(y))
    place = np.full(FEATURES, -1, np.int32)
    place[own] = np.arange(len(own))
    small = place[index]
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)[small >= 0]
    small = small[small >= 0]
    w, bias, g2, b2 = np.zeros(len(own)), 0.0, np.full(len(own), 1e-8), 1e-8
    # so many features at once, to bound the memory of a round
    cuts = [*range(0, len(small), 1 << 20), len(small)]
    for _ in range(rounds):
        total = np.zeros(len(y))
        for a, b in zip(cuts, cuts[1:], strict=False):
            total += np.bincount(row[a:b], w[small[a:b]], len(y))
        e = (_logistic(total + bias) - y) / len(y)
        g = np.zeros(len(own))
        for a, b in zip(cuts, cuts[1:], strict=False):
            g += np.bincount(small[a:b], e[row[a:b]], len(own))
        g2 += g**2
        b2 += e.sum() ** 2
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        bias -= rate * e.sum() / np.sqrt(b2)
    weights = np.zeros(FEATURES)
    weights[own] = w
    return weights, bias


Model = tuple[np.ndarray, float, np.ndarray, float] | None


def _labelled(seen: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``seen`` with the vote of every label in place of the last, silent labeller; of several labels the largest."""
    if labels is None:
        return seen.select("h", "q", "t", "x")
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    own = stored(own)
    vote = lambda votes, label, one, other: F.concat(F.expr(f"left({votes}, length({votes}) - 1)"), F.when(F.col(label).isNull(), str(NONE)).when(F.col(label) == 1, str(one)).otherwise(str(other)))
    return seen.join(small(own, own.count()), F.col("id") == F.col("_doc"), "left").select("h", vote("q", "_quality", GOOD, BAD).alias("q"), vote("t", "_toxic", BAD, GOOD).alias("t"), "x")


def train(docs: DataFrame, labels: DataFrame | None, text: str, doc_id: str, sample: int = SAMPLE) -> Model:
    session_of(docs)
    total = docs.count()
    if not total:
        return None
    # a share of all hashes: about ``sample`` documents wherever they lie
    threshold = None if total <= sample else int(2**63 * sample / total)
    rows = spread(docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).bitwiseAND(F.lit(2**63 - 1)).alias("h"), F.col(text).alias("text")))
    kind = docs.schema[doc_id].dataType.simpleString()
    lexicon = learn_lexicon(docs, labels, text, doc_id)
    seen = stored(_labelled(rows.mapInArrow(_scan(threshold, lexicon), f"id {kind}, h long, q string, t string, x array<int>"), labels))
    posterior = {}
    for column, rate in (("q", 0.15), ("t", 0.05)):
        counts = seen.groupBy(column).count().orderBy(column).toPandas()
        patterns = np.array([[int(c) for c in p] for p in counts[column]])
        post = weigh(patterns, counts["count"].to_numpy().astype(float), rate)
        if column == "t" and not len(lexicon):
            # accuracies cannot be told from one labeller: the label decides where there is one, else the list
            post = (np.where(patterns[:, -1] == NONE, patterns[:, 0], patterns[:, -1]) == BAD).astype(float)
        posterior[column] = dict(zip(counts[column], post, strict=True))
    fitted = seen.where("x is not null").orderBy("h", "q", "t").limit(2 * sample).select("q", "t", "x").toArrow()
    if not len(fitted):
        return None
    lists = fitted["x"].combine_chunks()
    index, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    soft = {c: np.array([posterior[c][v] for v in fitted[c].to_pylist()]) for c in ("q", "t")}
    del fitted, lists
    return (*fit_linear(index, size, soft["q"]), *fit_linear(index, size, soft["t"]))


def _score(model):
    def score(batches):
        fitted: Model = model.value
        for batch in batches:
            low, tox = [], []
            for text in batch["_text"].to_pylist():
                if fitted is None:
                    low.append(0.0)
                    tox.append(0.0)
                    continue
                text = text or ""
                x = hashed(*terms(text), shape(text))
                w, b, v, c = fitted
                low.append(float(_logistic(w[x].sum() + b)))
                tox.append(float(_logistic(v[x].sum() + c)))
            keep = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in keep], pa.array(low, pa.float64()), pa.array(tox, pa.float64())], names=[*keep, "_low", "_toxic"])

    return score


def classify(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` of every row with p_low, p_toxic (scores of low quality and toxicity) and kept.

    ``labels`` (doc_id, quality, toxic) is one more labeller of unknown
    accuracy, and all its rows vote.  Null and empty texts are
    judged by their shape like any other; texts of any length are read whole;
    repeated rows are rows of their own;
    an empty table gives no rows; other columns are ignored.
    """
    spark = session_of(docs)
    model = spark.sparkContext.broadcast(train(docs, labels, text, doc_id, sample))
    rows = spread(docs.select(*keep, F.col(text).alias("_text")))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", _low double, _toxic double"
    scored = rows.mapInArrow(_score(model), out)
    return scored.select(*keep, F.col("_low").alias("p_low"), F.col("_toxic").alias("p_toxic"), ((F.col("_low") < REJECT_LOW) & (F.col("_toxic") < REJECT_TOXIC)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns and texts are unchanged.

    Null and empty texts are judged by their shape, repeated rows alike; an
    empty table stays empty.
    """
    spark = session_of(docs)
    model = spark.sparkContext.broadcast(train(docs, labels, text, doc_id, sample))
    own = [f"_k{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(k) for k, c in zip(own, docs.columns, strict=True)], F.col(text).alias("_text"))
    rows = spread(rows)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", _low double, _toxic double"
    good = rows.mapInArrow(_score(model), out).where((F.col("_low") < REJECT_LOW) & (F.col("_toxic") < REJECT_TOXIC))
    return good.select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns, strict=True)])
