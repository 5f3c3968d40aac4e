"""The pipeline's contract, and its stages against plain versions of themselves."""

import re

import pytest

import corpus_pipeline
from quern.llm import queries
from quern.llm.common import stored, table


def test_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "mix"]


@pytest.fixture(scope="module")
def steps(spark, data):
    docs, out = table(spark, data, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data))
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, data, steps):
    columns = table(spark, data, "documents").columns
    assert [x.columns for x in steps[:-1]] == [columns] * 4 and steps[-1].columns[: len(columns)] == columns
    counts = [x.count() for x in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_run_equals_stages(spark, data, steps):
    key = lambda df: sorted((r.doc_id, r.text, r.mix_taken) for r in df.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(steps[-1])


def test_one_of_each_group_stays(steps):
    from quern.llm.similar import shingle_set

    sets = [set(shingle_set(r.text.encode(), 5).tolist()) for r in steps[1].collect()]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


def test_no_personal_data_is_left(steps):
    from quern.llm.pii import base_spans

    assert not any(base_spans(r.text) for r in steps[3].collect())


def words_of(text):
    """(word with A-Z lowered, start, end) of a text."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_clean(text, windows):
    """(items that ``text`` holds windows of, the text without the words they hit)."""
    words, hit, items = words_of(text), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            own = windows.get(tuple(w for w, _, _ in words[i : i + size]))
            if own is not None:
                hit |= set(range(i, i + size))
                items |= own
    out, last = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            end = i
            while end + 1 in hit:
                end += 1
            out += text[last : words[i][1]]
            last = words[end][2]
    return items, out + text[last:] if text is not None else None


def plain_targets(sizes, most=3):
    """Shares of 1, 2, 3 by source in code point order, null last, cut at ``most`` times a source's size and shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, left = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        unit = rest / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if unit * weight[s] >= most * sizes[s]}
        if not over:
            return full | {s: unit * weight[s] for s in left}
        full |= {s: most * sizes[s] for s in over}
        left -= over


def test_stages_equal_plain_versions(spark, data, steps):
    """Each stage on what the stages before it kept, against loops in Python."""
    from test_similar import kept

    from quern.llm.pii import find_pii
    from quern.llm.quality import classify

    documents = table(spark, data, "documents")
    rows = [{r.doc_id: r.asDict() for r in x.collect()} for x in (documents, *steps)]
    good = {r.doc_id for r in classify(documents, table(spark, data, "labels")).where("kept").collect()}
    assert rows[1] == {i: r for i, r in rows[0].items() if i in good} and len(good) < len(rows[0])
    assert rows[2] == {i: rows[1][i] for i in kept([(i, r["text"]) for i, r in rows[1].items()])}
    windows = {}
    for item in table(spark, data, "benchmark").collect():
        words = [w for w, _, _ in words_of(item.text)]
        for k in range(len(words) - min(8, len(words)) + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + 8]), set()).add(str(item.item_id))
    clean = {i: plain_clean(r["text"], windows) for i, r in rows[2].items()}
    want = {i: r | {"text": clean[i][1]} for i, r in rows[2].items() if len(clean[i][0]) < 2}
    assert rows[3] == {i: r | {"n_chars": len(r["text"])} for i, r in want.items()}
    spans = {r.doc_id: r.spans for r in find_pii(steps[2]).collect()}
    for i, r in rows[3].items():
        text = r["text"]
        for kind, s, e in reversed([x.split(":") for x in spans[i].split(",") if x]):
            text = text[: int(s)] + f"[{kind.upper()}]" + text[int(e) :]
        assert rows[4][i] == r | {"text": text, "n_chars": len(text)}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in rows[4].items()}
    sizes = {}
    for i, r in rows[4].items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[i]
    taken = dict.fromkeys(sizes, 0)
    for i, r in rows[5].items():
        assert {k: r[k] for k in rows[4][i]} == rows[4][i] and r["mix_size"] == size[i] and 0 < r["mix_taken"] <= 3 * size[i]
        taken[r["source"]] += r["mix_taken"]
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 1
