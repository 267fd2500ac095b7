import random

import numpy as np
import pytest

from tilewright.llm import decontamination
from tilewright.llm.decontamination import align, edit_budget, find_passages, mark_documents, normalise


def _norm(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes()


def _edits(pattern, text):
    """Least edits of the whole pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def _change(r, text, n):
    chars = list(text)
    for _ in range(n):
        k = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[k] = r.choice("xyzé")
        elif kind == 1:
            del chars[k]
        else:
            chars.insert(k, r.choice("xyz"))
    return "".join(chars)


def test_banded_alignment_matches_full_alignment():
    r = random.Random(4)
    for _ in range(60):
        p = "".join(r.choices("abcd ", k=r.randrange(1, 40)))
        t = "".join(r.choices("abcd ", k=r.randrange(0, 20))) + _change(r, p, r.randrange(3)) + "".join(r.choices("abcd ", k=r.randrange(0, 20)))
        want = _edits(p.encode(), t.encode())
        got = align(p.encode(), t.encode(), 0, len(t.encode()) + len(p), 1000)
        assert got[0] == want, (p, t)
        assert _edits(p.encode(), t.encode()[got[1] : got[2]]) == want


@pytest.mark.parametrize("index_bytes, block", [(4 << 20, 1 << 20), (4 << 20, 700), (0, 700)])
def test_found_passages_match_brute_force(spark, monkeypatch, index_bytes, block):
    """From one index, from an index over texts cut into parts, and by the shuffle join of a large benchmark."""
    monkeypatch.setattr(decontamination, "INDEX_BYTES", index_bytes)
    monkeypatch.setattr(decontamination, "LARGE_BITS", 16)
    frame, bench, want = _case(spark)
    if block < 1 << 20:
        # workers import the modules anew, so the cut is tried on the driver
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        index = decontamination.Index(tuple((i, p.encode()) for i, p in bench if p and i is not None), decontamination.EDIT_RATE)
        for r in frame.where("text is not null").collect():
            raw = np.frombuffer(r["text"].encode(), np.uint8)
            data, off = normalise(raw, np.array([0, len(raw)]))
            assert {(r["doc_id"], index.ids[i]): n for _, i, _, _, n in decontamination._search(data, off, index)} == {k: n for k, n in want.items() if k[0] == r["doc_id"]}
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in find_passages(frame, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want
    marked = {x["doc_id"]: x["passages"] for x in mark_documents(frame.withColumnRenamed("start", "own"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {(d, i) for d, items in marked.items() for i in items} == set(want) and len(marked) == frame.count()


def _case(spark):
    r = random.Random(9)
    words = ["tion", "ering", "the", "and", "éu", "of", "stand", "ble", "heat", "ou"]
    say = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    bench = [(i, say(r.choice([1, 3, 8, 25]))) for i in range(12)] + [(50, None), (51, ""), (52, "  "), (53, "tiny"), (None, "the and of the and of")]
    docs = [(0, None), (1, ""), (2, " \n ")]
    for i in range(60):
        passage = r.choice(bench[:12])[1]
        part = _change(r, passage, r.choice([0, 0, 1, 2, 5, 9]))
        docs.append((10 + i, say(r.choice([0, 5, 60])) + r.choice([" ", "\n", ""]) + part.replace(" ", r.choice([" ", "\n", "  "])).upper() + " " + say(r.choice([0, 20]))))
    docs.append((99, say(3000) + bench[3][1]))
    docs.append((100, "so tiny."))
    # passages cut off by a text's start or end, within the budget and far beyond it
    long = max((t for _, t in bench[:12]), key=len)
    docs += [(200 + c, long[c:] + " " + say(9)) for c in (1, 3, 9, 40, len(long) // 2)] + [(300 + c, say(9) + " " + long[: len(long) - c]) for c in (1, 3, 9, 40, len(long) // 2)] + [(400, long[len(long) // 2 :])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int").repartition(3)
    want = {}
    for d, t in docs:
        for i, p in bench:
            body = _norm(p).strip(b" ")
            if body and i is not None:
                n = _edits(body, _norm(t))
                if n <= edit_budget(len(body)):
                    want[d, i] = n
    return frame, bench, want


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_large_benchmarks_and_empty_tables(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "INDEX_BYTES", size)
    docs = spark.createDataFrame([(1, "here is a passage of some length to be found, in a text"), (None, "a passage of some length to be found")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a passage of some length to be found"), (2, "another one that no text has at all")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in find_passages(docs, bench).collect()) == [(0, 1), (1, 1)]
    assert sorted(r["passages"] for r in mark_documents(docs, bench).collect()) == [[1], [1]]
    assert find_passages(docs.where("doc_id < 0"), bench).count() == 0 and find_passages(docs, bench.where("item_id < 0")).count() == 0
    scans = find_passages(docs, bench)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert scans == 1 or size == 0
