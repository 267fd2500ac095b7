import hashlib
import random
from collections import Counter

import pytest

from tilewright.llm.fingerprints import edit_fingerprints, fingerprint, fingerprint_nodes, likeness, locate_edits, merkle_tree


def test_trees_locate_edits_and_roots_test_equality():
    a = "\n".join(f"paragraph {i} says this." for i in range(60))
    b = a.replace("paragraph 31 says", "paragraph 31 said")
    assert merkle_tree(a) == merkle_tree(a) and merkle_tree(a).root != merkle_tree(b).root
    assert sum(merkle_tree(a).sections) == 60
    assert fingerprint(None) == fingerprint("")


def test_likeness_is_ordered():
    a = " ".join(f"Sentence number {i} of it." for i in range(400))
    near = a.replace("number 7 ", "number x ")
    far = " ".join(f"Other words {i} here." for i in range(400))
    assert likeness(fingerprint(a), fingerprint(a)) == 1.0
    assert 0.9 < likeness(fingerprint(a), fingerprint(near)) < 1.0
    assert likeness(fingerprint(a), fingerprint(far)) == 0.0 and likeness(fingerprint(""), fingerprint(a)) == 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_next_documents_and_edits(spark, n):
    texts = {i * 3: (None if i % 11 == 5 else "" if i % 11 == 6 else f"é{i} text. " * (i % 7 * 5)) for i in range(n)}
    docs = spark.createDataFrame([(k, t, "x") for k, t in reversed(list(texts.items()))], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in edit_fingerprints(docs.repartition(3)).collect()}
    assert set(got) == set(texts)
    ids = sorted(texts)
    for i, k in enumerate(ids):
        text, then = texts[k] or "", texts[ids[(i + 1) % n]] or ""
        q = len(text) // 4
        edit = text[: len(text) - q] + then[:q]
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(text) and r["edited_fingerprint"] == fingerprint(edit)
        assert r["near_edited"] == likeness(fingerprint(text), fingerprint(edit)) and r["near_next"] == likeness(fingerprint(text), fingerprint(then))


def test_null_and_repeated_ids_and_nodes(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "x"), (2, None)], "doc_id long, text string")
    assert edit_fingerprints(docs).count() == 4
    nodes = fingerprint_nodes(docs)
    assert nodes.where("level = 0").count() == 4 and nodes.where("level = 2").count() == 4


def test_edits_are_located_on_both_sides(spark):
    r = random.Random(6)
    lines = [f"paragraph {i} says this." for i in range(60)]
    change = {
        1: lambda x: x, 2: lambda x: [x[1], x[0], *x[2:]], 3: lambda x: x[:20] + x[21:], 4: lambda x: x[:20] + [x[20]] + x[20:],
        5: lambda x: x[30:45] + x[:30] + x[45:], 6: lambda x: x[:31] + ["paragraph 31 said"] + x[32:], 7: lambda x: [], 8: lambda x: x[::-1],
    }
    before = {k: list(lines) for k in change} | {k: [r.choice("abcdefgh") for _ in range(r.randrange(30))] for k in range(10, 40)}
    after = {k: f(before[k]) for k, f in change.items()}
    for k in range(10, 40):
        x = list(before[k])
        for _ in range(r.randrange(5)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randrange(3)] = r.choices("abcxyz", k=r.randrange(3))
        after[k] = x
    frame = lambda d: spark.createDataFrame([(k, "\n".join(v)) for k, v in d.items()] + [(None, "x")], "doc_id long, text string")
    rows = {k: [] for k in before}
    for x in locate_edits(frame(before), frame(after)).collect():
        rows[x["doc_id"]].append((x["change"], x["old"], x["new"]))
    assert rows[1] == [] and len(rows[2]) == 1 and rows[2][0][0] == "moved" and rows[3] == [("removed", 20, None)] and rows[4] == [("added", None, 21)]
    assert sorted(rows[6], key=str) == [("added", None, 31), ("removed", 31, None)] and len(rows[5]) == 15
    for k, got in rows.items():
        a, b = "\n".join(before[k]).split("\n"), "\n".join(after[k]).split("\n")
        gone, came = Counter(a) - Counter(b), Counter(b) - Counter(a)
        assert Counter(a[o] for c, o, _ in got if c == "removed") == gone and Counter(b[n] for c, _, n in got if c == "added") == came
        assert all(a[o] == b[n] for c, o, n in got if c == "moved")
        # what is neither removed, added nor moved stands in the same order on both sides
        left = [x for i, x in enumerate(a) if i not in {o for c, o, _ in got if c != "added"}]
        right = [x for i, x in enumerate(b) if i not in {n for c, _, n in got if c != "removed"}]
        assert left == right
    assert locate_edits(frame({}), frame(after)).count() == 0


def test_many_rows_of_one_id_and_one_text(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(7, "same words here.") for _ in range(300)] + [(i, f"own {i}") for i in range(20, 60)]
    got = edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert Counter(x["doc_id"] for x in got) == Counter(i for i, _ in rows)
    assert sum(x["near_next"] == 1.0 for x in got if x["doc_id"] == 7) == 299
    # every row follows another one, and each is followed once: edits show what follows
    ends = Counter((fingerprint("same words here."[:12] + "text"), x["edited_fingerprint"]) for x in got if x["doc_id"] == 7)
    assert sum(ends.values()) == 300
