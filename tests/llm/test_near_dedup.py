import random
import re

import numpy as np

from tilewright.llm.near_dedup import near_duplicates
from tilewright.llm.text_arrays import shingles


def _set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _brute(rows):
    sets = {i: _set(t) for i, t in rows}
    name = {i: i for i in sets}
    ids = sorted(sets)
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and name[a] != name[b] and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    low, high = sorted((name[a], name[b]))
                    name = {k: low if v == high else v for k, v in name.items()}
                    again = True
    return {i: (len(sets[i]), name[i], name[i] == i) for i in ids}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(3)


def test_shingles_match_brute_force():
    texts = ["", "one", "One TWO three", "a b c d e f a b c d e", " x\ty\x0bz\x0c q\x1cw ünï É é ", "a b c d e", "\n\n", "É b c d e f"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    hashes, bounds = shingles(np.frombuffer(b"".join(raw), np.uint8), off)
    assert np.diff(bounds).tolist() == [len(_set(t)) for t in texts]
    again, _ = shingles(np.frombuffer(raw[3], np.uint8), np.array([0, len(raw[3])]))
    assert again.tolist() == hashes[bounds[3] : bounds[4]].tolist()


def test_components_match_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        words = r.choices(vocabulary, k=r.choice([30, 60, 200]))
        for _ in range(r.choice([2, 10, 30])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), r.choice([" ", "\n"]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", None, "  ", "one two", "ONE  two", "one two three four five", "long " * 30000, "long " * 29999])]
    r.shuffle(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(_docs(spark, rows)).collect()}
    assert got == _brute(rows)


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = "the same text of eight words or so"
    got = near_duplicates(_docs(spark, [(None, text), (3, text), (3, text), (2, text)])).collect()
    assert sorted((x["doc_id"] or -1, x["component_id"], x["kept"]) for x in got if x["doc_id"]) == [(2, 2, True), (3, 2, False), (3, 2, False)]
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] is None] == [(None, True)]
    assert near_duplicates(_docs(spark, [])).count() == 0


def test_very_many_copies_take_a_pair_each(spark, monkeypatch):
    from tilewright.llm import near_dedup

    pairs = []
    confirmed = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda sets, some, p: (pairs.append(some.count()), confirmed(sets, some, p))[1])
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:110] + [f"own{i}"] + words[110:])) for i in range(3000)]
    got = near_duplicates(_docs(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1
    assert pairs[0] <= 3000 and sum(pairs) < 2 * 3000
