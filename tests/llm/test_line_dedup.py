import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright import storage
from tilewright.llm import line_dedup
from tilewright.llm.line_dedup import dedup_lines


def _set(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def _brute(rows):
    places = [(i, p, line) for i, t in sorted(rows) if t for p, line in enumerate(t.split("\n")) if line]
    sets = [_set(line) for _, _, line in places]
    name = list(range(len(places)))

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for x in range(len(places)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            if places[x][2] == places[y][2] or 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared):
                a, b = find(x), find(y)
                name[max(a, b)] = min(a, b)
    gone = {places[k][:2] for k in range(len(places)) if find(k) != k}
    return {i: None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pos string, n_lines int").repartition(3)


def test_lines_match_brute_force(spark):
    r = random.Random(2)
    vocabulary = [r.choice(["ré", "to", "an", "ß"]) + r.choice(["tion", "ing", "ly", "er"]) + r.choice("abcdefgh") for _ in range(200)]
    bases = [" ".join(r.choices(vocabulary, k=r.choice([3, 8, 30, 120]))) for _ in range(40)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randrange(6)):
            words = r.choice(bases).split(" ") if r.random() < 0.6 else r.choices(vocabulary, k=12)
            if r.random() < 0.4:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "abc\nabc\nabd"), (504, "x" * 90000 + "\nshort"), (505, "x" * 90001)]
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in dedup_lines(_docs(spark, rows)).collect()}
    want = _brute(rows)
    wrong = [i for i in want if got[i]["text"] != want[i]]
    assert not wrong, [(got[i]["text"], want[i]) for i in wrong[:2]]
    assert got[500]["n_lines"] == 0 and got[502]["n_lines"] == 3 and got[503]["n_dropped"] == 1 and got[505]["pos"] == "x"


def test_null_and_repeated_ids_and_empty_tables(spark):
    got = dedup_lines(_docs(spark, [(None, "a line of text"), (3, "a line of text"), (3, "a line of text"), (4, "a line of text")])).collect()
    assert sorted((x["doc_id"] or -1, x["text"]) for x in got) == [(-1, ""), (3, "a line of text"), (3, "a line of text"), (4, "")]
    assert dedup_lines(_docs(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = dedup_lines(_docs(spark, [(1, "one\ntwo")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def _family(r, lines, template, pairs):
    """Lines of 80 characters that share a template, two by two alike but for ``pairs`` characters at the end."""
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, out = some(template), []
    for _ in range(lines // 2):
        tail = some(80 - template)
        out += [head + tail, head + tail[: len(tail) - pairs] + some(pairs)]
    return out


def test_members_of_template_families_meet_each_other(spark):
    r = random.Random(5)
    rows = list(enumerate(_family(r, 1500, 58, 7) + _family(r, 1500, 66, 7)))
    r.shuffle(rows)
    sets = {i: _set(line) for i, line in rows}
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert not any(alike(i, j) for i in range(0, 3000, 300) for j in range(i + 2, 3000))
    got = {x["doc_id"]: x["text"] for x in dedup_lines(_docs(spark, rows)).collect()}
    pairs = [i for i in range(0, 3000, 2) if alike(i, i + 1)]
    assert len(pairs) > 1400
    lost = [i for i in pairs if got[i + 1] != ""]
    assert len(lost) <= len(pairs) // 100, len(lost)
    assert all(got[i] == line for i, line in rows if i % 2 == 0)


def test_unlike_lines_of_few_syllables_are_not_proposed(spark):
    r = random.Random(9)
    syllables = ["th", "er", "an", "tion", "on", "he", "re", "nd", "in", "the", "of", "ing"]
    lines = [" ".join("".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(120)) for _ in range(2500)]
    near = [line[:-6] + "?????" for line in lines[:50]]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines + near)], "a long, line string").repartition(3)
    bins = line_dedup._signatures(rows)
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col("b")[i] for i in band]) for k, band in enumerate(line_dedup.BANDS)])
    members = line_dedup._members(bins.select("a", F.explode(keys).alias("key")), bins.drop("sparse", "b"))
    pairs = {(x["x"], x["y"]) for x in line_dedup._proposed(members).collect()}
    assert {(i, 2500 + i) for i in range(50)} <= pairs and len(pairs) < 10_000, len(pairs)


def test_written_tables_leave_no_shuffle_files_and_can_go(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = spark.conf.get(conf), lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    held = kept()
    table = storage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert kept() <= held and spark.conf.get(conf) == before
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 7 and os.path.isdir(folder)
    storage.discard(table)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        storage.discard(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_copies_just_too_unlike_do_not_leave_their_blocks(spark, monkeypatch):
    r = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    template = "".join(r.choices(letters, k=1000))
    # two copies have about 0.7 of their shingles in common, so each is a component, and 1024 bits cannot tell them
    lines = ["".join(r.choice(letters) if r.random() < 0.02 else c for c in template) for _ in range(400)]
    rows = list(enumerate(lines + [line[:500] + "?" + line[501:] for line in lines[:20]]))
    written, real = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: written.append((label, real(df, label))) or written[-1][1])
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: None)
    got = {x["doc_id"]: x["text"] for x in dedup_lines(_docs(spark, rows)).collect()}
    assert got == _brute(rows)
    pairs = {label: df.count() for label, df in written if label in ("proposed", "likely", "apart")}
    assert pairs and all(n < 20 * len(rows) for n in pairs.values()), pairs
