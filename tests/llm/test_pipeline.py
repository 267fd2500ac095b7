import random

import corpus_pipeline
from tilewright.llm.sentence_pieces import encode_text, load


def test_stages_by_hand(spark, tmp_path):
    r = random.Random(8)
    words = [a + b for a in ("ba", "do", "ki", "lu", "me") for b in ("tion", "ing", "ra", "so")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = "this is the one benchmark passage that must not be in any training text"
    long = say(80)
    near = long.split(" ")
    near[40] = "changed"
    rows = [(0, long, "aa"), (1, say(50), None), (2, "123 456", "aa"), (3, None, "aa"), (4, "", "aa"), (5, say(20) + "\n" + passage, "aa"), (6, long, "aa"), (7, " ".join(near[:40]) + "\n" + " ".join(near[40:]), "aa"), (8, say(30) + "\n" + say(30), "aa"), (None, say(10), "aa")]
    rows += [(9, rows[8][1].split("\n")[0] + "\n" + say(12), "aa")]
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 2, 3 and 4 have no letter; 6 loses its only line; 7 differs from 0 in one word, over two lines that are not 0's; 5 leaks
    texts = dict((i, t) for i, t, _ in rows)
    texts[9] = texts[9].split("\n")[1]
    assert set(got) == {0, 1, 8, 9, None}
    pieces = load(open(corpus_pipeline.MODEL, "rb").read())
    for i, x in got.items():
        assert x["round_trip"] and x["ids"] == encode_text(" " + texts[i], pieces) and x["n_tokens"] == len(x["ids"])
    assert got[1]["lang"] == "aa"


def test_near_copies_from_four_fifths_go(spark):
    rows = []
    for first, words in ((10, 200), (20, 240), (30, 180)):
        text = [f"w{first}x{i}" for i in range(words)]
        near = list(text)
        for i in (20, 60, 100, 140):
            near[i] = f"changed{i}"
        rows += [(first, " ".join(text)), (first + 1, " ".join(near))]
    # four changed words touch twenty shingles: 176 of 216 is 0.815, 216 of 256 is 0.844, 156 of 196 is 0.796
    docs = spark.createDataFrame([(i, t, "aa", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.near_copies(spark, docs, "").collect()} == {10, 20, 30, 31}
