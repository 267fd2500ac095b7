"""Extra columns with the operators' own names, long conversations, hot groups and laws over all rows."""

import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import chat, decontamination, fingerprints, language_id, line_dedup, near_dedup, quality, sentence_pieces, sharding, url_filters

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NAMES = ["own", "body", "letter", "key", "part", "row", "id", "of", "gone", "found", "hash", "a", "line", "pos", "salt", "tail", "__text", "__letter", "__drop", "__key", "__row", "__id", "__of", "h", "x"]


def _odd(spark, n=6):
    rows = [(i, None if i == 3 else f"the text of number {i}\nand a line that all of them share", *[f"{name}{i}" for name in NAMES]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


def test_no_name_of_another_column_clashes(spark):
    docs = _odd(spark)
    bench = spark.createDataFrame([(1, "the text of number 2")], "item_id long, text string")
    made = [
        sentence_pieces.decode(sentence_pieces.encode(docs, MODEL, chunk=60), MODEL),
        language_id.predict(docs, (("en", b"the text of all"),)),
        line_dedup.dedup_lines(docs),
        decontamination.mark_documents(docs, bench),
        quality.score(docs, quality.fit(quality.np.zeros((0, 16)), quality.np.zeros(0))),
        url_filters.judge(docs.withColumn("url", F.lit("http://a.b/c")), url_filters.rules_frame(spark, [("B", "/", "block")])),
    ]
    for out in made:
        rows = out.collect()
        assert len(rows) == 6
        for r in rows:
            assert all(r[name] == f"{name}{r['doc_id']}" for name in NAMES)
    assert all(r["verdict"] == "block" and r["rule"] == "b/" for r in made[-1].collect())
    for out in (near_dedup.near_duplicates(docs), sharding.shard_documents(docs), fingerprints.edit_fingerprints(docs), decontamination.find_passages(docs, bench)):
        out.collect()


def test_a_conversation_of_very_many_turns(spark):
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|turn|> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    back = chat.read_back(chat.format_conversations(turns)).select(F.size("turns").alias("n"), "n_merged", F.element_at("turns", -1)["text"].alias("last")).first()
    assert (back["n"], back["n_merged"], back["last"]) == (100_000, 2 * 33_333 + 1, "<|turn|> 99999") and time.time() - began < 60


def test_a_conversation_of_one_role(spark):
    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("<|more|> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    back = chat.read_back(chat.format_conversations(turns)).select(F.size("turns").alias("n"), "n_merged", F.element_at("turns", -1)["text"].alias("last"), F.element_at("turns", 2)["loss"].alias("loss")).first()
    assert tuple(back) == (100_000, 1, "<|more|> 99999", True) and time.time() - began < 60


def test_a_host_of_very_many_labels(spark):
    began = time.time()
    pages = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "Example.com/en/7?x"), (2, "http://" + "x" * 300_000 + "com/en/"), (3, "https://.com/en/")], "page_id long, url string")
    got = url_filters.judge(pages, url_filters.rules_frame(spark, [("com", "/en/", "block"), ("example.com", "/en/7", "allow")])).select("page_id", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "example.com/en/7", "allow"), (2, None, "allow"), (3, "com/en/", "block")] and time.time() - began < 60


def test_shards_by_bytes_over_hot_groups(spark):
    r = random.Random(8)
    rows = [(i, "" if i % 3 == 0 else "hot text" if i % 3 == 1 else "w" * r.randrange(1, 400)) for i in range(6000)] + [(None, None)] * 900 + [(7, "one row again and again")] * 900
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes, slots, shards_of = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        shards_of[x["text_crc32"]].add(x["shard"])
    want = Counter((i, len(t or "") + 1) for i, t in rows)
    assert Counter((x["doc_id"], x["size"]) for x in got) == want
    share = sum(sizes.values()) / 16
    # a shard is off by at most half a group that is kept whole at each end
    assert set(sizes) == set(range(16)) and all(abs(n - share) <= share / 16 + 400 for n in sizes.values()), sizes
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = Counter()
    for x in got:
        by_text[x["text_crc32"]] += x["size"]
    assert all(len(s) == 1 for c, s in shards_of.items() if by_text[c] <= share / 64)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_boosting_matches_a_plain_form(spark):
    """The cyclic fit of main tables, step by step over rows instead of bins."""
    rng = quality.np.random.default_rng(3)
    x, y = rng.normal(size=(300, 2)), (rng.random(300) < 0.4).astype(float)
    model = quality.fit(x, y, rounds=3, pairs=0)
    bins, mean = model.bins(x), (y.sum() + 0.5) / (len(y) + 1)
    odds = quality.np.full(300, quality.np.log(mean / (1 - mean)))
    for _ in range(3):
        for f in range(2):
            p = 1 / (1 + quality.np.exp(-odds))
            leaves = [list(range(len(model.main[f])))]
            gain = lambda part: (sum((y - p)[i] for i in range(300) if bins[i, f] in part)) ** 2 / (sum((p * (1 - p))[i] for i in range(300) if bins[i, f] in part) + 1.0)  # noqa: E731, B023
            for _ in range(2):
                cuts = [(gain(leaf[:k]) + gain(leaf[k:]) - gain(leaf), j, k) for j, leaf in enumerate(leaves) for k in range(1, len(leaf))]
                best, j, k = max(cuts, key=lambda c: c[0])
                leaves[j : j + 1] = [leaves[j][:k], leaves[j][k:]]
            for leaf in leaves:
                rows = [i for i in range(300) if bins[i, f] in leaf]
                odds[rows] += 0.15 * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1.0)
    assert quality.np.allclose(model.score(x), 1 / (1 + quality.np.exp(-odds)))
