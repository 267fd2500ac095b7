import zlib

import pandas as pd

from tilewright.llm.sharding import shard_documents


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


def test_shards_are_even_gapless_and_keep_small_groups_together(spark):
    rows = [(i, f"{i // 3} " + "w" * (i // 3 * 37 % 400 + 1), "clash") for i in range(3000)]
    rows += [(None, None, None), (7, "twice", "x"), (7, "twice", "x"), (9001, "", None), (9002, "ünïcode ✓", None)]
    out = shard_documents(_docs(spark, rows)).toPandas()
    assert len(out) == len(rows) and set(out.columns) == {"doc_id", "size", "text_crc32", "shard", "slot"}
    want = pd.DataFrame([(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows], columns=["size", "crc"])
    assert sorted(out["size"]) == sorted(want["size"]) and sorted(out["text_crc32"]) == sorted(want["crc"])
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.15 * sums.mean()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert out.groupby("text_crc32")["shard"].nunique().max() == 1


def test_a_third_of_all_rows_in_one_group_is_split(spark):
    rows = [(i, "the same text " * 5 if i % 3 == 0 else f"own text number {i} " * 4, None) for i in range(4000)]
    out = shard_documents(_docs(spark, rows)).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() / sums.min() < 1.15 and len(out) == 4000


def test_empty_and_tiny_tables(spark):
    assert shard_documents(_docs(spark, [])).count() == 0
    one = shard_documents(_docs(spark, [(1, None, None)])).collect()
    assert len(one) == 1 and one[0]["slot"] == 0 and one[0]["size"] == 1
