"""A shard's messages are folded in blocks, and the blocks' sizes change nothing."""

import random

from tidemark.streaming import topics


def test_blocks_give_what_one_fold_gives(spark):
    dice = random.Random(5)
    told, rows = [], []
    for i in range(400):
        shard = "ab"[dice.random() < 0.2]
        text = " ".join([f"topic{dice.randrange(4)}"] * 2 + [f"w{dice.randrange(4)}" for _ in range(8)])
        told.append((shard, 1_000 + i * 60, f"{i:04d}", text, f"c{dice.randrange(2)}"))
    df = spark.createDataFrame(told, "shard string, s long, id string, title string, channel string")
    df = df.selectExpr("shard", "timestamp_seconds(s) as ts", "'signal' as kind", "id", "title", "channel", "cast(null as long) as until")
    for name in "ab":
        shard = topics.Shard(topics.RULES, most=5)
        for _, s, ident, title, channel in (m for m in told if m[0] == name):
            rows += [(name, *e) for e in shard.apply(s, "signal", ident, title, channel)]
        rows += [(name, *e) for e in shard.advance(60_000)]
    for lead in (0, 20):
        got = topics.topic_table(df, upto=60_000, rows_a_block=60, lead=lead, most=5)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_a_task_folds_a_block_of_a_shard(spark):
    df = spark.range(300).selectExpr("'a' as shard", "timestamp_seconds(id * 60) as ts", "'signal' as kind", "lpad(cast(id as string), 4, '0') as id", "concat('m', id) as title", "'' as channel", "cast(null as long) as until")
    cut = topics._blocks(df, 6, 10).where("part = 2").groupBy("block").count().collect()
    assert len(cut) > 3 and max(r["count"] for r in cut) < 150
