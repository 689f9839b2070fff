"""Table functions with state, and running sums in ranges."""

import random

from pyspark.sql import functions as F

from gaugeframe.operators import batching, expanders, reshape

CONV = "conv_id long, turn int, role string, text string, turns string"


def test_segments_carry_on_from_turn_to_turn(spark):
    rows = [(1, 1, "assistant", "yes<image> ok ", "x"), (1, 0, "user", "é<image><image>  ", "x"), (2, 0, "user", None, "x"), (None, 0, "assistant", "<image>", "x"), (1, 1, "assistant", "yes<image> ok ", "x")]
    table = spark.createDataFrame(rows, CONV)
    got = expanders.numbered_segments(table)
    own = sorted((r.ordinal, r.kind, r.value, r.chars_before) for r in got.where("conv_id = 1").collect())
    texts = [(0, "text", "é", 0), (1, "image", None, 1), (2, "image", None, 1), (3, "text", "yes", 1), (4, "image", None, 4), (5, "text", " ok ", 4), (6, "text", "yes", 8), (7, "image", None, 11), (8, "text", " ok ", 11)]
    assert own == texts
    plain = batching.segments(table)
    key = lambda d: sorted(map(repr, d.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("position").cast("int").alias("position"), "kind", "value", "loss").collect()))
    assert key(got) == key(plain)
    assert expanders.numbered_segments(table.limit(0)).count() == 0
    table.createOrReplaceTempView("talks")
    expanders.register(spark)
    again = spark.sql("SELECT conv_id, turn, position, kind, value, loss FROM numbered_segments(TABLE(SELECT CAST(conv_id AS BIGINT) conv_id, turn, role, text FROM talks) PARTITION BY conv_id ORDER BY (turn, role, text))")
    assert key(again) == key(plain)


def test_running_sums_over_many_buckets(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(-5, 9)) for i in range(3000)]
    got = reshape.offset_running_sum(spark.createDataFrame(rows, "i long, v long").repartition(9), F.when(F.col("i") >= 10, F.floor(F.col("i") / 10)), ["i"], F.col("v"), "s")
    total, want = 0, []
    for i, v in rows:
        total += v
        want.append((i, v, total))
    assert sorted(map(tuple, got.collect())) == want
