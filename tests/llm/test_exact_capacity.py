"""With a capacity, groups are packed by their exact sizes."""

from collections import Counter

from pyspark.sql import functions as F

from repliphase.llm import sharding


def shards(spark, sizes, capacity):
    docs = spark.createDataFrame([(k, chr(97 + k) * n) for k, n in enumerate(sizes)], "doc_id long, text string")
    found = sharding.shard(docs, overhead=0, capacity=capacity).groupBy("sh_shard").agg(F.sum("sh_size").alias("n")).collect()
    return sorted(r.n for r in found)


def test_a_group_of_just_the_capacity_fits(spark):
    assert shards(spark, [1_000_001], 1_000_001) == [1_000_001]


def test_rounding_costs_no_shard(spark):
    # 12 significant bits would make 100,001 and 100,003 into 100,032 and need three shards.
    assert shards(spark, [100_001, 100_003, 100_001, 100_003], 200_004) == [200_004, 200_004]


def test_even_shards_use_exact_sizes():
    # Rounded to 12 significant bits these would be 100,032 and 200,064.
    classes = [(100_001, 30), (200_002, 15)]
    loads = Counter()
    for size, name, count in sharding.pack_evenly(classes, 6):
        assert size in (100_001, 200_002)
        loads[name] += size * count
    assert sorted(loads.values()) == [1_000_010] * 6


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7, 8)], "doc_id long, text string, __mine long, sh_mine long, __KEY long, sh_slot long")
    (found,) = sharding.shard(docs, shards=2).collect()
    assert (found["__mine"], found["sh_mine"], found["__KEY"], found["sh_slot"]) == (5, 6, 7, 0)
