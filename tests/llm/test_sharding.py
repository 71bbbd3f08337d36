import hashlib
import math
from collections import Counter

from corpusforge.llm import sharding
from messy import docs, empty


def brute(key, weights):
    def cost(s):
        u = (int(hashlib.md5(f"shard:{s}:{'null' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[s]
    return min(range(len(weights)), key=cost)


def test_matches_brute_force_and_numbers_without_gaps(spark):
    weights = [1.0, 2.0, 1.0, 4.0]
    got = sharding.assign(docs(spark), weights, "doc_id", ["text"], ["text"], grown_weight=1.5).collect()
    assert len(got) == docs(spark).count()
    for r in got:
        assert r["shard"] == brute(r["doc_id"], weights)
        assert r["grown_shard"] == brute(r["doc_id"], [*weights, 1.5]) and r["grown_shard"] in (r["shard"], 4)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_weights_set_the_shares_and_growth_moves_only_to_the_new_shard(spark):
    got = sharding.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), [1.0, 3.0], grown_weight=1.0).collect()
    count = Counter(r["shard"] for r in got)
    assert abs(count[1] / 20000 - 0.75) < 0.02
    assert abs(sum(r["grown_shard"] == 2 for r in got) / 20000 - 0.2) < 0.02
    assert all(r["grown_shard"] in (2, r["shard"]) for r in got)


def test_empty(spark):
    assert sharding.assign(empty(spark), [1.0] * 3).count() == 0


def test_reruns_agree_on_any_partitioning(spark):
    a = sharding.assign(docs(spark, False), [1.0] * 4, "doc_id", ["text"], ["text"])
    b = sharding.assign(docs(spark, False).repartition(7), [1.0] * 4, "doc_id", ["text"], ["text"])
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
