import random
import re

import xxhash
from corpusforge.llm import simhash
from corpusforge.llm.components import connected
from messy import docs, empty
from pyspark.sql import functions as F


def brute_fingerprint(text, k=3):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(values, distance=2):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_brute_force(spark):
    for r in docs(spark, False).collect():
        assert simhash.fingerprint(r["text"]) == brute_fingerprint(r["text"])


def test_spark_and_python_hash_alike(spark):
    row = spark.createDataFrame([("a b ç",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] == signed(xxhash.xxh64_intdigest("a b ç".encode(), 42))


def check_links(spark, values, **how):
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in connected(simhash.links(frame, **how)).collect()}
    want = brute_groups(values, how.get("distance", 2))
    assert all(got.get(v, v) == want[v] for v in values)


def near_values(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains of small steps
            out.add(signed(base))
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_match_brute_force(spark):
    check_links(spark, near_values(400, 1))
    check_links(spark, near_values(200, 2), distance=1, blocks=3)


def test_crowded_blocks_give_the_same_groups(spark):
    check_links(spark, near_values(400, 3), full=1)
    check_links(spark, near_values(200, 4), full=1, distance=1)
    rng = random.Random(5)  # one block of many values that differ in a few low bits
    base = rng.getrandbits(64)
    crowd = sorted({signed(base ^ rng.getrandbits(14)) for _ in range(300)})
    check_links(spark, crowd, full=8)


def test_near_duplicates_of_hard_rows(spark):
    got = simhash.near_duplicates(docs(spark).withColumn("copy", F.col("text")), carry=["copy"]).collect()
    assert len(got) == docs(spark).count()
    want = brute_groups(sorted({signed(brute_fingerprint(r["copy"])) for r in got}))
    low = {}
    for r in got:
        assert r["fp"] == signed(brute_fingerprint(r["copy"]))
        if r["doc_id"] is not None:
            low[want[r["fp"]]] = min(r["doc_id"], low.get(want[r["fp"]], r["doc_id"]))
    assert all(r["component_id"] == low.get(want[r["fp"]]) and r["group_fp"] == want[r["fp"]] for r in got)


def test_keep_one_keeps_one_row_of_each_group(spark):
    df = docs(spark, False)
    kept = simhash.keep_one(df).collect()
    values = {(r["doc_id"], r["text"]): signed(brute_fingerprint(r["text"])) for r in df.collect()}
    group = brute_groups(sorted(set(values.values())))
    groups = [group[values[r["doc_id"], r["text"]]] for r in kept]
    assert sorted(groups) == sorted(set(group.values()))
    for r, g in zip(kept, groups):
        ids = [i for (i, t), v in values.items() if group[v] == g and i is not None]
        assert r["doc_id"] == (min(ids) if ids else None)


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
