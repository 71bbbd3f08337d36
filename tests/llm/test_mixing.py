import hashlib
import heapq
import math
import re
from collections import defaultdict

from corpusforge.llm import mixing
from messy import docs, empty

B = mixing.BLOCK


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    keys = sorted(sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, left, open_ = {}, sum(sizes.values()), set(keys)
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * level > cap * sizes[k]}
        if not over:
            target |= {k: weight[k] * level for k in open_}
            break
        for k in over:
            target[k] = cap * sizes[k]
            left -= cap * sizes[k]
        open_ -= over
    return target


def brute_quotas(target, sizes, n, cap=3):
    won, heap = dict.fromkeys(target, 0), [(-t, k) for k, t in target.items()]
    heapq.heapify(heap)
    for _ in range(n):
        while heap:
            _, k = heapq.heappop(heap)
            if won[k] < cap * math.ceil(sizes[k] / B):
                won[k] += 1
                heapq.heappush(heap, (-target[k] / (2 * won[k] + 1), k))
                break
    return won


def brute_shards(target, sizes, n, shards, cap=3):
    """Quota of each source in each shard: its seats among the shard's blocks, moved on where they are more than its own
    blocks there can give."""
    upto = [brute_quotas(target, sizes, n * s // shards) for s in range(shards + 1)]
    out = {}
    for k in target:
        blocks = math.ceil(sizes[k] / B)
        first = int(md5("mix:turn:" + k)[:8], 16)
        own = [[b for b in range(blocks) if b % shards == (s - first) % shards] for s in range(shards)]
        due, late = [upto[s + 1][k] - upto[s][k] for s in range(shards)], 0
        got = [0] * shards
        for s in [*range(shards), *range(shards)]:
            late, due[s] = late + due[s], 0
            give = min(late, cap * len(own[s]) - got[s])
            got[s], late = got[s] + give, late - give
        assert late == 0
        out[k] = list(zip(own, got))
    return out


def brute_mix(rows, shards=mixing.SHARDS):
    """Lists every block of every source."""
    sized = [(i, r[0], ("1" if r[3] is None else "0" + r[3]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for i, r in enumerate(rows)]
    sizes = defaultdict(int)
    for _, _, k, n in sized:
        sizes[k] += n
    target = brute_targets(sizes)
    dealt = brute_shards(target, sizes, math.floor((2 * sum(target.values()) + B) / (2 * B)), shards)
    out = []
    for k in sizes:
        taken = []  # for each shard, how often it takes each of its blocks
        for s, (own, quota) in enumerate(dealt[k]):
            m = max(1, len(own))
            rest, offset = quota % m, int(md5(f"mix:blocks:{k}:{s}")[:8], 16) % m
            times = {b: quota // m + ((j + 1) * rest + offset) // m - (j * rest + offset) // m for j, b in enumerate(own)}
            assert sum(times.values()) == quota and all(x <= 3 for x in times.values())
            taken.append(times)
        mine = sorted((math.floor(math.log2(n + 1.0) * 8), md5("mix:" + ("null" if d is None else str(d))), n, d is not None, d or 0, i)
                      for i, d, key, n in sized if key == k)
        at = 0
        for _, _, n, _, _, i in mine:
            parts = [sum(times.get(w // B, 0) for w in range(at, at + n)) for times in taken]
            out.append((rows[i][0], n, sizes[k], round(target[k], 6), sum(parts), parts))
            at += n
    return out


def test_matches_listing_every_block(spark):
    rows = [tuple(r)[:5] for r in docs(spark, False).collect()]
    for shards in (mixing.SHARDS, 1, 64):
        got = mixing.mix(docs(spark), shards=shards).collect()
        assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["by_shard"]) for r in got),
                      key=str) == sorted(brute_mix(rows, shards), key=str)
    assert all(0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3 for r in got)


def test_quotas_of_shards_add_up_and_follow_the_targets(spark):
    sizes = {f"0s{i:02d}": 1000 * (i * i + 1) for i in range(30)} | {"1": 7}
    aims = mixing.targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long"), (5, 2, 1), 3)
    target = {r["key"]: r["target"] for r in aims.collect()}
    want = brute_targets(sizes)
    assert all(abs(target[k] - want[k]) < 1e-6 * max(1, want[k]) for k in sizes)
    rows = mixing.quotas(aims, shards=8).collect()
    n = math.floor((2 * sum(target.values()) + B) / (2 * B))
    assert all(r["quota"] >= 0 for r in rows)
    total = defaultdict(int)
    for r in rows:
        total[r["key"]] += r["quota"]
    assert dict(total) == brute_quotas(target, sizes, n)
    per_shard = [sum(r["quota"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(per_shard) - min(per_shard) <= 1


def test_shards_choose_their_own_quotas(spark):
    """The number of shards changes which blocks are taken, not how many; each shard takes its quota of blocks."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = ({r["doc_id"]: r for r in mixing.mix(table, shards=n).collect()} for n in (1, 64))
    assert sum(r["taken"] != many[d]["taken"] for d, r in few.items()) > len(few) / 4
    for key in {r["source"] for r in few.values()}:
        one, other = (sum(r["taken"] for r in rows.values() if r["source"] == key) for rows in (few, many))
        assert abs(one - other) <= 3 * B
    loads = [sum(r["by_shard"][s] for r in many.values()) for s in range(64)]
    assert sum(loads) == sum(r["taken"] for r in many.values()) and max(loads) - min(loads) <= 12 * B


def test_taken_and_copies_come_near_the_targets(spark):
    from pyspark.sql import functions as F
    found = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                         F.sum(F.col("copies") * F.col("size")).alias("whole")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * B and abs(r["whole"] / r["target"] - 1) < 0.05


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
