import hashlib
import re

import xxhash
from corpusforge.llm import order_minhash as omh
from messy import docs, empty, text_of
from pyspark.sql import functions as F

M = (1 << 64) - 1
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"


def long_hash(x, seed=42):
    return xxhash.xxh64_intdigest((x & M).to_bytes(8, "little"), seed)


def signed(x):
    x &= M
    return x - (1 << 64) if x >> 63 else x


def brute(text):
    words = []
    for run in re.findall(rf"[{UNSPACED}]|[^ \t\n\x0B\f\r{UNSPACED}]+", text or ""):
        words += [run] if len(run) <= omh.LONG else list(run)
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not hashes:
        return [0] * omh.SKETCHES
    if len(hashes) < omh.K:
        seed = 42
        for h in hashes:
            seed = long_hash(h, seed)
        kmers = [seed]
    else:
        kmers = [long_hash(b, long_hash(a)) for a, b in zip(hashes, hashes[1:])]
    seen, items = {}, []
    for place, k in enumerate(kmers):
        short = signed(k << 28) >> 28
        seen[short] = seen.get(short, 0) + 1
        h = xxhash.xxh64_intdigest(seen[short].to_bytes(4, "little"), long_hash(short))
        items.append((signed((h << 28 & M) | place), place, h & (1 << 36) - 1))
    items.sort()
    out = []
    for i in range(omh.SKETCHES):
        mark = -(1 << 63) + i * ((1 << 64) // omh.SKETCHES) | (1 << 28) - 1
        first = sum(x[0] < mark for x in items)
        picked = [(items + items[:omh.TUPLE])[first % (len(items) + 1) + j] if first + j < len(items) + omh.TUPLE else None
                  for j in range(min(omh.TUPLE, len(items)))]
        seed = 42
        for _, _, h in sorted(picked, key=lambda x: x[1]):
            seed = long_hash(h, seed)
        out.append(signed(seed))
    return out


def test_signatures_match_brute_force(spark):
    texts = [None, "", "one", "one two", "a a a a a a", "to be or not to be or not to be", text_of(1, 50), text_of(2, 700), " lead\ttrail\n",
             "日本語の文章を書く", "mixed 日本 and ไทย words", "x" * 24 + " " + "y" * 25 + "日" + "z" * 60, "é" * 24 + "\u3000" + "ñ" * 26, "\U00020001\U00020002a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["sig"] for r in rows.select("i", omh.signature(F.col("text")).alias("sig")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), texts[i]


def test_order_counts(spark):
    a, b = text_of(1, 400).split(), text_of(2, 400).split()
    swapped = b + a
    frame = spark.createDataFrame([(" ".join(a + b), " ".join(swapped), " ".join(b[::-1] + a[::-1]))], "x string, y string, z string")
    row = frame.select(*(omh.likeness(omh.signature(F.col("x")), omh.signature(F.col(c))).alias(c) for c in "xyz")).first()
    assert row["x"] == 1.0 and 0.2 < row["y"] < 0.9 and row["z"] < 0.1


def next_of(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [(r, ordered[(i + 1) % len(ordered)]) for i, r in enumerate(ordered)]


def edited(text, after):
    text, after = text or "", after or ""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def test_edits_meet_the_next_row_over_all_ranges(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    want = sorted((str(a[0]), len(a[1] or ""), hashlib.sha256(edited(a[1], b[1]).encode()).hexdigest()) for a, b in next_of(rows))
    got = omh.compare_edits(docs(spark)).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want


def test_sparse_keys(spark):
    rows = [(i * i * 10**11 - 5 * 10**15, text_of(i, 9)) for i in range(700)]
    got = omh.with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("_tail = 0").collect()
    assert {(r["key"], r["next_text"]) for r in got} == {(a[0], b[1]) for a, b in next_of(rows)} and len(got) == 700


def test_one_row_and_none(spark):
    one = omh.compare_edits(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one["edited"] == "abc " + "abc" and one["next_sig"] == one["sig"]
    assert omh.compare_edits(empty(spark)).count() == 0


def test_one_changed_character_where_no_spaces_are(spark):
    import random
    for lo, hi in ((0x4E00, 0x9FFF), (0x0E01, 0x0E2E), (0x61, 0x7A)):
        rng = random.Random(lo)
        text = "".join(chr(rng.randint(lo, hi)) for _ in range(1240))
        frame = spark.createDataFrame([(text, text[:600] + "~" + text[601:], text[::-1])], "x string, y string, z string")
        row = frame.select(*(omh.likeness(omh.signature(F.col("x")), omh.signature(F.col(c))).alias(c) for c in "yz")).first()
        assert row["y"] > 0.9 and row["z"] < 0.1


def test_keys_of_other_types_and_repeated_keys(spark):
    texts = [text_of(i, 9) for i in range(900)]
    for kind, keys in (("string", [f"https://site/{i * 7919 % 900:05d}" for i in range(900)]), ("double", [i * 1.5e-3 for i in range(900)]),
                       ("long", [7 if i % 3 else i for i in range(900)]), ("long", [None if i % 3 else i for i in range(900)]),
                       ("string", [None] * 900), ("long", [2**62 + i for i in range(899)] + [-5])):
        found = omh.with_next(spark.createDataFrame(list(zip(keys, texts)), f"doc_id {kind}, text string"))
        got, want = [(r["key"], r["text"], r["next_text"]) for r in found.where("_tail = 0").collect()], next_of(list(zip(keys, texts)))
        assert sorted(got, key=str) == sorted(((a[0], a[1], b[1]) for a, b in want), key=str)
        if keys[1] in (7, None):  # the rows of one key are no single range
            assert found.groupBy("_range").count().agg(F.max("count")).first()[0] < 300


def test_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(omh, "TASK_ROWS", 20)
    monkeypatch.setattr(omh, "KNOWN", 100)
    rows = [(i * 3, text_of(i, 5)) for i in range(1000)]
    found = omh.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.rdd.getNumPartitions() >= 50
    assert {(r["key"], r["next_text"]) for r in found.where("_tail = 0").collect()} == {(a[0], b[1]) for a, b in next_of(rows)}
