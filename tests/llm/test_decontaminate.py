import random

from corpusforge.llm import decontaminate as dec
from messy import docs, empty, text_of
from pyspark.sql import functions as F


def brute_tiling(item, doc, least):
    """Textbook greedy string tiling: the longest unmarked match, the earliest of equals, again and again."""
    least = min(least, len(item))
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        a[i:i + n], b[j:j + n] = [True] * n, [True] * n
        tiles.append(best)
    return tiles


def test_tiling_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        words = [bytes([97 + k]) for k in range(rng.choice([2, 4, 9]))]
        item, doc = [rng.choice(words) for _ in range(rng.randint(0, 14))], [rng.choice(words) for _ in range(rng.randint(0, 25))]
        got, want = dec.tiling(item, doc, 3), brute_tiling(item, doc, 3)
        assert sum(t[0] for t in got) == sum(t[0] for t in want) and [t[0] for t in got] == [t[0] for t in want]
        assert len({x for n, i, _ in got for x in range(i, i + n)}) == sum(t[0] for t in got)
        assert all(item[i:i + n] == doc[j:j + n] for n, i, j in got)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("_hash", F.lit(1)).withColumn("n", F.lit(2))


def test_finds_copies_reordered_passages_and_marked_up_text(spark):
    items = [(i, text_of(1000 + i, 40)) for i in range(6)]
    words = [t.split() for _, t in items]
    filler = text_of(1, 900)
    shuffled = " ".join(words[1][20:] + ["between", "them"] + words[1][:20])
    half = " ".join(words[2][:20])
    loud = "".join(w.upper() + "!! " for w in words[3])
    rows = [(1, filler + " " + items[0][1] + " " + filler), (2, filler + " " + shuffled), (3, half + " " + filler), (4, loud), (5, filler),
            (6, items[4][1] + " " + items[5][1]), (6, items[4][1] + " " + items[5][1]), (None, items[0][1])]
    found, clean = dec.search(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items))
    got = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 3), (6, 4), (6, 5), (None, 0)}
    assert got[1, 0]["coverage"] == 1.0 and got[2, 1]["coverage"] == 1.0 and got[2, 1]["n_tiles"] == 2
    assert sorted(r["doc_id"] for r in clean().collect()) == [3, 5]


def test_equals_testing_every_pair_on_the_small_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found, clean = dec.search(d, b)
    items = [(r["item_id"], dec.tokens(r["text"])) for r in b.collect()]
    want = set()
    for r in d.collect():
        words = dec.tokens(r["text"])
        for i, item in items:
            if item and sum(t[0] for t in dec.tiling(item, words)) >= 0.8 * len(item):
                want.add((r["doc_id"], i))
    assert want and {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert {r["doc_id"] for r in clean().collect()} == {r["doc_id"] for r in d.collect()} - {i for i, _ in want}


def test_hard_rows_short_items_and_empty_tables(spark):
    items = [(1, "word"), (2, None), (3, ""), (None, "no id here at all"), (5, "--- !!"), (1, "word")]
    found, clean = dec.search(docs(spark), bench(spark, items))
    assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == [(104, 1), (None, None)]
    assert clean().count() == docs(spark).count() - 2 and clean().columns == docs(spark).columns
    found, clean = dec.search(empty(spark), bench(spark, items))
    assert found.count() == 0 and clean().count() == 0
    found, clean = dec.search(docs(spark, False), bench(spark, []))
    assert found.count() == 0 and clean().count() == docs(spark).count()


def test_finds_items_with_every_fifth_word_changed_and_reordered_pieces(spark):
    items = [(i, text_of(2000 + i, 40)) for i in range(3)] + [(3, "again and " * 20)]
    words = [t.split() for _, t in items]
    pieces = [words[1][i:i + 4] for i in range(0, 40, 4)]
    rows = [(0, " ".join(w if i % 5 else "changed" for i, w in enumerate(words[0]))),
            (1, " ".join(w for k, p in enumerate(pieces[::-1]) for w in [*p, f"gap{k}"])),
            (2, " ".join(words[2][:30])), (3, items[3][1])]
    found, clean = dec.search(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items))
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in found.collect()}
    assert got == {(0, 0): 0.8, (1, 1): 1.0, (3, 3): 1.0} and [r["doc_id"] for r in clean().collect()] == [2]


def test_no_covered_item_shares_fewer_seeds_than_it_needs():
    rng = random.Random(3)
    for _ in range(2000):
        words = [bytes([97 + k]) for k in range(rng.choice([1, 2, 3, 9]))]
        item, doc = [rng.choice(words) for _ in range(rng.randint(1, 14))], [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if sum(t[0] for t in dec.tiling(item, doc)) / len(item) >= 0.8:
            length = [min(3, len(item))]
            assert len(set(dec.seeds(item, length)) & set(dec.seeds(doc, length))) >= dec.needed(item, 3, 0.8)


def test_tokens_of_any_script_and_spacing():
    assert dec.tokens("Don't stop_now 42") == [b"don", b"t", b"stop", b"now", b"42"]
    plain = dec.tokens("the \"quick\" fox - it's 3 o'clock, isn't it caf\u00e9")
    assert plain == dec.tokens("the\u00a0\u201cquick\u201d\u2003fox\u2014it\u2019s \uff13 o\u2019clock\uff0cisn\u2019t\u3000it cafe\u0301")
    assert dec.tokens("bench\u00admark") == [b"benchmark"]
    assert dec.tokens("\u6f22\u5b57\u3068\u30ab\u30ca\u3002ab") == [c.encode() for c in "\u6f22\u5b57\u3068\u30ab\u30ca"] + [b"ab"]
    assert dec.tokens("\u0939\u093f\u0928\u094d\u0926\u0940 \u0436\u0438\u0437\u043d\u044c") == ["\u0939\u093f\u0928\u094d\u0926\u0940".encode(), "\u0436\u0438\u0437\u043d\u044c".encode()]
    assert len(dec.tokens("\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22")) == 7
    assert dec.tokens("\u201c\u2014\u2026\u3002\uff01") == []


def test_finds_items_behind_wide_spaces_and_inside_unspaced_text(spark):
    latin = text_of(3000, 30).split()
    chinese = "".join(chr(0x4E00 + (k * 7919) % 5000) for k in range(40))
    rows = [(0, "\u00a0".join(f"\u201c{w}\u201d" for w in latin)), (1, "\u524d\u6587" + chinese + "\u540e\u6587"), (2, chinese[:20])]
    found, clean = dec.search(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, [(0, " ".join(latin)), (1, chinese)]))
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in found.collect()} == {(0, 0): 1.0, (1, 1): 1.0}
    assert [r["doc_id"] for r in clean().collect()] == [2]
