"""BPE against the library whose files it reads, round trips, and the lookahead against all short texts."""

import itertools
import json
import random

import pytest
from corpusforge.llm import bpe
from corpusforge.llm.queries import op12_bpe, tokenizer_path
from messy import docs, empty
from tokenizers import Tokenizer

PATH = tokenizer_path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts():
    rng = random.Random(4)
    yield from ("", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "I'll we've it's 'S", "tabs\t\t and\r\n\r\n  lines  ", "日本語 한국어 ไทย 👩‍👩‍👧", "x" * 30_000)
    for letters in ("ab", "aeiot", "-=", "  \n\t", "日本語é", "etaoin shrdlu", "0123456789", "thestrngi"):
        for n in (7, 60, 700, 9_000):
            yield "".join(rng.choice(letters) for _ in range(n))
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x300), rng.randrange(0x2000, 0xD000), rng.randrange(0x1F000, 0x20000)])) for _ in range(30))


def test_as_the_library(model, library):
    encoder, decoder = bpe.Encoder(model), bpe.Decoder(model)
    for text in some_texts():
        ids = list(encoder.ids(text))
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:50]
        assert decoder.text(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decodes_any_ids(model, library):
    rng, decoder = random.Random(7), bpe.Decoder(model)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(256), 60_000]) for _ in range(rng.randrange(40))]
        assert decoder.text(ids) == library.decode(ids, skip_special_tokens=False)


def test_streams_in_bounded_memory(model):
    rng = random.Random(8)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000)).encode()
    stream, got, most = bpe.Transducer(model), [], 0
    for at in range(0, len(text), 1000):
        got += stream.feed(text[at:at + 1000])
        most = max(most, len(stream.open))
    assert most <= model.reach + bpe.STEP + 1000 and got + list(stream.finish()) == bpe.Transducer(model).merge(text)


def small_model(merges):
    parts = {bytes([b]): b for b in range(256)}
    for i, (u, v) in enumerate(merges):
        parts[u + v] = 256 + i
    return bpe.Model(tuple(range(256)), {(parts[u], parts[v]): i for i, (u, v) in enumerate(merges)}, tuple(range(256, 256 + len(merges))),
                     tuple(parts), (), bpe.lookahead(merges))


def test_lookahead_holds_for_all_short_texts():
    """For random merge lists: tokens that end before the lookahead are the same whatever follows."""
    rng = random.Random(9)
    for _ in range(25):
        made, merges = [b"a", b"b", b"c"], []
        while len(merges) < 5:
            u, v = rng.choice(made), rng.choice(made)
            if u + v not in made:
                merges.append((u, v))
                made.append(u + v)
        m = small_model(merges)
        t = bpe.Transducer(m)

        def ends(text, t=t, m=m):
            return set(itertools.accumulate(len(m.spelled[i]) for i in t.merge(text)))

        for n in range(1, 6):
            for text in map(bytes, itertools.product(b"abc", repeat=n)):
                sure = {e for e in ends(text) if e < n - m.reach}
                for more in (b"a", b"b", b"c", b"ab", b"ba", b"cab", b"bbb"):
                    assert sure == {e for e in ends(text + more) if e < n - m.reach}


def test_lookahead_wants_proper_merges():
    for merges in ([(b"ab", b"c")], [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"bc")]):
        with pytest.raises(ValueError):
            bpe.lookahead(merges)


def test_long_runs_merge_alike(model):
    rng, t = random.Random(10), bpe.Transducer(model)
    for letters in ("ab", "aeiou", "xyz", "the "):
        text = "".join(rng.choice(letters) for _ in range(bpe.LONG - 1)).encode()
        ids = [model.single[b] for b in text]
        assert t.merge_long(list(ids), [model.pairs.get(p, bpe.NEVER) for p in itertools.pairwise(ids)]) == t.merge(text)


def test_other_files_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for path in (str(tmp_path / "t.json"), tokenizer_path("word_bpe_49k.json")):
        with pytest.raises(ValueError):
            bpe.load(path)


def test_hard_rows(spark, library):
    df = docs(spark).selectExpr("*", "1 AS ids", "2 AS _text", "3 AS decoded", "4 AS made")
    got = bpe.decode(bpe.encode(df, PATH), PATH)
    assert set(got.columns) == set(df.columns)
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "")
    assert bpe.encode(empty(spark), PATH).count() == 0
    odd = bpe.decode(spark.createDataFrame([(None,), ([],), ([None, 72, 999_999, -1],)], "ids array<int>"), PATH).collect()
    assert [r["decoded"] for r in odd] == ["", "", library.decode([72])]


def test_query(spark, library):
    from hashlib import sha256
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in op12_bpe(spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
