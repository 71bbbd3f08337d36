import pytest
from corpusforge.llm import langid, quality, toxicity
from corpusforge.llm.common import fold
from corpusforge.llm.queries import op6_toxicity, op7_langid, op10_quality
from messy import docs, empty
from pyspark.sql import functions as F

BIG = "/root/testdata/sf0.1"


def held_out(spark, found, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    return found.where("held_out").join(labels, "doc_id").where(F.col(column).isNotNull()).select("predicted", F.col(column).alias("label"), "score").collect()


def test_toxicity_on_held_out_labels(spark):
    found = op6_toxicity(spark, BIG).cache()
    rows = held_out(spark, found, "toxic")
    assert sum(r["predicted"] == r["label"] for r in rows) / len(rows) > 0.97
    assert sum(r["predicted"] for r in rows if r["label"]) / sum(r["label"] for r in rows) > 0.8
    assert found.where("score < 0 or score > 1 or predicted != int(score >= 0.5)").count() == 0 and found.count() == 10000


def test_quality_on_held_out_labels(spark):
    found = op10_quality(spark, BIG).cache()
    rows = held_out(spark, found, "quality")
    assert sum(r["predicted"] == r["label"] for r in rows) / len(rows) > 0.95
    assert found.where("score < 0 or score > 1 or predicted != int(score >= 0.7)").count() == 0 and found.count() == 10000


def test_language_on_held_out_rows(spark):
    found = op7_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98


def model_of(pairs, langs):
    import numpy as np
    tags, grams, counts = [], [], []
    for lang, text in pairs:
        words = langid.words_of(text)
        own = np.zeros((1 << langid.BITS) + len(langid.NAMES), int)
        for row in words.grams:
            own[:1 << langid.BITS] += np.bincount(row, minlength=1 << langid.BITS)
        codes = langid.scripts_of(np.array([ord(c) for c in words.text if c.isalpha()]))
        own[1 << langid.BITS:] += np.bincount(codes[codes >= 0], minlength=len(langid.NAMES))
        used = np.flatnonzero(own)
        tags += [lang] * len(used)
        grams.append(used)
        counts.append(own[used])
    return langid.learn(tags, np.concatenate(grams), np.concatenate(counts))


EN = "the house is on the hill and that was for the thing which they would have had with all of this "
DE = "der mann und die frau sind nicht auf einer straße mit den kindern sondern haben sich das haus gekauft "
RU = "дом стоит на холме и это было для вещей которые они имели со всем этим "


def test_spans_of_mixed_text_and_scripts():
    model = model_of([("en", EN * 5), ("de", DE * 5), ("ru", RU * 5)], None)
    lang, share, spans = langid.label(EN * 2 + DE + RU, model)
    assert lang == "en" and 0 < share < 1 and [s[2] for s in spans] == ["en", "de", "ru"]
    text = EN * 2 + DE + RU
    assert text[spans[0][0]:spans[0][1]] == (EN * 2).strip() and text[spans[2][0]:spans[2][1]] == RU.strip()
    assert langid.label("ПРИВЕТ", model)[0] == "ru"


def words_in(text):
    words = langid.words_of(text)
    return bytes(words.data.astype("uint8")).decode().split()


def test_words_are_runs_of_letters_of_one_script():
    cases = {"hello\u00a0monde": ["hello", "monde"], "“quoted” – it’s": ["quoted", "it", "s"], "你好world": ["你好", "world"], "日本の家 x": ["日本の家", "x"],
             "e\u0301te\u0301 naïve": ["e\u0301te\u0301", "naïve"], "हिन्दी,भाषा।": ["हिन्दी", "भाषा"], "приветHi5世": ["привет", "hi", "世"], "، !": []}
    for text, want in cases.items():
        assert words_in(text) == want, text


def test_scripts_are_told_apart():
    import unicodedata
    for name, c in {"Telugu": "త", "Kannada": "ಕ", "Malayalam": "മ", "Gujarati": "ગ", "Gurmukhi": "ਗ", "Khmer": "ខ", "Ethiopic": "አ", "Lao": "ລ", "Myanmar": "မ",
                    "Sinhala": "ස", "Thaana": "ހ", "Syriac": "ܐ"}.items():
        assert unicodedata.name(c).startswith(name.upper())
        assert langid.NAMES[langid.scripts_of(langid.np.array([ord(c)]))[0]] == name
    assert (langid.STARTS[1:] > langid.LAST[:-1]).all()


def test_a_switch_inside_a_run_and_letters_as_score():
    model = model_of([("en", EN * 5), ("ru", RU * 5), ("zh", "你好世界我们在这里看书写字" * 20)], None)
    text = EN.strip() + "我们在这里看书" + EN.strip()
    _, share, spans = langid.label(text, model)
    assert [text[a:b] for a, b, lang in spans if lang == "zh"] == ["我们在这里看书"]
    letters = sum(map(str.isalpha, text))
    assert abs(share - (letters - 7) / letters) < 1e-9


def test_all_languages_are_learnt(spark, monkeypatch):
    import random
    rng, rows = random.Random(4), []
    names = [f"l{i:03d}" for i in range(300)]
    for i, name in enumerate(names):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(i * 10 + j, " ".join(rng.choice(words) for _ in range(40)), name) for j in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for cells in (langid.CELLS, 300 << 12):
        monkeypatch.setattr(langid, "CELLS", cells)
        model = langid.fit(frame, F.lit(True))
        assert list(model.languages) == names and model.table.size <= cells
        found = langid.predict(frame, model).join(frame, "doc_id")
        assert found.where("lang_pred = lang").count() == len(rows)


def test_sample_of_a_language_with_most_rows(spark):
    """The texts learnt from are the first by hash, however many rows a language has."""
    import hashlib
    rows = [(i, f"w{i}a", "en" if i % 50 else "de") for i in range(3000)]
    place = lambda i: hashlib.md5(f"langid:{i}".encode()).hexdigest()
    first = sorted((i for i, _, lang in rows if lang == "en"), key=place)[:5] + sorted((i for i, _, lang in rows if lang == "de"), key=place)[:5]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit(frame, F.lit(True), per_language=5)
    want = langid.fit(frame.where(F.col("doc_id").isin(first)), F.lit(True))
    assert (got.table == want.table).all()


def test_short_cut_of_viterbi_gives_the_best_path():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(0, 4, (6, 3))
        value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 5.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(map(value, itertools.product(range(3), repeat=6)))
        assert abs(value(langid.viterbi(scores, 5.0).tolist()) - best) < 1e-9


def test_hard_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (7, None, None), (7, 0, 0), (100, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    n, keep = docs(spark).count(), fold(F.col("doc_id"), 4) != 2
    for module in (toxicity, quality):
        model = module.fit(docs(spark), labels, keep)
        got = module.score(docs(spark), model)
        assert got.count() == n and got.where("score is null or score < 0 or score > 1").count() == 0
        assert module.score(empty(spark), model).count() == 0
        module.score(docs(spark), module.fit(empty(spark), labels.limit(0), keep)).count()
    got = langid.predict(docs(spark), langid.fit(docs(spark), keep))
    assert got.count() == n and got.where("lang_pred is null or score is null").count() == 0
    assert {r["lang_pred"] for r in got.where("doc_id in (100, 101, 102)").collect()} == {"und"}
    assert langid.predict(docs(spark), langid.fit(empty(spark), keep)).where("lang_pred != 'und'").count() == 0
    assert toxicity.score(docs(spark), toxicity.fit(docs(spark), labels, keep)).columns.count("score") == 1


def test_models_do_not_depend_on_partitioning(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    keep = fold(F.col("doc_id"), 5) != 0
    a, b = toxicity.fit(d, labels, keep), toxicity.fit(d.repartition(5), labels.repartition(3), keep)
    assert a.intercept == b.intercept and (a.weights == b.weights).all() and (a.place == b.place).all()
    assert quality.fit(d, labels, keep) == quality.fit(d.repartition(5), labels.repartition(3), keep)


@pytest.mark.parametrize("text", ["", None, "x", "é" * 5])
def test_scores_of_tiny_texts(text):
    assert len(toxicity.features(text)) <= 20
    assert -1 < quality.Compressors(b"abc", b"def").difference(text) < 1


def test_quality_reads_labelled_texts_beyond_their_opening():
    import random
    rng = random.Random(1)
    vocabulary = {label: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(400)] for label in (0, 1)}
    header = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3000))
    rows = [(label, header + " ".join(rng.choices(vocabulary[label], k=300))) for _ in range(600) for label in (0, 1)]
    model = quality.fit_rows(rows, {0: 600, 1: 600})
    assert len(model.good) <= quality.DICT_BYTES and len(model.bad) <= quality.DICT_BYTES
    both = quality.Compressors(model.good, model.bad)
    for label in (0, 1):
        lead = both.difference(" ".join(rng.choices(vocabulary[label], k=300)))
        assert (lead > 0.02) if label else (lead < -0.02)


def test_quality_dictionaries_reach_the_end_of_long_texts():
    import random
    rng = random.Random(2)
    good, bad, text = ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (400_000, 400_000, 6_000_000))
    both = quality.Compressors(good.encode(), bad.encode())
    plain, ended = both.difference(text), both.difference(text + good)
    assert abs(plain) < 1e-3 and ended > 0.02


def test_quality_dictionaries_are_made_alike():
    import random
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    many, few = ([" ".join(rng.choices(words, k=200)) for _ in range(n)] for n in (900, 250))
    good, bad = quality.dictionaries(many, few)
    magic = (0xEC30A437).to_bytes(4, "little")
    assert good[:4] == bad[:4] == magic and 0.8 < len(good) / len(bad) < 1.25  # both trained, to one size
    for one, other in ((["the same line " * 100] * 2000, few), (["x" * 3_000_000], few), (["", ""], few), ([], [])):
        pair = quality.dictionaries(one, other)
        assert all(0 < len(d) <= quality.DICT_BYTES for d in pair) and pair[0][:4] == magic or pair[1][:4] != magic
    assert quality.raw([b"abc", b"abc", b"x" * 50, b"de"], 12) == b" \nabc\nde"  # whole texts only


def test_quality_score_against_a_plain_program(spark):
    """Difference and curve worked out text by text with the library alone."""
    import math

    import zstandard
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, labels, fold(F.col("doc_id"), 4) != 2)
    size = {}
    for row in d.select("doc_id", "text").limit(60).collect():
        data, sizes = row["text"].encode(), []
        for content in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False)
            sizes.append(sum(len(c.compress(data[i:i + quality.CHUNK])) for i in range(0, len(data), quality.CHUNK)))
        size[row["doc_id"]] = 1 / (1 + math.exp(-(model.slope * (sizes[1] - sizes[0]) / sum(sizes) + model.shift)))
    got = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert all(abs(got[k] - v) < 0.02 for k, v in size.items())
