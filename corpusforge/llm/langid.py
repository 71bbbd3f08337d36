"""Language of texts that may mix languages: script ranges narrow the candidates of each word, words are scored by
character n-grams, and Viterbi with a switching penalty labels spans.

A word is a run of letters, with the marks on them, of one script (Han and kana count as one) of the lower-cased text.
Its score for a language is the sum of
the log probabilities of its 2- to 4-grams of bytes, a space marking its ends, relative to the mean language. The
models come from a bounded, seeded sample of up to ``PER_LANGUAGE`` texts of each language, fewer if there are so many
languages that the sample would hold more than ``TEXTS``; n-grams are counted in Spark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import hex_key, hex_number, written

PER_LANGUAGE = 400
#: Texts of the whole sample, and values of the column taken for languages: beyond that, more than there are languages,
#: those with fewest rows are junk.
TEXTS, LANGUAGES = 102_400, 16_384
#: Numbers of the model's table; with more languages n-grams share fewer hashes.
CELLS = 1 << 24
#: Hex digits of the hash that part a language's rows when its sample is chosen.
RANGE_DIGITS = 4
ORDERS = (2, 3, 4)
BITS = 16
SMOOTH, LIMIT = 0.5, 4.0
#: Log odds that a change of language within a text has to make up for.
PENALTY = 16.0
#: A language uses a script if so large a part of its letters is written in it.
SCRIPT_SHARE = 0.02
PRIME, GOLDEN = np.uint32(16777619), np.uint32(0x9E3779B1)
# Code point ranges of scripts (first, last, script).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"),
    (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Odia"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x139F, "Ethiopic"),
    (0x13A0, 0x13FF, "Cherokee"), (0x1780, 0x17FF, "Khmer"), (0x1800, 0x18AF, "Mongolian"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xA980, 0xA9DF, "Javanese"), (0xAC00, 0xD7AF, "Hangul"),
    (0xF900, 0xFAFF, "Han"), (0x20000, 0x31FFF, "Han"),
)
NAMES = tuple(dict.fromkeys(name for _, _, name in SCRIPTS))
STARTS = np.array([a for a, _, _ in SCRIPTS])
LAST = np.array([b for _, b, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(name) for _, _, name in SCRIPTS])
#: Below this byte no code point lies beyond the first Latin range.
BEYOND_LATIN = 0xCA


#: Code points beyond the last letters known to a script range.
TOP = 0x32000


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it belongs to words, and its script (-1: none; kana counts as Han)."""
    codes = np.arange(TOP + 1)
    word = np.array([(c := chr(i)).isalpha() or unicodedata.category(c)[0] == "M" for i in range(TOP)] + [False])
    script = scripts_of(codes)
    return word, np.where(script == NAMES.index("Kana"), NAMES.index("Han"), np.where(word, script, -1))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # one row a hashed n-gram (row 0 is none), one column a language
    writes: np.ndarray  # one row a script, one column a language: whether it uses the script


@dataclass(frozen=True)
class Words:
    grams: list[np.ndarray]  # for each order, the table row at each position (0: crosses words)
    starts: np.ndarray  # position of the space before each word
    data: np.ndarray  # the words, single spaces between and around them
    at: np.ndarray  # place of each position in the bytes of the text
    text: str  # as lower-cased


def lowered(text: str) -> str:
    """Lower case with as many code points as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str) -> Words:
    low = lowered(text)
    data = np.frombuffer(f" {low} ".encode("utf-8", "replace"), np.uint8)
    breaks = np.empty(0, int)  # places of letters that begin a word right after another
    if low.isascii():
        letter = (data >= 97) & (data <= 122)
    else:
        codes = np.minimum(np.frombuffer(f" {low} ".encode("utf-32-le", "replace"), np.uint32), TOP)
        word, script = (table[codes] for table in letters())
        first = np.flatnonzero((data & 0xC0) != 0x80)
        letter = np.repeat(word, np.diff(first, append=len(data)))
        change = word[1:] & word[:-1] & (script[1:] != script[:-1]) & (script[1:] >= 0) & (script[:-1] >= 0)
        breaks = first[1:][change]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    at = np.flatnonzero(kept)
    packed = np.where(letter[at], data[at], 32).astype(np.uint32)
    if len(breaks):
        where = np.searchsorted(at, breaks)
        at, packed = np.insert(at, where, breaks), np.insert(packed, where, 32)
    space = packed == 32
    spaces = np.cumsum(space)
    rolled, grams = packed, []
    for n in range(2, max(ORDERS) + 1):
        if len(packed) < n:
            break
        rolled = (rolled[:-1] * PRIME) ^ packed[n - 1:]
        if n in ORDERS:
            row = ((((rolled + np.uint32(n)) * GOLDEN) >> np.uint32(32 - BITS)) | np.uint32(1)).astype(np.intp)
            if n == 2:
                row[space[:-1] & space[1:]] = 0
            else:
                row[spaces[n - 2:len(packed) - 1] != spaces[:len(packed) - n + 1]] = 0
            grams.append(row)
    return Words(grams, np.flatnonzero(space)[:-1], packed, at, low)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Script number of each code point, -1 where none applies."""
    k = np.searchsorted(STARTS, codes, "right") - 1
    return np.where((k >= 0) & (codes <= LAST[np.maximum(k, 0)]), SCRIPT_OF[np.maximum(k, 0)], -1)


def word_scripts(words: Words) -> np.ndarray:
    """Script number of each word: that of most of its code points (-1: none)."""
    parts = words.data.astype(np.uint8).tobytes().decode("utf-8", "replace").split(" ")[1:-1]
    out = np.full(len(words.starts), -1)
    for i, part in enumerate(parts[:len(out)]):
        found = scripts_of(np.array([ord(c) for c in part]))
        found = found[found >= 0]
        if len(found):
            out[i] = np.bincount(found).argmax()
    return out


def folded(rows: np.ndarray, size: int) -> np.ndarray:
    """Rows of a table of ``size`` rows for those of one of 2**BITS; none stays none."""
    shift = BITS - (size.bit_length() - 1)
    return rows if shift == 0 else np.where(rows > 0, (rows >> shift) | 1, 0)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """One row a word, one column a language; a language that doesn't use the word's script is far behind, unless
    none uses it."""
    sums = np.zeros((len(words.data), len(model.languages)), np.float32)
    for row in words.grams:
        sums[:len(row)] += model.table[folded(row, len(model.table))]
    scores = np.add.reduceat(sums, words.starts, axis=0).astype(float)
    latin = NAMES.index("Latin")
    if words.data.max() < BEYOND_LATIN:
        uses = np.broadcast_to(model.writes[latin], scores.shape)
    else:
        uses = np.vstack([model.writes, np.ones(len(model.languages), bool)])[word_scripts(words)]
    uses = uses | ~uses.any(axis=1, keepdims=True)
    return np.where(uses, scores, scores.min(initial=0.0) - 4 * PENALTY)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Labels of the words on the path of the highest sum of scores less ``penalty`` for each change.

    A path is compared with staying in the language of the highest total. Its first stretch gains at most the largest
    sum A of a beginning of the text, its last at most the largest sum Z of an end, any other at most the largest sum
    G of a stretch, and each change costs the penalty. If G and A + Z are within it, changes never pay and the answer
    is that language throughout; only other texts are walked word by word.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    ahead = np.vstack([np.zeros(k), np.cumsum(scores - scores[:, best:best + 1], axis=0)])
    edges = max(0.0, ahead.max()) + max(0.0, (ahead[-1] - ahead).max())
    if edges <= penalty and (ahead - np.minimum.accumulate(ahead, axis=0)).max() <= penalty:
        return np.full(n, best)
    path, back = [0.0] * k, []
    for row in scores.tolist():
        top = max(range(k), key=path.__getitem__)
        jump = path[top] - penalty
        back.append([i if path[i] >= jump else top for i in range(k)])
        path = [max(p, jump) + s for p, s in zip(path, row)]
    label, out = max(range(k), key=path.__getitem__), np.empty(n, int)
    for i in range(n - 1, -1, -1):
        out[i] = label
        label = back[i][label]
    return out


def label(text: str | None, model: Model) -> tuple[str, float, list[tuple[int, int, str]]]:
    """(language, share of the letters it labels, spans as (start, end, language) in code points).

    ``und``, 0 and no span for a null text, one without a letter, or a model without languages."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0, []
    words = words_of(text)
    if not len(words.starts):
        return "und", 0.0, []
    labels = viterbi(word_scores(words, model))
    ends = np.append(words.starts[1:], len(words.data) - 1)
    lead = (words.data != 32) & ((words.data & 0xC0) != 0x80)
    counts = np.bincount(labels, np.add.reduceat(lead, words.starts, dtype=int), len(model.languages))
    best = int(counts.argmax())
    first = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
    final = np.append(first[1:] - 1, len(labels) - 1)
    if len(first) == 1 and text.isascii():
        place = lambda i: int(words.at[i]) - 1
    else:
        points = np.cumsum((np.frombuffer(f" {words.text} ".encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80)
        place = lambda i: int(points[words.at[i]]) - 2
    spans = [(place(words.starts[a] + 1), place(ends[b]), model.languages[labels[a]]) for a, b in zip(first, final)]
    return model.languages[best], float(counts[best] / counts.sum()), spans


def fit(docs: DataFrame, keep: Column, per_language: int = PER_LANGUAGE, seed: str = "langid") -> Model:
    """n-gram models of all languages in ``docs.lang`` (the ``LANGUAGES`` with most rows, ties by name) among ids that
    ``keep`` admits, from at most ``per_language`` texts each and ``TEXTS`` in all, chosen in a seeded order on the slim
    (doc_id, lang) columns; null languages and texts are left out. The chosen ids are broadcast.

    Rows by language and hash range tell in which range a language's sample ends; only rows up to there are ranked, so
    a language with most of the rows is spread. Counts are summed by Spark; the driver receives at most 2**BITS rows
    and one a script for each language.
    """
    known = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), hex_key(seed, F.col("doc_id")).alias("rank"))
    known = known.withColumn("range", hex_number(F.col("rank"), RANGE_DIGITS))
    totals = written(known.groupBy("lang", "range").agg(F.count("*").alias("rows")))
    main = totals.groupBy("lang").agg(F.sum("rows").alias("all")).orderBy(F.desc("all"), "lang").limit(LANGUAGES).select("lang")
    per_language = max(1, min(per_language, TEXTS // max(1, main.count())))
    before = F.sum("rows").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = (totals.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language)
              .join(F.broadcast(main), "lang").select("lang", "range"))
    first = Window.partitionBy("lang").orderBy("rank", "doc_id")
    picked = (known.join(F.broadcast(ranges), ["lang", "range"]).withColumn("nth", F.row_number().over(first))
              .where(F.col("nth") <= per_language).select("doc_id", "lang").distinct())
    sample = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(picked), ["doc_id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, own = words_of(text or ""), counts.setdefault(lang, np.zeros((1 << BITS) + len(NAMES), np.int64))
                for row in words.grams:
                    own[:1 << BITS] += np.bincount(row, minlength=1 << BITS)
                script = scripts_of(np.frombuffer("".join(filter(str.isalpha, words.text)).encode("utf-32-le", "replace"), np.uint32))
                own[1 << BITS:] += np.bincount(script[script >= 0], minlength=len(NAMES))
            for lang, own in counts.items():
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(own[used])], ["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return learn(counted["lang"].to_pylist(), counted["gram"].to_numpy(), counted["n"].to_numpy())


def learn(langs: list[str], grams: np.ndarray, counts: np.ndarray) -> Model:
    languages = tuple(sorted(set(langs)))
    size = 1 << BITS
    table = np.zeros((size + len(NAMES), len(languages)))
    if languages:
        column = {x: i for i, x in enumerate(languages)}
        np.add.at(table, (grams, np.array([column[x] for x in langs])), counts)
    scripts, seen = table[size:], table[:size]
    bits = BITS
    while len(languages) << bits > CELLS:
        bits -= 1
    if bits < BITS:
        fewer = np.zeros((1 << bits, len(languages)))
        np.add.at(fewer, folded(np.arange(size), 1 << bits), seen)
        size, seen = 1 << bits, fewer
    seen[0] = 0
    log = np.log((seen + SMOOTH) / (seen.sum(axis=0) + SMOOTH * size))
    log = np.clip(log - log.mean(axis=1, keepdims=True), -LIMIT, LIMIT) if languages else log
    log[0] = 0
    return Model(languages, log.astype(np.float32), scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans array<struct<start, end, lang>>) of every row, in one pass without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0; repeated and null keys stay rows of their own;
    extra columns are ignored; an empty table gives no rows; a tie goes to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [label(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
                pa.array([[dict(zip(("start", "end", "lang"), s)) for s in r[2]] for r in rows], span)], ["key", "lang_pred", "score", "spans"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>").withColumnRenamed("key", key)
