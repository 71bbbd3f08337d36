"""Byte-level BPE encoding and decoding with a vocabulary file of a public tokenizer.

Encoding is a streaming transducer. Text left of what has been read may still be merged differently once more bytes
arrive, but only so far: a merge can change a boundary only if the token right of it changed before, by a merge of
lower rank. ``lookahead`` follows these chains through the merge list and bounds their length in bytes; tokens that end
further than that before the end of the buffer are final and are emitted, the rest is kept. So a run of any length that
the pre-tokeniser doesn't split (one word, one blank) is encoded in memory that depends on the merge list only.

Decoding feeds the bytes of each token to an incremental UTF-8 state machine, which keeps the open bytes of a character
between tokens and gives U+FFFD for a maximal ill-formed part.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.llm.common import map_rows

#: What byte-level tokenizers with ``use_regex`` split: words, numbers, contractions (fixed), marks, blanks. Words and
#: numbers, which no other alternative starts like, come first since they are the most.
SPLIT = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a task remembers; the memory is emptied when it is full.
REMEMBERED = 1 << 18
#: Bytes of text, or ids, after which the next row starts a new batch.
BATCH = 1 << 20
#: Words that are held and merged together.
WORDS = 1 << 17
#: Bytes that a transducer reads beyond its lookahead before it merges.
STEP = 2048
#: Bytes from which a run is merged on its own, with a heap; below it, with others of its length.
LONG = 64
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass(frozen=True)
class Model:
    """What a vocabulary file says: ``single`` ids of the 256 bytes, ``pairs`` from two ids to the rank, ``merged`` the
    id that each rank makes, ``spelled`` the bytes of each id (None where an id is free), ``special`` strings and ids."""

    single: tuple[int, ...]
    pairs: dict[tuple[int, int], int]
    merged: tuple[int, ...]
    spelled: tuple[bytes | None, ...]
    special: tuple[tuple[str, int], ...]
    reach: int

    @cached_property
    def encoder(self) -> Encoder:
        """One a worker: the words that it remembers serve all of its tasks."""
        return Encoder(self)


def load(path: str) -> Model:
    """The model in a ``tokenizers`` file of byte-level BPE. Other kinds of file, and parts that would change the
    result (a normaliser, a template, dropout, word affixes), are refused with ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [spec.get("normalizer"), spec.get("post_processor"), *(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))]
    if (model.get("type", "BPE") != "BPE" or any(odd) or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
            or pre.get("add_prefix_space") or (spec.get("decoder") or {}).get("type") != "ByteLevel"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    letters, vocab, added = byte_letters(), model["vocab"], spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in their surroundings")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    spelled: list[bytes | None] = [None] * (1 + max(chain(vocab.values(), (t["id"] for t in added))))
    for token, i in chain(vocab.items(), ((t["content"], t["id"]) for t in added)):
        spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    pairs = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
    return Model(tuple(vocab[c] for c, _ in sorted(letters.items(), key=itemgetter(1))), pairs,
                 tuple(vocab[a + b] for a, b in merges), tuple(spelled), tuple((t["content"], t["id"]) for t in added),
                 lookahead([(spelled[vocab[a]], spelled[vocab[b]]) for a, b in merges]))


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes from the end of a text within which a longer text may have other token boundaries.

    Say that at some rank the rule (u, v) removes a boundary in one of the two texts only, and that the next boundary
    that only one of them still has lies z bytes further right. Then z is a token there, v is z or starts with it, and
    the rule that removed that next boundary has a lower rank and a left side that z ends with. So ``far`` of a rule is
    at most the longest z plus the ``far`` of such an earlier rule, or plus nothing at the end of the text. The lists
    must be in the order in which tokens are made (ValueError otherwise), which makes ranks rise along a derivation.
    """
    far: dict[bytes, int] = {}  # by left side: the furthest boundary that a rule read so far can remove
    made = {bytes([b]) for b in range(256)}
    reach = 0
    for u, v in merges:
        if u not in made or v not in made or u + v in made:
            raise ValueError("merges that use a token before it is made, or make one twice")
        best = 0
        for i in range(1, len(v) + 1):
            z = v[:i]
            if z in made:
                best = max(best, i + max(far.get(z[j:], 0) for j in range(i)))
        far[u] = max(far.get(u, 0), best)
        made.add(u + v)
        reach = max(reach, best)
    return reach


@dataclass
class Transducer:
    """Bytes in, final ids out; holds at most ``model.reach + STEP`` bytes and the piece being fed."""

    model: Model
    open: bytearray = field(default_factory=bytearray)

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` as a text of its own: the pair of least rank, leftmost first, until none is left."""
        get, merged = self.model.pairs.get, self.model.merged
        ids = [self.model.single[b] for b in data]
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        if len(data) >= LONG:
            return self.merge_long(ids, ranks)
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            ids[i:i + 2] = [merged[rank]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
        return ids

    def merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list; a pair whose tokens have changed since is passed over."""
        get, merged, n = self.model.pairs.get, self.model.merged, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, rank in enumerate(ranks) if rank != NEVER]
        ranks.append(NEVER)  # the last token has no pair
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if ranks[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = merged[rank], -1, NEVER
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    ranks[left] = get((ids[left], ids[right]), NEVER)
                    if ranks[left] != NEVER:
                        heappush(heap, (ranks[left], left))
                elif left >= 0:
                    ranks[left] = NEVER
        return [i for i in ids if i >= 0]

    def feed(self, data: bytes) -> Iterator[int]:
        """The ids that no further byte can change."""
        for at in range(0, len(data), STEP):
            self.open += data[at:at + STEP]
            if len(self.open) < self.model.reach + STEP:
                continue
            final, end = len(self.open) - self.model.reach, 0
            for i in self.merge(self.open):
                end += len(self.model.spelled[i])
                if end >= final:
                    end -= len(self.model.spelled[i])
                    break
                yield i
            del self.open[:end]

    def finish(self) -> Iterator[int]:
        """The ids of what is left."""
        yield from self.merge(self.open)
        self.open.clear()


class Table:
    """The pairs of a model as sorted numbers, to look up many at once."""

    def __init__(self, model: Model):
        keys = np.array([a << 32 | b for a, b in model.pairs], dtype=np.int64)
        order = keys.argsort()
        self.keys, self.ranks = keys[order], np.array(list(model.pairs.values()), dtype=np.int64)[order]
        self.merged, self.single = np.array(model.merged, dtype=np.int64), np.array(model.single, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids, as the bytes of ints, of words of one length: in each round every word that has a pair left merges its least, leftmost one, so
        that all of them stay of one length."""
        out: list = [None] * len(words)
        ids = self.single[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)]
        row, ranks = np.arange(len(words)), self.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            least = ranks.min(axis=1, initial=NEVER)
            live = least < NEVER
            data, size = ids[~live].astype(np.int32).tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(row[~live].tolist()):
                out[i] = data[k * size:(k + 1) * size]
            row, ids, ranks, least = row[live], ids[live], ranks[live], least[live]
            if not len(row):
                break
            at, every = ranks.argmin(axis=1), np.arange(len(row))
            width = ids.shape[1] - 1
            ids[every, at] = self.merged[least]
            ids = np.take_along_axis(ids, np.arange(width) + (np.arange(width) > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, np.arange(width - 1) + (np.arange(width - 1) >= at[:, None]), axis=1)
            for place, some in ((at, at < width - 1), (at - 1, at > 0)):
                i, j = every[some], place[some]
                ranks[i, j] = self.rank(ids[i, j], ids[i, j + 1])
        return out


class Encoder:
    """Texts in, ids out. The ids of each word met are remembered as the bytes of ints; the memory is emptied when it
    holds ``REMEMBERED`` words. Words not met before are merged many at a time, runs of ``LONG`` bytes or more each by
    the transducer."""

    def __init__(self, model: Model):
        self.words: dict[str, bytes] = {}
        self.table, self.transducer = Table(model), Transducer(model)
        self.split, self.special = regex.compile(SPLIT), dict(model.special)
        ordered = sorted(self.special, key=lambda s: (-len(s), s))
        self.parts = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for word in words:
            data = word.encode()
            if len(data) < LONG:
                by_length.setdefault(len(data), []).append(word)
            else:
                self.words[word] = array("i", chain(self.transducer.feed(data), self.transducer.finish())).tobytes()
        for some in by_length.values():
            self.words.update(zip(some, self.table.merge([w.encode() for w in some]), strict=True))

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[str] | int]]:
        """(number of the text, some of its words or the id of a special token), in order."""
        for n, text in enumerate(texts):
            for part in self.parts.split(text) if self.parts else [text]:
                if part in self.special:
                    yield n, self.special[part]
                else:
                    words = map(itemgetter(0), self.split.finditer(part))
                    while some := list(islice(words, WORDS)):
                        yield n, some

    def encode(self, texts: list[str]) -> list[array]:
        """The ids of each text."""
        out, held, size = [array("i") for _ in texts], [], 0

        def passed() -> None:
            words = set().union(*(p for _, p in held if isinstance(p, list)))
            if len(self.words) + len(words) > REMEMBERED:
                self.words.clear()
            self.learn(words - self.words.keys())
            for n, p in held:
                out[n].frombytes(b"".join(map(self.words.__getitem__, p)) if isinstance(p, list) else array("i", [p]).tobytes())
            held.clear()

        for piece in self.pieces(texts):
            held.append(piece)
            size += len(piece[1]) if isinstance(piece[1], list) else 1
            if size >= WORDS:
                passed()
                size = 0
        passed()
        return out

    def ids(self, text: str) -> array:
        return self.encode([text])[0]


class Decoder:
    """Ids in, text out; holds at most the open bytes of one character."""

    def __init__(self, model: Model):
        self.spelled = {i: b for i, b in enumerate(model.spelled) if b is not None}
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete; ids that the vocabulary doesn't have are left out."""
        return self.machine.decode(b"".join(filter(None, map(self.spelled.get, ids))))

    def finish(self) -> str:
        """What an open character comes to at the end."""
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text

    def text(self, ids: Iterable[int]) -> str:
        ids, out = iter(ids), []
        while some := list(islice(ids, 1 << 16)):
            out.append(self.feed(some))
        return "".join(out) + self.finish()


def cut(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``sizes`` add up to about ``BATCH``; a row is never cut."""
    for batch in batches:
        ends = np.cumsum(sizes(batch).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + BATCH, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the column ``ids`` (array of int): the whole text encoded with the vocabulary at ``path``, which the
    driver reads and broadcasts (its size is that of the file). Strings of special tokens in a text become their ids.

    A null or empty text has no ids (an empty array). Rows stay as they are, repeated ones too; an empty table gives no
    rows; columns may have any names, a column named like ``ids`` is replaced. Nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    spare = "_" * (1 + max(map(len, df.columns)))  # a name that no column has
    slim = df.withColumn(spare, F.col(text).cast("string")).drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder
        for batch in cut(batches, lambda b: pc.binary_length(b.columns[-1])):
            made = encoder.encode([t or "" for t in batch.columns[-1].to_pylist()])
            ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
            flat = np.frombuffer(b"".join(m.tobytes() for m in made), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(flat))], [*batch.schema.names, "made"])

    return map_rows(slim, run, T.StructField(ids, T.ArrayType(T.IntegerType(), True))).drop(spare)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the column ``text``: the ids decoded with the vocabulary at ``path``, special tokens as their strings.

    A null or empty array gives the empty text; null ids and ids that the vocabulary doesn't have are left out; a column
    named like ``text`` is replaced. Nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    spare = "_" * (1 + max(map(len, df.columns)))
    slim = df.withColumn(spare, F.col(ids).cast("array<int>")).drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in cut(batches, lambda b: pc.list_value_length(b.columns[-1])):
            column = batch.columns[-1]
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            made = pa.array([decoder.text(flat[start:end]) for start, end in zip([0, *ends], ends, strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "made"])

    return map_rows(slim, run, T.StructField(text, T.StringType())).drop(spare)
