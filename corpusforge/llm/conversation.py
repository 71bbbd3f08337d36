"""Repair of the structure of conversations at least cost.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Rows may be kept, given the role that the
structure asks for, or deleted, and empty turns inserted; the least (cost, audit) is found by depth-first branch and
bound over an explicit stack. The texts of a conversation are never held together: the search sees one small number a
row, and the repaired lines are streamed in order behind their audit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Initials by number, and the faults of a row; a row's code is its initial plus 4 times its fault.
INITIALS, SOUND, EMPTY, REPEATED, CUT, LOST = "sua", 0, 1, 2, 3, 4
#: States of the structure: nothing yet, after the system row, a user's row, an assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states that a bound tells apart: after the system row counts as after an assistant's.
KIND = (0, 1, 2, 1)
FAR = 1 << 60
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COLUMNS = [c.split()[0] for c in SUMMARY.split(", ")]


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in the order of the letters."""
    initial, fault = code & 3, code >> 2
    out = [("D", DELETE, state)]
    if fault in (EMPTY, REPEATED):
        return out
    extra, wanted = TRUNCATED if fault == CUT else 0, ASSISTANT if state == USER else USER
    if initial == 0 and state == START:
        out.append(("K", extra, SYSTEM))
    if initial == (2 if wanted == ASSISTANT else 1):
        out.append(("K", extra, wanted))
    else:
        out.append(("R", REROLE + extra, wanted))
    return out


def bounds(codes: bytes) -> list[array]:
    """For each kind of state and each suffix of the rows a cost that no repair of the suffix goes below: the least
    cost if a conversation might also end after its system row."""
    n = len(codes)
    out = [array("q", bytes(8 * (n + 1))) for _ in range(3)]
    out[2][n] = INSERT
    for i in range(n - 1, -1, -1):
        raw = [min(cost + out[KIND[to]][i + 1] for _, cost, to in moves(codes[i], state)) for state in (START, SYSTEM, USER)]
        out[2][i] = min(raw[2], raw[1] + INSERT)
        out[1][i] = min(raw[1], raw[2] + INSERT)
        out[0][i] = min(raw[0], out[2][i] + INSERT)
    return out


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and, of the audits that have it, the least as text.

    The search goes down in the order of the letters, so that prefixes come in the order of the text. A first dive along
    the bounds gives the incumbent. A prefix is cut if its cost and the bound of its suffix exceed the incumbent's cost,
    or equal it once the search itself has reached that cost, or if its node (row and state) was reached before at no
    greater cost: two prefixes of equal cost at one node differ at some letter, so the earlier stays the lesser with any
    suffix. Time and memory are linear in the rows: the bound falls short of the truth by two insertions at most.
    """
    n, low = len(codes), bounds(codes)

    def children(i: int, state: int) -> list[tuple[str, int, int, int]]:
        out = [(letter, cost, i + 1, to) for letter, cost, to in moves(codes[i], state)] if i < n else []
        out.insert(min(len(out), 1), ("I", INSERT, i, ASSISTANT if state == USER else USER))
        return out

    i, state, best, path = 0, START, 0, bytearray()
    while i < n or state not in (START, ASSISTANT):
        letter, cost, i, state = min(children(i, state), key=lambda c: (c[1] + low[KIND[c[3]]][c[2]], c[0]))
        best, path = best + cost, path + letter.encode()
    audit, proved = bytes(path), False
    seen = [array("q", [FAR]) * (n + 1) for _ in range(4)]
    path, stack = bytearray(), [(0, 0, START, 0, "")]
    while stack:
        cost, i, state, depth, letter = stack.pop()
        bound = cost + low[KIND[state]][i]
        if bound > best or (proved and bound == best) or seen[state][i] <= cost:
            continue
        seen[state][i] = cost
        del path[max(depth - 1, 0):]
        path += letter.encode()
        if i == n and state in (START, ASSISTANT):
            best, audit, proved = cost, bytes(path), True
            continue
        for letter, more, at, to in reversed(children(i, state)):
            stack.append((cost + more, at, to, depth + 1, letter))
    return best, audit.decode()


def coded(df: DataFrame, conv: str, turn: str, role: str, text: str, lost: Column | None) -> DataFrame:
    """(conv, turn, role, text, mark, lost); nulls of role and text read as one space, ``mark`` stands for the text."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    lost_ = F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"),
                     F.md5(text_.cast("binary")).alias("mark"), lost_.alias("lost"))


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, its rows) of rows sorted by id, the first column; rows are read as they are asked for."""
    return groupby((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), itemgetter(0))


def batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int = 1024) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def summary(rows: Iterator[tuple]) -> tuple:
    """The values of ``SUMMARY`` for the (id, turn, code) of a conversation in order."""
    codes, least, greatest, different = bytearray(), None, None, 0
    for _, turn, code in rows:
        if code >> 2 != LOST:
            codes.append(code)
            if turn is not None and turn != greatest:
                least, greatest, different = turn if least is None else least, turn, different + 1
    faults, initials = [c >> 2 for c in codes], [c & 3 for c in codes]
    illegal = sum(p not in ((0, 1), (1, 2), (2, 1)) for p in zip(initials, initials[1:], strict=False))
    gaps = greatest - least + 1 - different if different else 0
    return (gaps, *(faults.count(f) for f in (EMPTY, REPEATED, CUT)), illegal, *solve(bytes(codes)))


def audits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation.

    Rows are taken by turn (nulls first; equal turns by role, then md5 of the text); a null role or text reads as one
    space; rows that ``lost`` marks only name their conversation, and one without any other row has zeros and an empty
    audit. A row's fault is the first of: no character but blanks; role and text of an earlier row; a last character
    other than ``.!?``. A null conversation id is one conversation; no rows give no rows; further columns are ignored.
    Texts are not shuffled: a row goes to its conversation's task as turn, role, mark of the text and fault.
    """
    rows = coded(df, conv, turn, role, text, lost)
    fault = (F.when(F.col("lost"), LOST).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), EMPTY)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))  # 1 for an empty role as well
    initial = F.when((F.col("role") == "") | (initial == 0), len(INITIALS)).otherwise(initial - 1)
    slim = rows.select("conv", "turn", "role", "mark", "lost", initial.alias("initial"), fault.alias("fault")).repartition("conv")
    nth = F.row_number().over(Window.partitionBy("conv", "role", "mark", "lost").orderBy("turn"))
    slim = slim.withColumn("nth", nth).withColumn("fault", F.when(F.col("fault").isin(SOUND, CUT) & (F.col("nth") > 1), REPEATED).otherwise(F.col("fault")))
    ordered = slim.sortWithinPartitions("conv", "turn", "role", "mark", "nth").select("conv", "turn", (F.col("initial") + F.col("fault") * 4).cast("int").alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = peeked(batches)
        found = ((one, *summary(part)) for one, part in by_conversation(batches))
        return batched(found, [batches.schema[0], *[pa.int64()] * 6, pa.string()], ["conv", *COLUMNS])

    return ordered.mapInArrow(run, f"conv {ordered.schema['conv'].dataType.simpleString()}, {SUMMARY}").withColumnRenamed("conv", conv)


class peeked:
    """Batches whose types are known before they are read."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        first = list(islice(batches, 1))
        self.schema = [c.type for c in first[0].columns] if first else [pa.null()]
        self.batches = chain(first, batches)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        return self.batches


def lines(rows: Iterator[tuple], audit: str) -> Iterator[tuple[str, int | None, str, str]]:
    """(letter, turn, role, text) of the repaired conversation, from its (id, place, turn, role, text) rows in order."""
    state = START
    for letter in audit:
        turn, role, text = (None, "", "") if letter == "I" else next(rows)[2:5]
        if letter == "D":
            continue
        if letter == "K":
            state = (SYSTEM, USER, ASSISTANT)[INITIALS.index(role[0])]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        yield letter, turn, role, text
    for _ in rows:  # nothing is left, but a group must be read to its end
        raise AssertionError("an audit shorter than its conversation")


def streamed(df: DataFrame, found: DataFrame, conv: str, turn: str, role: str, text: str, lost: Column | None) -> DataFrame:
    """(conv, place, turn, role, text, head): behind each conversation's row of ``audits`` its rows in order."""
    rows = coded(df, conv, turn, role, text, lost).where("not lost")
    head = found.select(F.col(conv).alias("conv"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                        F.lit("").alias("text"), F.lit("").alias("mark"), F.struct(*COLUMNS).alias("head"))
    both = head.unionByName(rows.select("conv", F.lit(1).alias("place"), "turn", "role", "text", "mark", F.lit(None).cast(head.schema["head"].dataType).alias("head")))
    return both.repartition("conv").sortWithinPartitions("conv", "place", "turn", "role", "mark").drop("mark")


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """(conv, place, edit, turn, role, text): the lines of the repaired conversations, ``place`` counting from 0; an
    inserted line has the edit I and no turn. Rows, nulls and order are those of ``audits``; a conversation whose rows
    are all deleted has no line."""
    rows = streamed(df, audits(df, conv, turn, role, text, lost), conv, turn, role, text, lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = peeked(batches)
        found = ((one, place, *line) for one, part in by_conversation(batches)
                 for place, line in enumerate(lines(part, next(part)[5]["audit"])))
        return batched(found, [batches.schema[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()],
                       ["conv", "place", "edit", "turn", "role", "text"])

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, place long, edit string, turn long, role string, text string").withColumnRenamed("conv", conv)


def digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: Column | None = None) -> DataFrame:
    """The rows of ``audits`` with ``repaired_sha256``: the SHA-256 of the repaired ``role:text`` lines, joined by line
    ends, taken as they stream by."""
    rows = streamed(df, audits(df, conv, turn, role, text, lost), conv, turn, role, text, lost)

    def hashed(part: Iterator[tuple], audit: str) -> str:
        sha = hashlib.sha256()
        for i, (_, _, role, text) in enumerate(lines(part, audit)):
            sha.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        return sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = peeked(batches)
        heads = ((one, part, next(part)[5]) for one, part in by_conversation(batches))
        found = ((one, *(head[c] for c in COLUMNS), hashed(part, head["audit"])) for one, part, head in heads)
        return batched(found, [batches.schema[0], *[pa.int64()] * 6, pa.string(), pa.string()], ["conv", *COLUMNS, "repaired_sha256"])

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, {SUMMARY}, repaired_sha256 string").withColumnRenamed("conv", conv)
