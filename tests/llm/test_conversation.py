"""Conversation repair against plain enumeration, and its queries against a plain program."""

import hashlib
import random
import re
import zlib

import pytest
from corpusforge.llm import conversation
from corpusforge.llm.queries import op11_conversation_repair

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def every_repair(rows, inserts=2):
    """(cost, audit, repaired lines) of the least repair of (role, text, fault) rows, by trying all."""
    best = None

    def go(i, lines, cost, audit, left):
        nonlocal best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            best = min(best or (cost, audit, lines), (cost, audit, lines), key=lambda b: b[:2])
        for role in ("user", "assistant") if left else ():
            go(i, [*lines, (role, "")], cost + 5, audit + "I", left - 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, lines, cost + 2, audit + "D", left)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, [*lines, (role, text)], cost + more, audit + "K", left)
                for other in ("user", "assistant"):
                    go(i + 1, [*lines, (other, text)], cost + more + 1, audit + "R", left)

    go(0, [], 0, "", inserts)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        out.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def plain(conv, rows, inserts=2):
    """The row of the query for (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marked = faults([r[1:] for r in rows])
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:], strict=False))
    cost, audit, lines = every_repair(marked, inserts)
    n = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)


def test_search_finds_the_least_of_all_repairs():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"{i}.", rng.choice(["", "", "", "blank", "duplicate", "truncated"]))
                for i in range(rng.randrange(6))]
        codes = bytes("sua".find(r[0]) % 4 + 4 * ["", "blank", "duplicate", "truncated"].index(f) for r, _, f in rows)
        assert conversation.solve(codes) == every_repair(rows, 3)[:2], rows


def test_search_is_linear():
    """Long conversations of any make; a repair of cost 0 is found, and none is left at one a pair."""
    assert conversation.solve(bytes([0] + [1, 2] * 50_000)) == (0, "K" * 100_001)
    cost, audit = conversation.solve(bytes([1] * 20_001))
    assert cost == 10_002 and audit.count("R") == 10_000
    assert conversation.solve(bytes([0] * 5_000))[0] == 5_000


def test_bound_never_exceeds_the_truth():
    rng = random.Random(6)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(7)))
        low = conversation.bounds(codes)
        for i in range(len(codes) + 1):
            assert low[0][i] <= conversation.solve(codes[i:])[0]


def hard(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (2, None, "system", "Be kind."), (2, 5, None, "What?"), (2, 5, "user", None),
            (3, 0, "user", "again."), (3, 0, "user", "again."), (3, 9, "assistant", "cut off"), (None, 1, "assistant", "no id."), (None, None, None, None),
            (4, 3, "", "no role."), (5, 0, "uncle", "u is an initial."), (5, 1, "aunt", "a too. \n"), (6, 7, "user", "word " * 50_000 + "."),
            (6, 8, "assistant", "Fin. "), (7, -2, "assistant", "."), (7, 2, "system", "?"), (8, 0, "user", " \t\n")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_hard_rows(spark):
    rows, df = hard(spark)
    df = df.selectExpr("*", "1 AS cost", "2 AS head", "3 AS `a.b`", "4 AS place")
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append([v if v is not None or i == 0 else " " for i, v in enumerate(row)])
    want = {plain(conv, part) for conv, part in want.items()}
    assert {tuple(r) for r in conversation.digests(df).collect()} == want
    assert {tuple(r) for r in conversation.audits(df).collect()} == {w[:-1] for w in want}


def test_repaired_lines_give_the_digest(spark):
    _, df = hard(spark)
    got = {}
    for r in sorted(conversation.repaired(df).collect(), key=lambda r: r["place"]):
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in conversation.digests(df).collect():
        assert hashlib.sha256("\n".join(got.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
        assert all(line.startswith(("system", "user", "assistant", "u", "a")) for line in got.get(r["conv_id"], []))


def test_empty_and_lost(spark):
    from pyspark.sql import functions as F
    _, df = hard(spark)
    none = df.where("false")
    assert conversation.digests(none).count() == conversation.repaired(none).count() == conversation.audits(none).count() == 0
    rows = conversation.digests(df, lost=F.lit(True)).collect()
    assert len(rows) == 9 and {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("sf_dir", [SMALL])
def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {r["conv_id"]: [] for r in table}
    for conv, *row in damaged(map(tuple, table)):
        want[conv].append(row)
    got = {r["conv_id"]: tuple(r) for r in op11_conversation_repair(spark, sf_dir).collect()}
    assert set(got) == set(want)
    for conv, rows in want.items():
        if len(rows) <= 7:
            assert got[conv] == plain(conv, rows, 1 if len(rows) > 5 else 2)
