import hashlib
import random
import re

from corpusforge.llm import pii
from corpusforge.llm.queries import op9_pii
from messy import docs, empty

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def base(text):
    return [s[:3] for s in pii.find(text) if s[2] in pii.BASE]


def test_base_kinds_match_plain_patterns():
    rng = random.Random(2)
    for alphabet in ("a.@-1 ", "0123456789", "0123456789 -", "12.5 ", "+(0) 19-.", "a@b.c_é1+ -"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert base(text) == brute(text), text


def test_card_numbers():
    assert [s[2] for s in pii.find("pay 4111 1111 1111 1111 now")] == ["card"]
    assert pii.find("pay 4111 1111 1111 1112 now") == []


def test_method_adds_confirmed_kinds():
    assert [s[2] for s in pii.find("account GB82 WEST 1234 5698 7654 32 closed")] == ["iban"]
    assert pii.find("GB82 WEST 1234 5698 7654 33") == []
    assert [s[2] for s in pii.find("my social security number is 123-45-6789")] == ["ssn"]
    assert pii.find("part 123-45-6789 in stock") == []


def coded(country, rest):
    """An IBAN with its check digits."""
    turned = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{rest}"


def test_ibans_end_where_their_country_says():
    rng = random.Random(5)
    for country, size in pii.IBAN_LENGTH.items():
        code = coded(country, "".join(rng.choice("0123456789") for _ in range(size - 4)))
        grouped = " ".join(code[i:i + 4] for i in range(0, size, 4))
        for shown in (code, grouped):
            for after in ("", " CALL ME", " 1234", ".", " é", "\nX"):
                text = f"konto {shown}{after}"
                assert [s[:2] for s in pii.find(text) if s[2] == "iban"] == [(6, 6 + len(shown))], text
            assert not [s for s in pii.find(f"konto {shown}7") + pii.find(f"konto Q{shown}") if s[2] == "iban"]
    assert [s[:3] for s in pii.find("BE68 5390 0754 7034 CALL ME")] == [(0, 19, "iban")]


def test_context_decides_for_every_added_kind():
    code = "GB82 WEST 1234 5698 7654 32"
    assert [s[2] for s in pii.find(f"pay {code} now")] == ["iban"]
    assert [s[2] for s in pii.find(f"a test of my bank account {code}")] == ["iban"]
    assert pii.find(f"an example of a code: {code}") == []
    assert pii.find("social security test 123-45-6789") == [] and pii.find("example 123-45-6789") == []


def test_context_moves_the_score():
    near, far, against = (pii.find(t)[0][3] for t in ("server address 10.1.2.3", "saw 10.1.2.3 there", "version 10.1.2.3"))
    assert near > far > against


def test_linear_on_long_runs():
    assert pii.find("a" * 300_000 + " " + "1" * 300_000 + " " + "@" * 100_000 + " " + "1.x" * 100_000 + "+" * 100_000) == []


def test_query_on_small_tables(spark):
    got = {r["doc_id"]: r for r in op9_pii(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want, row = brute(r["text"]), got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in want) for k in pii.BASE]


def test_hard_rows(spark):
    got = pii.spans(docs(spark)).collect()
    assert len(got) == docs(spark).count() and pii.spans(empty(spark)).count() == 0
    assert all(r["spans"] == [] for r in got if r["doc_id"] in (100, 101, 102, 107))
