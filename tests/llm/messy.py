"""Small hard tables: nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog and then sleeps in warm grass until morning comes again".split()


def text_of(seed: int, n: int) -> str:
    out, state = [], seed * 7919 + 13
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 16 & 15] + (str(state % 50) if state % 3 else ""))
    return " ".join(out)


def rows() -> list[tuple]:
    out = [(i, text_of(i, 20 + i % 60), "en" if i % 2 else "de", f"s{i % 4}", 100) for i in range(40)]
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \t\n ", None, "s1", 4), (None, "no id here at all", "en", None, 17),
            (None, None, None, None, None), (103, text_of(3, 83), "en", "s9", 5), (104, "word", "fr", "s2", 4), (105, "Ärger über ÄRGER 日本", "de", "s2", 9)]
    out += [out[5], out[5], (5, "another text of the same id", "en", "s1", 27)]  # repeated rows and ids
    out += [(106, text_of(7, 30000), "en", "s3", 1), (107, "x" * 200_000, "en", "s3", 200_000), (108, "@" * 5000 + "1" * 5000, "en", "s3", 10_000)]
    return out


def docs(spark, extra: bool = True):
    df = spark.createDataFrame(rows(), DOCS)
    if not extra:
        return df
    from pyspark.sql import functions as F
    clash = ("score", "shard", "slot", "size", "fp", "key", "rank", "label", "_hash", "_seeds", "_order", "_key", "component_id", "row", "a.b", "n")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


def empty(spark):
    return spark.createDataFrame([], DOCS)
