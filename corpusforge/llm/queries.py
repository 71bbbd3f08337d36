"""Registered queries of the operators, one for each, over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import (bpe, conversation, decontaminate, html_extract, langid, mixing, order_minhash, pii, quality, sharding, simhash, toxicity,
                             whitening)
from corpusforge.llm.common import fold, table
from corpusforge.llm.conversation_sql import ORACLE_SQL as CONVERSATION_SQL

#: Where the vocabulary files of public tokenizers are; the driver reads them.
TOKENIZERS = "/opt/tokenizers"
SHARDS = 16
WEIGHTS = (5, 2, 1)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    return f"{TOKENIZERS}/{name}"


def held_out(n: int, rest: int) -> Column:
    """Whether doc_id is in the fold that is never learnt from (a null doc_id is not, nor is it learnt from)."""
    return F.coalesce(fold(F.col("doc_id"), n) == rest, F.lit(False))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards by doc_id, and where they go with a seventeenth."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = sharding.assign(docs, [1.0] * SHARDS, "doc_id", ["size", "text_crc32"], ["text_crc32", "size"], grown_weight=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating, to the size of the whole, with the words that each of
    the 16 shards of the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken",
                                            F.array_join(F.col("by_shard").cast("array<string>"), ",").alias("taken_by_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the part of it that they cover."""
    found, _ = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; the likeness to the next document."""
    found = order_minhash.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        order_minhash.fingerprint(F.col("sig")).alias("fingerprint"),
        order_minhash.fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        order_minhash.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels of the other four folds."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the other three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs, fold(F.col("doc_id"), 4) != 2))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the group it links to at 2 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all reported spans with their
    scores."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def listed(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of the other three folds."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least repair and digest of every conversation, whose rows are damaged by the crc32 of ``conv_id:turn``."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    rows = rows.withColumn("harm", harm).select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.coalesce("text", F.lit(" "))).alias("text"),
        F.explode(F.array_repeat(F.col("harm") == 0, F.when(F.col("harm") == 3, 2).otherwise(1))).alias("dropped"))
    return conversation.digests(rows, lost=F.col("dropped"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a byte-level BPE vocabulary of 50,257 ids and decoded again."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json")
    ids = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding, in units of 1/1024."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whitening.quantised(F.col("embedding"), 1024, 100000).alias("x"))
    return whitening.whiten(rows, components=8)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html": op2_html,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_order_minhash": op5_order_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_bpe": op12_bpe,
    "op13_whitening": op13_whitening,
}


def _words_before(at: str) -> str:
    """SQL: words up to the place ``at`` of a source in the blocks that shard ``p`` of the mix takes."""
    block = f"({at} // {mixing.BLOCK})"
    nth = f"(({block} - p.turn + {mixing.SHARDS - 1}) // {mixing.SHARDS})"
    times = [f"(p.whole * {k} + ({k}::HUGEINT * p.rest + p.shift) // p.own)" for k in (nth, f"({nth} + 1)")]
    return (f"({mixing.BLOCK} * {times[0]} + CASE WHEN {block} % {mixing.SHARDS} = p.turn "
            f"THEN ({times[1]} - {times[0]}) * ({at} % {mixing.BLOCK}) ELSE 0 END)")


ORACLE = {
    "op11_conversation_repair": CONVERSATION_SQL,
    # A draw is the md5 of seed, shard and key; only its order counts where weights are equal.
    "op1_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, text,
         coalesce(CAST(doc_id AS VARCHAR), 'null') AS k
  FROM documents),
draws AS (
  SELECT doc_id, size, text, k,
         list_transform(range(0, {SHARDS + 1}), lambda s: CAST('0x' || substr(md5('shard:' || s || ':' || k), 1, 13) AS BIGINT)) AS u
  FROM d),
placed AS (
  SELECT doc_id, size, text, k, list_position(u[1:{SHARDS}], list_max(u[1:{SHARDS}])) - 1 AS shard,
         list_position(u, list_max(u)) - 1 AS grown_shard
  FROM draws),
bits AS (
  SELECT list_reduce([CAST(i AS UBIGINT)] || list_transform(range(0, 8), lambda x: CAST(x AS UBIGINT)),
                     lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS entry, i
  FROM range(0, 256) AS r(i)),
crc AS (
  SELECT list(entry ORDER BY i) AS entries FROM bits),
summed AS (
  SELECT p.*, CASE WHEN text IS NULL THEN NULL ELSE
         xor(list_reduce([CAST(4294967295 AS UBIGINT)] || list_transform(
               regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS UBIGINT)),
               lambda a, b: xor(a >> 8, entries[CAST(xor(a, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) END AS text_crc32
  FROM placed p, crc)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY
         md5('shard:slot:' || k || CASE WHEN doc_id IS NULL THEN ':' || coalesce(CAST(CAST(text_crc32 AS BIGINT) AS VARCHAR), 'null') || ':' || size ELSE ':null:null' END),
         doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS BIGINT) AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM summed
""",
    "op3_mixing": f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(key)) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY key),
fill AS (
  SELECT *, 3 * source_size AS cap,
         CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER below, 0) AS DOUBLE)
         / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER below, 0) AS DOUBLE) AS level
  FROM s WINDOW below AS (ORDER BY 3 * source_size / weight, encode(key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aim AS (
  SELECT key, source_size, least(CAST(cap AS DOUBLE), weight * (
           SELECT level FROM fill WHERE level * weight <= cap ORDER BY cap / weight, encode(key) LIMIT 1)) AS target
  FROM fill),
house AS (
  SELECT CAST(floor((sum(target) * 2 + {mixing.BLOCK}) / {2 * mixing.BLOCK}) AS BIGINT) AS n FROM aim),
seats AS (
  SELECT key, target / (2 * seat - 1) AS quotient
  FROM aim, house, LATERAL (SELECT unnest(range(1, 1 + CAST(least(n, 3 * ceil(source_size / {mixing.BLOCK})) AS BIGINT))) AS seat)),
ranked AS (
  SELECT key, row_number() OVER (ORDER BY quotient DESC, encode(key)) AS nth FROM seats),
ends AS (
  SELECT key, source_size, target, CAST(ceil(source_size / {mixing.BLOCK}) AS BIGINT) AS blocks, shard, n * (shard + 1) // {mixing.SHARDS} AS house,
         (({mixing.SHARDS} + shard - CAST('0x' || substr(md5('mix:turn:' || key), 1, 8) AS BIGINT) % {mixing.SHARDS}) % {mixing.SHARDS}) AS turn
  FROM aim, house, range(0, {mixing.SHARDS}) AS r(shard)),
won AS (
  SELECT e.key, source_size, target, shard, turn, (blocks - turn + {mixing.SHARDS - 1}) // {mixing.SHARDS} AS own, count(nth) AS upto
  FROM ends e LEFT JOIN ranked r ON r.key = e.key AND nth <= house GROUP BY ALL),
queue AS (
  SELECT *, 3 * sum(own) OVER byshard AS room, max(upto) OVER (PARTITION BY key) AS quota FROM won WINDOW byshard AS (PARTITION BY key ORDER BY shard)),
served AS (
  SELECT *, room + least(0, min(upto - room) OVER byshard) AS done FROM queue WINDOW byshard AS (PARTITION BY key ORDER BY shard)),
got AS (
  SELECT *, done - lag(done, 1, 0) OVER byshard AS got, quota - max(done) OVER (PARTITION BY key) AS late
  FROM served WINDOW byshard AS (PARTITION BY key ORDER BY shard)),
filled AS (
  SELECT *, got + least(3 * own - got, greatest(0, late - coalesce(sum(3 * own - got) OVER earlier, 0))) AS due
  FROM got WINDOW earlier AS (PARTITION BY key ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
picks AS (
  SELECT key, source_size, target, list({{'turn': turn, 'own': held, 'whole': CAST(due AS BIGINT) // held, 'rest': CAST(due AS BIGINT) % held,
           'shift': CAST('0x' || substr(md5('mix:blocks:' || key || ':' || shard), 1, 8) AS BIGINT) % held}} ORDER BY shard) AS picks
  FROM (SELECT *, greatest(1, own) AS held FROM filled) GROUP BY key, source_size, target),
laid AS (
  SELECT doc_id, key, size, CAST(sum(size) OVER (
           PARTITION BY key ORDER BY floor(log2(CAST(size AS DOUBLE) + 1.0) * 8.0), place, size, doc_id NULLS FIRST
           ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM d),
parts AS (
  SELECT doc_id, size, source_size, target, list_transform(picks, lambda p: CAST({_words_before("stop")} - {_words_before("(stop - size)")} AS BIGINT)) AS parts
  FROM laid JOIN picks USING (key))
SELECT doc_id, size, source_size, target, CAST(list_sum(parts) AS BIGINT) AS taken, array_to_string(parts, ',') AS taken_by_shard FROM parts
""",
}
