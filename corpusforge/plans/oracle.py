"""Independent DuckDB SQL for each registered query.

Written the plain way (joins per pair, direct formulas) so that it checks the
single-pass Spark plans rather than repeating them.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Python str.split() whitespace in RE2 syntax
WS = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]+"

DOCS = r"""
docs AS (
  SELECT doc_id, lang, source, text,
         CASE WHEN ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.2
              THEN 'dev' ELSE 'train' END AS split
  FROM documents),
docs2 AS (SELECT *, split || ':' || lang AS corpus,
                 CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS body
          FROM docs)"""

LINES = DOCS + r""",
lines AS (
  SELECT doc_id, lang, source, split, corpus,
         unnest(range(len(string_split(body, chr(10))))) AS line_in_doc,
         unnest(string_split(body, chr(10))) AS line
  FROM docs2)"""

TOKENS = DOCS + rf""",
toks AS (
  SELECT corpus, unnest(list_filter(string_split_regex(text, '{WS}'), lambda t: t <> '')) AS token FROM docs2),
lex AS (SELECT corpus, token, count(*)::BIGINT AS n FROM toks GROUP BY corpus, token)"""

LANGS = ["de", "en", "es", "fr"]
GRID = ("grid AS (SELECT t.c AS train, d.c AS dev FROM (VALUES " +
        ", ".join(f"('train:{x}')" for x in LANGS) + ") t(c) CROSS JOIN (VALUES " +
        ", ".join(f"('dev:{x}')" for x in LANGS) + ") d(c))")


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


register("lexicon", f"WITH {TOKENS} SELECT corpus, token, n FROM lex")

register("char_ngrams", f"""WITH {LINES},
grams AS (
  SELECT corpus, substr(l, i, 3) AS gram
  FROM (SELECT corpus, line || chr(10) AS l FROM lines) x,
       range(1, greatest(length(l) - 2, 1) + 1) r(i))
SELECT corpus, gram, count(*)::BIGINT AS n FROM grams GROUP BY corpus, gram""")

register("oov_grid", f"""WITH {TOKENS}, {GRID},
dev_tot AS (SELECT corpus, sum(n)::BIGINT AS tot, count(*)::BIGINT AS uni FROM lex GROUP BY corpus),
miss AS (
  SELECT g.train, g.dev, sum(d.n)::BIGINT AS n_oov, count(*)::BIGINT AS n_uoov
  FROM grid g JOIN lex d ON d.corpus = g.dev
  WHERE NOT EXISTS (SELECT 1 FROM lex t WHERE t.corpus = g.train AND t.token = d.token)
  GROUP BY g.train, g.dev)
SELECT g.train, g.dev,
       coalesce(m.n_oov, 0)::BIGINT AS n_oov,
       coalesce(t.tot, 0)::BIGINT AS n_tokens,
       coalesce(m.n_uoov, 0)::BIGINT AS n_unique_oov,
       coalesce(t.uni, 0)::BIGINT AS n_unique,
       round(100.0 * coalesce(m.n_oov, 0) / nullif(t.tot, 0), 6) AS oov,
       round(100.0 * coalesce(m.n_uoov, 0) / nullif(t.uni, 0), 6) AS unique_oov
FROM grid g LEFT JOIN miss m USING (train, dev) LEFT JOIN dev_tot t ON t.corpus = g.dev""")

KL_CTE = f"""{LINES}, {GRID},
grams AS (
  SELECT corpus, substr(l, i, 3) AS gram
  FROM (SELECT corpus, line || chr(10) AS l FROM lines) x,
       range(1, greatest(length(l) - 2, 1) + 1) r(i)),
cnt AS (SELECT corpus, gram, count(*) AS n FROM grams GROUP BY corpus, gram),
support AS (
  SELECT DISTINCT g.train, g.dev, c.gram FROM grid g JOIN cnt c ON c.corpus = g.train OR c.corpus = g.dev),
sm AS (
  SELECT s.train, s.dev, coalesce(a.n, 0) + 1.0 AS a, coalesce(b.n, 0) + 1.0 AS b
  FROM support s LEFT JOIN cnt a ON a.corpus = s.train AND a.gram = s.gram
                 LEFT JOIN cnt b ON b.corpus = s.dev AND b.gram = s.gram),
pq AS (
  SELECT train, dev, b / sum(b) OVER (PARTITION BY train, dev) AS p,
         a / sum(a) OVER (PARTITION BY train, dev) AS q FROM sm),
klg AS (SELECT train, dev, count(*)::BIGINT AS n_grams, round(sum(p * ln(p / q)), 6) AS kl_dev_train
        FROM pq GROUP BY train, dev)"""

register("kl_grid", f"WITH {KL_CTE} SELECT * FROM klg")

LANG_LEX = TOKENS + """,
lexm AS MATERIALIZED (SELECT corpus, token, n FROM lex),
tl AS MATERIALIZED (SELECT split_part(corpus, ':', 2) AS lang, token, n FROM lexm WHERE corpus LIKE 'train:%'),
dl AS MATERIALIZED (SELECT split_part(corpus, ':', 2) AS lang, token, n FROM lexm WHERE corpus LIKE 'dev:%'),
oovt AS MATERIALIZED (SELECT d.lang, d.token, d.n FROM dl d ANTI JOIN tl t ON t.lang = d.lang AND t.token = d.token)"""

register("oov_stats", f"""WITH {LANG_LEX}
SELECT d.lang,
       coalesce(sum(CASE WHEN o.token IS NOT NULL THEN d.n END), 0)::BIGINT AS n_oov,
       sum(d.n)::BIGINT AS n_tokens,
       count(o.token)::BIGINT AS n_unique_oov,
       count(*)::BIGINT AS n_unique,
       round(coalesce(sum(CASE WHEN o.token IS NOT NULL THEN d.n END), 0) / sum(d.n), 6) AS p_oov,
       round(count(o.token) / count(*), 6) AS p_unique_oov
FROM dl d LEFT JOIN oovt o ON o.lang = d.lang AND o.token = d.token
GROUP BY d.lang""")

register("oov_tokens", f"WITH {LANG_LEX} SELECT lang, token, n::BIGINT AS n FROM oovt")

register("sample_oov", f"""WITH {LANG_LEX},
r AS (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || token), token) AS rank
      FROM oovt)
SELECT lang, rank::BIGINT AS rank, token, n::BIGINT AS n FROM r WHERE rank <= 20""")

register("vocab_setops", f"""WITH {LANG_LEX},
a AS (SELECT DISTINCT lang, token FROM tl), b AS (SELECT DISTINCT lang, token FROM dl),
u AS (SELECT lang, token FROM a UNION SELECT lang, token FROM b)
SELECT u.lang,
       (SELECT count(*) FROM a WHERE a.lang = u.lang)::BIGINT AS n_a,
       (SELECT count(*) FROM b WHERE b.lang = u.lang)::BIGINT AS n_b,
       count(*)::BIGINT AS n_union,
       (SELECT count(*) FROM (SELECT token FROM a WHERE a.lang = u.lang EXCEPT SELECT token FROM b WHERE b.lang = u.lang))::BIGINT AS n_a_minus_b,
       (SELECT count(*) FROM (SELECT token FROM b WHERE b.lang = u.lang EXCEPT SELECT token FROM a WHERE a.lang = u.lang))::BIGINT AS n_b_minus_a
FROM u GROUP BY u.lang""")

GRAMS = """,
grams AS (
  SELECT corpus, split, lang, substr(l, i, 3) AS gram
  FROM (SELECT corpus, split, lang, line || chr(10) AS l FROM lines) x,
       range(1, greatest(length(l) - 2, 1) + 1) r(i)),
cnt AS (SELECT corpus, split, lang, gram, count(*) AS n FROM grams GROUP BY ALL)"""

register("kl_divergence", f"""WITH {LINES}{GRAMS},
sm AS (
  SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) + 1.0 AS a, coalesce(b.n, 0) + 1.0 AS b
  FROM (SELECT * FROM cnt WHERE split = 'train') a
  FULL OUTER JOIN (SELECT * FROM cnt WHERE split = 'dev') b ON a.lang = b.lang AND a.gram = b.gram),
pq AS (SELECT lang, b / sum(b) OVER (PARTITION BY lang) AS p, a / sum(a) OVER (PARTITION BY lang) AS q FROM sm)
SELECT lang, count(*)::BIGINT AS n_grams, round(sum(p * ln(p / q)), 6) AS kl_dev_train FROM pq GROUP BY lang""")

UNIQ = r"""
uniq AS (
  SELECT corpus, count(DISTINCT t)::BIGINT AS n_unique FROM (
    SELECT corpus, unnest(list_filter(string_split_regex(translate(line, ':;,?!"', '      '), '[ \n]+'),
                                      lambda x: x <> '')) AS t FROM lines) GROUP BY corpus)"""

register("unique_tokens", f"WITH {LINES}, {UNIQ} SELECT corpus, n_unique FROM uniq")

CSTATS = f"""{LINES}, {UNIQ},
sizes AS (
  SELECT corpus, count(*)::BIGINT AS n_lines,
         sum(len(list_filter(string_split_regex(line, '{WS}'), lambda t: t <> '')))::BIGINT AS n_tokens,
         sum(strlen(line) + 1)::BIGINT AS n_bytes, sum(length(line) + 1)::BIGINT AS n_chars
  FROM lines GROUP BY corpus),
cstats AS (
  SELECT s.corpus, n_lines, n_tokens, n_bytes, n_chars,
         (n_tokens // n_lines)::BIGINT AS mean_line_tokens, (n_bytes // n_tokens)::BIGINT AS mean_token_bytes,
         u.n_unique, (100 * u.n_unique // n_tokens)::BIGINT AS pct_unique
  FROM sizes s LEFT JOIN uniq u USING (corpus))"""

register("corpus_stats", f"WITH {CSTATS} SELECT * FROM cstats")

register("stats_export", f"""WITH {CSTATS}
SELECT corpus, concat_ws(' & ', corpus, n_lines, mean_line_tokens, mean_token_bytes, pct_unique) || ' \\\\' AS tex
FROM cstats""")

register("line_counts", f"WITH {LINES} SELECT lang, split, count(*)::BIGINT AS n_lines FROM lines GROUP BY lang, split")

register("corpus_lines", f"""WITH {LINES}
SELECT corpus, doc_id, line_in_doc::BIGINT AS line_in_doc,
       (row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_in_doc) - 1)::BIGINT AS line_no, line
FROM lines""")

_TRAIN_ORDER = "[" + ", ".join(f"'train:{x}'" for x in LANGS) + "]"
_CELLS = ", ".join(f"max(CASE WHEN dev = 'dev:{x}' THEN printf('%.2f', round(kl_dev_train, 2)) END) AS dev_{x}"
                   for x in LANGS)
_TEX = ", ".join(f"coalesce(dev_{x}, '')" for x in LANGS)
register("grid_export", f"""WITH {KL_CTE},
cells AS (SELECT train, {_CELLS} FROM klg GROUP BY train)
SELECT train, coalesce(list_position({_TRAIN_ORDER}, train) - 1, 0)::BIGINT AS rank,
       {", ".join(f"dev_{x}" for x in LANGS)},
       concat_ws(' & ', train, {_TEX}) || ' \\\\' AS tex
FROM cells""")


def hash_unit_sql(expr: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


def lang_file(lang: str, name: str) -> str:
    return f"""{name} AS (SELECT (row_number() OVER (ORDER BY doc_id, line_in_doc) - 1)::BIGINT AS line_no, line
  FROM lines WHERE lang = '{lang}')"""


PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

register("shuffle_rows", """SELECT doc_id,
  (row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1)::BIGINT AS pos FROM documents""")

register("head_rows", """SELECT doc_id, lang FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")

register("tail_rows", """SELECT doc_id, lang FROM documents
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) DESC, doc_id DESC LIMIT 100""")

register("split_corpus", f"""WITH {LINES},
r AS (SELECT doc_id, line_in_doc,
             row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_in_doc AS VARCHAR)),
                                CAST(doc_id AS VARCHAR) || ':' || CAST(line_in_doc AS VARCHAR)) - 1 AS r
      FROM lines)
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc,
       CASE WHEN r < 4096 THEN 'val' WHEN r < 8192 THEN 'dev' ELSE 'train' END AS split FROM r""")

register("reshuffle_split", f"""WITH {DOCS},
n AS (SELECT count(*) AS n_train FROM docs WHERE split = 'train'),
p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos FROM docs)
SELECT doc_id, CASE WHEN pos < (SELECT n_train FROM n) THEN 'train' ELSE 'valid' END AS split FROM p""")

register("size_matched_subsample", f"""WITH {LINES},
n AS (SELECT count(*) AS n_ref FROM lines WHERE source = 'src0' AND split = 'train'),
t AS (SELECT source, doc_id, line_in_doc, split,
             row_number() OVER (PARTITION BY source ORDER BY doc_id, line_in_doc) - 1 AS pos
      FROM lines WHERE split = 'train')
SELECT source, doc_id, line_in_doc::BIGINT AS line_in_doc, split FROM t WHERE pos < (SELECT n_ref FROM n)
UNION ALL
SELECT source, doc_id, line_in_doc::BIGINT, split FROM lines WHERE split <> 'train'""")

register("bernoulli_sample", f"""WITH {LINES},
l AS (SELECT lang, doc_id, line_in_doc, line,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_in_doc) - 1 AS line_no,
             CAST(doc_id AS VARCHAR) || ':' || CAST(line_in_doc AS VARCHAR) AS line_id FROM lines)
SELECT lang, doc_id, line_in_doc::BIGINT AS line_in_doc FROM l
WHERE ({hash_unit_sql('line_id')} <= 0.3 OR line_no = 0) AND line <> ''""")

register("concat_corpora", f"""WITH {PAIRS}
SELECT conv_id, turn, 'src' AS side, src AS text FROM pairs
UNION ALL SELECT conv_id, turn, 'tgt' AS side, tgt AS text FROM pairs""")

register("augment_mix", f"""WITH {PAIRS}
SELECT 'syn' AS origin, 1 AS copy, conv_id, turn, tgt AS src, src AS tgt FROM pairs
UNION ALL
SELECT 'nat' AS origin, c.copy, conv_id, turn, src, tgt FROM pairs, (VALUES (1), (2)) c(copy)""")

register("tsv_pairs", f"""WITH {PAIRS},
l AS (SELECT conv_id, turn, src || chr(9) || tgt AS line FROM pairs
      UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'system')
SELECT conv_id, turn,
       CASE WHEN strpos(line, chr(9)) = 0 THEN line ELSE split_part(line, chr(9), 1) END AS f1,
       CASE WHEN strpos(line, chr(9)) = 0 THEN line ELSE split_part(line, chr(9), 2) END AS f2
FROM l""")

register("paste_align", f"""WITH {LINES}, {lang_file('fr', 'a')}, {lang_file('en', 'b')}
SELECT coalesce(a.line_no, b.line_no) AS line_no, coalesce(a.line, '') AS src, coalesce(b.line, '') AS tgt
FROM a FULL OUTER JOIN b ON a.line_no = b.line_no""")

register("zip_align", f"""WITH {LINES}, {lang_file('en', 'a')}, {lang_file('es', 'b')}
SELECT a.line_no, a.line AS src, '__label__en' AS src_label, b.line AS tgt FROM a JOIN b USING (line_no)""")


def _paste(a: str, b: str) -> str:
    return f"""SELECT coalesce(x.line_no, y.line_no) AS line_no, coalesce(x.line, '') AS src, coalesce(y.line, '') AS tgt
  FROM {a} x FULL OUTER JOIN {b} y ON x.line_no = y.line_no"""


register("swap_direction", f"""WITH {LINES}, {lang_file('en', 'en_f')}, {lang_file('fr', 'fr_f')},
{lang_file('es', 'es_f')}, {lang_file('de', 'de_f')}
SELECT line_no, 'en' AS src_lang, 'fr' AS tgt_lang, src, tgt FROM ({_paste('en_f', 'fr_f')})
UNION ALL
SELECT line_no, 'de' AS src_lang, 'es' AS tgt_lang, tgt AS src, src AS tgt FROM ({_paste('es_f', 'de_f')})""")

register("build_parallel", f"""WITH {LINES}, {lang_file('fr', 'fr_f')}, {lang_file('en', 'en_f')},
p AS ({_paste('fr_f', 'en_f')}),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(line_no AS VARCHAR)), line_no) - 1 AS r FROM p)
SELECT line_no, CASE WHEN r < 4096 THEN 'val' WHEN r < 8192 THEN 'dev' ELSE 'train' END AS split,
       'fr' AS src_lang, 'en' AS tgt_lang, src, tgt FROM r""")


LID = f"""{LINES},
tg AS (SELECT lang, substr(l, i, 3) AS gram
       FROM (SELECT lang, line || chr(10) AS l FROM lines WHERE split = 'train') x,
            range(1, greatest(length(l) - 2, 1) + 1) r(i)),
cnt AS (SELECT lang, gram, count(*) AS n FROM tg GROUP BY lang, gram),
v AS (SELECT count(DISTINCT gram) AS v FROM cnt),
lt AS (SELECT lang, sum(n) AS n_total FROM cnt GROUP BY lang)"""


def lid_pred_sql(src: str, ids: str, text: str, out: str) -> str:
    """CTE chain predicting ``text`` of relation ``src`` keyed by ``ids``."""
    on = " AND ".join(f"s.{c} = n.{c}" for c in ids.split(", "))
    return f"""{out}_g AS (SELECT {ids}, substr(l, i, 3) AS gram
       FROM (SELECT {ids}, {text} || chr(10) AS l FROM {src}) x, range(1, greatest(length(l) - 2, 1) + 1) r(i)),
{out}_n AS (SELECT {ids}, count(*) AS n_g FROM {out}_g GROUP BY {ids}),
{out}_s AS (SELECT {", ".join("g." + c for c in ids.split(", "))}, c.lang, sum(ln(c.n + 1)) AS s
       FROM {out}_g g JOIN cnt c ON c.gram = g.gram GROUP BY ALL),
{out}_sc AS (SELECT {", ".join("n." + c for c in ids.split(", "))}, lt.lang,
       round(coalesce(s.s, 0) - n.n_g * ln(lt.n_total + v.v), 6) AS score
       FROM {out}_n n CROSS JOIN lt CROSS JOIN v LEFT JOIN {out}_s s ON {on} AND s.lang = lt.lang),
{out} AS (SELECT {ids}, lang AS {out}, score AS {out}_score FROM (
       SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY score DESC, lang DESC) AS rk FROM {out}_sc) WHERE rk = 1)"""


register("lid_fit", f"""WITH {LID}
SELECT c.lang, c.gram, c.n::BIGINT AS n, round(ln(c.n + 1) - ln(lt.n_total + v.v), 6) AS logp
FROM cnt c JOIN lt USING (lang) CROSS JOIN v""")

register("lid_predict", f"""WITH {LID},
dl AS (SELECT doc_id, line_in_doc, lang, line FROM lines),
{lid_pred_sql('dl', 'doc_id, line_in_doc', 'line', 'pred')}
SELECT dl.doc_id, dl.line_in_doc::BIGINT AS line_in_doc, dl.lang, p.pred, p.pred_score
FROM dl JOIN pred p USING (doc_id, line_in_doc)""")

_BP = ORACLE["build_parallel"]
_BP_CTE = _BP[len("WITH "):_BP.index("\nSELECT line_no, CASE WHEN r < 4096")]
register("lid_filter", f"""WITH {LID}, {_BP_CTE.replace(LINES + ",", "", 1)},
bp AS (SELECT line_no, CASE WHEN r < 512 THEN 'val' WHEN r < 1024 THEN 'dev' ELSE 'train' END AS split, src, tgt
       FROM r),
{lid_pred_sql('bp', 'line_no', 'src', 'ps')},
{lid_pred_sql('bp', 'line_no', 'tgt', 'pt')}
SELECT bp.line_no, bp.split, bp.src, bp.tgt FROM bp JOIN ps USING (line_no) JOIN pt USING (line_no)
WHERE bp.split <> 'train' OR (ps.ps = 'fr' AND pt.pt = 'en')""")

register("clean_pairs", f"""WITH {PAIRS},
l AS (SELECT conv_id, turn,
             len(list_filter(string_split_regex(src, '{WS}'), lambda t: t <> '')) AS a,
             len(list_filter(string_split_regex(tgt, '{WS}'), lambda t: t <> '')) AS b FROM pairs)
SELECT conv_id, turn FROM l
WHERE a BETWEEN 1 AND 100 AND b BETWEEN 1 AND 100 AND a / b <= 1.8 AND b / a <= 1.8""")

register("mono_length", f"""WITH {LINES}
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc, split FROM lines
WHERE split <> 'train' OR len(list_filter(string_split_regex(line, '{WS}'), lambda t: t <> '')) < 100""")


def char_pieces_sql(expr: str) -> str:
    words = f"array_to_string(list_filter(string_split_regex({expr}, '{WS}'), lambda t: t <> ''), ' ')"
    marked = f"('▁' || replace({words}, ' ', '▁'))"
    return f"array_to_string(list_filter(string_split({marked}, ''), lambda x: x <> ''), ' ')"


register("truncate_tokens", f"""WITH {LINES}
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc,
       array_to_string(string_split({char_pieces_sql('line')}, ' ')[1:1022], ' ') AS pieces
FROM lines""")

register("encoded_length", f"""WITH {PAIRS},
e AS (SELECT conv_id, turn,
             len(list_filter(string_split({char_pieces_sql('src')}, ' '), lambda t: t <> '')) + 1 AS src_len,
             len(list_filter(string_split({char_pieces_sql('tgt')}, ' '), lambda t: t <> '')) + 1 AS tgt_len
      FROM pairs)
SELECT conv_id, turn, src_len::BIGINT AS src_len, tgt_len::BIGINT AS tgt_len FROM e
WHERE src_len <= 1024 AND tgt_len <= 1024""")


from ..functions.rules import (ABBREVIATIONS, DELAY_TOKENS, DETOKENISE, SENTENCE_END_TOKENS,  # noqa: E402
                               normalise_tokenise_sql, rules_sql)


def _in_list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


TOKL = LINES + f""",
tokl AS (SELECT *, {normalise_tokenise_sql('line', 'lang')} AS tok FROM lines)"""


def flags_sql(src: str, ids: str, text: str, name: str) -> str:
    """CTEs ``{name}`` = (ids, pos, t, s): tokens with sentence-start flags."""
    return f"""{name}_t AS (
  SELECT {ids}, unnest(generate_series(1, len(tk))) AS pos, unnest(tk) AS t
  FROM (SELECT {ids}, list_filter(string_split({text}, ' '), lambda x: x <> '') AS tk FROM {src})),
{name}_p AS (
  SELECT *, last_value(CASE WHEN t NOT IN {_in_list(DELAY_TOKENS)} THEN t END IGNORE NULLS)
            OVER (PARTITION BY {ids} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM {name}_t),
{name} AS (SELECT {ids}, pos, t, (prev IS NULL OR prev IN {_in_list(SENTENCE_END_TOKENS)}) AS s FROM {name}_p)"""


register("normalise_tokenise", f"WITH {TOKL} SELECT doc_id, line_in_doc::BIGINT AS line_in_doc, tok FROM tokl")

register("detokenise", f"""WITH {TOKL}
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc, {rules_sql('tok', DETOKENISE, 'lang')} AS text FROM tokl""")

ABBR = LINES + r""",
cores AS (
  SELECT lang, regexp_extract(tok, '^[^\p{L}]*([\p{L}][\p{L}.]*)[^\p{L}.]*$', 1) AS core
  FROM (SELECT lang, unnest(list_filter(string_split_regex(line, '""" + WS + r"""'), lambda t: t <> '')) AS tok FROM lines WHERE split = 'train')),
words AS (
  SELECT lang, lower(CASE WHEN ends_with(core, '.') THEN left(core, length(core) - 1) ELSE core END) AS word,
         count(*) FILTER (ends_with(core, '.')) AS n_dot, count(*) FILTER (NOT ends_with(core, '.')) AS n_plain
  FROM cores WHERE core <> '' GROUP BY ALL),
shares AS (SELECT lang, least(greatest(sum(n_dot) / sum(n_dot + n_plain), 1e-9), 1 - 1e-9) AS share FROM words GROUP BY lang),
weighed AS (
  SELECT lang, word, n_dot::BIGINT AS n_dot, n_plain::BIGINT AS n_plain, round(
         -2 * ((n_dot * ln(share) + n_plain * ln(1 - share)) - (n_dot * ln(0.99) + n_plain * ln(1 - 0.99::DOUBLE)))
         * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1)
         * pow(length(replace(word, '.', ''))::DOUBLE, -n_plain), 6) + 0.0 AS score
  FROM words JOIN shares USING (lang) WHERE n_dot > 0),
abbr AS (SELECT *, score >= 0.3 AS is_abbreviation FROM weighed)"""

register("sentence_fit", f"WITH {ABBR} SELECT lang, word, n_dot, n_plain, score, is_abbreviation FROM abbr")

def sentences_sql(src: str) -> str:
    """CTEs up to ``sents`` (doc_id, line_in_doc, lang, split, sent_no, sentence) of the lines in ``src``."""
    return f"""learnt AS (SELECT lang, list(word) AS words FROM abbr WHERE is_abbreviation GROUP BY lang),
cut AS (SELECT doc_id, line_in_doc, lang, split, coalesce(words, []) AS words,
               string_split(regexp_replace(line, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM {src} LEFT JOIN learnt USING (lang)),
piece AS (SELECT doc_id, line_in_doc, lang, split, words, unnest(range(len(parts))) AS i, unnest(parts) AS p,
                 unnest(list_concat([''], parts[1:len(parts) - 1])) AS before FROM cut),
tested AS (SELECT *, regexp_extract(before, '([\\p{{L}}][\\p{{L}}.]*)\\.$', 1) AS word FROM piece),
marked AS (
  SELECT *, CAST(i > 0 AND regexp_matches(p, '^[\\p{{Lu}}\\p{{N}}"(]')
                 AND NOT list_contains([{", ".join(f"'{x}'" for x in ABBREVIATIONS)}], word)
                 AND NOT list_contains(words, lower(word)) AS BIGINT) AS opens
  FROM tested),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line_in_doc ORDER BY i) AS sent_no FROM marked),
sents AS (SELECT doc_id, line_in_doc, lang, split, sent_no::BIGINT AS sent_no, trim(string_agg(p, ' ' ORDER BY i)) AS sentence
          FROM numbered GROUP BY doc_id, line_in_doc, lang, split, sent_no HAVING trim(string_agg(p, ' ' ORDER BY i)) <> '')"""


register("sentence_split", f"""WITH {ABBR}, {sentences_sql('lines')}
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc, sent_no, sentence FROM sents""")

TC_MODEL = TOKL + """,
trn AS (SELECT doc_id, line_in_doc, lang, tok FROM tokl WHERE split = 'train'),
""" + flags_sql("trn", "doc_id, line_in_doc, lang", "tok", "trf") + """,
tcc AS (SELECT lang, lower(t) AS lc, t AS form, count(*)::BIGINT AS n FROM trf WHERE NOT s GROUP BY ALL),
tcm AS (SELECT *, row_number() OVER (PARTITION BY lang, lc ORDER BY n DESC, form) = 1 AS is_best FROM tcc)"""

register("truecase_fit", f"WITH {TC_MODEL} SELECT lang, lc, form, n, is_best FROM tcm")

register("truecase_apply", f"""WITH {TC_MODEL},
dv AS (SELECT doc_id, line_in_doc, lang, tok FROM tokl),
{flags_sql('dv', 'doc_id, line_in_doc, lang', 'tok', 'dvf')},
nt AS (
  SELECT f.doc_id, f.line_in_doc, f.pos,
         CASE WHEN f.s AND b.form IS NOT NULL THEN b.form
              WHEN k.form IS NOT NULL THEN f.t
              WHEN b.form IS NOT NULL THEN b.form ELSE f.t END AS tok
  FROM dvf f
  LEFT JOIN (SELECT lang, lc, form FROM tcm WHERE is_best) b ON b.lang = f.lang AND b.lc = lower(f.t)
  LEFT JOIN tcm k ON k.lang = f.lang AND k.form = f.t),
agg AS (SELECT doc_id, line_in_doc, string_agg(tok, ' ' ORDER BY pos) AS text FROM nt GROUP BY doc_id, line_in_doc)
SELECT dv.doc_id, dv.line_in_doc::BIGINT AS line_in_doc, coalesce(agg.text, '') AS text
FROM dv LEFT JOIN agg USING (doc_id, line_in_doc)""")


def detruecase_sql(src: str, ids: str, text: str, name: str) -> str:
    return flags_sql(src, ids, text, name + "_f") + f""",
{name} AS (
  SELECT {ids}, string_agg(CASE WHEN s AND left(t, 1) <> 'ß' THEN upper(left(t, 1)) || substr(t, 2) ELSE t END,
                           ' ' ORDER BY pos) AS text
  FROM {name}_f GROUP BY {ids})"""


register("detruecase", f"""WITH {TOKL},
lw AS (SELECT doc_id, line_in_doc, lower(tok) AS tok FROM tokl),
{detruecase_sql('lw', 'doc_id, line_in_doc', 'tok', 'dt')}
SELECT lw.doc_id, lw.line_in_doc::BIGINT AS line_in_doc, coalesce(dt.text, '') AS text
FROM lw LEFT JOIN dt USING (doc_id, line_in_doc)""")

register("postprocess", f"""WITH {TOKL},
hy AS (SELECT doc_id, line_in_doc, lang, {char_pieces_sql('lower(tok)')} AS hyp FROM tokl),
dec AS (SELECT doc_id, line_in_doc, lang,
               replace(ltrim(translate(replace(hyp, ' ', ''), '▁', ' ')), '@@ ', '') AS tok FROM hy),
{detruecase_sql('dec', 'doc_id, line_in_doc', 'tok', 'dt')}
SELECT dec.doc_id, dec.line_in_doc::BIGINT AS line_in_doc,
       {rules_sql("coalesce(dt.text, '')", DETOKENISE, 'dec.lang')} AS text
FROM dec LEFT JOIN dt USING (doc_id, line_in_doc)""")


from ..operators.metrics import BLEU_13A, ENTITIES  # noqa: E402


def tok13a_sql(expr: str) -> str:
    s = f"replace(replace(replace({expr}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"(' ' || {s} || ' ')"
    for pat, rep in BLEU_13A:
        s = f"regexp_replace({s}, '{pat}', '{rep.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({s}, '{WS}'), lambda t: t <> '')"


def bleu_sql(src: str, ids: str, hyp: str, ref: str) -> str:
    """CTE chain ending in ``bleu_out``."""
    grams = " UNION ALL ".join(
        f"SELECT {ids}, {n} AS n, array_to_string(tk[i:i + {n - 1}], ' ') AS g, side "
        f"FROM (SELECT *, unnest(generate_series(1, len(tk) - {n - 1})) AS i FROM bt WHERE len(tk) >= {n})"
        for n in range(1, 5))
    logs = []
    for n in range(1, 5):
        zeros = " + ".join(f"(CASE WHEN t{k} > 0 AND m{k} = 0 THEN 1 ELSE 0 END)" for k in range(1, n + 1))
        p = (f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN m{n} = 0 THEN 100.0 / (pow(2.0, {zeros}) * t{n}) "
             f"ELSE 100.0 * m{n} / t{n} END)")
        logs.append(f"(CASE WHEN {p} > 0 THEN ln({p}) ELSE -9999999999.0 END)")
    return f"""bt AS (
  SELECT {ids}, 'h' AS side, {tok13a_sql(hyp)} AS tk FROM {src}
  UNION ALL SELECT {ids}, 'r' AS side, {tok13a_sql(ref)} AS tk FROM {src}),
bg AS ({grams}),
bc AS (SELECT n, {ids}, g, count(*) FILTER (WHERE side = 'h') AS ch, count(*) FILTER (WHERE side = 'r') AS cr
       FROM bg GROUP BY ALL),
bo AS (SELECT n, sum(least(ch, cr)) AS m, sum(ch) AS t FROM bc GROUP BY n),
bl AS (SELECT sum(len(tk)) FILTER (WHERE side = 'h') AS sys_len, sum(len(tk)) FILTER (WHERE side = 'r') AS ref_len FROM bt),
bw AS (SELECT bl.sys_len, bl.ref_len,
              {", ".join(f"coalesce((SELECT m FROM bo WHERE n = {n}), 0) AS m{n}, coalesce((SELECT t FROM bo WHERE n = {n}), 0) AS t{n}" for n in range(1, 5))}
       FROM bl),
bp AS (SELECT *, CASE WHEN sys_len >= ref_len THEN 1.0 WHEN sys_len = 0 THEN 0.0
                      ELSE exp(1 - ref_len / sys_len) END AS bp FROM bw),
bleu_out AS (
  SELECT round(bp * exp(({" + ".join(logs)}) / 4.0), 6) AS bleu, round(bp, 6) AS bp,
         sys_len::BIGINT AS sys_len, ref_len::BIGINT AS ref_len,
         {", ".join(f"m{n}::BIGINT AS matches_{n}" for n in range(1, 5))},
         {", ".join(f"t{n}::BIGINT AS total_{n}" for n in range(1, 5))}
  FROM bp)"""


register("bleu", f"""WITH {PAIRS},
bp_in AS (SELECT conv_id, turn, src AS hyp, tgt AS ref FROM pairs),
{bleu_sql('bp_in', 'conv_id, turn', 'hyp', 'ref')}
SELECT * FROM bleu_out""")

register("score_dev", f"""WITH {PAIRS},
hy AS (SELECT conv_id, turn, 'en' AS lang, tgt AS ref,
              {char_pieces_sql('lower(' + normalise_tokenise_sql('src') + ')')} AS hyp FROM pairs),
dec AS (SELECT conv_id, turn, lang, ref,
               replace(ltrim(translate(replace(hyp, ' ', ''), '▁', ' ')), '@@ ', '') AS tok FROM hy),
{detruecase_sql('dec', 'conv_id, turn', 'tok', 'dt')},
sd AS (SELECT dec.conv_id, dec.turn, dec.ref,
              {rules_sql("coalesce(dt.text, '')", DETOKENISE, 'dec.lang')} AS hyp
       FROM dec LEFT JOIN dt USING (conv_id, turn)),
{bleu_sql('sd', 'conv_id, turn', 'hyp', 'ref')}
SELECT *, 0::BIGINT AS unmatched_hyps, 0::BIGINT AS unmatched_refs FROM bleu_out""")


# Colons are doubled first, so that neighbouring pairs need not share one.
SCALARS = """logs AS (
  SELECT user_id % 4 AS run, event_id AS line_no,
         CASE WHEN event_id % 100 = 0
              THEN '[2020] Ep. 1 : Up. ' || event_id || ' : Sen. 64,000 : Cost ' || value || ' : Time 3.1s : L.r. 3.0e-04'
              WHEN event_id % 100 = 50 THEN 'n_lines: ' || event_id || ', ' || value || ' % of oov tokens : acc : 0.5 : ' || event_type || ' : ' || value || ' :'
              ELSE ': ' || event_type || ' : ' || value || ' :' END AS line
  FROM events),
tagged AS (
  SELECT run, line_no, line, replace(line, ':', '::') AS d,
         nullif(regexp_extract(line, ': Up\\. ([0-9]+) :', 1), '')::BIGINT AS step_here FROM logs),
filled AS (
  SELECT *, last_value(step_here IGNORE NULLS) OVER (PARTITION BY run ORDER BY line_no
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step
  FROM tagged),
found AS (
  SELECT run, line_no, step, 'nlines' AS key, unnest(regexp_extract_all(line, 'n_lines: ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1)) AS v FROM filled
  UNION ALL
  SELECT run, line_no, step, 'oov', unnest(regexp_extract_all(line, '([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?) % of oov tokens', 1)) FROM filled
  UNION ALL
  SELECT run, line_no, step, 'BLEU', unnest(regexp_extract_all(line, 'BLEU[^ ]* = ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1)) FROM filled
  UNION ALL
  SELECT run, line_no, step, 'lr', unnest(regexp_extract_all(line, 'L\\.r\\. ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1)) FROM filled
  UNION ALL
  SELECT run, line_no, step, unnest(regexp_extract_all(d, ': ([^ :]+) :: ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?) :', 1)),
         unnest(regexp_extract_all(d, ': ([^ :]+) :: ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?) :', 2)) FROM filled
  UNION ALL
  SELECT run, line_no, step, unnest(regexp_extract_all(d, ': ([^ :]+) ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?) :', 1)),
         unnest(regexp_extract_all(d, ': ([^ :]+) ([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?) :', 2)) FROM filled),
scalars AS (SELECT run, line_no, step, key, CAST(v AS DOUBLE) AS value FROM found WHERE key <> 'Up.')"""

register("log_scalars", f"WITH {SCALARS} SELECT * FROM scalars")

register("best_checkpoint", f"""WITH {SCALARS},
m AS (SELECT * FROM scalars WHERE key = 'purchase' AND step IS NOT NULL),
r AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY value DESC, step) AS rk FROM m)
SELECT run, step AS best_step, value AS best_value FROM r WHERE rk = 1""")

register("early_stop", f"""WITH {SCALARS},
m AS (SELECT run, line_no, step, value, row_number() OVER (PARTITION BY run ORDER BY line_no) - 1 AS idx
      FROM scalars WHERE key = 'purchase'),
p AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb
      FROM m),
q AS (SELECT *, max(CASE WHEN pb IS NULL OR value > pb THEN idx END)
                OVER (PARTITION BY run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM p),
fs AS (SELECT run, min(idx) AS i FROM q WHERE idx - li >= 10 GROUP BY run),
nv AS (SELECT run, count(*)::BIGINT AS n_validations FROM m GROUP BY run)
SELECT nv.run, q.step AS stop_step, nv.n_validations
FROM nv LEFT JOIN fs ON fs.run = nv.run LEFT JOIN q ON q.run = fs.run AND q.idx = fs.i""")


def chars_sql(expr: str) -> str:
    return f"list_filter(string_split({expr}, ''), lambda x: x <> '')"


def _marked(expr: str) -> str:
    return f"('▁' || array_to_string(list_filter(string_split_regex({expr}, '{WS}'), lambda t: t <> ''), '▁'))"


register("char_vocab", f"""WITH {TOKL},
c AS (SELECT lang, unnest({chars_sql(_marked('tok'))}) AS piece FROM tokl WHERE split = 'train'),
n AS (SELECT lang, piece, count(*)::BIGINT AS n FROM c GROUP BY lang, piece),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, piece) AS rk,
             sum(n) OVER (PARTITION BY lang) AS total FROM n)
SELECT lang, (rk + 2)::INTEGER AS id, piece, n, round(ln(n / total), 6) AS score FROM r""")

register("bpe_pair_counts", f"""WITH {TOKL},
w AS (SELECT lang, unnest(list_filter(string_split_regex(tok, '{WS}'), lambda t: t <> '')) AS word
      FROM tokl WHERE split = 'train'),
wf AS (SELECT lang, word, count(*) AS freq, {chars_sql("'▁' || word")} AS s FROM w GROUP BY lang, word),
p AS (SELECT lang, freq, s[i] AS l, s[i + 1] AS r FROM (SELECT *, unnest(generate_series(1, len(s) - 1)) AS i
      FROM wf WHERE len(s) > 1))
SELECT lang, l AS "left", r AS "right", sum(freq)::BIGINT AS n FROM p GROUP BY lang, l, r""")

register("subword_encode", f"""WITH {TOKL}
SELECT doc_id, line_in_doc::BIGINT AS line_in_doc, {char_pieces_sql('tok')} AS pieces FROM tokl""")

register("numericalise", f"""WITH {TOKL},
c AS (SELECT unnest({chars_sql(_marked('tok'))}) AS piece FROM tokl WHERE split = 'train'),
v AS (SELECT piece, (row_number() OVER (ORDER BY count(*) DESC, piece) + 1)::INTEGER AS id FROM c GROUP BY piece),
d AS (SELECT doc_id, line_in_doc, string_split({char_pieces_sql('tok')}, ' ') AS ps FROM tokl),
e AS (SELECT doc_id, line_in_doc, unnest(generate_series(1, len(ps))) AS pos, unnest(ps) AS piece FROM d),
j AS (SELECT e.doc_id, e.line_in_doc, e.pos, coalesce(v.id, 1) AS id FROM e LEFT JOIN v USING (piece)
      WHERE e.piece <> ''),
a AS (SELECT doc_id, line_in_doc, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM j
      GROUP BY doc_id, line_in_doc)
SELECT d.doc_id, d.line_in_doc::BIGINT AS line_in_doc,
       CASE WHEN a.ids IS NULL THEN '0' ELSE a.ids || ' 0' END AS ids
FROM d LEFT JOIN a USING (doc_id, line_in_doc)""")


def truecase_sql(fit_src: str, apply_src: str, ids: str, text: str, name: str, group: str | None = None) -> str:
    """CTE chain: fit a truecaser on ``fit_src`` and apply it to ``apply_src``;
    ``{name}`` = (ids, text) with every row of ``apply_src``."""
    g = f"{group}, " if group else ""
    gj = (lambda a, b: f"{a}.{group} = {b}.{group} AND ") if group else (lambda a, b: "")
    fit_ids = f"{ids}, {group}" if group else ids
    return f"""{flags_sql(fit_src, fit_ids, text, name + '_ff')},
{name}_c AS (SELECT {g}lower(t) AS lc, t AS form, count(*) AS n FROM {name}_ff WHERE NOT s GROUP BY ALL),
{name}_m AS (SELECT *, row_number() OVER (PARTITION BY {g}lc ORDER BY n DESC, form) = 1 AS is_best FROM {name}_c),
{flags_sql(apply_src, fit_ids, text, name + '_af')},
{name}_nt AS (
  SELECT {", ".join("f." + c for c in fit_ids.split(", "))}, f.pos,
         CASE WHEN f.s AND b.form IS NOT NULL THEN b.form WHEN k.form IS NOT NULL THEN f.t
              WHEN b.form IS NOT NULL THEN b.form ELSE f.t END AS tok
  FROM {name}_af f
  LEFT JOIN (SELECT * FROM {name}_m WHERE is_best) b ON {gj('b', 'f')}b.lc = lower(f.t)
  LEFT JOIN {name}_m k ON {gj('k', 'f')}k.form = f.t),
{name}_ag AS (SELECT {fit_ids}, string_agg(tok, ' ' ORDER BY pos) AS text FROM {name}_nt GROUP BY {fit_ids}),
{name} AS (SELECT {", ".join("a." + c for c in fit_ids.split(", "))}, coalesce(g.text, '') AS text
           FROM {apply_src} a LEFT JOIN {name}_ag g USING ({fit_ids}))"""


_LF = ORACLE["lid_filter"]
_LF_CTE = _LF[len("WITH "):_LF.index("\nSELECT bp.line_no, bp.split, bp.src, bp.tgt FROM bp")]
register("preprocess_corpus", f"""WITH {_LF_CTE},
lf AS (SELECT bp.line_no, bp.split, bp.src, bp.tgt FROM bp JOIN ps USING (line_no) JOIN pt USING (line_no)
       WHERE bp.split <> 'train' OR (ps.ps = 'fr' AND pt.pt = 'en')),
tk AS (SELECT line_no, split, {normalise_tokenise_sql('src', "'fr'")} AS src,
              {normalise_tokenise_sql('tgt', "'en'")} AS tgt FROM lf),
cl AS (SELECT * FROM (SELECT *, len(list_filter(string_split_regex(src, '{WS}'), lambda t: t <> '')) AS a,
                               len(list_filter(string_split_regex(tgt, '{WS}'), lambda t: t <> '')) AS b FROM tk)
       WHERE split <> 'train' OR (a BETWEEN 1 AND 100 AND b BETWEEN 1 AND 100 AND a / b <= 1.8 AND b / a <= 1.8)),
s_all AS (SELECT line_no, split, src FROM cl), s_fit AS (SELECT * FROM s_all WHERE split = 'train'),
t_all AS (SELECT line_no, split, tgt FROM cl), t_fit AS (SELECT * FROM t_all WHERE split = 'train'),
{truecase_sql('s_fit', 's_all', 'line_no', 'src', 'tcs')},
{truecase_sql('t_fit', 't_all', 'line_no', 'tgt', 'tct')}
SELECT cl.line_no, cl.split, tcs.text AS src, tct.text AS tgt
FROM cl JOIN tcs USING (line_no) JOIN tct USING (line_no)""")

register("preprocess_monolingual", f"""WITH {TOKL},
ml AS (SELECT doc_id, line_in_doc, lang, split, tok FROM tokl
       WHERE split <> 'train' OR len(list_filter(string_split_regex(tok, '{WS}'), lambda t: t <> '')) < 100),
mf AS (SELECT * FROM ml WHERE split = 'train'),
{truecase_sql('mf', 'ml', 'doc_id, line_in_doc', 'tok', 'tcm2', 'lang')}
SELECT ml.doc_id, ml.line_in_doc::BIGINT AS line_in_doc, ml.lang, ml.split, tcm2.text
FROM ml JOIN tcm2 USING (doc_id, line_in_doc, lang)""")


register("recipe_monolingual", f"""WITH {ABBR},
fitted AS (SELECT * FROM lines WHERE split = 'train'),
{sentences_sql('fitted')},
rows_ AS (SELECT doc_id, line_in_doc, sent_no, lang, split, sentence AS line FROM sents
          UNION ALL SELECT doc_id, line_in_doc, 0, lang, split, line FROM lines WHERE split <> 'train'),
rt AS (SELECT *, {normalise_tokenise_sql('line', 'lang')} AS tok FROM rows_),
ml AS (SELECT doc_id, line_in_doc, sent_no, lang, split, tok FROM rt
       WHERE split <> 'train' OR len(list_filter(string_split_regex(tok, '{WS}'), lambda t: t <> '')) < 100),
mf AS (SELECT * FROM ml WHERE split = 'train'),
{truecase_sql('mf', 'ml', 'doc_id, line_in_doc, sent_no', 'tok', 'tcm2', 'lang')},
pos AS (SELECT doc_id, line_in_doc, sent_no, row_number() OVER (PARTITION BY split ORDER BY
               md5('42:' || doc_id || ':' || line_in_doc || ':' || sent_no), doc_id || ':' || line_in_doc || ':' || sent_no) - 1 AS pos FROM ml)
SELECT ml.doc_id, ml.line_in_doc::BIGINT AS line_in_doc, ml.sent_no::BIGINT AS sent_no, ml.lang, ml.split, pos.pos::BIGINT AS pos, tcm2.text
FROM ml JOIN tcm2 USING (doc_id, line_in_doc, sent_no, lang) JOIN pos USING (doc_id, line_in_doc, sent_no)""")


_VOCAB_FILE = f"""{TOKL},
vc AS (SELECT unnest({chars_sql(_marked('tok'))}) AS piece FROM tokl WHERE split = 'train'),
vn AS (SELECT piece, count(*) AS n FROM vc GROUP BY piece),
vr AS (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + 2 AS id,
              round(ln(n / sum(n) OVER ()), 6) AS score FROM vn)"""

register("vocab_read", f"""WITH {_VOCAB_FILE}
SELECT (id - 3)::INTEGER AS id, piece, score FROM vr""")

register("vocab_dict", f"""WITH {_VOCAB_FILE}
SELECT (id - 3)::INTEGER AS id, piece || ' 100' AS line FROM vr""")

_RS = ORACLE["reshuffle_split"]
register("relabel_split", _RS.replace(
    "SELECT doc_id, CASE WHEN pos < (SELECT n_train FROM n) THEN 'train' ELSE 'valid' END AS split FROM p",
    "SELECT doc_id, CASE WHEN pos < (SELECT n_train FROM n) THEN 'train' ELSE 'val' END AS split FROM p"))

register("corpus_registry", f"""WITH {LINES}
SELECT source || ':' || split AS corpus, split AS role, count(*)::BIGINT AS n_lines FROM lines GROUP BY source, split""")

register("vocab_json", f"""WITH {_VOCAB_FILE}
SELECT piece, (id - 1)::INTEGER AS id FROM vr
UNION ALL SELECT '</s>', 0 UNION ALL SELECT '<unk>', 1""")

register("write_pairs", f"""WITH {PAIRS},
k AS (SELECT conv_id || '-' || turn AS id, src, tgt FROM pairs),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS r FROM k)
SELECT id, CASE WHEN r < 100 THEN 'val' WHEN r < 200 THEN 'dev' ELSE 'train' END AS split, src, tgt FROM r""")

register("recipe_concatenated", f"""WITH {LINES}, {lang_file('fr', 'fr_f')}, {lang_file('en', 'en_f')},
{lang_file('es', 'es_f')}, {lang_file('de', 'de_f')},
c AS (SELECT 'fr-en' AS origin, 'fr-en:' || line_no AS id, src, tgt FROM ({_paste('fr_f', 'en_f')})
      UNION ALL SELECT 'es-de', 'es-de:' || line_no, src, tgt FROM ({_paste('es_f', 'de_f')})),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS r FROM c)
SELECT origin, id, CASE WHEN r < 512 THEN 'val' WHEN r < 1024 THEN 'dev' ELSE 'train' END AS split, src, tgt FROM r""")

register("recipe_resampled", f"""WITH {LINES}, {lang_file('fr', 'fr_f')}, {lang_file('en', 'en_f')},
p AS ({_paste('fr_f', 'en_f')}),
n AS (SELECT count(*) AS n_train FROM p WHERE {hash_unit_sql('CAST(line_no AS VARCHAR)')} >= 0.2),
r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || line_no), line_no) - 1 AS pos,
             CAST('0x' || substr(md5('7:' || line_no), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM p),
s AS (SELECT *, CASE WHEN pos < (SELECT n_train FROM n) THEN 'train' ELSE 'val' END AS split FROM r)
SELECT line_no, split, src, tgt FROM s WHERE split = 'val' OR ((u <= 0.3 OR line_no = 0) AND src <> '')""")

register("recipe_size_matched", f"""WITH {LINES}, {lang_file('fr', 'fr_f')}, {lang_file('en', 'en_f')},
{lang_file('es', 'es_f')}, {lang_file('de', 'de_f')},
a AS (SELECT line_no, row_number() OVER (ORDER BY md5('42:' || line_no), line_no) - 1 AS r FROM ({_paste('fr_f', 'en_f')})),
n AS (SELECT greatest(0, count(*) - 1024) AS n FROM ({_paste('es_f', 'de_f')})),
t AS (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM a WHERE r >= 1024)
SELECT line_no, 'train' AS split FROM t WHERE pos < (SELECT n FROM n)
UNION ALL SELECT line_no, CASE WHEN r < 512 THEN 'val' ELSE 'dev' END FROM a WHERE r < 1024""")

register("recipe_evaluation_only", f"""WITH {TOKL}, {_BP_CTE.replace(LINES + ",", "", 1)},
bp AS (SELECT line_no, CASE WHEN r < 4096 THEN 'val' WHEN r < 8192 THEN 'dev' ELSE 'train' END AS split, src, tgt FROM r),
tk AS (SELECT line_no, split, {normalise_tokenise_sql('src', "'fr'")} AS src,
              {normalise_tokenise_sql('tgt', "'en'")} AS tgt FROM bp),
f_fr AS (SELECT doc_id || ':' || line_in_doc AS line_no, tok AS src FROM tokl WHERE lang = 'fr' AND split = 'train'),
f_en AS (SELECT doc_id || ':' || line_in_doc AS line_no, tok AS tgt FROM tokl WHERE lang = 'en' AND split = 'train'),
s_all AS (SELECT line_no, src FROM tk), t_all AS (SELECT line_no, tgt FROM tk),
{truecase_sql('f_fr', 's_all', 'line_no', 'src', 'tcs')},
{truecase_sql('f_en', 't_all', 'line_no', 'tgt', 'tct')}
SELECT tk.line_no, tk.split, tcs.text AS src, tct.text AS tgt
FROM tk JOIN tcs USING (line_no) JOIN tct USING (line_no)""")


def _segment_chars(joint: bool, cap: int | None = None) -> str:
    by, on = ("", "USING (piece)") if joint else ("PARTITION BY side ", "USING (side, piece)")
    keys = "piece" if joint else "side, piece"
    return f"""WITH {PAIRS},
k AS (SELECT conv_id || '-' || turn AS id, src, tgt FROM pairs),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS r FROM k),
p AS (SELECT *, CASE WHEN r < 50 THEN 'val' WHEN r < 100 THEN 'dev' ELSE 'train' END AS split FROM r),
t AS (SELECT id, split, 'src' AS side, src AS text FROM p UNION ALL SELECT id, split, 'tgt', tgt FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('42:' || id || ':' || side), id) AS nth FROM t WHERE split = 'train'),
c AS (SELECT side, unnest({chars_sql(_marked('text'))}) AS piece FROM n {f"WHERE nth <= {cap}" if cap else ""}),
v AS (SELECT {keys}, (row_number() OVER ({by}ORDER BY count(*) DESC, piece) + 1)::INTEGER AS id FROM c GROUP BY {keys}),
d AS (SELECT id, side, split, string_split({char_pieces_sql('text')}, ' ') AS ps FROM t),
e AS (SELECT id AS line, side, unnest(generate_series(1, len(ps))) AS pos, unnest(ps) AS piece FROM d),
j AS (SELECT e.line, e.side, e.pos, coalesce(v.id, 1) AS n FROM e LEFT JOIN v {on} WHERE e.piece <> ''),
a AS (SELECT line AS id, side, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY pos) || ' 0' AS ids FROM j GROUP BY line, side)
SELECT id, side, split, len(string_split(coalesce(ids, '0'), ' '))::BIGINT AS n_ids, coalesce(ids, '0') AS ids
FROM d LEFT JOIN a USING (id, side)"""


register("segment_chars", _segment_chars(joint=False))
register("segment_chars_joint", _segment_chars(joint=True))
register("segment_capped", _segment_chars(joint=False, cap=100))
