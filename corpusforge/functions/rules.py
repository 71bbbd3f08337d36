"""Rule tables for normalisation, tokenisation, detokenisation and sentence
splitting, applied as chains of ``regexp_replace``.

These are our own rules (documented, tested), written without look-around or
back-references so that an RE2 engine can run exactly the same chain. A rule
is ``(pattern, replacement, langs)``: ``langs`` None applies everywhere, a
tuple restricts it to those languages, a tuple starting with ``"!"`` excludes
them. Replacements use ``$n`` for groups.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

Rule = tuple[str, str, "tuple[str, ...] | None"]

# ---- fixed values: one-character mappings (one ``translate`` pass; a
# character without a counterpart is deleted) ----------------------------------
TRANSLATE_FROM = "\u201c\u201d\u201e\u201f\u00ab\u00bb\u2018\u2019\u201a\u201b\u00b4`\u2013\u00a0\u202f\u2009\u3000\r"
# six double-quote forms, six apostrophe forms, en dash, four spaces; CR is dropped
TRANSLATE_TO = '"' * 6 + "'" * 6 + "-" + " " * 4

# ---- fixed values: spaces inside French quotes, while these can be told from others
QUOTE_SPACES: list[Rule] = [
    ("\u00ab[ \u00a0\u202f\u2009]+", "\u00ab", None),
    ("[ \u00a0\u202f\u2009]+\u00bb", "\u00bb", None),
]

# ---- fixed values: punctuation normalisation -------------------------------
# a comma goes outside the closing quote in German, Spanish and French, commas and
# stops go inside it in English; French keeps a space before high marks
NORMALISE: list[Rule] = [
    (',"', '",', ("de", "es", "fr")),
    ('"([,.]+)', '$1"', ("en",)),
    ("\u2026", "...", None),
    ("\u2014", " - ", None),
    (" +([:;?!%])", "$1", ("!", "fr")),
    (" {2,}", " ", None),
    ("^ ", "", None),
    (" $", "", None),
]

# ---- fixed values: tokenisation (after NORMALISE) -------------------------
TOKENISE: list[Rule] = [
    ("([^\\p{L}\\p{N} \\t.',\\-])", " $1 ", None),
    ("([\\p{L}\\p{N}])-([\\p{L}\\p{N}])", "$1 @-@ $2", None),
    ("([\\p{L}\\p{N}])-([\\p{L}\\p{N}])", "$1 @-@ $2", None),
    ("([^\\p{N}]),", "$1 , ", None),
    (",([^\\p{N}])", " , $1", None),
    (",$", " ,", None),
    ("([\\p{L}])'([\\p{L}])", "$1 '$2", ("en",)),
    ("([\\p{L}])'([\\p{L}])", "$1' $2", ("fr",)),
    ("[ \\t]+", " ", None),
    ("^ ", "", None),
    (" $", "", None),
]

# ---- fixed values: words that keep their full stop, by language ---------------
PREFIXES = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt Maj Gov Sen Rep Pres St Jr Sr Mt Inc Ltd Co Corp vs cf etc approx Jan Feb Aug Sept Oct Nov Dec".split(),
    "de": "Hr Fr Frl Dr Prof Dipl Ing Abb bzw ca evtl ggf inkl max min Mio Mrd Nr sog Str u usw vgl z zzgl d h B i a s o Bd Jh Chr".split(),
    "fr": "M MM Mme Mlle Me Mgr Dr Pr St Ste av boul chap env ex fig p pp vol art".split(),
    "es": "Sr Sra Srta Sres Dr Dra Prof D Ud Uds Excmo Lic Ing Av Avda C pág págs cap ej etc".split(),
}
# words that keep it before a number only
NUMBER_PREFIXES = {"en": "No Nos Art pp p Fig Vol".split(), "de": "Nr Art Abs S Kap Bd".split(), "fr": "n nos no art".split(), "es": "núm núms n art".split()}

# ---- fixed values: detokenisation ------------------------------------------
DETOKENISE: list[Rule] = [
    (" @-@ ", "-", None),
    (" ([.,%)\\]}])", "$1", None),
    (" ([:;?!])", "$1", ("!", "fr")),
    ("([(\\[{\u00bf\u00a1]) ", "$1", None),
    (" '(\\p{L})", "'$1", ("en",)),
    ("(\\p{L})' ", "$1'", ("fr",)),
    ('" ([^"]*) "', '"$1"', None),
    (" {2,}", " ", None),
    ("^ ", "", None),
    (" $", "", None),
]

# ---- fixed values: abbreviations whose point ends no sentence ----------------
ABBREVIATIONS = ("Mr Mrs Ms Dr Prof Rev Gen Col Capt Lt Sgt St Jr Sr Fig No vs cf "
                 "Hr Fr Nr Abb bzw ca Bd Mme Mlle Me M Ste Sra Srta Dra Ud Uds").split()

# ---- fixed values: sentence boundaries --------------------------------------
# the space after an abbreviation is held as U+0001 while sentences are cut;
# neighbouring abbreviations share a space, hence the rule runs twice
_HELD = ("(^|[^\\p{L}])(" + "|".join(ABBREVIATIONS) + ")\\. +", "$1$2.\u0001", None)
SENTENCE_BREAK: list[Rule] = [
    _HELD,
    _HELD,
    ("([.!?]) +([\\p{Lu}\\p{N}\"(])", "$1\n$2", None),
    ("\u0001", " ", None),
]

# ---- fixed values: sentence-start logic for truecasing -----------------------
SENTENCE_END_TOKENS = [".", ":", "?", "!"]
DELAY_TOKENS = ['"', "'", "(", "[", "\u00bf", "\u00a1"]


def _rule_applies(langs, lang: str | None) -> bool:
    """Does a rule apply to ``lang`` (None = a language no rule names)?"""
    if langs is None:
        return True
    if langs[0] == "!":
        return lang is None or lang not in langs[1:]
    return lang is not None and lang in langs


def _variants(rules: list[Rule]) -> list[str]:
    names = {x for _, _, langs in rules if langs for x in langs if x != "!"}
    return sorted(names)


# strings of which a text must contain one for the rule to change it; the rule is left out for other texts
NEEDS: dict[str, tuple[str, ...]] = {
    ',"': (',"',), '"([,.]+)': ('"',), "\u2026": ("\u2026",), "\u2014": ("\u2014",), " +([:;?!%])": (" :", " ;", " ?", " !", " %"), " {2,}": ("  ",),
    "([\\p{L}\\p{N}])-([\\p{L}\\p{N}])": ("-",), "([^\\p{N}]),": (",",), ",([^\\p{N}])": (",",), ",$": (",",),
    "([\\p{L}])'([\\p{L}])": ("'",), "[ \\t]+": ("  ", "\t"),
    " @-@ ": (" @-@ ",), " ([:;?!])": (" :", " ;", " ?", " !"), "([(\\[{\u00bf\u00a1]) ": ("( ", "[ ", "{ ", "\u00bf ", "\u00a1 "),
    " '(\\p{L})": (" '",), "(\\p{L})' ": ("' ",), '" ([^"]*) "': ('" ',),
}


def _chain(c: Column, rules: list[Rule], lang: str | None) -> Column:
    out = c
    for needs, some in groupby((r for r in rules if _rule_applies(r[2], lang)), key=lambda r: NEEDS.get(r[0])):
        def replaced(x: Column, some=tuple(some)) -> Column:
            for pat, rep, _ in some:
                x = F.regexp_replace(x, pat, rep)
            return x
        out = replaced(out) if needs is None else _where_any(out, needs, replaced)
    return out


def _where_any(c: Column, needs: tuple[str, ...], change) -> Column:
    """``change`` of the texts that contain one of the strings; the text is bound once, not worked out for every use."""
    return F.get(F.transform(F.array(c), lambda x: F.when(reduce(or_, [x.contains(n) for n in needs]), change(x)).otherwise(x)), F.lit(0))


def apply_rules(c, rules: list[Rule], lang_col: str | None = None) -> Column:
    """Chain of ``regexp_replace``. With ``lang_col`` the chain is built once
    per language that some rule names, plus one default chain, under a single
    CASE: the expression stays linear in the number of rules."""
    base = col_of(c)
    variants = _variants(rules) if lang_col else []
    if not variants:
        return _chain(base, [r for r in rules if r[2] is None], None)
    out = None
    for v in variants:
        branch = _chain(base, rules, v)
        cond = F.col(lang_col) == F.lit(v)
        out = F.when(cond, branch) if out is None else out.when(cond, branch)
    return out.otherwise(_chain(base, rules, None))


def _plain(c) -> Column:
    text = col_of(c)  # most texts have none of these characters
    return F.when(text.rlike(f"[{TRANSLATE_FROM}]"), F.translate(apply_rules(text, QUOTE_SPACES), TRANSLATE_FROM, TRANSLATE_TO)).otherwise(text)


def normalise(c, lang_col: str | None = None) -> Column:
    return apply_rules(_plain(c), NORMALISE, lang_col)


def _listed(word: Column, lists: dict[str, list[str]], lang_col: str | None) -> Column:
    """Is the word in its language's list (in none without a language)?"""
    out = F.lit(False)
    for lang, words in lists.items() if lang_col else ():
        out = out | ((F.col(lang_col) == lang) & word.isin(words))
    return F.coalesce(out, F.lit(False))


def split_stops(text: Column, lang_col: str | None = None) -> Column:
    """Tokenised text in which a word's full stop is a token of its own, unless it belongs to the word.

    It does within a line if the word has an inner stop and a letter, is in its language's ``PREFIXES``, comes before a
    lower-case word, or is in ``NUMBER_PREFIXES`` and comes before a digit. The last word of a line always loses it, an
    ellipsis is left alone. The line is cut behind the words that end in a full stop, so that only these are looked at."""
    def of(parts: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            after, token = F.get(parts, i + 1), F.substring_index(part, " ", -1)
            word = F.substring(token, F.lit(1), F.length(token) - 1)
            kept = after.isNotNull() & (
                after.rlike(r"^\p{Ll}") | (word.contains(".") & word.rlike(r"\p{L}")) | _listed(word, PREFIXES, lang_col)
                | (after.rlike("^[0-9]") & _listed(word, NUMBER_PREFIXES, lang_col)))
            ends = after.isNotNull() | part.rlike(r"[^ .]\.\z")
            return F.when(ends & ~F.coalesce(kept, F.lit(False)), F.concat(F.substring(part, F.lit(1), F.length(part) - 1), F.lit(" ."))).otherwise(part)
        return F.array_join(F.transform(parts, one), " ")
    # the array is bound once, not worked out for every element
    return F.get(F.transform(F.array(F.split(text, r"(?<=[^ .]\.) ", -1)), of), F.lit(0))


def normalise_tokenise(c, lang_col: str | None = None) -> Column:
    return split_stops(apply_rules(_plain(c), NORMALISE + TOKENISE, lang_col), lang_col)


def detokenise(c, lang_col: str | None = None) -> Column:
    return apply_rules(c, DETOKENISE, lang_col)


def sentence_breaks(c) -> Column:
    return apply_rules(c, SENTENCE_BREAK)


# ---- the same chains as SQL text for an RE2 engine -----------------------------

def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_replacement(rep: str) -> str:
    out, i = [], 0
    while i < len(rep):
        if rep[i] == "$" and i + 1 < len(rep) and rep[i + 1].isdigit():
            out.append("\\" + rep[i + 1])
            i += 2
        else:
            out.append("\\\\" if rep[i] == "\\" else rep[i])
            i += 1
    return "".join(out)


def _sql_pattern(pat: str) -> str:
    return pat.replace("\r", "\\r").replace("\n", "\\n").replace("\t", "\\t")


def _chain_sql(expr: str, rules: list[Rule], lang: str | None) -> str:
    out = expr
    for pat, rep, langs in rules:
        if _rule_applies(langs, lang):
            out = (f"regexp_replace({out}, {_sql_literal(_sql_pattern(pat))}, "
                   f"{_sql_literal(_sql_replacement(rep))}, 'g')")
    return out


def rules_sql(expr: str, rules: list[Rule], lang_expr: str | None = None) -> str:
    variants = _variants(rules) if lang_expr else []
    if not variants:
        return _chain_sql(expr, [r for r in rules if r[2] is None], None)
    arms = " ".join(f"WHEN {lang_expr} = {_sql_literal(v)} THEN {_chain_sql(expr, rules, v)}" for v in variants)
    return f"(CASE {arms} ELSE {_chain_sql(expr, rules, None)} END)"


def translate_sql(expr: str) -> str:
    return (f"translate({rules_sql(expr, QUOTE_SPACES)}, {_sql_literal(TRANSLATE_FROM.replace(chr(13), ''))} || chr(13), "
            f"{_sql_literal(TRANSLATE_TO)})")


def normalise_tokenise_sql(expr: str, lang_expr: str | None = None) -> str:
    """The rule chain from the same tables; the full stops by SQL of their own."""
    def listed(lists: dict[str, list[str]]) -> str:
        if not lang_expr:
            return "false"
        return f"list_contains(CASE {lang_expr} " + " ".join(
            f"WHEN '{lang}' THEN [{', '.join(map(_sql_literal, words))}]" for lang, words in lists.items()) + " ELSE [] END, x[1:-2])"

    kept = (f"(contains(x[1:-2], '.') AND regexp_matches(x, '\\p{{L}}')) OR {listed(PREFIXES)} OR regexp_matches(t[i + 1], '^\\p{{Ll}}') "
            f"OR ({listed(NUMBER_PREFIXES)} AND regexp_matches(t[i + 1], '^[0-9]'))")
    return (f"list_transform([string_split({rules_sql(translate_sql(expr), NORMALISE + TOKENISE, lang_expr)}, ' ')], lambda t: array_to_string("
            f"list_transform(t, lambda x, i: CASE WHEN regexp_matches(x, '[^.]\\.$') AND NOT (i < len(t) AND ({kept})) THEN x[1:-2] || ' .' ELSE x END), ' '))[1]")
