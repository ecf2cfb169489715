"""Queries of the text functions over all samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.samples import SAMPLES_SQL, samples

_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"regexp_replace(regexp_replace(%s, '^{_WS}+', ''), '{_WS}+$', '')"
_TIDY = _STRIP % f"regexp_replace(regexp_replace(%s, '{_WS}+([.,!?、。])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g')"


def _query(columns):
    return lambda spark, sf_dir: samples(spark, sf_dir).select("part", "id", *columns(F.col("text")))


def _one(f):
    return _query(lambda t: [f(t).alias("value")])


def _sql(value: str) -> str:
    return f"WITH {SAMPLES_SQL} SELECT part, id, {value} AS value FROM samples"


_S = _STRIP % "text"
_MIXED = (
    "regexp_matches(text, '[가-힣][A-Za-z0-9]{1,2}([^A-Za-z0-9]|$)|(^|[^A-Za-z0-9])[A-Za-z0-9]{1,2}[가-힣]')"
    " OR len(list_filter(range(1, greatest(length(text) - 2, 1)), lambda i: text[i] <> chr(10) AND text[i] = text[i+1] AND text[i] = text[i+2] AND text[i] = text[i+3])) > 0"
)
_HEADING = f"(length(text) <= 60 AND NOT regexp_matches(regexp_replace(text, '{_WS}+$', ''), '[.!?。」』\"''’”)\\]]$'))"
_FIGURE = f"(length({_S}) BETWEEN 1 AND 40 AND NOT regexp_matches({_S}, '[.!?。」』]$') AND NOT regexp_matches({_S}, '[가-힣]{{4}}') AND (regexp_matches({_S}, '[←→↑↓↔⇐⇒⇔∠△▲□■○●◇◆※＊✓✔·•]') OR len(regexp_extract_all({_S}, '[가-힣]')) <= 2))"
_NUMBERS = "[가-힣\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
_PARENS = f"""
WITH {SAMPLES_SQL},
c AS (SELECT part, id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS i FROM samples WHERE text <> ''),
w AS (SELECT *, CASE WHEN ch IN ('(', '（') THEN 1 WHEN ch IN (')', '）') THEN -1 ELSE 0 END AS d FROM c),
s AS (SELECT *, sum(d) OVER (PARTITION BY part, id ORDER BY i) AS depth FROM w),
g AS (SELECT part, id, min(depth) AS low, arg_max(depth, i) AS final, coalesce(string_agg(ch, '' ORDER BY i) FILTER (WHERE depth = 0 AND d = 0), '') AS kept FROM s GROUP BY part, id)
SELECT part, id, CASE WHEN g.id IS NULL THEN '' WHEN low < 0 OR final <> 0 THEN text ELSE {_TIDY % "kept"} END AS value FROM samples LEFT JOIN g USING (part, id)
"""
_SPACED = f"array_to_string(list_transform(range(1, length(x) + 1), lambda i: (CASE WHEN i > 1 AND regexp_matches(x[i - 1], '[가-힣]') AND regexp_matches(x[i], '[가-힣]') AND i % 3 = 0 THEN ' ' ELSE '' END) || x[i]), '')"


def _respaced(t):
    """A proposal that puts a space before every third character, as a stand-in for a model's."""
    return F.regexp_replace(T.squeeze(t), "(?s)(..)(.)", "$1 $2")


QUERIES = {
    "tidy_whitespace": _one(T.tidy),
    "strip_unicode": _one(T.strip),
    "collapse_whitespace": _one(T.collapse),
    "remove_parenthetical": _one(T.remove_parenthetical),
    "correct_spacing": _one(lambda t: T.correct_spacing(T.squeeze(t), _respaced(t))),
    "corruption_flag": _one(T.is_corrupt),
    "xml_escape": _one(T.xml_text),
    "mixed_script_flag": _one(T.is_mixed_script),
    "long_hangul_run": _one(T.has_long_hangul),
    "heading_candidate": _one(lambda t: T.is_heading_like(t, F.lit("body"))),
    "gloss_flag": _one(T.has_bracket),
    "figure_residue": _one(T.is_figure_residue),
    "junk_flag": _one(T.is_junk),
    "stray_flag": _query(lambda t: [T.is_stray(t, 3 + F.length(t), F.lit(5), F.lit(15.0)).alias("tiny"), T.is_stray(t, F.lit(20), F.lit(20), F.lit(20.0)).alias("normal")]),
    "excerpts": _query(lambda t: [T.excerpt(t, True, 24).alias("before"), T.excerpt(t, False, 24).alias("after")]),
    "typo_fixes": _one(lambda t: T.fix_typos(t, [("the", "teh"), ("der", "dre")])),
    "needs_review": _one(lambda t: T.needs_review(t, F.lit("body"))),
    "review_structure": _one(lambda t: T.needs_review(t, F.lit("body"), {"structure"})),
    "review_features_off": _one(lambda t: T.needs_review(t, F.lit("body"), {"glosses", "spacing"})),
}

_WORD = "\\p{L}\\p{M}\\p{N}\\p{Pc}"


def _whole_word(value: str, old: str, new: str) -> str:
    """Twice, as the character after a word is used up by its match and may be what the next one begins with."""
    once = f"regexp_replace(%s, '(?i)(^|[^{_WORD}]){old}($|[^{_WORD}])', '\\1{new}\\2', 'g')"
    return once % (once % value)


def junk_sql(value: str) -> str:
    s = _STRIP % value
    return f"({s} = '' OR NOT regexp_matches({s}, '[\\p{{L}}\\p{{N}}]') OR (length({s}) <= 10 AND regexp_matches({s}, '[A-Za-z]') AND NOT regexp_matches({s}, '[가-힣]') AND NOT regexp_matches({s}, '\\p{{Nd}}') AND NOT regexp_matches(lower({s}), 'tel|fax|isbn')))"


ORACLE_SQL = {
    "typo_fixes": _sql(_whole_word(_whole_word("text", "the", "teh"), "der", "dre")),
    "tidy_whitespace": _sql(_TIDY % "text"),
    "strip_unicode": _sql(_S),
    "collapse_whitespace": _sql(_STRIP % f"regexp_replace(text, '{_WS}+', ' ', 'g')"),
    "remove_parenthetical": _PARENS,
    "correct_spacing": f"WITH {SAMPLES_SQL}, q AS (SELECT part, id, regexp_replace(text, '{_WS}', '', 'g') AS x FROM samples) SELECT part, id, {_SPACED} AS value FROM q",
    "corruption_flag": _sql(r"regexp_matches(text, '[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{3131}-\x{318E}]')"),
    "xml_escape": _sql("replace(replace(replace(replace(replace(regexp_replace(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{FFFE}\\x{FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"),
    "mixed_script_flag": _sql(f"({_MIXED})"),
    "long_hangul_run": _sql("regexp_matches(text, '[가-힣]{12}')"),
    "heading_candidate": _sql(_HEADING),
    "gloss_flag": _sql("(contains(text, '(') OR contains(text, ')') OR contains(text, '（') OR contains(text, '）'))"),
    "figure_residue": _sql(_FIGURE),
    "junk_flag": _sql(junk_sql("text")),
    "stray_flag": f"WITH {SAMPLES_SQL}, q AS (SELECT part, id, text, {_S} AS t FROM samples), r AS (SELECT *, NOT regexp_matches(t, '{_NUMBERS}') AND regexp_matches(t, '[^IVXLCDM]') AS odd FROM q) SELECT part, id, length(t) BETWEEN 1 AND 2 AND ((5 < 15.0::double * 0.35::double AND 3 + length(text) < 15.0::double * 0.35::double) OR odd) AS tiny, length(t) BETWEEN 1 AND 2 AND odd AS normal FROM r",
    "excerpts": f"WITH {SAMPLES_SQL}, q AS (SELECT part, id, {_STRIP % f"regexp_replace(text, '{_WS}+', ' ', 'g')"} AS t FROM samples) SELECT part, id, right(t, 24) AS before, left(t, 24) AS after FROM q",
    "needs_review": _sql(f"({_STRIP % 'text'} <> '' AND ({_MIXED} OR regexp_matches(text, '[가-힣]{{12}}') OR regexp_matches(text, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}\\x{{F0000}}-\\x{{FFFFD}}\\x{{100000}}-\\x{{10FFFD}}\\x{{00}}-\\x{{08}}\\x{{0B}}\\x{{0C}}\\x{{0E}}-\\x{{1F}}\\x{{3131}}-\\x{{318E}}]') OR {_HEADING} OR regexp_matches(text, '[()（）]') OR {_FIGURE}))"),
    "review_structure": _sql(f"({_STRIP % 'text'} <> '' AND {_HEADING})"),
    "review_features_off": _sql("(regexp_matches(text, '[()（）]') OR regexp_matches(text, '[가-힣]{12}'))"),
}
