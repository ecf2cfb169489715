"""Column functions on text: white space, brackets, scripts, noise, escapes.

White space is what Unicode calls so plus U+001C to U+001F, everywhere; Java's own classes differ, so they aren't used.
Lengths are in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = "[^" + SPACE[1:]
#: The same for patterns that look at every character: one table for Latin-1, the rest behind one range.
_SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
#: A text of so many characters that aren't white space (% "2,60"): it stops at the first one more.
BARE = rf"\A(?:{_SPACE}*+[^{_SPACE[1:]}){{%s}}+{_SPACE}*+\z"
#: White space one by one: at a text's ends they are cut off without a pattern, which would be tried at every blank inside.
SPACES = "".join(chr(k) for a, b in ((9, 13), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for k in range(a, b + 1))
HANGUL = "[가-힣]"
CORRUPT = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x00-\x08\x0B\x0C\x0E-\x1Fㄱ-ㆎ]"
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
SHAPES = "[←→↑↓↔⇐⇒⇔∠△▲□■○●◇◆※＊✓✔·•]"
NUMERALS = "IVXLCDM"
CLOSED = "[.!?。」』\"'’”)\\]]\\z"
CONTACTS = "tel|fax|isbn"
#: Digits that aren't decimal: superscript, subscript and circled ones.
OTHER_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def strip_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def ascii_digits(text: Column) -> Column:
    """Full-width, Arabic and Indic decimal digits as 0 to 9."""
    zeros = (0xFF10, 0x0660, 0x06F0, 0x0966, 0x09E6)
    return F.translate(text, "".join(chr(z + k) for z in zeros for k in range(10)), "0123456789" * len(zeros))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"{_SPACE}+", "")


def tidy(text: Column) -> Column:
    """No white space before punctuation, runs of blanks as one space, none at the ends."""
    closed = F.regexp_replace(text, f"{_SPACE}+([.,!?、。])", "$1")
    return strip(F.regexp_replace(closed, "[ \t]{2,}", " "))


def remove_parenthetical(text: Column) -> Column:
    """Text outside all brackets, tidied; unchanged where brackets don't balance. ASCII and full-width ones match each other.

    A fold over the stretches between brackets, so the work grows with their number.
    """
    parts = F.regexp_extract_all(text, F.lit("([^()（）]+|[()（）])"), F.lit(1))
    step = F.transform(parts, lambda p: F.struct(F.when(p.isin("(", "（"), 1).when(p.isin(")", "）"), -1).otherwise(0).alias("d"), p.alias("p")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("bad"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        depth = a["depth"] + x["d"]
        keep = (x["d"] == 0) & (a["depth"] == 0)
        return F.struct(depth.alias("depth"), (a["bad"] | (depth < 0)).alias("bad"), F.when(keep, F.concat(a["out"], F.array(x["p"]))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(step, start, add)
    return F.when(~text.rlike("[()（）]"), tidy(text)).when(done["bad"] | (done["depth"] != 0), text).otherwise(tidy(F.array_join(done["out"], "")))


def correct_spacing(text: Column, proposed: Column) -> Column:
    """The proposed spaces between two Hangul syllables, the text's own elsewhere; the text if other characters differ.

    Stretches of Hangul, with the white space inside, are cut out of both: where other characters are equal, there are as many,
    and the proposed ones take the place of the text's. Work is for each stretch, not for each character.
    """
    inside = HANGUL[:-1] + SPACE[1:]
    stretch = f"{HANGUL}(?:{inside}*{HANGUL})?"
    rows = F.arrays_zip(F.split(text, stretch, -1).alias("mine"), F.regexp_extract_all(proposed, F.lit(f"({stretch})"), F.lit(1)).alias("theirs"))
    spaced = F.array_join(F.flatten(F.transform(rows, lambda x: F.array(x["mine"], x["theirs"]))), "")
    # a text without two syllables side by side has nothing to be replaced
    there = text.rlike(f"{HANGUL}{_SPACE}*{HANGUL}") & (squeeze(text) == squeeze(proposed))
    return F.when(there, spaced).otherwise(text)


def is_corrupt(text: Column) -> Column:
    """Replacement or private-use characters, control characters, lone Hangul letters."""
    return text.rlike(CORRUPT)


def xml_text(text: Column) -> Column:
    """Without what XML 1.0 forbids, and with the five characters escaped."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.regexp_replace(text, NOT_XML, ""))


def is_mixed_script(text: Column) -> Column:
    """One or two Latin letters or digits caught at a Hangul syllable, or a character four times on end."""
    caught = rf"(?<={HANGUL})[A-Za-z0-9]{{1,2}}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Za-z0-9]{{1,2}}(?={HANGUL})"
    return text.rlike(caught) | text.rlike(r"([^\n])\1{3,}")


def has_long_hangul(text: Column) -> Column:
    return text.rlike(HANGUL + "{12}")


def is_heading_like(text: Column, kind: Column) -> Column:
    closed = strip_end(text).rlike(CLOSED)
    return (kind == "heading") | ((F.length(text) <= 60) & ~closed)


def has_bracket(text: Column) -> Column:
    return text.rlike("[()（）]")


def is_figure_residue(text: Column) -> Column:
    """Short, no sentence and no Hangul word, and a shape or hardly any Hangul."""
    t = strip(text)
    bare = ~t.rlike("[.!?。」』]\\z") & ~t.rlike(HANGUL + "{4}")
    return F.length(t).between(1, 40) & bare & (t.rlike(SHAPES) | (F.regexp_count(t, F.lit(HANGUL)) <= 2))


def is_junk(text: Column) -> Column:
    """Nothing but punctuation, or ten characters of Latin at most without Hangul or digit, other than contact labels."""
    t = strip(text)
    short = (F.length(t) <= 10) & t.rlike("[A-Za-z]") & ~t.rlike(HANGUL) & ~t.rlike(r"(?U)\d") & ~F.lower(t).rlike(CONTACTS)
    return (t == "") | ~t.rlike(r"[\p{L}\p{N}]") | short


def is_stray(text: Column, width: Column, height: Column, body: Column) -> Column:
    """One or two characters that are tiny beside the body's lines, or have no Hangul or digit and aren't a numeral."""
    t = strip(text)
    tiny = (body > 0) & (height < body * F.lit(0.35)) & (width < body * F.lit(0.35))
    foreign = ~t.rlike(rf"[가-힣\p{{Nd}}{OTHER_DIGITS}]") & t.rlike(f"[^{NUMERALS}]")
    return F.length(t).between(1, 2) & (tiny | foreign)


def excerpt(text: Column, left: bool, size: int = 240) -> Column:
    """The end of a left text, or the beginning of a right one, with white space collapsed."""
    flat = collapse(text)
    return F.right(flat, F.lit(size)) if left else F.substring(flat, 1, size)


#: What a paragraph can need an outside judgement for.
REVIEWS = ("ocr_words", "spacing", "anomalies", "structure", "headings", "glosses", "figures")


def needs_review(text: Column, kind: Column, on=frozenset(REVIEWS)) -> Column:
    """Whether a paragraph goes to an outside judgement: any of the features that are on. Those that are off fold to false.

    Blank text never goes; structure looks at what headings does; a name that isn't one of REVIEWS is an error.
    """
    if wrong := sorted(set(on) - set(REVIEWS)):
        raise ValueError(f"no such reviews: {', '.join(wrong)}")
    rules = {
        "ocr_words": is_mixed_script(text), "spacing": has_long_hangul(text), "anomalies": is_corrupt(text),
        "structure": is_heading_like(text, kind), "headings": is_heading_like(text, kind), "glosses": has_bracket(text), "figures": is_figure_residue(text),
    }
    return (strip(text) != "") & reduce(lambda found, name: found | rules[name] if name in on else found, REVIEWS, F.lit(False))


def fix_typos(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole words replaced whatever their case, in order."""
    return reduce(lambda t, p: F.regexp_replace(t, rf"(?iU)\b{p[0]}\b", p[1]), pairs, text)
