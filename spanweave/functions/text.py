"""Text and identity functions as Spark columns: normalised terms, token overlap, content ids."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes and quotes that count as their ASCII forms (fixed values).
FOLDED = {
    "-": "‐‑‒–—―−",
    "'": "‘’‚‛′´",
    '"': "“”„‟″«»",
}
_FROM = "".join(FOLDED.values())
_TO = "".join(k * len(v) for k, v in FOLDED.items())
TOKEN = r"(?U)\w+(?:[-']\w+)*"
#: The same where a text is ASCII: white space and folding change no word of it.
PLAIN = r"[a-z0-9_]+(?:[-'][a-z0-9_]+)*"


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters that NFKC replaces: those by one character (from, to), and those by several."""
    made = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0xA0, 0x10000)) if not "\ud800" <= c <= "\udfff"}
    one = {c: n for c, n in made.items() if n != c and len(n) == 1 and not "\uac00" <= c <= "\ud7a3"}
    several = {c: n for c, n in made.items() if len(n) > 1 and not c.isspace()}
    return "".join(one), "".join(one.values()), several


def compatible(text: Column) -> Column:
    """Compatibility forms replaced character by character, as NFKC does to text without loose marks.

    Spark has no such function. Text within Latin letters of one byte is passed by; characters that
    become several are looked up only where a text has one.
    """
    before, after, several = _compatible()
    one = F.translate(text, before, after)
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    spread = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    wide = F.when(one.rlike(_MANY), spread).otherwise(one)
    return F.when(text.rlike(r"[\x{A0}-\x{BF}\x{100}-\x{FFFF}]"), wide).otherwise(text)


#: Where characters that NFKC makes several of may stand: Latin-1 fractions and marks, ligatures, signs, symbols.
_MANY = r"[\x{A8}\x{AF}\x{B4}\x{B8}\x{BC}-\x{BE}\x{132}-\x{149}\x{1C4}-\x{1F3}\x{2D8}-\x{2DD}\x{37A}-\x{387}\x{587}-\x{678}\x{E33}-\x{EDD}\x{F0C}-\x{FB9}\x{1E9A}-\x{1FFE}\x{2017}-\x{2057}\x{20A8}-\x{2488}\x{249C}-\x{2A76}\x{2ADC}\x{3036}-\x{33FF}\x{FB00}-\x{FFEF}]"


def fold(text: Column) -> Column:
    """Dash and quote variants as ASCII, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, _FROM, _TO), r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Compatibility forms, folded and case-folded; sharp s becomes ss, final sigma sigma."""
    return F.replace(F.replace(F.lower(fold(compatible(text))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tokens(text: Column) -> Column:
    """Words of the normalised text, hyphens and apostrophes inside kept."""
    plain = F.regexp_extract_all(F.lower(text), F.lit(PLAIN), F.lit(0))
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.regexp_extract_all(normalise(text), F.lit(TOKEN), F.lit(0)))


def jaccard(left: Column, right: Column) -> Column:
    """Share of the united tokens that both have; 0 where either is empty."""
    both = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / both)


def content_id(*parts: Column, length: int = 16) -> Column:
    """The first hexadecimal digits of a sha256 over the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def cited(line: Column) -> Column:
    """References in square brackets of a line."""
    return F.regexp_extract_all(line, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))


def keep_cited(text: Column, known: Column) -> Column:
    """Only the lines that cite a known reference."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: F.arrays_overlap(cited(line), known)), "\n")


def reslices(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a span's offsets give its quote."""
    return F.coalesce(F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == quote, F.lit(False))
