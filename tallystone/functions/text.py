"""Text expressions: tokens, blanks, chunks, file extensions. Lengths and offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP, PROMPT_CHARS = 1000, 200, 8000
#: White space as Unicode has it, and the four separators that Java leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]"
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def not_blank(text: Column) -> Column:
    return text.rlike(_NOT_BLANK)


def tokens(text: Column) -> Column:
    """Lower-cased words between white space; no stemming, no stop words."""
    return F.filter(F.split(F.lower(text), _SPACE + "+"), lambda t: t != "")


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of windows of ``size`` characters, each starting ``size - overlap`` after the last; blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    found = F.filter(F.transform(starts, lambda i: F.substring(text, (i + 1).cast("int"), F.lit(size))), not_blank)
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<string>"))


def prompt_prefix(text: Column, chars: int = PROMPT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def extension(name: Column) -> Column:
    """The last dot and what follows, lower-cased; leading dots of the name don't count."""
    return F.lower(F.regexp_extract(name, r"[^./][^/]*(\.[^./]*)$", 1))


def chunk_id(project: Column, document: Column, index: Column) -> Column:
    return F.concat(F.lit("proj_"), project.cast("string"), F.lit("_doc_"), document.cast("string"), F.lit("_chunk_"), index.cast("string"))


def two_places(x: Column) -> Column:
    """A double with two places as C prints it: the binary value is rounded, ties go to even digits.

    Java rounds the shortest decimal text instead. The two differ only where that text ends in a 5 at the third place; there the exact
    value, a whole number of 2**-60 (2**-50, 2**-40 for larger ones), is held against the tie. From a million on Java's rounding stays.
    """
    x = x.cast("double")
    plain = F.format_string("%.2f", x)
    size = F.abs(x)
    thousands = F.round(size * 1000).cast("bigint")
    wide = "decimal(38,0)"
    # the scaled value is a whole number below 2**63, so the cast to bigint is exact
    scale = F.when(size < 4, F.lit(1 << 60)).when(size < 4096, F.lit(1 << 50)).otherwise(F.lit(1 << 40))
    exact = (size * scale.cast("double")).cast("bigint").cast("decimal(19,0)").cast(wide) * F.lit(1000).cast("decimal(4,0)")
    tie = thousands.cast("decimal(12,0)") * scale.cast("decimal(19,0)")
    down = ((thousands - 5) / 10).cast("bigint")
    cents = F.when(exact > tie, down + 1).when(exact < tie, down).otherwise(down + down % 2)
    sign = F.when(x < 0, "-").otherwise("")
    text = F.concat(sign, (cents / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when((size < 1e6) & x.cast("string").rlike(r"^-?\d+\.\d\d5$"), text).otherwise(plain)
