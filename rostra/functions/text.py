"""Text and number cleaning as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a Unicode-aware strip removes (U+200B and U+FEFF are not white space).
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
WIDE_DIGITS = "０１２３４５６７８９"
#: Full-width forms of the printable ASCII characters, and those characters.
WIDE_ASCII = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW_ASCII = "".join(map(chr, range(0x21, 0x7F)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """PRJ-6: missing becomes empty, no-break spaces become spaces, white space at both ends goes."""
    return F.coalesce(strip(F.translate(c.cast("string"), "\xa0", " ")), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def coerce_count(c: Column) -> Column:
    """PRJ-7 for text cells: an integer with optional sign, surrounding white space, single underscores
    between digits and full-width digits; everything else, and what exceeds 64 bits, becomes 0."""
    ascii_ = F.translate(strip(c), WIDE_DIGITS, "0123456789")
    whole = F.when(ascii_.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(ascii_, "_", ""))
    return F.coalesce(whole.try_cast("bigint"), F.lit(0).cast("bigint"))


def coerce_number(c: Column) -> Column:
    """PRJ-7 for numeric cells: truncation towards zero; null, NaN and infinities become 0."""
    d = c.cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18))
    return F.when(finite, F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).otherwise(F.lit(0)).cast("bigint")
