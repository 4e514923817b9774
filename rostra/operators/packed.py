"""Problem 4: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import strip
from rostra.functions.timeparse import let

#: Quote characters; the straight one closes itself, the others come in pairs.
PAIRED_QUOTES = {"“": "”", "「": "」", "『": "』", "«": "»", "„": "“", "〝": "〞"}
_QUOTES = '"' + "“”„「」『』«»〝〞"
_OPENING, _CLOSING = "(（[【〔{〈《", ")）]】〕}〉》"
_OPEN, _CLOSE = (x.replace("[", r"\[").replace("]", r"\]") for x in (_OPENING, _CLOSING))
#: Marks that separate values wherever they stand outside quotes and brackets.
MARKS = "、，,；;／/｜|＆&＋+\n\r\t\x0b\x0c　  "
#: Conjunctions that separate values if white space is on both sides; single letters in lower case only, since a
#: capital one is an initial.
CONJUNCTIONS = ["与", "和", "及", "以及", "(?i:and|und|et)", "y", "и"]

_GAP = r"[ \xa0]"
_DELIMITER = rf"(?:{_GAP}+(?:{'|'.join(CONJUNCTIONS)})(?={_GAP})|[{MARKS}]|{_GAP}{{2,}})"
# tokens of an even piece: a delimiter, a bracket, or a run of text (single spaces included)
_TOKENS = rf"{_DELIMITER}|[{_OPEN}{_CLOSE}]|[^{MARKS}{_OPEN}{_CLOSE} \xa0]+|{_GAP}"


def split_packed(c: Column) -> Column:
    """array<string> of the values in a field, empty ones left out, order kept, repeats kept.

    The text is split at quote characters: odd pieces are literals, even pieces are split into delimiters,
    brackets and text; one SQL fold puts the values together. Within quotes and brackets nothing separates. Quotes
    around a value go, a doubled straight quote inside quotes becomes a single one, white space at both ends
    goes; quotes in the middle of a value stay, and protect what they hold. A quote or bracket that is never
    closed protects the rest of the field. Null and empty fields give an empty array.
    """
    # every piece with the quote character before it: the fold knows what opened and what closes
    pieces = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?s)[{_QUOTES}][^{_QUOTES}]*|^[^{_QUOTES}]+"), F.lit(0))
    tokens = F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(
                F.left(p, F.lit(1)).rlike(rf"[{_QUOTES}]"),
                F.concat(F.array(F.left(p, F.lit(1))), F.regexp_extract_all(F.substring(p, F.lit(2), F.length(p)), F.lit(_TOKENS), F.lit(0))),
            ).otherwise(F.regexp_extract_all(p, F.lit(_TOKENS), F.lit(0))),
        )
    )
    closer = F.create_map(*[F.lit(x) for kv in ({'"': '"'} | PAIRED_QUOTES).items() for x in kv])
    zero = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),  # the value so far
        F.lit("").alias("quote"),  # closing quote that is waited for
        F.lit(False).alias("keep"),  # the quote is in the middle of a value
        F.lit(False).alias("was"),  # the last token closed a quote
        F.lit(0).alias("depth"),
    )

    def step(a: Column, t: Column) -> Column:
        inside, at_start = a["quote"] != "", strip(a["cur"]) == ""
        closes = inside & (t == a["quote"])
        doubled = a["was"] & (t == '"')  # "" inside quotes: the quote goes on with one quote in the text
        opens = ~inside & ~doubled & closer[t].isNotNull() & (a["depth"] == 0)
        # tokens are whole delimiters, brackets or texts without either: what one is can be told without a pattern
        gap = t.startswith(" ") | t.startswith("\xa0")
        splits = ~inside & (a["depth"] == 0) & (F.contains(F.lit(MARKS), t) | (gap & (F.length(t) > 1)))
        depth = (
            F.when(~inside & F.contains(F.lit(_OPENING), t), a["depth"] + 1)
            .when(~inside & F.contains(F.lit(_CLOSING), t), F.greatest(a["depth"] - 1, F.lit(0)))
            .otherwise(a["depth"])
        )
        return F.struct(
            F.when(splits & ~doubled, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(doubled, F.concat(a["cur"], F.lit('"'))).when(splits, "").when(opens & at_start, "").when(closes & ~a["keep"], a["cur"]).otherwise(F.concat(a["cur"], t)).alias("cur"),
            F.when(doubled, F.lit('"')).when(opens, closer[t]).when(closes, "").otherwise(a["quote"]).alias("quote"),
            F.when(opens, ~at_start).otherwise(a["keep"]).alias("keep"),
            (closes & (t == '"') & ~a["keep"]).alias("was"),
            F.when(doubled, a["depth"]).otherwise(depth).alias("depth"),
        )

    values = F.aggregate(tokens, zero, step, lambda a: F.concat(a["done"], F.array(a["cur"])))
    return F.filter(F.transform(values, strip), lambda v: v != "")


def unpack_values(df: DataFrame, column: str, keys: list[str], at_least: int = 1) -> DataFrame:
    """(keys, pos, column): one distinct row for each value of the field, pos counting from 1, of the fields that
    hold `at_least` values. Repeated rows are collapsed before anything is split, so a text repeated in a third of
    all rows is split once per key."""
    rows = df.select(*keys, column).filter(F.col(column).isNotNull()).distinct()
    if at_least > 1:  # a field without any mark, gap or conjunction holds one value at most
        rows = rows.filter(F.col(column).rlike(rf"[{MARKS}]|{_GAP}{{2,}}|{_GAP}(?:{'|'.join(CONJUNCTIONS)}){_GAP}"))
    # not a filter on the values: it would be pushed below and split every field once more for each of its conditions
    several = let(split_packed(F.col(column)), lambda v: F.when(F.size(v) >= at_least, v))
    return rows.select(*keys, F.posexplode(several).alias("pos", column)).withColumn("pos", F.col("pos") + 1).distinct()
