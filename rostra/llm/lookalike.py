"""Problem 10: visually identical text with different characters, brought to one form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.bpe import byte_runs
from rostra.session import checkpointed, skew_safe_join

# Cyrillic and Greek letters that look like a Latin letter, in pairs.
_LOOKALIKES = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԚQ ԜW ԌG ѴV аa еe оo рp сc уy хx ѕs іi јj ԛq ԝw һh ԁd ӏl ѵv үy "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa γy ιi κk νv οo ρp υu χx ϲc ϳj"
)
# CJK radical signs without a compatibility decomposition, and their ideographs, in pairs.
_RADICALS = "⺁厂 ⺅亻 ⺇几 ⺉刂 ⺋㔾 ⺒巳 ⺓幺 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺟母 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 ⺨犭 ⺩王 ⺪疋 ⺫罒 ⺬示 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺷羊 ⺸羊 ⺹耂 ⺼肉 ⺽臼 ⺾艹 ⺿艹 ⻀艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻰龙 ⻳龟"
#: Characters of a format or filler kind that show nothing although their category alone doesn't say so.
_HIDDEN = "͏ᅟᅠ឴឵ㅤﾠ⁥"


def _invisible(c: str) -> bool:
    """Format characters (but for the few that print a sign of their own), variation selectors, fillers."""
    p = ord(c)
    if unicodedata.category(c) == "Cf":
        return not (0x600 <= p <= 0x605 or p in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0xFFF9 <= p <= 0xFFFB or 0x13430 <= p < 0x13460)
    return c in _HIDDEN or 0xFE00 <= p <= 0xFE0F or 0x180B <= p <= 0x180F or 0xE0000 <= p <= 0xE0FFF


def _replacement(c: str) -> str | None:
    """What stands for the character before composition; itself if nothing is to be done."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    p, name = ord(c), unicodedata.name(c, "")
    if 0xFF01 <= p <= 0xFF5E:
        return chr(p - 0xFEE0)
    if 0x2E80 <= p <= 0x2FD5 or "LIGATURE" in name:
        compat = unicodedata.normalize("NFKC", c)
        return compat if all(unicodedata.category(x)[0] in "LM" for x in compat) else c
    return c


def _code_points() -> Iterator[str]:
    """Every code point that may need attention: planes above the third hold but tags and selectors."""
    for a, b in ((0x80, 0xD800), (0xE000, 0x33480), (0xE0000, 0xE1000)):
        yield from map(chr, range(a, b))


class Canonical:
    """Brings text to one form: NFC of the text in which invisible characters are gone, special spaces are spaces,
    full-width forms, ligatures and radical signs are the plain characters, and look-alike letters are Latin.

    A quick check tells stable from unstable characters: a character is unstable if it has a replacement, isn't
    allowed in the normal form (quick check no), may combine with what stands before it (maybe), or is a mark.
    Only runs of unstable characters, together with the starter before them, are normalized; the results are
    spliced into the text, whose stable stretches stay as they are. Characters beyond the first plane count as unstable in
    the quick check, so that it is one look-up in a bit map for each character; normalizing them changes only those that aren't stable.
    """

    def __init__(self) -> None:
        pairs = [p for p in (_LOOKALIKES + " " + _RADICALS).split(" ")]
        self.letters = {ord(p[0]): p[1] for p in pairs}
        # of a chain of replacements the last counts
        self.letters = {k: self.letters.get(ord(v), v) for k, v in self.letters.items()}
        self.table: dict[int, str] = {}
        unstable, maybe = [], set()
        for c in _code_points():
            parts = unicodedata.decomposition(c)
            if parts and parts[0] != "<" and " " in parts:
                maybe.add(chr(int(parts.split(" ")[1], 16)))
        maybe |= set(map(chr, range(0x1161, 0x1176))) | set(map(chr, range(0x11A8, 0x11C3)))  # Hangul is composed by rule
        for c in _code_points():
            r = _replacement(c)
            if r != c:
                self.table[ord(c)] = r
            if c in maybe or unicodedata.combining(c) or self._normal(c) != c:
                unstable.append(ord(c))
        kinds, start = [], None
        unstable = [p for p in unstable if p < 0x10000]
        for k, p in enumerate(unstable):  # as ranges
            start = p if start is None else start
            if k + 1 == len(unstable) or unstable[k + 1] != p + 1:
                kinds.append(f"{re.escape(chr(start))}-{re.escape(chr(p))}")
                start = None
        self.runs = re.compile("[" + "".join(kinds) + "\U00010000-\U0010ffff]+", re.DOTALL)
        self.known: dict[str, str] = {}

    def _normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(self.table)).translate(self.letters))

    def _segment(self, s: str) -> str:
        out = self.known.get(s)
        if out is None:
            out = self._normal(s)
            if len(s) < 16:
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[s] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        pieces, at = [], 0
        for run in self.runs.finditer(text):
            start = max(at, run.start() - 1)  # the starter before the run
            pieces += (text[at:start], self._segment(text[start : run.end()]))
            at = run.end()
        return "".join(pieces) + text[at:] if pieces else text


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts one after the other; only a bounded slice of them is turned into strings at a time."""
    for lo, hi in byte_runs(column):
        yield from column.slice(lo, hi - lo).to_pylist()


def canonical_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, canonical): the one form of every text; null stays null, an empty text empty. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            texts = [None if t is None else canonical(t) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "canonical"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("value"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, canonical string")
    return out.select(F.col("id").alias(id_column), "canonical")


def _fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, look, chars): 128-bit hashes of the canonical and of the given text, of texts that show something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        digest = lambda t: hashlib.blake2b(t.encode("utf8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            shown, looks, chars = [], [], []
            for text in _texts(batch.column(1)):
                form = canonical(text) if text else ""
                shown.append(bool(form) and not form.isspace())
                if shown[-1]:
                    chars.append(digest(text))
                    looks.append(chars[-1] if form is text else digest(form))
            ids = batch.column(0).filter(pa.array(shown, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(looks, pa.binary()), pa.array(chars, pa.binary())], names=["doc_id", "look", "chars"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, look binary, chars binary")


def _classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, classes): of each text of a class of several texts its look, chars and number n of documents; and of each such
    class its look, class_id (smallest doc_id), number of texts and of documents."""
    texts = prints.groupBy("look", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    classes = texts.groupBy("look").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("documents")).filter("texts > 1")
    return texts.select("look", "chars", "n"), classes


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, texts, documents) of every document whose text looks the same as another text: the class by its
    smallest doc_id, how many different texts it has and how many documents. The compact and complete form of the pairs, one row
    a document, however large a class is; texts that nothing else looks like, null texts and ones that show nothing are left out.
    """
    prints = checkpointed(_fingerprints(docs.filter("text is not null and doc_id is not null")))
    _, classes = _classes(prints)
    return skew_safe_join(prints, classes, ["look"], "documents", "doc_id", prints.count()).select("doc_id", "class_id", "texts", "documents")


def lookalike_pairs(docs: DataFrame, block: int = 20_000, most_texts: int = 2_000) -> DataFrame:
    """(doc_id_1, doc_id_2), doc_id_1 < doc_id_2: all pairs of documents whose texts look the same but aren't the
    same characters. Null texts and texts that show nothing are left out, as are documents without an id. The pairs grow with
    the square of a class; lookalike_classes says the same with one row a document.

    Only 40 bytes of a document are shuffled. Copies of one text make no pairs with each other: classes of a single
    text, however many copies it has, drop out before anything is joined. In the others each document of one text meets
    those of the other texts, which is the result itself. A look of more than `most_texts` texts is split into parts
    that meet each other two by two, and texts with many copies are split into blocks of `block` documents, so no task has
    more than two parts of a look, or two blocks of texts, at a time.
    """
    # canonical forms are made once; they are used for the class counts and for both sides
    prints = checkpointed(_fingerprints(docs.filter("text is not null and doc_id is not null")))
    texts, classes = _classes(prints)
    # the pairs of different texts of a class, with the number of blocks of either
    several = texts.join(classes.select("look", "texts"), "look").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    parts = F.ceil(F.col("texts") / most_texts).cast("int")
    several = several.withColumn("part", F.pmod(F.xxhash64("chars"), parts).cast("int")).withColumn("every", F.sequence(F.lit(0), parts - 1))
    one = several.select("look", F.col("part").alias("p1"), F.explode("every").alias("p2"), F.col("chars").alias("chars_1"), F.col("blocks").alias("blocks_1"))
    other = several.select("look", F.explode("every").alias("p1"), F.col("part").alias("p2"), F.col("chars").alias("chars_2"), F.col("blocks").alias("blocks_2"))
    pairs = one.join(other, ["look", "p1", "p2"]).filter("chars_1 < chars_2").drop("look", "p1", "p2")
    seq = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = pairs.withColumn("block_1", seq("blocks_1")).withColumn("block_2", seq("blocks_2"))
    # documents of a text in their blocks; only texts that have a partner
    met = skew_safe_join(prints, several.select("look", "chars", "n", "blocks"), ["look", "chars"], "n", "doc_id", prints.count())
    placed = met.select("chars", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    side = lambda k: placed.select(F.col("chars").alias(f"chars_{k}"), F.col("block").alias(f"block_{k}"), F.col("doc_id").alias(f"d{k}"))
    met = pairs.join(side(1), ["chars_1", "block_1"]).join(side(2), ["chars_2", "block_2"]).filter("d1 <> d2")
    return met.select(F.least("d1", "d2").alias("doc_id_1"), F.greatest("d1", "d2").alias("doc_id_2")).distinct()
