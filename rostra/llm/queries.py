"""Queries of the text problems and the SQL that checks them."""

from __future__ import annotations

import unicodedata

from rostra.llm import bpe, format_dedup, lookalike, packing
from rostra.session import checkpointed, table


def p7_found(spark, d):
    return format_dedup.hidden_copies(table(spark, d, "exam_listing"))


def p7_entries(spark, d):
    return format_dedup.collapsed_entries(table(spark, d, "exam_listing"))


def p8_ids(spark, d):
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p9_audit(spark, d):
    """What must hold of any packing, whatever the order of the items."""
    docs = table(spark, d, "documents")
    return packing.audit(checkpointed(packing.pack_documents(docs)), docs)


def p10_found(spark, d):
    return lookalike.lookalike_pairs(table(spark, d, "documents"))


def p10_classes(spark, d):
    return lookalike.lookalike_classes(table(spark, d, "documents"))


def p10_canonical(spark, d):
    return lookalike.canonical_texts(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_found, p7_entries, p8_ids, p9_containers, p9_audit, p10_found, p10_classes, p10_canonical)}


def _stripped(c: str) -> str:
    return f"lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'))"


_CLASSES = f"""
with k as (select *, min(listing_id) over e first_id, count(*) over e copies from exam_listing
           window e as (partition by list_sort([{", ".join(map(_stripped, format_dedup.FIELDS))}])))
"""


# Fixed values, apart from the operator's: by script, letters and the Latin ones that look like them; radical signs and their ideographs.
_SAME_SHAPE = {
    **dict(zip("АВЕЅІЈКМНОРСТХҮԚԜԌѴ", "ABESIJKMHOPCTXYQWGV", strict=True)), **dict(zip("аеорсухѕіјԛԝһԁӏѵү", "aeopcyxsijqwhdlvy", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ", strict=True)), **dict(zip("αγικνορυχϲϳ", "ayikvopuxcj", strict=True)),
}
_RADICAL_SIGNS = dict(zip(
    "⺁⺅⺇⺉⺋⺒⺓⺖⺗⺘⺙⺛⺝⺟⺠⺡⺢⺣⺤⺦⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺷⺸⺹⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳",
    "厂亻几刂㔾巳幺忄㣺扌攵旡月母民氵氺灬爫丬犭王疋罒示礻竹糹纟罓罒羊羊耂肉臼艹艹艹虎衤覀西见角讠贝车辶辶辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄齐齿龙龟", strict=True,
))


def _canonical_sql() -> str:
    """The same form without segments: hidden characters out, letters and signs replaced, the whole composed."""
    pairs = _SAME_SHAPE | {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x2E9F, 0x2EF4)) if unicodedata.decomposition(c)} | _RADICAL_SIGNS
    wide = {chr(p): chr(p - 0xFEE0) for p in range(0xFF01, 0xFF5F)}
    spaces = {chr(p): " " for p in range(0x80, 0x3001) if unicodedata.category(chr(p)) == "Zs"}
    signs = {c: unicodedata.normalize("NFKC", c) for c in map(chr, range(0x2F00, 0x2FD6))}
    one = wide | spaces | signs | pairs
    quoted = lambda s: s.replace("'", "''")
    sql = r"regexp_replace(text, '[\x{ad}\x{34f}\x{61c}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{e0000}-\x{e0fff}]+', '', 'g')"
    for ligature in map(chr, range(0xFB00, 0xFB07)):
        sql = f"replace({sql}, '{ligature}', '{unicodedata.normalize('NFKC', ligature)}')"
    for composed in "ёЁѐЀїЇӑӐӓӒӗӖӱӰӳӲӯӮўЎάΆέΈΉίΊϊΪόΌύΎϋΫ":  # composed letters whose base looks like a Latin one
        sql = f"replace({sql}, '{composed}', '{unicodedata.normalize('NFD', composed)}')"
    return f"nfc_normalize(translate({sql}, '{quoted(''.join(one))}', '{quoted(''.join(one.values()))}'))"


_ALIKE = f"""
with c as (select doc_id, text, {_canonical_sql()} k from documents where text is not null),
s as (select * from c where regexp_matches(k, '[^\\s\\x{{a0}}\\x{{3000}}]'))
"""

ORACLE = {
    "p7_found": _CLASSES + "select first_id, listing_id as copy_id from k where listing_id <> first_id",
    "p7_entries": _CLASSES + f"select listing_id, {', '.join(format_dedup.FIELDS)}, copies from k where listing_id = first_id",
    "p9_audit": """
select 0::bigint overfull, true tight, 0::bigint misplaced, 0::bigint wrong_documents, count(*) documents, count(*) filter (coalesce(text, '') = '') empty from documents""",
    "p10_found": _ALIKE + """
select a.doc_id doc_id_1, b.doc_id doc_id_2 from s a join s b on a.k = b.k and a.doc_id < b.doc_id and a.text <> b.text""",
    "p10_classes": _ALIKE + """,
g as (select k, min(doc_id) class_id, count(distinct text) texts, count(*) documents from s group by k having count(distinct text) > 1)
select doc_id, class_id, texts, documents from s join g using (k)""",
    "p10_canonical": f"select doc_id, {_canonical_sql()} as canonical from documents",
}
