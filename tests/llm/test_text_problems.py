"""The text problems: edge cases, and brute force or round trips over whole tables."""

import random
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra.llm import bpe, format_dedup, lookalike, packing
from rostra.session import table
from tests.conftest import rows


# ---------------------------------------------------------------- 7: formatting differences
def _listing(spark, data):
    return spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(data, 1)], "listing_id bigint, course_code string, class_name string, raw_time string, location string, first_id string, copies int")


def test_hidden_copies(spark):
    df = _listing(spark, [
        ("GE-1", "甲 A", "8:00", None), ("甲a", "g e1", "800", ""), ("ge1", "甲A", "801", ""), ("#GE1!", "", "８00", "甲A"), ("甲A", "_", "GE1。", "(8.00)"),
        (None, None, None, None), ("", " ", "-", "\xa0"), ("①", None, None, None), ("ab", "c", "", ""), ("a", "bc", "", ""), ("É", "", "", ""), ("é", "", "", ""), ("E", "", "", ""),
    ])
    assert rows(format_dedup.hidden_copies(df)) == [(1, 2), (1, 5), (11, 12), (6, 7), (6, 8)]
    kept = {r.listing_id: (r.copies, r.course_code) for r in format_dedup.collapsed_entries(df).collect()}
    assert kept[1] == (3, "GE-1") and kept[6] == (3, None) and kept[3] == (1, "ge1") and sum(c for c, _ in kept.values()) == 13
    assert format_dedup.hidden_copies(df.limit(0)).count() == 0
    hard = _listing(spark, [("ΟΔΟΣ", "x", "y", ""), ("y", "", "οδος", "X"), ("a\x01b", "c", None, None), ("c", None, "AB", "\x01"), ("a", "b", "c", None), ("x" * 50_000, "", "", ""), ("", "X-" * 50_000, "", "")])
    assert rows(format_dedup.hidden_copies(hard)) == [(1, 2), (3, 4), (6, 7)]
    again = df.filter("listing_id <= 3").unionAll(df.filter("listing_id = 1")).unionAll(df.filter("listing_id = 3").withColumn("listing_id", F.lit(None).cast("bigint")))
    again = again.unionAll(again.filter("listing_id is null"))
    assert rows(format_dedup.collapsed_entries(again).select("listing_id", "course_code", "copies")) == [(None, "ge1", 1), (None, "ge1", 1), (1, "GE-1", 3), (3, "ge1", 1)]
    assert rows(format_dedup.hidden_copies(again)) == [(1, 2)]


def test_hidden_copies_of_a_hot_entry(spark):
    from rostra.session import skew_safe_join

    rows_ = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700).alias("k"))
    groups = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = skew_safe_join(rows_, groups, ["k"], "n", "id", 5000, hot_rows=50)
    assert out.count() == 5000 and out.select("id").distinct().count() == 5000
    assert rows(out.groupBy("k").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a <> b")) == []


# ---------------------------------------------------------------- 8: tokens
@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_tables())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return t


def _split(ids, counts):
    at, out = 0, []
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=40))
def test_encoding_agrees_with_the_library(encoder, public, texts):
    assert _split(*encoder.encode(texts)) == [public.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_of_odd_texts(encoder, public):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcde tnhs  \n\té中文字的是\x1c\x85​🎓１.,!'srvd") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 5000, "的" * 5000, " " * 3000, "中文" * 20_000, "<|endoftext|>", "", "it's  \n x"]
    assert _split(*encoder.encode(texts)) == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_both_kinds_of_trees_agree(encoder):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh中文") for _ in range(rnd.randint(2, 70))).encode() for _ in range(800)]
    assert all((a == encoder._encode_one(w)).all() for w, a in zip(words, encoder.encode_words(words), strict=True))


def test_corpus(spark, sf_dir, public):
    docs = table(spark, sf_dir, "documents")
    out = {r.doc_id: r.ids for r in bpe.encode_corpus(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert out == {k: public.encode(t, add_special_tokens=False).ids if t else [] for k, t in texts.items()}
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "x", "c"), (2, "x", "c"), (None, "y", "d")], "id int, value string, ids string")
    assert [r.ids for r in bpe.encode_corpus(odd, "id", "value").orderBy("id").collect()].count([]) == 2
    assert bpe.encode_corpus(docs.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(docs).collect()} == {k: len(v) for k, v in out.items()}


# ---------------------------------------------------------------- 9: containers
def _check_packing(df, sizes, capacity):
    used, pieces = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.item].append((r.item_start, r.size))
        if r.container is not None:
            used[r.container].append((r.container_start, r.size))
        else:
            assert r.size == 0
    for spans in used.values():  # contents lie one behind the other
        spans.sort()
        at = 0
        for start, size in spans:
            assert start == at
            at += size
        assert at <= capacity
    assert set(pieces) == set(sizes)
    for item, n in sizes.items():
        spans = sorted(pieces[item])
        assert sum(s for _, s in spans) == max(n or 0, 0)
        assert len(spans) == max(1, -(-max(n or 0, 0) // capacity))
    return len(used)


def test_packing(spark):
    rnd = random.Random(4)
    sizes = {i: rnd.choice([0, 1, 7, 60, 100, 101, 250, 1000, rnd.randint(1, 99)]) for i in range(3000)} | {-1: None, -2: -5}
    df = spark.createDataFrame([(k, v, "c") for k, v in sizes.items()], "item bigint, size bigint, container string")
    total = sum(max(v or 0, 0) for v in sizes.values())
    for shards in (1, 5):
        boxes = _check_packing(packing.pack(df, 100, shards=shards), sizes, 100)
        assert boxes <= 1.03 * total / 100 + 2
    assert packing.pack(df.limit(0), 100).count() == 0


def test_level_array_places_by_the_sum_of_squares():
    rnd = random.Random(5)
    levels, fills = packing.LevelArray(20), []
    for _ in range(2000):
        size = rnd.randint(1, 20)

        def score(h, size=size):
            counts = defaultdict(int)
            for f in fills:
                counts[f] += 1
            counts[h] -= h > 0
            counts[h + size] += 1
            return sum(n * n for k, n in counts.items() if 0 < k < 20)

        best = min(score(h) for h in {0, *fills} if h + size <= 20)
        box, at = levels.place(size)
        assert score(at) == best
        if box == len(fills):
            fills.append(size)
        else:
            assert fills[box] == at
            fills[box] += size
    assert max(fills) <= 20


def test_documents_in_containers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = packing.pack_documents(docs)
    sizes = {r.doc_id: r.tokens for r in bpe.count_tokens(docs).collect()}
    renamed = out.selectExpr("doc_id item", "piece", "doc_start item_start", "tokens size", "container_id container", "container_start")
    assert _check_packing(renamed, sizes, 2048) <= 1.02 * sum(sizes.values()) / 2048 + 3
    good = packing.audit(out, docs).first().asDict()
    assert good == {"overfull": 0, "tight": True, "misplaced": 0, "wrong_documents": 0, "documents": docs.count(), "empty": sum(n == 0 for n in sizes.values())}
    rows_ = sorted(map(tuple, out.collect()), key=lambda r: (r[4] is None, r[4] or 0, r[5] or 0))
    for spoil, what in ((lambda r: [r[0], *r[2:]], "wrong_documents"), (lambda r: [(*r[0][:5], 1), *r[1:]], "misplaced"), (lambda r: [(*r[0][:3], 3000, *r[0][4:]), *r[1:]], "overfull")):
        assert packing.audit(spark.createDataFrame(spoil(rows_), out.schema), docs).first()[what] > 0
    assert packing.audit(out.limit(0), docs.limit(0)).first()["documents"] == 0


# ---------------------------------------------------------------- 10: look-alikes
@pytest.fixture(scope="module")
def canonical():
    return lookalike.Canonical()


def test_canonical_form(canonical):
    same = [
        ("ＡＢ，（１）～", "AB,(1)~"), ("oﬃce ﬁn ﬂ", "office fin fl"), ("⼈⽇⻚", "人日页"), ("é", "é"), ("е́", "é"), ("ё", "ë"), ("Ѕеϲ", "Sec"), ("ΑΒ ο", "AB o"),
        ("a b　c\xa0d", "a b c d"), ("a​­﻿⁠b", "ab"), ("e‍́", "é"), ("ｅ̧́", "ȩ́"), ("⚠️", "⚠"), ("ᄀ​ᅡᆨ", "각"), ("豈", "豈"),
    ]
    for a, b in same:
        assert canonical(a) == canonical(b) == unicodedata.normalize("NFC", canonical(b)), (a, b)
    apart = [("é", "e"), ("A", "a"), ("①", "1"), ("²", "2"), ("½", "1/2"), ("№", "No"), ("…", "..."), ("“", '"'), ("—", "-"), ("0", "O"), ("1", "l"), ("\n", " "), ("\t", " "), ("·", "."), ("й", "и")]
    for a, b in apart:
        assert canonical(a) != canonical(b), (a, b)
    for look, latin in (("ανυκιργχ ѵү", "avukipyx vy"), ("ά", "á"), ("𝐀е", "𝐀e"), ("е\U000e0100x", "ex")):
        assert canonical(look) == latin


_HARD = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeо ｅﬁ⼈̧́̈​‍　ёЙ가ᅡᆨ각ⅷㄱ이")), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(_HARD)
def test_splicing_equals_the_whole(canonical, text):
    form = canonical(text)
    assert form == canonical._normal(text)
    assert canonical(form) == form


def test_pairs(spark):
    texts = ["Ａb", "Ab", "Ab", "A​b", "ab", None, "", "​ ", " 　", "Аb", "x" * 100_000, "x" * 99_999 + "х"]
    df = spark.createDataFrame([(i, t, "k", "c") for i, t in enumerate(texts)], "doc_id bigint, text string, look string, chars string")
    alike = [0, 1, 2, 3, 9]
    expected = [(a, b) for a in alike for b in alike if a < b and (a, b) != (1, 2)] + [(10, 11)]
    for block, most in ((1, 1), (2, 3), (1000, 2), (1000, 1000)):
        assert sorted(map(tuple, lookalike.lookalike_pairs(df, block, most).collect())) == sorted(expected)
    assert lookalike.lookalike_pairs(df.limit(0)).count() == lookalike.lookalike_classes(df.limit(0)).count() == 0
    assert sorted(map(tuple, lookalike.lookalike_classes(df).collect())) == [(i, 0, 4, 5) for i in alike] + [(i, 10, 2, 2) for i in (10, 11)]


def test_pairs_of_a_whole_table(spark, sf_dir, canonical):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    by = defaultdict(list)
    for r in docs.collect():
        if r.text is not None and canonical._normal(r.text).strip():
            by[canonical._normal(r.text)].append((r.doc_id, r.text))
    expected = sorted((min(a, b), max(a, b)) for g in by.values() for i, (a, s) in enumerate(g) for b, t in g[i + 1 :] if s != t)
    assert sorted(map(tuple, lookalike.lookalike_pairs(docs).collect())) == expected
