import re
from types import SimpleNamespace

import numpy as np
import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from lectern.llm.lines import line_bitmaps, line_key, pack, repeated_lines, site_lines, unite, unpack, without_lines
from lectern.llm.look import consistent_form, consistent_texts, look_classes, look_prints, looks_of, resolved_set, same_looking_pairs
from lectern.llm.pieces import cores, cut_texts, pieces, trimmed


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("café", "café"), ("zero​width﻿", "zerowidth"), ("a b c", "a b c"),
        ("ﬁsh ½", "fish 1⁄2"), ("рарег", "рарег"), ("pаper wоrk", "paper work"), ("Тhe end", "The end"), ("ｶﾞ", "ガ"), ("a\r\nb", "a\nb"),
        ("Москвa река", "Москва река"), ("со­оп", "сооп"), ("", "​"), ("e​́", "é"),
    ],
)
def test_same_look(a, b):
    assert consistent_form(a) == consistent_form(b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("\u0410\u0308lt", "Ält"), ("\u04d2lt", "A\u0308lt"), ("sch\u043e\u0308n", "schön"), ("tr\u0435\u0300s", "très"), ("avi\u03cc\u006e", "avión"), ("avi\u03bf\u0301n", "avión"),
        ("н\u00ebбо", "нёбо"), ("наïв", "наїв"), ("л\u00eb", "л\u0451"), ("\u03ac\u03bbλ\u03bf", "\u00e1λλo"),
    ],
)
def test_same_look_with_accents(a, b):
    assert consistent_form(a) == consistent_form(b)
    assert consistent_form(consistent_form(a)) == consistent_form(a)


@pytest.mark.parametrize(("a", "b"), [("Book", "book"), ("3", "8"), ("café", "cafe"), ("a, b", "a b"), ("a  b", "a b"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("Мир", "мир")])
def test_other_look(a, b):
    assert consistent_form(a) != consistent_form(b)


def test_forms_are_stable_and_keep_scripts():
    for t in ["Привет, мир! в 2024", "paper", "日本語 テキスト", "हिन्दी पाठ", "a" * 100_000]:
        once = consistent_form(t)
        assert consistent_form(once) == once
    assert consistent_form("он сор в лесу") == "он сор в лесу"
    assert consistent_form("the сор ran") == "the cop ran"
    assert consistent_form(None) is None
    assert not resolved_set("pаper") and resolved_set("paper") == {"Latin"} and "Jpan" in resolved_set("日本の")


def test_unicode_confusables(spark):
    """Letters of ICU's data, beyond the fixed table, and stable forms."""
    looks = looks_of(spark)
    assert len(looks.alike) > 150
    for a, b in [("\u0251pple", "apple"), ("\ua4d0ook", "Book"), ("b\u2c9fok", "book"), ("t\u0433ee", "tree"), ("\ua4f3pen", "Open"), ("l\u0561st", "lwst"), ("\u13d4ay", "Way")]:
        assert consistent_form(a, looks) == consistent_form(b, looks) == b, a
    for t in ["Привет, мир! Гора и город", "город", "Быстрая река", "\u03bb\u03cc\u03b3\u03bf\u03c2 \u03c3\u03bf\u03c6\u03af\u03b1", "Straße", "ısı", "日本語 テキスト", "हिन्दी"]:
        assert consistent_form(t, looks) == t, t
        assert consistent_form(t) == t
    assert consistent_form("Г\u006fра, \u0059тро и го\u0433од", looks) == "Гора, Утро и гогод" == consistent_form("Гора, Утро и го\u0072од", looks)


def test_a_session_without_icu_is_an_error(spark):
    """No JVM, a JVM without ICU and one that fails: never the smaller fixed table."""

    class Session:
        def __init__(self, jvm):
            self._jvm = jvm

    def fails():
        raise Py4JError("lost")

    icu = lambda text: SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=text))))
    for jvm in (None, icu(spark._jvm.no.such.text), icu(SimpleNamespace(**{"SpoofChecker$Builder": fails}))):
        for _ in range(2):  # nor on a second call
            with pytest.raises(RuntimeError, match="ICU"):
                looks_of(Session(jvm))
    assert len(looks_of(spark).alike) > 150


def test_classes_and_split_groups(spark):
    rows = [(i, "paper" if i % 2 else "pаper") for i in range(60)] + [(100, "x"), (101, "x"), (102, None)]
    prints = look_prints(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").withColumn("k", F.lit("x"))
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if (a + b) % 2}
    for split in (7, 2000):
        got = [(r.left_id, r.right_id) for r in same_looking_pairs(prints, "k", split).collect()]
        assert len(got) == len(want) and set(got) == want
    assert sorted((r.item_id, r.class_id, r.members) for r in look_classes(prints, "k").collect()) == [(i, 0, 60) for i in range(60)]
    assert look_classes(prints.limit(0), "k").count() == 0


def test_pairs(spark):
    rows = [(1, "paper"), (2, "pаper"), (3, "paper"), (3, "paper"), (4, None), (5, ""), (6, "​"), (7, "other"), (None, "paper")]
    df = spark.createDataFrame(rows, "id bigint, t string").withColumn("look", F.lit(1)).withColumn("raw", F.lit(2))
    got = same_looking_pairs(look_prints(df, "id", "t").withColumn("k", F.lit("x")), "k").collect()
    assert sorted((r.left_id, r.right_id) for r in got) == [(1, 2), (2, 3), (5, 6)]
    assert same_looking_pairs(look_prints(df.limit(0), "id", "t").withColumn("k", F.lit("x")), "k").count() == 0
    forms = consistent_texts(df, "t", "look").orderBy("id").collect()
    assert forms[0].look == "paper" and df.columns == ["id", "t", "look", "raw"]


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 4000, 4096):
        ids = np.sort(rng.choice(1 << 12, n, replace=False))
        assert (unpack(pack(ids)) == ids).all()
    a, b = np.arange(0, 4000, 2), np.arange(0, 4000, 3)
    assert (unpack(unite([pack(a), pack(b), pack(b)])) == np.union1d(a, b)).all()


def test_variants_are_united_before_they_are_counted(spark):
    """Three variants of one line in three documents each, of which two overlap."""
    docs = [(i, 1, t) for i, t in [(1, "Share us"), (2, "Share us"), (3, "SHARE US"), (3, "SHARE US"), (4, "share 5 us"), (5, "Share us\nshare us"), (9000, "sharе us"), (6, "other")]]
    df = spark.createDataFrame(docs, "doc_id bigint, book_id bigint, text string").repartition(3)
    bk = spark.createDataFrame([(1, "s", "T"), (1, "s", "T")], "book_id bigint, site string, title string")
    bits = line_bitmaps(site_lines(df, bk), 2).collect()
    assert sorted((r.hi, r.n, unpack(r.bits).tolist()) for r in bits) == [(0, 5, [1, 2, 3, 4, 5]), (2, 1, [9000 - (2 << 12)])]
    assert {(r.doc_id, r.line_no) for r in repeated_lines(df, bk, 6, 0.0).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (5, 2), (9000, 1)}
    assert repeated_lines(df, bk, 7, 0.0).count() == 0


def test_line_keys():
    assert line_key("Share with 12 friends") == line_key("  SHARE  with 345 Ｆriends ")
    assert line_key("* * *") is None and line_key("") is None and line_key(None) is None
    assert line_key("a.") != line_key("a")


def _brute(docs, books, n_min=5, share=0.05):
    site = {b: s for b, s, _ in books}
    title = {b: line_key(t) for b, _, t in books}
    size, per, lines = {}, {}, []
    for d, b, t in set(docs):
        if site.get(b) is not None:
            size.setdefault(site[b], set()).add(d)
        for n, x in enumerate(re.split("\r?\n", t or ""), 1):
            k = line_key(x)
            if k:
                per.setdefault((site.get(b), k), set()).add(d)
                lines.append((d, n, site.get(b), k, k == title.get(b)))
    return {(d, n) for d, n, s, k, own in lines if own or (s is not None and len(per[s, k]) >= max(n_min, share * len(size[s])))}


def test_repeated_lines(spark):
    rng = np.random.default_rng(2)
    books = [(b, None if b == 9 else f"s{b % 3}", f"Book {b} Title") for b in range(10)] + [(10, "s0", None)]
    docs = []
    for d in range(400):
        b = 0 if d % 3 == 0 else int(rng.integers(0, 11))  # a third of all in one book
        own = [f"story line {d} {chr(97 + i)}{d % 7}x" for i in range(3)]
        noise = [f"Visit  our site {d}", "ALL rights reserved", f"book {b} title", "* * *"]
        rows = [*own[:2], *[x for x in noise if rng.random() < 0.4], own[2]]
        docs.append((d + 70_000 * (d % 2), b, ("\r\n" if d % 5 == 0 else "\n").join(rows)))
    docs += [docs[0], (999_999, 3, None), (999_998, 3, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, book_id bigint, text string").withColumn("site", F.lit("clash"))
    bk = spark.createDataFrame(books, "book_id bigint, site string, title string").withColumn("text", F.lit("clash"))
    got = repeated_lines(df, bk)
    assert {(r.doc_id, r.line_no) for r in got.collect()} == _brute(docs, books)
    clean = {r.doc_id: r for r in without_lines(df, got).collect()}
    gone = _brute(docs, books)
    for d, _, t in docs:
        if t is None:
            assert clean[d].clean_text is None
        else:
            parts = re.split("(?<=\n)", t)
            assert clean[d].clean_text == "".join(p for n, p in enumerate(parts, 1) if (d, n) not in gone)
    assert repeated_lines(df.limit(0), bk).count() == 0 and repeated_lines(df.limit(5), bk.limit(0)).count() == 0


TEXTS = ["", " \n ", "short", "word " * 900, "x" * 5000, "一句话。" * 700, "a\n\nb\n" * 600, ("Dr. No said 4.5. " * 50 + "\n\n") * 9, "é" * 3000, "é" * 3000, "~=" * 2000]


@pytest.mark.parametrize("t", TEXTS)
@pytest.mark.parametrize("limit", [2, 61, 900, 1200])
def test_pieces(t, limit):
    t0 = trimmed(t)
    got = pieces(t, limit)
    assert "".join(t0[a:e] for _, a, e in got) == t0
    for g, a, e in got:
        assert 0 < e - g <= limit and 0 <= a - g <= 60
    assert all(x[0] < y[0] for x, y in zip(got, got[1:]))
    assert (len(got) > 1) == (len(t0) > limit)


def test_weak_boundaries_are_merged_first():
    t = "aaa bbb. ccc ddd.\n\neee fff. ggg"
    assert [t[a:b] for a, b in cores(t, 20, 0)] == ["aaa bbb. ccc ddd.\n\n", "eee fff. ggg"]


def test_cut_texts(spark):
    df = spark.createDataFrame([("c", 1, "x" * 50, 20), ("c", 2, "ab " * 20, 20), ("c", 3, None, 20), ("c", 4, "ok", 20), ("c", 5, "a" * 9, None)], "item_kind string, item_id bigint, text string, size_limit int")
    rows = cut_texts(df.withColumn("piece", F.lit(0)), only_oversized=True).collect()
    assert {(r.item_id, r.cut_kind) for r in rows} == {(1, "forced"), (2, "natural")}
    assert {(r.item_id, r.cut_kind) for r in cut_texts(df).collect()} == {(1, "forced"), (2, "natural"), (4, "whole")}
    assert cut_texts(df.limit(0)).count() == 0
