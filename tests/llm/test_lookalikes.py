import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkmill.llm.lookalikes import Former, confusable_kind, looks, reading_pairs, resolved_scripts, with_form

SAME = [
    ("pausеd", "paused"), ("café", "café"), ("саfе́", "café"), ("ﬁle ＡＢ１", "file AB1"), ("a​b­c﻿⁠", "abc"), ("a b c　d", "a b c d"),
    ("well‐tested‑x", "well-tested-x"), ("Поsle", "Пosle"), ("ё", "ё"), ("ë", "ё"), ("й", "й"), ("СО", "CO"), ("a\r\nb", "a\nb"), ("Τօϲ", "Toc"),
    # Disguises by hand, from several scripts and from the same one.
    ("Ꭺ", "A"), ("ꓮ", "A"), ("ɑ", "a"), ("ı", "i"), ("ℎ", "h"), ("Ⅳ", "IV"), ("𝗯old", "bold"), ("к", "k"), ("a–b", "a-b"), ("a−b", "a-b"), ("a…", "a..."), ("‘a’", "'a'"), ("“a”", '"a"'), ("｀a", "`a"), ("ƽ".replace("ƽ", "ѕ"), "s"), ("ⲟ", "o"), ("Ᏼ", "B"), ("ꓢ", "S"), ("ɡ", "g"), ("ᴏ", "o"), ("ⅼ", "l"),
]
OTHER = ["abc", "Abc", "ábc", "abd", "ab c", "ab1", "abl", "abI", "x²", "x2", "", " ", "a\nb", "a b", "straße", "strasse", "½", "1/2", "нет", "het", "O", "0", "l", "1", "m", "rn", "æ", "ae", "cafe", "café", "a—b", "a-b", "ł", "w"]


@pytest.fixture(scope="module")
def table(spark):
    return looks(spark)


@pytest.fixture(scope="module")
def consistent_form(table):
    return Former(table)


def test_table_is_bounded_and_respects_case_and_digits(table):
    assert 1000 < len(table.letter) < 10_000 and len(table.sign) < 1000
    assert all(latin.isalpha() and latin.isascii() for latin in table.letter.values()) and not any(c.isalnum() for s in table.sign.values() for c in s)
    assert all(latin.isupper() == c.isupper() for c, latin in table.letter.items() if unicodedata.category(c) in ("Lu", "Ll"))


def test_same_look_same_form(consistent_form):
    for a, b in SAME:
        assert consistent_form(a) == consistent_form(b), (a, b)


def test_differences_stay(consistent_form):
    forms = [consistent_form(x) for x in OTHER]
    assert len(set(forms)) == len(forms)


def test_scripts(consistent_form, table):
    assert "LATIN" in resolved_scripts("аbc", table) and confusable_kind("pаy", table) == "mixed" and confusable_kind("рау", table) == "whole" and confusable_kind("дом", table) == "single"
    assert consistent_form("дoм") == "дом"


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_form_is_stable(consistent_form, text):
    assert consistent_form(consistent_form(text)) == consistent_form(text)
    assert consistent_form(unicodedata.normalize("NFD", text)) == consistent_form(text)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdehijopsxy ABEHKMOPTX", min_size=1, max_size=40), st.randoms())
def test_disguise_round_trip(consistent_form, table, text, rng):
    disguised = "".join(rng.choice([c, *(x for x, latin in table.letter.items() if latin == c)]) + rng.choice(["", "", "​"]) for c in text)
    assert consistent_form(disguised) == text


def test_pairs(spark, rows, consistent_form):
    data = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "abd"), (5, None), (6, ""), (7, "​"), (1, "abc"), (None, "abc"), (8, "x" * 300_000), (9, "x" * 299_999 + "х"), (10, "same"), (11, "same")]
    df = rows(data, "doc_id bigint, text string").selectExpr("*", "'c' AS form", "1 AS raw", "2 AS key")
    texts = {i: t for i, t in data if i and t is not None}
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if texts[a] != texts[b] and consistent_form(texts[a]) == consistent_form(texts[b])}
    assert {tuple(r) for r in reading_pairs(df, "doc_id", "text").collect()} == want == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert reading_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert {r["doc_id"]: r["form"] for r in with_form(df, "doc_id", "text").where("doc_id IN (2, 5, 6)").collect()} == {2: "abc", 5: None, 6: ""}
