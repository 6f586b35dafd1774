import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from inkroll.llm import lookalikes as L


def test_forms():
    for odd in ("Ａｎｎ Lée", "Ann Lée", "A​nn Lée", "Аnn Lée", "﻿Ann　Lée ", "Αnn Lée"):
        assert L.canonical_text(odd) == "Ann Lée"
    assert L.canonical_text("Vocaﬂ") == "Vocafl"
    assert L.canonical_text("Zoe") != L.canonical_text("Zoë")
    assert L.canonical_text(None) is None and L.canonical_text("​") == ""


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30))
def test_idempotent_and_stable_texts_unchanged(text):
    once = L.canonical_text(text)
    assert L.canonical_text(once) == once
    if not L._UNSTABLE.search(text):
        assert once == " ".join(text.replace("\x0b", " ").replace("\x0c", " ").split())


@given(st.text(alphabet="aȩ́́ﬂＡ ́각가", max_size=12))
def test_splicing_equals_whole(text):
    whole = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text))
    spliced = L.canonical_text(text)
    assert " ".join(whole.split()) == spliced


def test_rows(spark):
    rows = [(1, "Ann Lee"), (2, "Ann Lee"), (3, " Ann  Lee "), (4, None), (5, ""), (6, "ANN LEE"), (7, "Аnn Lee"), (7, "Аnn Lee"), (8, "х" * 50_000)]
    df = spark.createDataFrame(rows, "id long, name string")
    refs = spark.createDataFrame([(9, "Ann Lee"), (10, None)], "ref_id long, ref_name string")
    got = sorted((r.id, r.ref_id) for r in L.looks_like(df, "name", refs, "ref_name").collect())
    assert got == [(1, 9), (7, 9), (7, 9)]
    assert L.looks_like(df.limit(0), "name", refs, "ref_name").count() == 0
    out = {r.id: r.c for r in L.normalise(df, "name", "c").collect()}
    assert out[1] == out[2] == out[3] == out[7] == "Ann Lee" and out[4] is None and out[5] == "" and out[8] == "x" * 50_000
