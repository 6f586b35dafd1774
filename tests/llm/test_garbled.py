import random

import pytest

from inkroll.llm import garbled as G

FIRST = ["René", "Łukasz", "José", "Søren", "Zoltán", "Małgorzata", "Anna", "Иван", "Ольга", "王静", "Chloé", "Tomáš"]
LAST = ["Müller", "Kowalski", "García", "Nowák", "Grêvik", "Stöve", "Петров", "Смирнова", "Lindström", "Şahin"]


def names():
    return [f"{a} {b}" for a in FIRST for b in LAST]


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame([(i, "; ".join(names()[i : i + 4])) for i in range(0, 120, 4)] * 20, "line_no long, authors string")
    return G.fit(df, "authors")


def test_held_out_restoration(fitted):
    model, margin = fitted
    held = ["Élodie Müller", "Márta Şahin", "Nikołaj Gröve", "Ирина Петрова"]
    total = right = 0
    for name in held:
        for wrong in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"):
            bad = G.garble(name, "utf-8", wrong)
            total += 1
            found, restored, _ = G.restore(bad, model, margin)
            assert found
            right += restored == name
    assert right >= 0.9 * total
    twice = G.garble(G.garble("René Müller", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert G.restore(twice, model, margin)[1] == "René Müller"


def test_clean_and_unusual_names_pass(fitted):
    model, margin = fitted
    for name in [*names(), "Ａｎｎａ Müller", "An​na Müller", "René Müller", "Аnna Müller", "Anna Müller", "O’Neil Müller", "", "Ann"]:
        assert not G.restore(name, model, margin)[0], name
    assert G.restore("Ren� Müller", model, margin) == (True, None, None)


def test_rows(spark, fitted):
    model, margin = fitted
    bad = G.garble("José García", "utf-8", "cp1252")
    df = spark.createDataFrame([(1, f"Anna Lee; {bad}"), (2, "Anna Lee"), (3, None), (4, ""), (1, f"Anna Lee; {bad}")], "line_no long, authors string")
    got = [(r.line_no, r.position, r.restored) for r in G.find_garbled(df, "authors", model, margin).collect()]
    assert got == [(1, 1, "José García")] * 2
    assert G.find_garbled(df.limit(0), "authors", model, margin).count() == 0


def test_margin_covers_chance_readings():
    model = G.CharModel({" a": 5, "ab": 5, "b ": 5})
    assert G.validated_margin(model, ["ab"]) == 2.0
    random.seed(0)
