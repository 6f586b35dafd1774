import pytest

from inkroll.llm import variants as V


@pytest.fixture
def entities(spark, monkeypatch):
    monkeypatch.setattr(V, "common_words", lambda names: frozenset("robert anna ivo".split()))

    def run(weighted):
        df = spark.createDataFrame(weighted, "name string, weight long")
        return {r.name: r.entity for r in V.link_variants(df).collect()}

    return run


def test_typos_in_short_family_names(entities):
    got = entities([("Robert Zuren", 9), ("Robert Zurn", 1), ("Anna Kolm", 9), ("Anna Klom", 1), ("Ivo Drat", 9), ("Ivo Drata", 1), ("Anna Bel", 9), ("Anna Bal", 1)])
    assert got["Robert Zuren"] == got["Robert Zurn"] and got["Anna Kolm"] == got["Anna Klom"] and got["Ivo Drat"] == got["Ivo Drata"]
    assert got["Anna Bel"] != got["Anna Bal"]  # three letters are too few


def test_chains_and_circles_of_any_length_have_one_root(spark):
    chain = [(k, k + 1) for k in range(1, 14)]  # to 14
    ring = [(21, 22), (22, 23), (23, 21), (24, 21), (25, 24)]  # with a tail
    pair = [(31, 32), (32, 31)]
    df = spark.createDataFrame([(u, v, 60) for u, v in [*chain, *ring, *pair, (41, 42), (43, 42)]], "u long, v long, score int")
    got = {r.u: r.v for r in V.rooted(df).collect()}
    assert got == {**{k: 14 for k in range(1, 14)}, **{k: 23 for k in range(21, 26)}, 31: 32, 32: 32, 41: 42, 43: 42}
    assert V.rooted(df.limit(0)).count() == 0
