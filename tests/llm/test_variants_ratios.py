import pytest

from inkroll.llm import variants as V


@pytest.fixture
def groups(spark, monkeypatch):
    monkeypatch.setattr(V, "common_words", lambda names: frozenset("robert anna katherine john james institute of".split()))

    def run(weighted):
        df = spark.createDataFrame(weighted, "name string, weight long")
        found: dict[int, set] = {}
        for r in V.link_variants(df).collect():
            found.setdefault(r.entity, set()).add(r.name)
        return {frozenset(x) for x in found.values()}

    return run


MIXED = [("Katherine Zabrinskie", 6), ("Katherine Zabrinskye", 2), ("Anna Gr\u00f6vik", 40), ("Anna Grovik", 30), ("Robert Kolmarek", 9), ("Bob Kolmarek", 3), ("R. Kolmarek", 1), ("Robert Klomarek", 1), *((f"Robert Ordin{c}lav", 1) for c in "aeou")]


def test_the_same_rows_ten_times_over_change_nothing(groups):
    one = groups(MIXED)
    assert one == groups([(n, w * 10) for n, w in MIXED])
    assert frozenset({"Katherine Zabrinskie", "Katherine Zabrinskye"}) in one
    assert not any({"Anna Gr\u00f6vik", "Anna Grovik"} <= x for x in one)


def test_a_chain_of_ten_spellings_is_one_entity(groups):
    family = "Zabrinskaterov"
    chain = [(f"Katherine {family[: len(family) - k]}", 1) for k in range(10)]
    assert groups(chain) == {frozenset(n for n, _ in chain)}


def test_middle_initials_part_people(groups):
    got = groups([("John A Smith", 50), ("John B Smith", 40), ("John Smith", 50), ("Smith, John A.", 3), ("J. B. Smith", 2), ("James C Smith", 9), ("James Smith", 4), ("J. C. Smith", 1)])
    assert got == {frozenset({"John A Smith", "Smith, John A."}), frozenset({"John B Smith", "J. B. Smith"}), frozenset({"John Smith"}), frozenset({"James C Smith", "James Smith", "J. C. Smith"})}


def test_forms_do_not_pair_the_names_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(V, "common_words", lambda names: frozenset("robert".split()))
    given = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in ("nar", "ros", "til", "vek")]
    df = spark.createDataFrame([(f"{g} Kolmarek", 1) for g in given] + [("Robert Kolmarek", 5), ("R. Kolmarek", 1)], "name string, weight long")
    assert len({r.entity for r in V.link_variants(df).where("name in ('Robert Kolmarek', 'R. Kolmarek')").collect()}) == 1
    targets = []
    keep = V._targets
    monkeypatch.setattr(V, "_targets", lambda live: targets.append(keep(live)) or targets[-1])
    monkeypatch.setattr(V, "release", lambda *frames: None)
    V.link_variants(df).count()
    assert targets[0].count() == targets[0].select("key").distinct().count()  # one row per form
