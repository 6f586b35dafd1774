import pytest

from inkroll.llm import variants as V

PEOPLE = ["Robert Stanovik", "Bob Stanovik", "Stanovik, Robert", "R. Stanovik", "Stanovik RJ", "Dr. Robert J. Stanovik", "Robret Stanovik", "Robert Stanovki", "Rob. Stanovik"]
OTHERS = ["Anna Stanovik", "Robert Kolmarek", "K. Dreneva", "Ivo Dreneva", "Kai Dreneva"]
ORGS = ["Blomek Institute of Polar Optics", "Blomek Inst. for Polar Optics", "The Blomek Institut Polar Optics", "Polar Optics, Blomek Institute", "Blomke Institute of Polar Optics", "Blomek IPO"]
COMMON = frozenset("robert anna ivo institute of polar optics".split())


def entities(spark, names):
    df = spark.createDataFrame([(n, 1) for n in names], "name string, weight long")
    return {r.name: r.entity for r in V.link_variants(df).collect()}


@pytest.fixture
def known(monkeypatch):
    monkeypatch.setattr(V, "common_words", lambda names: COMMON)


def test_one_person_and_strangers(spark, known):
    got = entities(spark, PEOPLE + OTHERS)
    assert len({got[n] for n in PEOPLE}) == 1
    assert len({got[n] for n in OTHERS} | {got[PEOPLE[0]]}) == len(OTHERS) + 1 - (got["K. Dreneva"] == got["Kai Dreneva"])


def test_organisation(spark, known):
    got = entities(spark, ORGS + ["Blomek Institute of Tidal Physics"])
    assert len({got[n] for n in ORGS}) == 1 and got["Blomek Institute of Tidal Physics"] != got[ORGS[0]]


def test_pairs_are_all_and_ordered_and_leave_out_formats(spark, known):
    df = spark.createDataFrame([(n, 1) for n in ["Robert Stanovik", "ROBERT  STANOVIK", "Bob Stanovik", "R. Stanovik", "Robеrt Stanovik"]], "name string, weight long")
    got = {(r.name_1, r.name_2) for r in V.variant_pairs(V.link_variants(df)).collect()}
    full = ["Robert Stanovik", "ROBERT  STANOVIK", "Robеrt Stanovik"]
    want = {tuple(sorted((a, b))) for a in full for b in ("Bob Stanovik", "R. Stanovik")} | {("Bob Stanovik", "R. Stanovik")}
    assert got == want


def test_accents_of_two_frequent_names_stay_apart(spark, known):
    df = spark.createDataFrame([("Anna Grövik", 40), ("Anna Grovik", 30), ("Anna Trávek", 40), ("Anna Travek", 1)], "name string, weight long")
    got = {r.name: r.entity for r in V.link_variants(df).collect()}
    assert got["Anna Grövik"] != got["Anna Grovik"] and got["Anna Trávek"] == got["Anna Travek"]


def test_odd_input(spark):
    assert entities(spark, ["", "  ", "-", "X", "王静", "a b " * 2000]).keys() >= {"X", "王静"}
    assert V.link_variants(spark.createDataFrame([], "name string, weight long")).count() == 0


def test_typo_forms_meet_for_any_single_error():
    words = ["kolmarek", "kolmrek", "kolmarrek", "kolmatek", "klomarek", "olmarek", "kolmare", "a", "", "x" * 3000]
    index, forms = V.deletion_hashes(words)
    by = {k: set(forms[index == k].tolist()) for k in range(len(words))}
    assert all(by[0] & by[k] for k in range(1, 7)) and not any(by[0] & by[k] for k in (7, 8, 9))
    assert [len(by[k]) for k in (0, 2, 7, 8, 9)] == [9, 9, 2, 0, 2]  # runs of equal letters count once
