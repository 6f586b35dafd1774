import pytest

from inkroll.functions import text as X
from inkroll.operators.candidates import explode_candidates
from inkroll.operators.features import FEATURES, with_features
from inkroll.operators.rules import by_thresholds, classify_by_rules, with_rules
from pyspark.sql import functions as F

INPUTS = [
    "John Smith, Department of Physics, University of X, Maria Rossi",
    "J. Smith and J.K. Li; J.K. Rowling | A. B.",
    "John Smith (University of X), CMS Collaboration, et al",
    "Jean-Luc O'Connor, Balázs Kégl, van der Berg",
    "Eugene Cernan, Takashi Kanasaki, LI Wei, WEI ZHANG",
    "Physics, Physics Lab, Smith Lab, The Beatles, ATLAS",
    "a (b (c) d) e, --X. Y.--, ..., Smith, Jr.",
    "Ana de la Cruz, Working Smith, http://x.y, a@b.c, Agent 007",
    "A; and B, Smith Labs, Physics Labs, Lab of Smith",
    "Ann Lee and Bo\u001cEk,　Ulf Ox",
    "A and and B, ATLAS Experiment, Li Wei et al., WEI",
    "One Two Three Four Five Six, One Two Three Four Five Six Seven, Mary and Co of Art, art by design",
]
P, N, U = "PERSON", "NON_PERSON", "UNCERTAIN"
GOLDEN = [
    [("John Smith", P, 0.9), ("Department of Physics", N, 0.97), ("University of X", N, 0.97), ("Maria Rossi", P, 0.9)],
    [("J. Smith", P, 0.9), ("J.K. Li", N, 0.88), ("J.K. Rowling", U, 0.5), ("A. B", U, 0.5)],
    [("John Smith", P, 0.9), ("CMS Collaboration", N, 0.98), ("et al", U, 0.5)],
    [("Jean-Luc O'Connor", P, 0.9), ("Balázs Kégl", P, 0.9), ("van der Berg", P, 0.9)],
    [("Eugene Cernan", N, 0.97), ("Takashi Kanasaki", N, 0.97), ("LI Wei", N, 0.88), ("WEI ZHANG", U, 0.5)],
    [("Physics", U, 0.5), ("Physics Lab", N, 0.96), ("Smith Lab", U, 0.5), ("The Beatles", N, 0.92), ("ATLAS", N, 0.88)],
    [("a d) e", U, 0.5), ("X. Y", U, 0.5), ("Smith", U, 0.5), ("Jr", U, 0.5)],
    [("Ana de la Cruz", P, 0.9), ("Working Smith", N, 0.98), ("http://x.y", N, 0.99), ("a@b.c", N, 0.99), ("Agent 007", N, 0.99)],
    [("A", U, 0.5), ("and B", U, 0.45), ("Smith Labs", U, 0.5), ("Physics Labs", N, 0.96), ("Lab of Smith", N, 0.95)],
    [("Ann Lee", P, 0.9), ("Bo Ek", P, 0.9), ("Ulf Ox", P, 0.9)],
    [("A", U, 0.5), ("and B", U, 0.45), ("ATLAS Experiment", N, 0.98), ("Li Wei et al", P, 0.9), ("WEI", N, 0.88)],
    [("One Two Three Four Five Six", U, 0.5), ("One Two Three Four Five Six Seven", N, 0.93), ("Mary", U, 0.5), ("Co of Art", P, 0.9), ("art by design", U, 0.45)],
]


def test_golden_rows(spark):
    df = spark.createDataFrame(list(enumerate(INPUTS)), "line_no long, authors string")
    got = {}
    for r in with_rules(explode_candidates(df)).orderBy("line_no", "position").collect():
        got.setdefault(r.line_no, []).append((r.candidate, r.rule_label, r.rule_score))
    assert [got[i] for i in range(len(INPUTS))] == GOLDEN


def test_empty_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, " ,; ", "p"), (4, "Ann Lee", "p")], "line_no long, authors string, position string")
    out = explode_candidates(df)
    assert out.columns == ["line_no", "position", "candidate"]
    assert [tuple(r) for r in out.collect()] == [(4, 0, "Ann Lee")]
    assert explode_candidates(df.limit(0)).count() == 0
    rows = with_rules(spark.createDataFrame([(None,), ("",)], "candidate string")).collect()
    assert [(r.rule_label, r.rule_reason) for r in rows] == [("UNCERTAIN", "ambiguous"), ("NON_PERSON", "empty")]


def test_ner_and_scores(spark):
    df = spark.createDataFrame([("smith", "ORG"), ("smith jones", "PERSON"), ("smith jones", None)], "candidate string, ner_label string")
    got = [(r.label, r.score, r.reason) for r in classify_by_rules(df, "candidate", "ner_label").collect()]
    assert got == [("NON_PERSON", 0.2, "NER says ORG"), ("PERSON", 0.88, "NER says PERSON and structure plausible"), ("UNCERTAIN", 0.5, "ambiguous")]


def test_features(spark):
    r = with_features(spark.createDataFrame([("The Ann-Lee O’Hara & 7 of CERN a@b",)], "candidate string")).first().asDict()
    assert set(FEATURES) <= set(r)
    assert (r["token_count"], r["has_digit"], r["has_email"], r["has_ampersand"], r["has_hyphen"], r["has_apostrophe"], r["starts_with_the"], r["contains_of"], r["org_phrase_count"]) == (8, 1, 1, 1, 1, 1, 1, 1, 1)


def test_nfkc_and_idempotence(spark):
    df = spark.createDataFrame([(1, "Ａｎｎ（Ｘ） Lee, Bo Ek; Cy and Di Ox")], "line_no long, authors string")
    first = [r.candidate for r in explode_candidates(df).collect()]
    assert first == ["Ann Lee", "Bo Ek", "Cy", "Di Ox"]
    again = spark.createDataFrame([(1, ",".join(first))], "line_no long, authors string")
    assert [r.candidate for r in explode_candidates(again).collect()] == first


@pytest.mark.parametrize("score, want", [(0.9, "PERSON"), (0.1, "NON_PERSON"), (0.5, "UNCERTAIN"), (None, "UNCERTAIN")])
def test_thresholds(spark, score, want):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(by_thresholds(F.col("s"), 0.9, 0.1)).first()[0] == want


def test_spaces(spark):
    df = spark.createDataFrame([("  a  b\u001c ",)], "c string")
    assert df.select(X.normalize_spaces(F.col("c"))).first()[0] == "a b"
