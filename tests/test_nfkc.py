import re
import unicodedata
from collections import Counter

import pytest

import __spark_entry__ as entry
from inkroll.operators.rules import classify_by_rules

FIELDS = ["Mei K. Stablozos；Ann Lee；Bloclu Array Collaboration；Bo Eklund", "Ａｎｎ Lee, Bo Eklund; Ｌｉ Wei", "Ann Lee and Bo Eklund（Ｘ； Y）, atlas", "Ann Lee, ﬁnn Moe｜Ulf Ox", None, "", "；， ；"]


def brute(text):
    """Candidates of a field by the reference's steps, in plain Python."""
    text = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFKC", text)).replace("\n", " ").replace("\t", " ")
    text = re.sub(r"\s+and\s+", ",", re.sub(r"\s*[;|]\s*", ",", " ".join(text.split())), flags=re.I)
    parts = [" ".join(" ".join(x.split()).strip(" .;:-").split()) for x in text.split(",")]
    return [x for x in parts if x]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, f"r{i}", a) for i, a in enumerate(FIELDS)], "line_no long, id string, authors string").write.parquet(str(tmp_path / "raw_records.parquet"))
    return str(tmp_path)


def test_candidate_queries_take_the_whole_cleaning_path(spark, folder):
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, folder).collect()]
    want = [(i, f"r{i}", p, c) for i, a in enumerate(FIELDS) if a for p, c in enumerate(brute(a))]
    assert sorted(run("candidates_nfkc")) == want and len(want) == 13
    decided = classify_by_rules(spark.createDataFrame(want, "line_no long, id string, position int, candidate string")).collect()
    people = Counter(r.candidate for r in decided if r.label == "PERSON")
    assert people["Ann Lee"] == 4 and people["Bo Eklund"] == 3
    assert dict(run("author_counts_nfkc")) == dict(run("top_authors_nfkc")) == people
    assert run("author_counts_nfkc")[0] == ("Ann Lee", 4)
    assert run("distinct_authors_nfkc") == [(len(people),)]
    assert dict(run("decision_counts_nfkc")) == Counter(r.label for r in decided)
    uncertain = sorted((r.line_no, r.id, r.position, r.candidate, r.score, r.reason) for r in decided if r.label == "UNCERTAIN")
    assert sorted(run("uncertain_rows_nfkc")) == uncertain
    sheet = {r.candidate: r.frequency for r in entry.queries()["labelling_sheet_nfkc"](spark, folder).collect()}
    assert sheet == Counter(c for *_, c in want)


def test_flagship_is_the_whole_path(spark, folder, monkeypatch):
    ask = []
    monkeypatch.setattr(entry.registry, "queries", lambda: {"author_counts_nfkc": lambda s, d: ask.append(d)})
    entry.entry(spark)
    assert ask == ["/root/testdata/sf0.001"]
