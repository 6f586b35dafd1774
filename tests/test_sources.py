import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from inkroll.operators.model import char_ngrams, fit_model, score_candidates, tfidf_stages
from inkroll.plans import cleaning, cli
from inkroll.sources import records as R
from inkroll.streaming.cleaning import stream_author_counts, stream_decisions, stream_records

LINES = [
    '{"id":"r0","authors":"John Smith, Maria Rossi"}', "", "not json", '{"id":"r3"}', '{"id":"r4","authors":null}', '{"id":"r5","authors":""}', '{"id":"r6","authors":"A. B"} x', '{"authors":"Ana Paz"}', '{"id":"r8","authors":7}',
]


@pytest.fixture
def jsonl(tmp_path):
    path = tmp_path / "in" / "records.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_limits_and_offsets(spark, jsonl):
    got = [(r.line_no, r.id, r.authors) for r in R.records(spark, jsonl).orderBy("line_no").collect()]
    assert got == [(0, "r0", "John Smith, Maria Rossi"), (3, "r3", ""), (4, "r4", None), (5, "r5", ""), (7, "", "Ana Paz"), (8, "r8", None)]
    assert [r.line_no for r in R.records(spark, jsonl, 4).collect()] == [0, 3]
    assert [r.line_no for r in R.record_slice(spark, jsonl, 0, 4).collect()] == [0, 3, 4, 5]
    assert [r.line_no for r in R.record_slice(spark, jsonl, 4, 2).collect()] == [4, 5]


def test_csv_missing_values(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('candidate,label\n"Smith, A",1\nNA,0\n"null",1\nB,x\nC,2\nD,0\nE,1.0\n', encoding="utf-8")
    df = R.read_csv(spark, str(path))
    assert [(r.candidate, r.label) for r in R.labelled_for_evaluation(df).collect()] == [("Smith, A", 1), ("D", 0), ("E", 1)]
    with pytest.raises(ValueError):
        R.labelled_for_training(df.drop("label"))
    with pytest.raises(ValueError):
        R.labelled_for_evaluation(df.where("label = '1'"))
    assert R.read_csv_if_exists(spark, None) is None and R.read_csv_if_exists(spark, str(tmp_path / "none.csv")) is None


def test_stream(spark, jsonl, tmp_path):
    folder = jsonl.rsplit("/", 1)[0]
    counts = stream_author_counts(stream_decisions(stream_records(spark, folder)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("authors").start()
    query.processAllAvailable()
    query.stop()
    assert {r.author: r["count"] for r in spark.table("authors").collect()} == {"John Smith": 1, "Maria Rossi": 1, "Ana Paz": 1}


def test_clean_and_count(spark, jsonl, tmp_path):
    counts = cleaning.clean_and_count(spark, jsonl, uncertain_to=str(tmp_path / "u"), counts_to=str(tmp_path / "c"))
    assert [(r.author, r["count"]) for r in counts.collect()] == [("John Smith", 1), ("Maria Rossi", 1), ("Ana Paz", 1)]
    assert R.read_csv(spark, str(tmp_path / "c")).count() == 3


def test_summaries_without_optional_columns(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "author string, count long")
    tables = cleaning.summaries(counts, None, spark.createDataFrame([("x",), ("x",)], "candidate string"))
    assert tables["top_rejected"].collect()[0].frequency == 2
    assert "rejected_score_distribution" not in tables


def test_parser():
    args = cli.parser().parse_args(["clean", "--file", "x", "--mode", "trial"])
    assert (args.person_threshold, args.nonperson_threshold, args.max_records) == (0.90, 0.10, None)


def test_ngrams(spark):
    got = spark.createDataFrame([("ab",), ("A",), (None,)], "c string").select(char_ngrams(F.col("c")).alias("g")).collect()
    assert sorted(got[0].g) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    assert sorted(got[1].g) == sorted([" a", "a ", " a "]) and got[2].g == []


def test_model(spark, tmp_path):
    people = [(f"{a} {b}", 1) for a in ("Ann", "Bo", "Cy", "Di") for b in ("Lee", "Ross", "Fox", "Day")]
    groups = [(f"{a} {b}", 0) for a in ("Atlas", "Institute of", "Department of", "Physics") for b in ("Collaboration", "Physics", "Optics", "Group")]
    df = spark.createDataFrame(people + groups, "candidate string, label int")
    model = fit_model(df, max_iter=30)
    rows = spark.createDataFrame([("Ann Fox", 1), ("Institute of Optics", 2), (None, 3), ("Ann Fox", 4)], "candidate string, n int")
    got = {r.n: r.person_score for r in score_candidates(rows, model).collect()}
    assert got[1] == got[4] > 0.5 > got[2] and got[3] is None
    model.write().overwrite().save(str(tmp_path / "m"))
    again = {r.n: r.person_score for r in score_candidates(rows, PipelineModel.load(str(tmp_path / "m"))).collect()}
    assert again[1] == pytest.approx(got[1])
    counts, scale, _ = tfidf_stages(df.withColumn("ngrams", char_ngrams(F.col("candidate"))))
    k = counts.vocabulary.index(" a")
    n_docs, with_it = 32, sum(any(w.startswith("a") for w in c.lower().split()) for c, _ in people + groups)
    import math

    assert scale.getScalingVec()[k] == pytest.approx(math.log((1 + n_docs) / (1 + with_it)) + 1)
