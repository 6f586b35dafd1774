import json

import pytest

from inkroll import session as S
from inkroll.plans import charts, cleaning
from inkroll.sources import records as R
from inkroll.sources import sinks

ODD = [
    '{"id":"a","authors":"X Y"} trailing', '{"id":"a"} {"id":"b"}', '{"id":"a"},{"id":"b"}', '{"id":"a"}],[{"id":"b"}', '{"id":"a"}}', "{'id':'a'}", '{id:"a"}', '{"id":"a",}', '[{"id":"a"}]', "7", '"text"', "null", "{", "}", "{}",
    '{"id":"a","id":"b","authors":"last"}', '{"id":NaN,"authors":"n"}', '{"id":1.50,"authors":"x"}', '{"id":["a"],"authors":{"b":1}}', '{"id":null,"authors":true}', '{"id":"\\u00e9\\n\\"q\\"","authors":"\\ud83d\\ude00"}', '{"id":"~end of line~"}',
    '  {"id":"blank","authors":"A"}\t', '{"other":{"id":"inner","authors":"inner"},"id":"outer"}', '{"id":"tab\there"}', '\ufeff{"id":"mark"}', '{"versions":[{"v":1},{"v":2}],"id":"deep","authors":"B","p":[["a",["b"]]]}', '{"id":01}', '{"id":"a" /* c */}',
]


def strict(line):
    try:
        got = json.loads(line.strip(" "))
    except ValueError:
        return None
    return (got.get("id", ""), got.get("authors", "")) if isinstance(got, dict) else None


def test_lines_are_read_as_the_standard_says(spark):
    want = {k: tuple(x if isinstance(x, str) else None for x in got) for k, line in enumerate(ODD) if (got := strict(line))}
    df = spark.createDataFrame(list(enumerate(ODD)), "line_no long, line string")
    assert {r.line_no: (r.id, r.authors) for r in R.parse_lines(df).collect()} == want
    assert R.parse_lines(df.limit(0)).count() == 0


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    lines = []
    for name, n in (("b", 300), ("a", 1), ("c", 0), ("d", 700)):
        own = [json.dumps({"id": f"{name}{k}", "authors": "x" * (k % 50)}) if k % 7 else "" for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{x}\n" for x in own))
        lines.append((name, own))
    want = [x for _, own in sorted(lines) for x in own]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", old):  # many splits of a file, and many files in a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert [r.line for r in R.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == want
            got = R.records(spark, str(tmp_path), 400).collect()
            assert {r.line_no: r.id for r in got} == {k: json.loads(x)["id"] for k, x in enumerate(want[:400]) if x}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


class _Far:
    """A session of a cluster without a shared folder."""

    def __init__(self, master, named=None):
        self.sparkContext, self.conf, self.master, self.named, self.folder = self, self, master, named, None

    def get(self, key, default=None):
        return self.named or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            S.shared_folder(_Far(master))
        assert S.shared_folder(_Far(master, "hdfs://shared")) == "hdfs://shared"
    assert S.shared_folder(_Far("local[4]")) and S.shared_folder(_Far("local"))


def test_tables_are_released(spark):
    import os

    one, two = S.materialise(spark.range(5)), S.materialise(spark.range(6))
    path = one._inkroll_table.removeprefix("file:")
    assert os.path.exists(path) and one.count() == 5
    S.release(one, spark.range(1))
    assert not os.path.exists(path) and two.count() == 6
    S.clear()
    assert not os.path.exists(two._inkroll_table.removeprefix("file:"))


def test_text_is_written_by_the_file_system(spark, tmp_path):
    sinks.write_text(spark, "précis\n", str(tmp_path / "new" / "a.txt"))
    assert (tmp_path / "new" / "a.txt").read_text(encoding="utf-8") == "précis\n"


def test_sensitivity_writes_buckets_and_top_lists(spark, tmp_path, monkeypatch):
    from inkroll.operators import model

    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps({"id": str(k), "authors": a}) for k, a in enumerate(["Ann Lee, Bo Ross", "Cy Fox, Bo Ross", "Di Day, Group X, Bo Ross, Cy Fox"])))
    from pyspark.sql import functions as F

    scores = {"Ann Lee": 0.99, "Bo Ross": 0.5, "Cy Fox": 0.4, "Di Day": 0.8, "Group X": 0.01}
    cases = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    monkeypatch.setattr(model, "score_candidates", lambda df, m: df.withColumn("person_score", cases[F.col("candidate")]))
    got = cleaning.threshold_sensitivity(spark, str(path), None, str(tmp_path / "out"), [(0.9, 0.1), (0.7, 0.3)], top_n=1).collect()
    assert [(r.person_occurrences, r.nonperson_occurrences, r.uncertain_unique) for r in got] == [(1, 1, 3), (2, 1, 2)]
    top = spark.read.csv(str(tmp_path / "out" / "top_uncertain"), header=True).collect()
    assert {(r.tag, r.candidate, r.frequency) for r in top} == {("p09_np01", "Bo Ross", "3"), ("p07_np03", "Bo Ross", "3")}
    assert sorted(x.name for x in (tmp_path / "out" / "groups" / "tag=p09_np01").iterdir() if x.is_dir()) == ["decision=NON_PERSON", "decision=PERSON", "decision=UNCERTAIN"]


def test_points_of_charts(spark):
    curve = spark.range(5000).selectExpr("id / 5000 as fpr", "id / 5000 as tpr", "cast(null as double) as threshold")
    got = charts.points(curve, charts.CHARTS["roc_curve"])
    assert 0 < len(got) <= charts.MOST + 1 and [r["fpr"] for r in got] == sorted(r["fpr"] for r in got)
    assert len(charts.points(spark.range(3).selectExpr("cast(id as string) author", "id as count"), charts.CHARTS["top_authors"])) == 3
