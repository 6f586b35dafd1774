import random

import numpy as np
import pytest

from inkroll.operators import aggregate as A
from inkroll.operators import metrics as M
from inkroll.operators import thresholds as TH
from inkroll.operators.histogram import equal_width


def test_pairs():
    assert TH.parse_pairs(" 0.9:0.1, ,0.8:0.2") == [(0.9, 0.1), (0.8, 0.2)]
    assert TH.tag(0.9, 0.1) == "p09_np01"
    for bad in ("0.9", "0.1:0.9", "1.1:0.1", ""):
        with pytest.raises(ValueError):
            TH.parse_pairs(bad)


def test_sweep_adds_up_and_is_monotone(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randrange(20)}", rng.random(), rng.choice(["PERSON", "ORG", None])) for _ in range(500)] + [(None, 0.5, None), ("x", None, None)]
    df = spark.createDataFrame(rows, "candidate string, person_score double, ner_label string")
    out = sorted(TH.summarise(TH.apply_pairs(df, TH.parse_pairs(TH.DEFAULT_PAIRS))).collect(), key=lambda r: -r.person_threshold)
    for r in out:
        assert r.person_occurrences + r.nonperson_occurrences + r.uncertain_occurrences == r.total_candidate_occurrences == 502
    assert [r.uncertain_occurrences for r in out] == sorted((r.uncertain_occurrences for r in out), reverse=True)
    groups = TH.bucket_groups(TH.apply_pairs(df, [(0.9, 0.1)])).collect()
    assert sum(r.frequency for r in groups) == 501 and all(r.most_common_ner_label is not None for r in groups)


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "k string, v string")
    assert dict(df.groupBy("k").agg(A.mode("v").alias("m")).collect()) == {"a": "x", "b": ""}


def test_order_of_appearance(spark):
    rows = [(3, 0, "B", "PERSON"), (1, 1, "A", "PERSON"), (1, 0, "C", "PERSON"), (2, 0, "C", "NON_PERSON"), (2, 1, None, "PERSON")]
    df = spark.createDataFrame(rows, "line_no long, position int, candidate string, label string")
    assert [r.author for r in A.author_counts(df).collect()] == ["C", "A", "B"]


@pytest.mark.parametrize("values", [[0.1, 0.5, 0.5, 0.9], [2.0], [1.0, 1.0, 3.0, 7.0, 7.5]])
def test_histogram_as_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r["count"] for r in equal_width(df, "x", 5).orderBy("bin").collect()]
    assert got == np.histogram(values, 5)[0].tolist()
    assert equal_width(df.limit(0), "x", 5).count() == 0


def brute(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, n = sum(s >= t for s in pos), sum(s >= t for _, s in rows)
        ap += (tp - last) / len(pos) * tp / n
        last = tp
    return auc, ap


def test_curves_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.6), round(rng.random(), 2)) for _ in range(300)]
    df = M.binary(spark.createDataFrame([*rows, (1, None), (None, 0.3), (2, 0.4)], "y int, s double"), "y", "s")
    auc, ap = brute(rows)
    assert M.roc_auc(df).first()[0] == pytest.approx(auc) and M.average_precision(df).first()[0] == pytest.approx(ap)
    roc = sorted((r.fpr, r.tpr) for r in M.roc_curve(df).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    assert np.trapezoid([y for _, y in roc], [x for x, _ in roc]) == pytest.approx(auc)
    sweep = M.threshold_sweep(df).orderBy("threshold").collect()
    assert len(sweep) == 99 and all(a.recall >= b.recall for a, b in zip(sweep, sweep[1:]))
    t = sweep[49]
    assert t.recall == pytest.approx(sum(y and s >= t.threshold for y, s in rows) / sum(y for y, _ in rows))
    m = M.confusion(df, 0.5).first()
    assert m.tn + m.fp + m.fn + m.tp == 300
    assert sum(r["count"] for r in M.calibration(df).collect()) == 300


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, 0.5)], "y int, s double")
    assert M.roc_auc(df).first()[0] is None and M.average_precision(df).first()[0] == 1.0
    empty = df.limit(0)
    assert tuple(M.confusion(empty).first()) == (0, 0, 0, 0)
    assert {r.f1 for r in M.class_report(empty).collect()} == {0.0}
    assert M.roc_auc(empty).first()[0] is None


def test_split_is_stratified(spark):
    df = spark.createDataFrame([(f"c{i}", i % 3 == 0) for i in range(90)], "candidate string, label boolean")
    got = {(r.label, r.is_test): r["count"] for r in A.stratified_split(df, "label", ["candidate"]).groupBy("label", "is_test").count().collect()}
    assert got == {(True, True): 6, (True, False): 24, (False, True): 12, (False, False): 48}


@pytest.mark.parametrize("size", [1, 2, 5, 400, 50_000])
def test_quantiles_as_numpy(spark, size):
    rng = random.Random(size)
    values = [float(min(int(rng.paretovariate(1.0)), 10**12)) + (rng.random() if rng.random() < 0.3 else 0) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = list(A.quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]).first())
    assert got == pytest.approx(np.percentile(values, [0, 25, 50, 75, 99, 100]).tolist())
    empty = A.describe(df.limit(0), "x").first()
    assert empty["count"] == 0 and empty.p50 is None
