import pytest
from pyspark.sql import functions as F

from inkroll.llm import mixing as X
from inkroll.llm import packing as P
from inkroll.llm.tokens import CHUNK, token_count, tokenizer


def test_large_texts_are_used_and_shares_met(spark):
    rows = [(i, "a", 100) for i in range(40)] + [(100 + i, "b", n) for i, n in enumerate([1074, 941, 300, 200, 90, 40, 17, 8, 5, 3])] + [(7, "a", 100)] * 200
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 4)], "source string, target_share double, max_repeats int")
    mixed = X.mix(df, "doc_id", "source", "tokens", targets)
    got = {r.source: r for r in X.shares(mixed, targets).collect()}
    assert abs(got["b"].used - got["a"].used / 4) < 10 and got["a"].used == 24_000
    assert {r.uses for r in mixed.where("source = 'b' and tokens > 900").collect()} <= {2, 3}


def test_a_given_schedule_decides_when_a_source_comes(spark):
    rows = [(i, "abc"[i % 3], 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 1), ("c", 0.25, 1)], "source string, target_share double, max_repeats int")
    plans = {"a": [1, 1], "b": [3, 1, 0], "c": [0, 4]}
    order = X.schedule(X.mix(df, "doc_id", "source", "tokens", targets, plans), "doc_id").collect()
    total = sum(r.tokens for r in order)
    assert total == 40_000
    for t in (0.25, 0.5, 0.75):
        early = {s: sum(r.tokens for r in order if r.source == s and r.position < t * total) for s in "abc"}
        b = (3 * t - 2 * t * t) / 1.25 * 1 if t <= 0.5 else (1.0 + (t - 0.5) - (t - 0.5) ** 2) / 1.25
        assert early["a"] == pytest.approx(20_000 * t, abs=30)
        assert early["b"] == pytest.approx(10_000 * b, abs=30)
        assert early["c"] == pytest.approx(10_000 * t * t, abs=30)
    with pytest.raises(ValueError):
        X.plan_mix({"a": 10}, [("a", 1.0, 1)], schedules={"a": [0, 0]})


def test_rows_of_one_id_are_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 50)
    df = spark.range(400).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 60).alias("tokens"))
    out = P.pack(df, "doc_id", "tokens", [(1, 60)]).collect()
    assert len(out) == 400 and len({r.container.split("-")[0] for r in out if r.doc_id == 5}) > 4
    sums: dict[str, int] = {}
    for r in out:
        sums[r.container] = sums.get(r.container, 0) + r.piece_tokens
    assert max(sums.values()) <= 60


def test_cuts_of_long_texts_change_no_token():
    text = ("It's a test, don't cut   here: naïve café 12 345 — yes! \n\n" * (CHUNK // 20))[: 3 * CHUNK + 17]
    assert token_count(text) == len(tokenizer().encode_ordinary(text))
