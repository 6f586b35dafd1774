import numpy as np
import pytest
from pyspark.sql import functions as F

from inkroll.llm import mixing as X
from inkroll.llm import packing as P
from inkroll.llm.tokens import CHUNK, token_count


def test_tokens():
    assert token_count(None) == token_count("") == 0 and token_count("hello world") == 2
    long = "word " * (CHUNK // 2)
    assert abs(token_count(long) - CHUNK // 2) <= 5


@pytest.mark.parametrize("capacity", [1, 7, 256])
def test_online_rule(capacity):
    rng = np.random.default_rng(6)
    sizes = rng.integers(0, max(1, capacity // 2) + 1, 3000)  # small sizes can be packed nearly without waste
    boxes, fills = P.pack_online(sizes, capacity)
    for b, f in ((boxes, fills), P.close(sizes, boxes, fills, capacity)):
        sums = np.bincount(b, weights=sizes, minlength=len(f))
        assert (sums == f).all() and (f <= capacity).all() and (f > 0).all()
    assert len(P.close(sizes, boxes, fills, capacity)[1]) <= len(fills) <= sizes.sum() / capacity * 1.05 + 2


def test_least_sum_of_squares_is_taken():
    sizes, capacity = np.array([3, 3, 2, 4, 1, 5, 2]), 10
    boxes, _ = P.pack_online(sizes, capacity)
    levels: dict[int, int] = {}
    for s, b in zip(sizes, boxes):
        best = min(self_cost(levels, {**levels, c: v + s}, capacity) for c, v in [*levels.items(), (len(levels), 0)] if v + s <= capacity)
        levels[int(b)] = levels.get(int(b), 0) + int(s)
        assert self_cost(None, levels, capacity) == best


def self_cost(_, fills, capacity):
    counts: dict[int, int] = {}
    for v in fills.values():
        if 0 < v < capacity:
            counts[v] = counts.get(v, 0) + 1
    return sum(n * n for n in counts.values())


def test_every_text_is_packed_once(spark):
    rows = [(i, i % 23) for i in range(300)] + [(900, 130), (901, 120), (902, 0), (5, 5), (903, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    out = P.pack(df, "doc_id", "tokens", [(1, 60), (2, 500)]).collect()
    for pack_id, capacity in ((1, 60), (2, 500)):
        own = [r for r in out if r.pack_id == pack_id]
        fill: dict[str, int] = {}
        size: dict[int, int] = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.piece_tokens
            size[r.doc_id] = size.get(r.doc_id, 0) + r.piece_tokens
        assert max(fill.values()) <= capacity
        assert size == {k: sum((n or 0) for i, n in rows if i == k) for k in size} and len(size) == 304
        assert {r.doc_id for r in own if r.piece > 0} == ({900, 901} if pack_id == 1 else set())
        assert len([r for r in own if r.doc_id == 901]) == (2 if pack_id == 1 else 1)
    assert P.pack(df.limit(0), "doc_id", "tokens", [(1, 60)]).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, "doc_id", "tokens", [(1, 0)])


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 4), ("missing", 0.1, 2)]


def test_shares_caps_and_schedule(spark):
    rows = [(i, "a" if i % 3 else "b", 20 + i % 7) for i in range(3000)] + [(5000 + i, "c", 10) for i in range(400)] + [(9000, None, 50), (9001, "other", 50), (9002, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = X.mix(df, "doc_id", "source", "tokens", targets)
    got = {r.source: r for r in X.shares(mixed, targets).collect()}
    for source, share, most in TARGETS[:3]:
        assert got[source].real_share == pytest.approx(share / 0.9, abs=0.002) and got[source].most_uses <= most
    assert got["missing"].used == got["other"].used == got[None].used == 0
    assert mixed.count() == len(rows)
    order = X.schedule(mixed, "doc_id").collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert len(order) == sum(r.uses for r in mixed.collect())
    half = [r for r in order if r.position < order[-1].position / 2]
    early = sum(r.tokens for r in half if r.source == "c") / sum(r.tokens for r in half)
    assert early < got["c"].real_share  # its weight rises


def test_plan_edges(spark):
    assert X.plan_mix({}, [("a", 0.5, 1)])[0]["demand"] == 0.0
    assert X.plan_mix({"a": 10}, [("a", 1.0, 0)])[0]["passes"] == 0
    assert X.plan_mix({"a": 10}, [("a", 1.0, None), ("a", 0.5, 3)])[0]["demand"] == 10
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert X.mix(empty, "doc_id", "source", "tokens", targets).count() == 0
