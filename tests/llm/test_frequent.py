import random
from collections import Counter

from inkroll.llm.frequent import Summary, candidates, frequent


def test_bounds_hold_for_any_merge_order():
    rng = random.Random(4)
    stream = [f"i{min(int(rng.paretovariate(0.9)), 5000)}" for _ in range(20_000)]
    true = Counter(stream)
    parts = []
    for k in range(7):
        s = Summary(60)
        for at in range(0, len(stream[k::7]), 500):
            c = Counter(stream[k::7][at : at + 500])
            s.add(list(c), list(c.values()), [0] * len(c), 0, sum(c.values()))
        parts.append(s)
    top = Summary(60)
    for s in parts:
        top.add(list(s.low), list(s.low.values()), list(s.slack.values()), s.floor, s.total)
    assert top.total == 20_000 and len(top.low) <= 60
    for x in top.low:
        assert top.low[x] <= true[x] <= top.low[x] + top.slack[x]
    assert max((n for x, n in true.items() if x not in top.low), default=0) <= top.floor


def test_exact_result(spark):
    rng = random.Random(5)
    rows = [(f"i{min(int(rng.paretovariate(1.0)), 900)}", rng.choice([1, 1, 5, -3, None])) for _ in range(6000)] + [(None, 7)] * 50
    df = spark.createDataFrame(rows, "item string, w long").repartition(9)
    want = {x for x, n in Counter(x for x, _ in rows).items() if x is not None and n >= 0.01 * len(rows)}
    assert {r.item for r in frequent(df, "item", 0.01).collect()} == want
    weights = Counter()
    for x, w in rows:
        weights[x] += max(w or 0, 0)
    total = sum(weights.values())
    assert {r.item: r.frequency for r in frequent(df, "item", 0.02, "w").collect()} == {x: n for x, n in weights.items() if x is not None and n >= 0.02 * total}
    assert candidates(df, "item", 0.01).count() <= 800
    assert frequent(df.limit(0), "item", 0.01).count() == 0
