import random

from inkroll.llm import garbled as G

FIRST = ["René", "Łukasz", "José", "Søren", "Zoltán", "Иван", "Ольга", "Chloé", "Tomáš", "Jürgen"]


def names():
    rng = random.Random(5)
    return sorted({f"{rng.choice(FIRST)} {rng.choice('KLMNT')}{''.join(rng.choices('aeiou', k=2))}{rng.choice('nrst')}{rng.choice('éöáü')}{rng.choice('klm')}{rng.choice(['ov', 'er', 'sen'])}" for _ in range(600)})


def frame(spark, rows, parts):
    return spark.createDataFrame(list(enumerate(rows)), "line_no long, authors string").repartition(parts)


def test_held_out_names_are_not_learned_from(spark):
    held = [n for n in names() if G.held_out(n)]
    assert 10 <= len(held) < 0.2 * len(names())
    counted = G.count(frame(spark, names() * 2, 3), "authors")
    assert sorted((r.text, r.n) for r in counted.where("held").collect()) == [(n, 2) for n in held]
    want = {p for n in names() if not G.held_out(n) for p in map("".join, zip(f" {n} ", f"{n} "))}
    assert set(G.trained(counted).pairs) == want


def test_every_held_out_name_is_scored_clean_and_garbled_in_any_order(spark):
    held = [n for n in names() if G.held_out(n)]
    model, margin = G.fit(frame(spark, names(), 2), "authors")
    again = G.fit(frame(spark, names()[::-1], 7), "authors")
    assert again[1] == margin and again[0].pairs == model.pairs
    tally = G.tally_leads(spark.createDataFrame([(n,) for n in held], "text string"), model)
    assert sum(n for (bad, _), n in tally.items() if not bad) == len(held)
    assert sum(n for (bad, _), n in tally.items() if bad) == sum(len(list(G._spoilt(n))) for n in held) > 10 * len(held)
    assert margin == G.margin_from(tally) == G.validated_margin(model, held)


def test_margin_weighs_both_errors():
    assert G.margin_from({}) == 2.0
    assert G.margin_from({(False, 0): 90, (False, 9): 10, (True, 30): 50}) == 4.5  # above all clean leads, below the garbled ones
    assert G.margin_from({(False, 0): 10**6, (False, 90): 1, (True, 30): 50}) == 2.0  # one odd name does not hide all garbled ones
