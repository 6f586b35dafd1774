import random
import re

from inkroll.llm.copies import collapse, copy_classes


def brute(rows):
    groups = {}
    for i, k, name in rows:
        if name is not None:
            words = tuple(sorted(re.findall(r"[^\W_]+", name.upper().lower())))
            groups.setdefault((k, words or name), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_as_brute_force(spark):
    rng = random.Random(3)
    names = ["Ann Lee", "ann  lee", "Lee, Ann", "ANN-LEE", "[Ann Lee]", "Ann Lee Lee", "Anne Le", "Bo Éck", "bo éck", "Bo Eck", "", "..", None, "x" * 20_000]
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(names)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, name string")
    got = {(r.first_id, r.id) for r in copy_classes(df, "id", ["k"], "name").where("id <> first_id").collect()}
    assert got == brute(rows)
    counts = {r.first_id: r.copies for r in collapse(df, "id", ["k"], "name").collect()}
    assert sum(counts.values()) == len(got) + len(counts)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "k", "Ann"), (2, "k", "ANN")], "first_id long, _n string, _name string")
    got = copy_classes(df, "first_id", ["_n"], "_name")
    assert got.count() == 2 and copy_classes(df.limit(0), "first_id", ["_n"], "_name").count() == 0
