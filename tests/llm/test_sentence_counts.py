import random

from inkroll.llm import sentences as S

NEXT = {"Fig": ["7", "x", "(see"], "z.B": ["the", "we"], "approx": ["the", "7"], "Ltd": ["the", "we", "The", "We"], "run": ["The", "We", "¿Que", "これ"], "job": ["We", "Is"], "a.B": ["The"]}


def corpus():
    rng = random.Random(3)
    docs = []
    for _ in range(300):
        text = "The job"
        for _ in range(rng.randint(1, 5)):
            word = rng.choice(list(NEXT))
            text += f" {word}. {rng.choice(NEXT[word])}"
        docs.append(f"{text} run.\n\nWe {rng.choice(['job', 'Ltd', 'run'])}.")
    return docs + ["ผู้ดูแล ลบไฟล์\n\nผู้ดูแล ข้อมูล ลบไฟล์ เข้า"] * 9


def test_classes_of_all_words_are_those_of_all_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 50)
    docs = corpus()
    want = S.count_words([p for t in docs for p in S.observe(t)])
    got = S.count_all(spark.createDataFrame([(t,) for t in [*docs, None, ""]], "text string").repartition(3), "text")
    words = {w.lstrip("_") for c in (want.starts, want.ends, want.seen_before, want.seen_after) for w in c} - {""}
    for w in words:
        assert got.can_end(w) == want.can_end(w), w
        assert (got.can_start(w), got.can_start(w, True)) == (want.can_start(w), want.can_start(w, True)), w
    assert {want.can_end(w) for w in words} >= {"abbr", "both", "word"} and {want.can_start(w) for w in words} >= {"start", "never"}


def test_words_are_counted_beyond_the_sample(spark):
    docs = [(k, "The job failed again. We asked.") for k in range(40)] + [(100 + k, "See vgl. the job here and vgl. nothing else.") for k in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for sample in (2, 1000):  # two documents of the 43 train the weights, yet all are counted
        model = S.train(df, "doc_id", "text", sample)
        assert model.can_end("vgl") == "abbr" and model.seen_before["vgl"] == 6
        assert model.starts["The"] == 40
