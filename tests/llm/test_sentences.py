import random

import pytest

from inkroll.llm import sentences as S

EN = ["The job failed again.", "We asked Dr. Kovrin about it, e.g. last week.", "Is it fixed?", "See Fig. 12 for details.", "He said \"Wait. Not yet.\" and left.", "It took approx. 7 minutes...", "Nobody at Orvane Ltd. could explain it."]
DE = ["Das gilt z. B. für alle Zeilen ab Nr. 4.", "Der Wert stieg um 3,4 Prozent.", "Was soll das?!"]
ZH = ["他说：“先备份。再运行。”", "我们改了第一列。", "怎么回事？！"]
TH = ["ผู้ดูแลลบไฟล์ข้อมูลเข้า", "โปรแกรม abc หยุดทำงานหลังจาก 2.5 วินาที", "สคริปต์เก่านับค่าว่างในบรรทัดที่ 37"]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    docs = []
    for _ in range(400):
        pool = rng.choice([EN, EN, DE, ZH, TH])
        glue = "" if pool is ZH else " "
        docs.append("\n\n".join(glue.join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(3)))
    return S.fit(docs)


def units(text, model):
    got = S.segment(text, model)
    covered = "".join(text[a:b] for a, b in got)
    assert "".join(covered.split()) == "".join(text.split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
    assert got == sorted(got)
    return [text[a:b] for a, b in got]


@pytest.mark.parametrize("pool, glue", [(EN, " "), (DE, " "), (ZH, ""), (TH, " ")])
def test_held_out_orders(model, pool, glue):
    rng = random.Random(8)
    right = total = 0
    for _ in range(50):
        want = rng.sample(pool, 3)
        got = units(glue.join(want), model)
        total += 3
        right += sum(w in got for w in want)
    assert right >= 0.97 * total


def test_layout(model):
    text = "Hi all,\n\n- The job failed\nagain. Is it fixed?\n- Yes.\n> The job failed.\n> Is it fixed?\n\n```py\nx = 1.\n\ny = 2\n```\nThe job failed.\n\n    code. here\n    more\n\nno\n\n<pre><code>a.\n\nB</code></pre>\n\n~~~\nz\n~~~"
    assert units(text, model) == [
        "Hi all,", "- The job failed\nagain.", "Is it fixed?", "- Yes.", "> The job failed.", "> Is it fixed?", "```py\nx = 1.\n\ny = 2\n```", "The job failed.", "code. here\n    more", "no", "<pre><code>a.\n\nB</code></pre>", "~~~\nz\n~~~",
    ]


def test_missing_blank_links_and_inline_code(model):
    assert units("Is it fixed?The job failed again.We asked.", model) == ["Is it fixed?", "The job failed again.", "We asked."]
    assert units("See http://a.example/b.html?x=1 and `re.sub(...)` now. The job failed.", model) == ["See http://a.example/b.html?x=1 and `re.sub(...)` now.", "The job failed."]


def test_odd_texts(model):
    assert S.segment(None, model) == S.segment("", model) == S.segment(" \n ", model) == []
    for text in ("x" * 200_000, "a. " * 30_000, "```\nnever closed", "<pre>never closed", "“never closed. The job", "\r\n\r\nThe job.\r\nIs it?"):
        units(text, model)
    untrained = S.fit([])
    units("The job failed. Is it fixed?", untrained)


def test_rows(spark, model):
    df = spark.createDataFrame([(1, "The job failed. Is it fixed?", "x"), (2, None, "x"), (3, "", "x"), (1, "The job failed. Is it fixed?", "x")], "doc_id long, text string, sent_end string")
    got = [tuple(r) for r in S.sentences(df, "text", model).collect()]
    assert got == [(1, 0, 15), (1, 16, 28)] * 2
    assert S.sentences(df.limit(0), "text", model).count() == 0
    assert S.train(df, "doc_id", "text").ends["failed"] == 0
