import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkroll.operators.multivalue import split_field, split_values


def values(text):
    return [v for v, _ in split_field(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('"Ross, Ann B.","Lee, Bo",Tor Institute for Ice and Snow Studies,"Sko, Will ""Wily"""', ["Ross, Ann B.", "Lee, Bo", "Tor Institute for Ice and Snow Studies", 'Sko, Will "Wily"']),
        ("Ross, Ann;Lee, Bo R.;王静一莹;Tor Collaboration", ["Ross, Ann", "Lee, Bo R.", "王静一莹", "Tor Collaboration"]),
        ("Ross, Ann and Lee, Bo and Tor Group", ["Ross, Ann", "Lee, Bo", "Tor Group"]),
        ("Ann Ross, III, Bo Lee, Cy Day, Jr., Di Eck", ["Ann Ross, III", "Bo Lee", "Cy Day, Jr.", "Di Eck"]),
        ("Ann Ross (Lab, Dept. 5; Unit 2), Bo Lee (1, 2)", ["Ann Ross (Lab, Dept. 5; Unit 2)", "Bo Lee (1, 2)"]),
        ("Ann Ross,, Bo Lee & Cy Day ;", ["Ann Ross", "Bo Lee", "Cy Day"]),
        ("Ann Ross\tBo Lee\nCy Day / Di Eck • El Fox、Gu Hi；Jo Ka", ["Ann Ross", "Bo Lee", "Cy Day", "Di Eck", "El Fox", "Gu Hi", "Jo Ka"]),
        ("Drew, Dr. Wei | Fox, Gii.", ["Drew, Dr. Wei", "Fox, Gii."]),
        ("ANN ROSS AND TOR INSTITUTE FOR ICE AND SNOW STUDIES", ["ANN ROSS", "TOR INSTITUTE FOR ICE AND SNOW STUDIES"]),
        ("Ann Ross", ["Ann Ross"]),
        (" , ; ", []),
        ("", []),
    ],
)
def test_values(text, want):
    assert values(text) == want


def test_malformed_quotes_and_brackets_are_flagged():
    assert split_field('"Ann Ross, Bo Lee') == [('"Ann Ross', "bad_quote"), ("Bo Lee", None)]
    assert split_field("Ann (Ross, Bo Lee") == [("Ann (Ross", "bad_bracket"), ("Bo Lee", None)]


@given(st.text(alphabet='aB "(),;|&/\n\'', max_size=40))
def test_never_fails_and_keeps_order(text):
    at = 0
    for value, _ in split_field(text):
        assert value == value.strip() and value
        if '"' not in text:
            at = text.index(value, at) + len(value)


def test_rows(spark):
    rows = [(1, "a", "Ann Ross; Bo Lee", "x"), (2, "b", None, "x"), (3, None, "  ", "x"), (4, "d", "Ann Ross; Bo Lee", "x"), (5, "e", "Ann Ross, " * 3000, "x")]
    df = spark.createDataFrame(rows, "line_no long, id string, authors string, position string")
    out = split_values(df, "authors")
    assert out.columns == ["line_no", "id", "position", "item", "error"]
    got = [(r.line_no, r.position, r.item) for r in out.collect()]
    assert [x for x in got if x[0] < 5] == [(1, 0, "Ann Ross"), (1, 1, "Bo Lee"), (4, 0, "Ann Ross"), (4, 1, "Bo Lee")]
    assert [x[1] for x in got if x[0] == 5] == list(range(3000))
    assert split_values(df.limit(0), "authors").count() == 0
