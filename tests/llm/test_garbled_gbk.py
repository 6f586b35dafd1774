import unicodedata

from inkroll.llm import garbled as G

FIRST = ["René", "Łukasz", "José", "Søren", "Zoltán", "Anna", "Chloé", "Tomáš", "Élodie"]
LAST = ["Müller", "Kowalski", "García", "Nowák", "Stöve", "Lindström", "Lee"]


def test_quick_check_lets_every_letter_of_two_bytes_pass():
    letters = [chr(c) for c in range(0x80, 0x800) if chr(c).isalpha() and unicodedata.category(chr(c)) != "Lo"]
    for c in letters:
        try:
            bad = G.garble(f"Ga{c}. {c}", "utf-8", "gbk")
        except UnicodeError:
            continue
        assert (f"Ga{c}. {c}", "gbk>utf-8") in G.readings(bad), c


def test_separate_accents_read_as_gbk_are_found(spark):
    names = [f"{a} {b}" for a in FIRST for b in LAST]
    model, margin = G.fit(spark.createDataFrame([(i, n) for i, n in enumerate(names)] * 20, "line_no long, authors string"), "authors")
    clean = ["José García", "É. García", "Anna Müller"]
    rows = [(i, f"Anna Lee; {G.garble(n, 'utf-8', 'gbk')}") for i, n in enumerate(clean)] + [(8, "王 Lee"), (9, "Anna Lee")]
    got = {(r.line_no, r.position, r.restored, r.chain) for r in G.find_garbled(spark.createDataFrame(rows, "line_no long, authors string"), "authors", model, margin).collect()}
    assert got == {(i, 1, n, "gbk>utf-8") for i, n in enumerate(clean)}
