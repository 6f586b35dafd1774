import random
import unicodedata

from pyspark.sql import functions as F

from inkroll.llm import lookalikes as L


def whole(text):
    """Without the quick check: everything normalised."""
    return L._BLANKS.sub(" ", unicodedata.normalize("NFC", L._normal(text))).strip()


def test_segments_give_what_the_whole_text_gives():
    rng = random.Random(3)
    blocks = [(0x20, 0x3000), (0x300, 0x370), (0x1100, 0x1200), (0xAC00, 0xD7A4), (0x10000, 0x20000), (0x41, 0x7B)]
    for _ in range(30_000):
        text = "".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(1, 6)))
        assert L.canonical_text(text) == whole(text), ascii(text)


def test_the_jvm_and_python_agree_on_every_character(spark):
    rows = spark.range(0x20000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32").alias("c"))  # behind an "a", as a mark at the start would be eaten
    got = {r.id for r in rows.where(L.is_stable(F.col("c"))).select("id").collect()}
    assert got == {c for a, b in L._RANGES for c in range(a, b + 1)}


def test_scripts_that_need_no_python(spark):
    texts = ["ประเทศไทย", "محمد", "김철수", "王静", "René Šťastný", "नमस्ते"]
    assert all(L.canonical_text(x) == unicodedata.normalize("NFC", x) for x in texts)
    df = spark.createDataFrame([(x,) for x in [*texts, "Аnna", None, "a​b", "  x  y "]], "c string")
    assert [r[0] for r in df.select(L.canonical(F.col("c"))).collect()] == [*texts, "Anna", None, "ab", "x y"]
    assert all(not L._UNSTABLE.search(x) for x in texts[1:5])


def test_letters_of_more_scripts_look_latin():
    assert L.canonical_text("Ꭺոոа Ⲕеⅼⅼу") == "Anna Kelly"
