import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from pagebundle.functions import text as tx


def python_fold(value):
    value = unicodedata.normalize("NFKD", value.translate({0x142: "l", 0x141: "L"}))
    kept = "".join(c for c in value if ord(c) < 128).upper()
    return " ".join(re.split(r"\s+", kept)).strip()


def evaluate(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_every_code_point(spark):
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF] + list("ﬁ㎏𝐀\U0001f600")
    values = [f"a{c} {c}b" for c in chars]
    assert evaluate(spark, values, tx.normalize_text) == [python_fold(v) for v in values]


def test_normalize_examples(spark):
    values = ["Umowa  o\n pracĘ\tłącznie", "   ", "", "½ ﬁn…", "a\x1fb\x1c \x0bc", " x \n y "]
    assert evaluate(spark, values, tx.normalize_text) == [
        "UMOWA O PRACE LACZNIE", "", "", "12 FIN...", "A B C", "X Y"
    ]


@settings(max_examples=5, deadline=None)
@given(hs.lists(hs.text(alphabet=" \t\n\x0b\x1cabŁłéßﬁ½0", max_size=30), min_size=40, max_size=60))
def test_normalize_random(spark, values):
    assert evaluate(spark, values, tx.normalize_text) == [python_fold(v) for v in values]


def test_counts_previews_names(spark):
    values = ["aż 1!", "—…", "²x", "x" * 24, "é" * 25]
    assert evaluate(spark, values, tx.alnum_count) == [3, 0, 2, 24, 25]
    for n in (1, 3, 25):
        want = [c >= n for c in (3, 0, 2, 24, 25)]
        assert evaluate(spark, values, lambda c: tx.has_alnum(c, n)) == want
    assert evaluate(spark, ["a  b\n c ", "abcdef"], lambda c: tx.page_preview(c, 5)) == [
        "a b c", "abcde..."
    ]
    assert evaluate(spark, ["a.pdf", "a.PDF", "a.pdf.txt"], lambda c: tx.derive_name(c, "_s")) == [
        "a_s.pdf", "a_s.pdf", "a.pdf.txt_s.pdf"
    ]
    assert evaluate(spark, ["C:\\x\\a b.pdf ", "/t/u.PDF", "x/"], tx.clean_file_name) == [
        "a b.pdf", "u.PDF", ""
    ]
    assert evaluate(spark, ["a/b:c d\\e"], lambda c: tx.document_file_name(
        c, F.lit(1), F.lit(12))) == ["a_b_c_d_e_strony_001-012.pdf"]
    assert evaluate(spark, ["5W1A0"], tx.fold_ocr_digits) == ["SWIAO"]


def test_two_decimals_like_exact_rounding(spark):
    numbers = [i / 1000 for i in range(1001)] + [0.125, 0.285, 0.015, 0.7000000000000001]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    got = [r.v for r in df.select("i", tx.two_decimals(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [f"{x:.2f}" for x in numbers]
