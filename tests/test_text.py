import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.functions import arrays
from doclens.functions.text import fold_case, tokenise_chars, tokenise_words, tokeniser, word_terms


def column(spark, values, function):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r["x"] for r in df.select("i", function(F.col("text")).alias("x")).orderBy("i").collect()]


def expected(text):
    """The rule in plain Python."""
    text = text.casefold()
    text = re.sub(r"(?:\d+[.,]?)+", " <NUMBER> ", text)
    text = re.sub(r"[.?!]", " <STOP> ", text)
    return re.sub(r"[^\w\s<>]", " <PUNCT> ", text).split()


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("In 1987. The", "in <NUMBER> the"),
        ("1.2.3,!", "<NUMBER> <STOP>"),
        ("a_b <x> ½²", "a_b <x> ½²"),
        ("Straße ½ 1,000.5. next", "strasse ½ <NUMBER> next"),
        ("x́y", "x <PUNCT> y"),
        ("in <NUMBER> x", "in <number> x"),
        ("ΟΔΟΣ ﬁne ŉ ᾳ İ", None),
        ("tab\tnew\nline and　wide\x1cfile", None),
        ("", ""),
    ],
)
def test_tokenise_words(spark, text, tokens):
    tokens = expected(text) if tokens is None else tokens.split()
    assert column(spark, [text], tokenise_words) == [tokens]


def test_null_text_has_no_tokens(spark):
    assert column(spark, [None], tokenise_words) == [[]]
    assert column(spark, [None], tokenise_chars) == [[]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=30), min_size=20, max_size=60))
def test_tokenise_matches_the_rule_on_any_text(spark, texts):
    # Letters newer than the Java runtime's Unicode tables may fold or class differently.
    texts = [t for t in texts if all(ord(c) < 0x1C80 or 0x1E00 <= ord(c) < 0xA640 for c in t)]
    if texts:
        assert column(spark, texts, tokenise_words) == [expected(t) for t in texts]


def test_fold_case_of_every_latin_and_greek_letter(spark):
    letters = [chr(c) for c in [*range(0x20, 0x590), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)]]
    letters = [c for c in letters if c.isalpha()]
    assert column(spark, letters, fold_case) == [c.casefold() for c in letters]


def test_chars_are_code_points(spark):
    assert column(spark, ["a😀\nb"], tokenise_chars) == [["a", "😀", "\n", "b"]]


def test_terms_need_two_word_characters(spark):
    assert column(spark, ["A <STOP> of b2 x_ é"], word_terms) == [["stop", "of", "b2", "x_"]]


def test_levels(spark):
    assert tokeniser("word") is tokenise_words
    assert tokeniser("anything else") is tokenise_chars
    assert tokeniser(word_terms) is word_terms


def test_run_lengths(spark):
    df = spark.createDataFrame([([3, 1, 3, 3],), ([],), ([7],)], "v array<int>")
    found = [[(x["value"], x["n"]) for x in r[0]] for r in df.select(arrays.run_lengths(F.col("v"))).collect()]
    assert found == [[(1, 1), (3, 3)], [], [(7, 1)]]


def test_padding_of_a_short_row(spark):
    row = (
        spark.sql("SELECT array(7, 8) AS ids, 10 AS size")
        .withColumn("encoder", arrays.left_pad(F.col("ids"), F.col("size")))
        .withColumn("decoder", arrays.decoder_input(F.col("ids"), F.col("size")))
        .withColumn("weights", arrays.target_weights(F.col("decoder"), F.col("size")))
        .withColumn("given", arrays.inference_weights(F.col("ids"), F.col("size")))
        .first()
    )
    assert row["encoder"] == [4] * 8 + [7, 8]
    assert row["decoder"] == [0, 7, 8] + [4] * 7
    assert row["weights"] == row["given"] == [1.0] * 2 + [0.0] * 8


def test_transpose(spark):
    row = spark.sql("SELECT array(array(1, 2, 3), array(4, 5, 6)) AS rows").select(
        arrays.transpose(F.col("rows"), F.lit(3)).alias("x")
    )
    assert row.first()["x"] == [[1, 4], [2, 5], [3, 6]]


@pytest.mark.parametrize(
    "text", ["Příliš žluťoučký kůň", "İstanbul ığdır ŞĞÜ", "Tiếng Việt Ệ Ữ", "Ελληνικά ΐ ΰ ᾳ ᾲ", "ﬁ ﬀ ŉ ǰ ẖ Straße", "ﬃx"]
)
def test_folding_of_other_alphabets(spark, text):
    from doclens.functions.text import fold_case

    found = spark.createDataFrame([(text,)], "t string").select(fold_case(F.col("t")).alias("f")).first()["f"]
    assert found.replace("i̇", "i") == text.casefold().replace("i̇", "i")


def test_rare_letters_are_an_exact_class():
    import re

    from doclens.functions import text as T

    multiple = [c for c in T._fold_rules()[1] if c != "ß"]
    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), T._class(multiple)))
    assert all(pattern.match(c) for c in multiple)
    assert not any(pattern.match(c) for c in "šžřěůğşıİệữάέήßab")


def test_folding_decides_by_the_given_text(spark, capsys):
    from doclens.functions import text as T

    spark.createDataFrame([("x",)], "t string").select(fold_case(F.col("t"), T._blanks()).alias("f")).explain()
    plan = capsys.readouterr().out.lower()
    assert "rlike(t#" in plan  # not of the folded text, which would be folded twice, by a map of characters
    assert not any(f"rlike({call}(" in plan for call in ("replace", "translate", "lower"))


def test_every_way_of_folding_gives_the_same(spark):
    """Words of plain letters, with blanks, and with each letter that needs one of the longer ways."""
    from doclens.functions import text as T

    single, multiple = T._fold_rules()
    letters = [c for c in [*single, *multiple, *map(str.upper, single), *"ẞKÅİŸΣ"] if len(c) == 1]
    texts = [f"Ä\tß{c}\x85µ{c}" for c in letters]
    folded = column(spark, texts, lambda t: fold_case(t, T._blanks()))
    blank = str.maketrans(T._blanks())
    assert folded == [t.lower().casefold().translate(blank) for t in texts]
