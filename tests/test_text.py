import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions.text import (
    clean_basic,
    clean_light,
    clean_simple,
    collapse_spaces,
    compose_unicode,
    split_tokens,
    strip_digits,
    strip_emails,
    strip_punctuation,
    strip_urls,
    term_tokens,
    unigrams_and_bigrams,
)
from kindred.operators.dictionaries import (
    Dictionaries,
    _replacer,
    clean_full,
    drop_tokens,
    map_tokens,
    replace_symbols,
)

NFD = unicodedata.normalize("NFD", "Khách sạn Đẹp")
def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", column(F.col("text")).alias("out")).orderBy("id").collect()
    return [r["out"] for r in rows]


# (step, input, output), worked out by hand
STEPS = [
    (strip_urls, "xem http://a.vn/x?y=1 hoặc www.b.com nhé", "xem   hoặc   nhé"),
    (strip_emails, "mail a.b-c@x.com.vn, hoặc @ trống x@ y", "mail  , hoặc @ trống x@ y"),
    (strip_emails, "a@b@c d@e", " @c  "),
    (strip_digits, "phòng 12a giá 3.500.000đ ٣٤", "phòng  a giá  . . đ  "),
    (strip_punctuation, "ĐÀ NẴNG: view ĐẸP!!", "ĐÀ NẴNG  view ĐẸP  "),
    (strip_punctuation, "snake_case _x_ a-b c'd", "snake_case _x_ a b c d"),
    (strip_punctuation, "한국어 日本語 ⅷ ½", "한국어 日本語 ⅷ ½"),
    (collapse_spaces, "tab\tnew\nline\u00a0nbsp\u2003em\x1cfs ", "tab new line nbsp em fs"),
    (collapse_spaces, "   ", ""),
    (split_tokens, " a\tb\u00a0c ", ["a", "b", "c"]),
    (split_tokens, "", []),
    (compose_unicode, NFD, "Khách sạn Đẹp"),
    (clean_basic, "Xem http://a.vn, mail a@b.vn: 12 phòng_lớn!", "Xem mail phòng_lớn"),
    (clean_light, "ĐÀ NẴNG: view ĐẸP!! 12a", "đà nẵng view đẹp 12a"),
    (clean_light, NFD, "khách sạn đẹp"),
    (clean_light, "ΣΑΣ 😀 :)", "σας"),
    (clean_simple, "Phòng 12a, www.b.com", "phòng a"),
    (term_tokens, "Aa b cc_d 한국", ["aa", "cc_d", "한국"]),
]


@pytest.mark.parametrize(("column", "text", "expected"), STEPS)
def test_each_step(spark, column, text, expected):
    assert run(spark, [text], column) == [expected]


def test_light_and_simple_are_idempotent(spark):
    texts = [text for _, text, _ in STEPS]
    for column in (clean_light, clean_simple):
        once = run(spark, texts, column)
        assert run(spark, once, column) == once


def test_null_text_is_a_choice(spark):
    assert run(spark, [None], clean_light) == [""]
    assert run(spark, [None], lambda c: clean_light(c, null_text="nan")) == ["nan"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aé́b ậ1_-@.wđĐ가 \n", max_size=30), min_size=1, max_size=60))
def test_random_text_becomes_words(spark, texts):
    for column in (clean_light, clean_simple):
        for out in run(spark, texts, column):
            assert out == " ".join(out.split()) == out.lower()
            assert all(c.isalnum() or c in "_ " for c in out)


def test_word_pairs(spark):
    grams = run(spark, ["aa bb b cc", "aa", ""], lambda c: unigrams_and_bigrams(term_tokens(c)))
    # the single letter is no term, so its neighbours become neighbours
    assert grams == [["aa", "bb", "cc", "aa bb", "bb cc"], ["aa"], []]


SLANG = {"ko": "không", "ks": "khách sạn", "two words": "never"}
STOP = ["và", "là"]


def pairs(spark, table):
    rows = [(k, v, i) for i, (k, v) in enumerate(table.items())]
    return spark.createDataFrame(rows, "key string, value string, line_no bigint")


def words(spark, tokens):
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def test_token_map(spark):
    texts = ["ko đẹp ko, KO", "ks  two words", "", None, "không"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")

    def mapped(**options):
        out = map_tokens(
            df, "text", pairs(spark, SLANG), id_col="id", **options
        )
        assert out.columns == ["id", "text"]
        return [r["text"] for r in out.orderBy("id").collect()]

    assert mapped() == ["không đẹp ko, KO", "khách sạn two words", "", None, "không"]
    assert mapped(lower=True)[0] == "không đẹp ko, không"


def test_token_drop(spark):
    texts = ["đẹp và Là x rẻ", "và", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = drop_tokens(
        df, "text", words(spark, STOP), id_col="id", lower=True, min_length=2,
    )
    assert [r["text"] for r in out.orderBy("id").collect()] == ["đẹp rẻ", "", "", None]


def test_dictionaries_with_repeated_and_null_entries(spark):
    """The last line of a key counts, null entries do not; alike at every size."""
    df = spark.createDataFrame([(1, "aa bb null")], "id int, text string")
    rows = [("aa", "x", 1), ("aa", "b", 2), ("bb", None, 3), (None, "z", 4)]
    table = spark.createDataFrame(rows, "key string, value string, line_no bigint")
    options = {"id_col": "id"}
    assert map_tokens(df, "text", table, **options).first()["text"] == "b bb null"
    gone = drop_tokens(df, "text", words(spark, ["bb", None, "bb"]), **options)
    assert gone.first()["text"] == "aa null"


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    rows = [(None, "aa cc"), (None, "aa cc"), (1, "aa bb"), (1, "aa bb"), (1, "bb dd"), (2, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    table = spark.createDataFrame([("aa", "x", 1), ("bb", "y z", 2)], "key string, value string, line_no bigint")
    out = map_tokens(df, "text", table).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    expected = [(None, "x cc"), (None, "x cc"), (1, "x y z"), (1, "x y z"), (1, "y z dd"), (2, None)]
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)
    left = drop_tokens(df, "text", words(spark, ["aa", "dd"])).collect()
    expected = [(None, "cc"), (None, "cc"), (1, "bb"), (1, "bb"), (1, "bb"), (2, None)]
    assert sorted(map(tuple, left), key=key) == sorted(expected, key=key)


def test_symbols_are_replaced_in_order(spark):
    df = spark.createDataFrame([("hay :)) :) x",)], "text string")
    table = pairs(spark, {":))": "cười lớn", ":)": "cười", "lớn": "to"})
    out = replace_symbols(df, "text", table).first()["text"]
    assert out.split() == ["hay", "cười", "to", "cười", "x"]


def in_turn(text, table):
    for key, value in table:
        text = text.replace(key, f" {value} ")
    return text


SYMBOL_TEXTS = st.text(alphabet="ab: )", max_size=25)


@settings(max_examples=300, deadline=None)
@given(SYMBOL_TEXTS, st.lists(st.tuples(st.text(alphabet="ab: )", min_size=1, max_size=3), st.text(alphabet="ab: )", max_size=3)),
                              max_size=8, unique_by=lambda e: e[0]))
def test_one_pass_gives_what_replacing_in_turn_gives(text, table):
    """Overlapping keys, values that hold keys, keys across the border of a value."""
    assert (_replacer(table)(text) if table else text) == in_turn(text, table)


def test_symbols_in_blocks_and_at_the_edges(spark):
    """A table applied in many blocks gives the same texts; nulls, empty keys, regex characters."""
    table = [(f"]{i:x}^", f"v{i}") for i in range(300)] + [("v7", "seven"), ("-\\", "x"), ("n s", "ns")]
    texts = ["]7^ a ]12b^]0^", "-\\ \U0001f600", "", None, "]12c^", "seven s"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    symbols = pairs(spark, dict(table)).union(
        spark.createDataFrame([("", "x", 0), (None, "y", 0), ("a", None, 0)], "key string, value string, line_no bigint")
    )
    expected = [None if t is None else in_turn(t, table) for t in texts]
    for size in (10**6, 800):
        out = replace_symbols(df, "text", symbols, size).orderBy("id").collect()
        assert [r["text"] for r in out] == expected
    none = symbols.limit(0)
    assert [r["text"] for r in replace_symbols(df, "text", none).orderBy("id").collect()] == texts


# (input, output) of all steps together, worked out by hand
CLEANED = [
    ("Hotel nice ko 😀 bậy, ko. ks:) là x9", "khách sạn đẹp không vui vẻ ko khách sạn cười"),
    ("ko, ks", "ko khách sạn"),
    ("phòng 12a giá 3.500.000đ", "phòng giá"),
    ("xem http://a.vn/x?y=1 hoặc a.b@x.vn", "xem hoặc"),
    (NFD, "khách sạn đẹp"),
    ("   ", ""),
    ("", ""),
]


def test_full_pipeline(spark):
    emoji = {"😀": "vui vẻ", ":)": "cười"}
    blocked, translation = ["bậy"], {"hotel": "khách sạn", "nice": "và đẹp"}
    texts = [text for text, _ in CLEANED]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tables = Dictionaries(
        emoji=pairs(spark, emoji),
        slang=pairs(spark, SLANG),
        blocked=words(spark, blocked),
        translation=pairs(spark, translation),
        stopwords=words(spark, STOP),
    )
    out = clean_full(df, "text", tables, id_col="id")
    assert [r["text"] for r in out.orderBy("id").collect()] == [done for _, done in CLEANED]


def test_full_pipeline_on_spellings_and_repeated_words(spark):
    """Blocked words go by spelling, the rest by lower case; translations are checked for stopwords."""
    df = spark.createDataFrame([(1, "xx yy zz"), (None, "xx yy zz"), (1, None), (1, "no")], "id int, text string")
    tables = Dictionaries(
        slang=pairs(spark, {"xx": "Bad bad", "yy": "GO on"}),
        blocked=words(spark, ["bad", "no", None]),
        translation=pairs(spark, {"go": "Und x geh", "bad": "böse", "on": ""}),
        stopwords=words(spark, ["und", "zz"]),
    )
    out = clean_full(df, "text", tables).collect()
    assert sorted(r["text"] for r in out) == ["", "", "böse geh", "böse geh"]


def test_full_pipeline_without_dictionaries_drops_single_letters(spark):
    df = spark.createDataFrame([(1, "a bc d")], "id int, text string")
    assert clean_full(df, "text", Dictionaries(), id_col="id").first()["text"] == "bc"
