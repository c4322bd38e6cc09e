"""Text cleaning as Column expressions.

Everything runs inside the JVM except Unicode composition, for which Spark has no
built-in; that one is a vectorised function which is fed only the rows that can
change.

The character classes follow Unicode on purpose: a word character is any letter,
any number or the underscore, so accented text keeps its letters.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that define the cleaning rules.
WORD = r"\p{L}\p{N}_"
SPACE = r"(?U)[\s\x1c-\x1f]+"
URL = r"(?U)http[^\s\x1c-\x1f]+|www[^\s\x1c-\x1f]+"
EMAIL = rf"(?<![{WORD}.-])[{WORD}.-]++@[{WORD}.-]+"
DIGITS = r"\p{Nd}+"
NOT_WORD_NOT_SPACE = rf"(?U)[^{WORD}\s\x1c-\x1f]"
NOT_WORD_RUN = rf"[^{WORD}]+"
NOT_LETTER_RUN = r"[^\p{L}\p{Nl}\p{No}_]+"

# Below U+0300 every character is composed already, and so are those of the listed
# blocks (Vietnamese, dashes and quotes, ideographs, Korean syllables). A text of these
# alone is its own NFC. Written as a range and a look back, since one class of many
# ranges is several times slower to search for.
COMPOSED_ABOVE = (
    r"\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}"
)
MAY_COMPOSE = rf"[\x{{300}}-\x{{10ffff}}](?<![{COMPOSED_ABOVE}])"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: unicodedata.normalize("NFC", t), na_action="ignore"
    )


def compose_unicode(text: Column) -> Column:
    """NFC. Only text with a character that could change travels to Python."""
    return F.coalesce(_compose(F.when(text.rlike(MAY_COMPOSE), text)), text)


def as_text(value: Column, null_text: str = "") -> Column:
    """String form with a stated text for null ("" is clean, "nan" is parity)."""
    return F.coalesce(value.cast("string"), F.lit(null_text))


def fold_case(text: Column) -> Column:
    return F.lower(text)


def _where(has: Column, changed: Column, text: Column) -> Column:
    """Run a pattern only over text that holds what it looks for."""
    return F.when(has, changed).otherwise(text)


def strip_urls(text: Column) -> Column:
    has = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    return _where(has, F.regexp_replace(text, URL, " "), text)


def strip_emails(text: Column) -> Column:
    has = F.contains(text, F.lit("@"))
    return _where(has, F.regexp_replace(text, EMAIL, " "), text)


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS, " ")


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, NOT_WORD_NOT_SPACE, " ")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def split_tokens(text: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clean_basic(text: Column) -> Column:
    """URLs, e-mails, digits and punctuation out, one space between words.

    The last three steps all turn characters into a space and then collapse, so one
    pass over the text does them together: what stays is a word character that is no
    decimal digit.
    """
    return F.trim(F.regexp_replace(strip_emails(strip_urls(text)), NOT_LETTER_RUN, " "))


def clean_simple(text: Column, null_text: str = "") -> Column:
    """Preset without dictionaries: lower case, NFC, then :func:`clean_basic`."""
    return clean_basic(compose_unicode(fold_case(as_text(text, null_text))))


def clean_light(text: Column, null_text: str = "") -> Column:
    """Preset for search: lower case, NFC, punctuation out, spaces collapsed.

    Punctuation and whitespace both end as one space, so it is a single pass.
    """
    composed = compose_unicode(fold_case(as_text(text, null_text)))
    return F.trim(F.regexp_replace(composed, NOT_WORD_RUN, " "))


# Fixed value: a term is a run of two or more word characters.
TERM = rf"[{WORD}]{{2,}}"


def term_tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def first_and_last_term(text: Column) -> tuple[Column, Column]:
    """The outermost of :func:`term_tokens`, empty where there are none, without finding those between.

    A term is a whole run of word characters, so the last one is the first of the text read backwards.
    """
    folded = F.lower(text)
    pattern = f"({TERM})"
    last = F.reverse(F.regexp_extract(F.reverse(folded), pattern, 1))
    return F.regexp_extract(folded, pattern, 1), last


def bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs joined by a space; none for fewer than two tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), n),
        F.slice(tokens, F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def unigrams_and_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))
