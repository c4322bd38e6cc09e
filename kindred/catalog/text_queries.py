"""Text cleaning, dictionaries, feedback bags and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.catalog.common import LIGHT_DOCUMENTS_SQL, table, term_ctes
from kindred.functions.text import clean_light, clean_simple, split_tokens
from kindred.operators.corpus import (
    bag_segments,
    corpus_lengths,
    feedback_bag,
    item_corpus,
    number_profile,
)
from kindred.operators.dictionaries import (
    Dictionaries,
    clean_full,
    drop_tokens,
    map_tokens,
    replace_symbols,
)
from kindred.operators.embeddings import (
    MIN_COUNT,
    UNITS,
    VECTOR_SIZE,
    WINDOW,
    embed,
    fit_embedding,
)
from kindred.operators.terms import FULL_CORPUS_FEATURES
from kindred.plans.content import index_corpus

QUERIES = {}
SQL = {}

# Small dictionaries over the words and marks that the documents really contain.
SYMBOLS = [("###", "heading"), ("##", "mark"), ("=", "equals")]
SLANG = {"of": "belonging to", "le": "the", "der": "the", "que": "what", "es": "it is"}
BLOCKED = ["token", "hand", "anth"]
TRANSLATION = {"la": "the", "und": "and", "con": "with", "the": "a certain"}
STOPWORDS = ["a", "and", "is", "it", "les", "die", "with", "in", "en"]


def _pairs(spark: SparkSession, pairs) -> DataFrame:
    rows = [(k, v, i) for i, (k, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "key string, value string, line_no bigint")


def _tokens(spark: SparkSession, tokens) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tokens], "token string")


def dictionaries(spark: SparkSession) -> Dictionaries:
    return Dictionaries(
        emoji=_pairs(spark, SYMBOLS),
        slang=_pairs(spark, SLANG.items()),
        blocked=_tokens(spark, BLOCKED),
        translation=_pairs(spark, TRANSLATION.items()),
        stopwords=_tokens(spark, STOPWORDS),
    )


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _split(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda t: t <> '')"


def _map_sql(text: str, pairs: dict[str, str], key: str = "t") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    mapped = f"list_transform({_split(text)}, lambda t: CASE {key} {cases} ELSE t END)"
    return f"array_to_string({mapped}, ' ')"


def _drop_sql(text: str, words, key: str = "t", longer_than: int = 0) -> str:
    kept = f"{key} NOT IN ({_in(words)}) AND length(t) > {longer_than}"
    return f"array_to_string(list_filter({_split(text)}, lambda t: {kept}), ' ')"


def _symbols_sql(text: str) -> str:
    for key, value in SYMBOLS:
        text = f"replace({text}, '{key}', ' {value} ')"
    return text


def _basic_sql(text: str) -> str:
    steps = [
        r"http\S+|www\S+",
        r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+",
        r"\p{Nd}+",
        r"[^\p{L}\p{N}_\s]",
        r"\s+",
    ]
    for pattern in steps:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return f"trim({text})"


def full_ctes(source: str, id_cols: str, out: str) -> str:
    """The full pipeline one step at a time."""
    return f"""
{out}_1 AS (SELECT {id_cols}, {_symbols_sql('nfc_normalize(lower(text))')} AS text FROM {source}),
{out}_2 AS (SELECT {id_cols}, {_map_sql('text', SLANG)} AS text FROM {out}_1),
{out}_3 AS (SELECT {id_cols}, {_basic_sql('text')} AS text FROM {out}_2),
{out}_4 AS (SELECT {id_cols}, {_drop_sql('text', BLOCKED)} AS text FROM {out}_3),
{out}_5 AS (SELECT {id_cols}, {_map_sql('text', TRANSLATION, 'lower(t)')} AS text FROM {out}_4),
{out} AS (SELECT {id_cols}, {_drop_sql('text', STOPWORDS, 'lower(t)', 1)} AS text FROM {out}_5)"""


def light(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", clean_light(F.col("text")).alias("text"))


QUERIES["clean_light"] = light
SQL["clean_light"] = f"WITH {LIGHT_DOCUMENTS_SQL} SELECT doc_id, text FROM light"


def simple(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", clean_simple(F.col("text")).alias("text"))


QUERIES["clean_simple"] = simple
SQL["clean_simple"] = f"""
SELECT doc_id, {_basic_sql('nfc_normalize(lower(text))')} AS text FROM documents"""


# What the texts of the test tables lack: by id, put in front of them.
EXTRAS = {
    1: "see HTTP://x.example/a?b=1 and www.y.example/z, ",
    2: "cafe\u0301 A\u030angstro\u0308m \u1112\u1161\u11ab ",
    3: "non\u00a0breaking\u2003spaces\u3000here ",
    4: "mail me_2@host.example now ",
}


def _odd_documents(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("doc_id") % 6
    extra = F.lit("")
    for n, words in EXTRAS.items():
        extra = F.when(turn == n, words).otherwise(extra)
    text = F.when(turn != 5, F.concat(extra, "text"))
    return _documents(spark, folder).select("doc_id", text.alias("text"))


_ODD_SQL = f"""
odd AS (
  SELECT doc_id, CASE WHEN doc_id % 6 <> 5 THEN
    CASE doc_id % 6 {" ".join(f"WHEN {n} THEN '{words}'" for n, words in EXTRAS.items())} ELSE '' END
    || text ELSE '' END AS text
  FROM documents
)"""


def odd_light(spark: SparkSession, folder: str) -> DataFrame:
    """Light cleaning of texts with addresses, decomposed letters, other spaces and nulls."""
    return _odd_documents(spark, folder).select("doc_id", clean_light(F.col("text")).alias("text"))


QUERIES["clean_light_odd"] = odd_light
SQL["clean_light_odd"] = rf"""
WITH {_ODD_SQL}
SELECT doc_id, trim(regexp_replace(nfc_normalize(lower(text)), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS text
FROM odd"""


def odd_simple(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts through the preset that takes addresses out."""
    return _odd_documents(spark, folder).select("doc_id", clean_simple(F.col("text")).alias("text"))


QUERIES["clean_simple_odd"] = odd_simple
SQL["clean_simple_odd"] = f"""
WITH {_ODD_SQL},
spaced AS (
  SELECT doc_id, regexp_replace(nfc_normalize(lower(text)), '[\u00a0\u2003\u3000]', ' ', 'g') AS text FROM odd
)
SELECT doc_id, {_basic_sql('text')} AS text FROM spaced"""


def full(spark: SparkSession, folder: str) -> DataFrame:
    return clean_full(_documents(spark, folder), "text", dictionaries(spark))


QUERIES["clean_full"] = full
SQL["clean_full"] = f"""
WITH {full_ctes('documents', 'doc_id', 'done')} SELECT doc_id, text FROM done"""


def token_map(spark: SparkSession, folder: str) -> DataFrame:
    """Slang lookup."""
    return map_tokens(
        _documents(spark, folder),
        "text",
        _pairs(spark, SLANG.items()),
        lower=True,
    )


QUERIES["token_map"] = token_map
SQL["token_map"] = f"""
SELECT doc_id, {_map_sql('text', SLANG, 'lower(t)')} AS text FROM documents"""


def token_block(spark: SparkSession, folder: str) -> DataFrame:
    """Stopwords dropped."""
    return drop_tokens(
        _documents(spark, folder),
        "text",
        _tokens(spark, STOPWORDS),
        lower=True,
        min_length=2,
    )


QUERIES["token_block"] = token_block
SQL["token_block"] = f"""
SELECT doc_id, {_drop_sql('text', STOPWORDS, 'lower(t)', 1)} AS text FROM documents"""


def emoji_replace(spark: SparkSession, folder: str) -> DataFrame:
    return replace_symbols(_documents(spark, folder), "text", _pairs(spark, SYMBOLS))


QUERIES["emoji_replace"] = emoji_replace
SQL["emoji_replace"] = f"SELECT doc_id, {_symbols_sql('text')} AS text FROM documents"


def symbols_many(spark: SparkSession, folder: str) -> DataFrame:
    """Every longer word of the benchmark as a symbol, put between marks wherever it occurs."""
    words = table(spark, folder, "benchmark").select(
        F.explode(split_tokens(F.col("text"))).alias("key")
    )
    symbols = (
        words.where(F.length("key") > 3)
        .distinct()
        .select("key", F.concat(F.lit("<"), "key", F.lit(">")).alias("value"), F.lit(0).alias("line_no"))
    )
    return replace_symbols(_documents(spark, folder), "text", symbols)


QUERIES["symbols_many"] = symbols_many
SQL["symbols_many"] = rf"""
WITH words AS (SELECT DISTINCT unnest({_split('text')}) AS w FROM benchmark),
symbols AS (SELECT list(w ORDER BY w) AS keys FROM words WHERE length(w) > 3)
SELECT doc_id, list_reduce(
         list_concat([text], keys), lambda a, k: replace(a, k, ' <' || k || '> ')) AS text
FROM documents, symbols"""


def _light_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", clean_light(F.col("text")).alias("said")
    )


LIGHT_BAG_SQL = r"""
bag AS (
  SELECT conv_id AS doc_id, string_agg(
    trim(regexp_replace(nfc_normalize(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g')),
    ' ' ORDER BY turn) AS bag
  FROM conversations GROUP BY conv_id
)"""


def bags(spark: SparkSession, folder: str) -> DataFrame:
    return feedback_bag(_light_feedback(spark, folder), "doc_id", "said", "turn", chunk=3)


QUERIES["feedback_bag"] = bags
SQL["feedback_bag"] = f"WITH {LIGHT_BAG_SQL} SELECT doc_id, bag FROM bag"


# Characters of a part: short, so that the bags of the test tables have several.
PART = 200


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """The bags in parts of equal width."""
    return bag_segments(_light_feedback(spark, folder), "doc_id", "said", "turn", width=PART, chunk=3)


QUERIES["bag_segments"] = segments
SQL["bag_segments"] = f"""
WITH {LIGHT_BAG_SQL},
parts AS (
  SELECT doc_id, bag, unnest(range(0, greatest((length(bag) + {PART - 1}) // {PART}, 1))) AS part
  FROM bag WHERE bag IS NOT NULL
)
SELECT doc_id, part, part * {PART} AS offset, substr(bag, part * {PART} + 1, {PART}) AS text
FROM parts"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    bag = feedback_bag(_light_feedback(spark, folder), "doc_id", "said", "turn")
    return item_corpus(light(spark, folder), bag, "doc_id", "text")


_CORPUS_SQL = f"""
{LIGHT_DOCUMENTS_SQL}, {LIGHT_BAG_SQL},
corpus AS (
  SELECT doc_id, text || ' ' || coalesce(bag, '') AS corpus
  FROM light LEFT JOIN bag USING (doc_id)
)"""
QUERIES["item_corpus"] = corpus
SQL["item_corpus"] = f"WITH {_CORPUS_SQL} SELECT doc_id, corpus FROM corpus"


def corpus_profile(spark: SparkSession, folder: str) -> DataFrame:
    said = _light_feedback(spark, folder)
    profile = number_profile(corpus_lengths(light(spark, folder), said, "doc_id", "text", "said"), "n")
    return profile.select(
        "count",
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in profile.columns[1:]],
    )


QUERIES["corpus_profile"] = corpus_profile
SQL["corpus_profile"] = f"""
WITH {_CORPUS_SQL}, n AS (SELECT CAST(length(corpus) AS DOUBLE) AS n FROM corpus)
SELECT count(*) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       round(min(n), 6) AS min, round(quantile_cont(n, 0.25), 6) AS p25,
       round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75,
       round(max(n), 6) AS max
FROM n"""


def corpus_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary over documents with all their feedback, fully cleaned."""
    index = index_corpus(
        _documents(spark, folder),
        table(spark, folder, "conversations").select(
            F.col("conv_id").alias("doc_id"),
            "turn",
            F.col("text").alias("said"),
        ),
        key="doc_id",
        item_text="text",
        feedback_text="said",
        order_col="turn",
        dictionaries=dictionaries(spark),
        max_features=FULL_CORPUS_FEATURES,
    )
    return index.model.terms.select("term", "df", "ctf", F.round("idf", 6).alias("idf"))


QUERIES["corpus_vocab"] = corpus_vocab
SQL["corpus_vocab"] = f"""
WITH {full_ctes('documents', 'doc_id', 'own')},
{full_ctes('conversations', 'conv_id, turn', 'said')},
bag AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS bag
        FROM said GROUP BY conv_id),
corpus AS (SELECT doc_id, text || ' ' || coalesce(bag, '') AS text
           FROM own LEFT JOIN bag USING (doc_id)),
{term_ctes('corpus', 'doc_id', 'text', FULL_CORPUS_FEATURES)}
SELECT term, df, ctf, round(idf, 6) AS idf FROM idf"""


def doc_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """An embedding of every document, learnt on all of them.

    Means of whole numbers often lie just between two roundings; the nudge decides for both sides.
    """
    texts = light(spark, folder)
    found = embed(fit_embedding(texts, "text"), texts, "doc_id", "text")
    return found.select("item_id", F.posexplode("embedding").alias("dimension", "x")).select(
        "item_id", "dimension", (F.round(F.col("x") + 1e-9, 6) + 0.0).alias("value")
    )


QUERIES["doc_embedding"] = doc_embedding
SQL["doc_embedding"] = f"""
WITH {LIGHT_DOCUMENTS_SQL},
toks AS (SELECT doc_id, {_split('text')} AS t FROM light),
met AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (
    SELECT unnest(t) AS a, unnest(t[1 + d:] || list_transform(range(least(d, len(t))), lambda x: NULL)) AS b
    FROM toks, range(1, {WINDOW + 1}) r(d)
  ) WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {MIN_COUNT}
),
directed AS (
  SELECT word, other, sum(n) AS n FROM (
    SELECT a AS word, b AS other, n FROM met UNION ALL SELECT b, a, n FROM met
  ) GROUP BY word, other
),
alone AS (SELECT word, sum(n) AS own FROM directed GROUP BY word),
total AS (SELECT sum(n) AS n FROM directed),
gains AS (
  SELECT b.word, b.other,
         CAST(floor(ln(CAST(b.n AS DOUBLE) * CAST(t.n AS DOUBLE) / (CAST(w.own AS DOUBLE) * CAST(o.own AS DOUBLE))) * {UNITS} + 0.5) AS BIGINT) AS gain
  FROM directed b JOIN alone w ON w.word = b.word JOIN alone o ON o.word = b.other, total t
),
sign AS (
  SELECT word AS other, d,
         2 * ((CAST('0x' || substr(md5(word), CAST(1 + d // 4 AS INTEGER), 1) AS INTEGER) >> CAST(d % 4 AS INTEGER)) % 2) - 1 AS s
  FROM alone, range({VECTOR_SIZE}) r(d)
),
vectors AS (
  SELECT word, d, CAST(sum(gain * s) AS BIGINT) AS x FROM gains JOIN sign USING (other) WHERE gain > 0 GROUP BY word, d
),
counted AS (
  SELECT doc_id, tok AS word, count(*) AS c FROM (SELECT doc_id, unnest(t) AS tok FROM toks) GROUP BY doc_id, tok
),
means AS (
  SELECT doc_id, d, sum(c * x) / (sum(c) * {float(UNITS)}) AS x
  FROM counted JOIN vectors USING (word) GROUP BY doc_id, d
)
SELECT a.doc_id AS item_id, CAST(r.d AS INTEGER) AS dimension, coalesce(round(m.x + 1e-9, 6), 0.0) + 0.0 AS value
FROM (SELECT DISTINCT doc_id FROM light) a CROSS JOIN range({VECTOR_SIZE}) r(d)
LEFT JOIN means m ON m.doc_id = a.doc_id AND m.d = r.d"""
