"""Secret scan: candidate tokens, and a random forest that removes false positives.

Candidates are runs of 16 or more token characters with a digit among them, formats that issuers
publish, and whatever of six or more characters is assigned to a secret's name with ``=`` or
``:``, up to a blank or quote (marks at the end that close a clause are not part of it). Each is described by
its length, its make-up (shares of letters, capitals and digits, entropy), its character
transitions (changes of character class, vowel and consonant alternation), how much of it
dictionary words cover, the path it was found under, and the words next to it. A random forest
trained on labelled findings gives the probability that it is a secret; findings below
``KEEP`` are false positives.

The forest is fitted on at most ``MAX_ROWS`` labelled findings, those with the lowest hashes,
in a fixed order, so the model does not depend on partitions. All texts are scanned whole.
Where no findings are labelled, ``rule_labels`` labels them: formats that issuers publish and
values assigned to a secret's name are secrets, plain numbers, UUIDs, placeholders and digests
named as such are not, everything else (among it plain words after a secret's name) stays unlabelled
and is left to the forest. :func:`held_out_quality` measures a forest on labelled findings it has not seen.

Everything is DataFrame expressions and Spark's own forest; no Python runs on the executors.

Defined cases: null and empty texts have no findings; rows without an id have findings with a
null id; repeated rows are each scanned; a null path is an empty one; if the labelled findings
are of one class only or there are none, no finding is removed; an empty table gives an empty
result. Offsets are code points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import cut

MAX_ROWS = 20_000
TREES, DEPTH, SEED = 30, 6, 7
#: Findings of a text whose lengths are summed at a time.
RUN = 128
KEEP = 0.5

# What a candidate is, and formats that issuers publish.
SECRET_NAME = (
    r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential)[sS]?"
)
ASSIGNED = (
    r"(?<=[=:\s\"'])(?<=[=:]\s{0,3}[\"']?)(?<=" + SECRET_NAME + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?)"
    r"[^\s\"'=:][^\s\"']{4,}[^\s\"',;.]"
)
PUBLISHED = r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|xox[abpr]-[A-Za-z0-9-]{10,})"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{ASSIGNED}|{PUBLISHED}|{TOKEN}"
ISSUED = (
    r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{24,}$"
    r"|^xox[abpr]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^glpat-[A-Za-z0-9_-]{20}$"
)
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
NAMED = SECRET_NAME + r"[\"']?\s*[=:]?\s*[\"']?$"
PLAIN_WORD = r"^[A-Za-z]?[a-z]+[!?)]*$"
DIGEST = r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|etag|revision|build)[\"']?\s*[=:]?\s*[\"']?$"
PLACEHOLDER = r"(?i)x{6,}|0{8,}|1234567|abcdef|example|changeme|placeholder|sample|dummy"
TEST_PATH = r"(?i)test|example|sample|fixture|mock|doc|demo"
# Words that make a token look written by people.
DICTIONARY = (
    "admin",
    "and",
    "api",
    "app",
    "auth",
    "client",
    "config",
    "data",
    "default",
    "dev",
    "example",
    "file",
    "for",
    "from",
    "home",
    "http",
    "image",
    "index",
    "info",
    "key",
    "local",
    "main",
    "name",
    "new",
    "page",
    "password",
    "path",
    "prod",
    "public",
    "report",
    "sample",
    "secret",
    "server",
    "service",
    "static",
    "test",
    "that",
    "the",
    "this",
    "token",
    "user",
    "value",
    "version",
    "with",
)

FEATURES = (
    "f_length",
    "f_letters",
    "f_capitals",
    "f_digits",
    "f_marks",
    "f_entropy",
    "f_changes",
    "f_alternation",
    "f_words",
    "f_hex",
    "f_test_path",
    "f_path_depth",
    "f_named",
    "f_digest",
    "f_quoted",
    "f_assigned",
)


def findings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """All candidates: ``doc_id``, ``start``, ``end``, ``value``, ``before``, ``after``, ``path``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[path_col].cast("string"), F.lit("")).alias("path"),
        text.alias("text"),
    ).where(F.col("text").rlike(CANDIDATE))
    pieces, values, lengths = F.col("pieces"), F.col("values"), F.col("lengths")

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    def block(number: Column) -> Column:
        return total(F.slice(lengths, number * RUN + 1, RUN))

    numbers = F.sequence(F.lit(0), F.floor(F.size("values") / RUN).cast("int"))
    reached = F.aggregate(
        F.transform(numbers, block),
        F.array(F.lit(0)),
        lambda a, x: F.array_append(a, F.element_at(a, -1) + x),
    )

    def one(i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        inside = total(F.slice(lengths, run * RUN + 1, i % RUN))
        start = F.get("reached", run) + inside + F.length(F.get(pieces, i))
        return F.struct(
            start.alias("start"),
            F.get(values, i).alias("value"),
            F.substring(F.get(pieces, i), -40, 40).alias("before"),
            F.substring(F.get(pieces, i + 1), 1, 20).alias("after"),
        )

    return (
        rows.select(
            "doc_id",
            "path",
            F.split("text", CANDIDATE).alias("pieces"),
            F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("values"),
        )
        .withColumn(
            "lengths", F.transform(values, lambda v, i: F.length(v) + F.length(F.get(pieces, i)))
        )
        .withColumn("reached", reached)
        .select(
            "doc_id",
            "path",
            F.explode(F.transform(F.sequence(F.lit(0), F.size("values") - 1), one)).alias("f"),
        )
        .select(
            "doc_id",
            F.col("f.start").cast("bigint").alias("start"),
            (F.col("f.start") + F.length("f.value")).cast("bigint").alias("end"),
            F.col("f.value").alias("value"),
            F.col("f.before").alias("before"),
            F.col("f.after").alias("after"),
            "path",
        )
    )


def described(found: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``, all doubles."""
    value, size = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / size

    chars = F.array_distinct(F.split(value, ""))
    entropy = F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.lit(0.0),
        lambda total, c: total
        - (size - F.length(F.replace(value, c, F.lit("")))) / size
        * F.log2((size - F.length(F.replace(value, c, F.lit("")))) / size),
    )
    changes = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"
    turns = r"(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"
    without = F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")
    columns = {
        "f_length": size,
        "f_letters": share("[A-Za-z]"),
        "f_capitals": share("[A-Z]"),
        "f_digits": share("[0-9]"),
        "f_marks": share("[^A-Za-z0-9]"),
        "f_entropy": entropy,
        "f_changes": share(changes),
        "f_alternation": share(turns),
        "f_words": 1 - F.length(without) / size,
        "f_hex": F.when(value.rlike("^[0-9a-fA-F]+$"), 1.0).otherwise(0.0),
        "f_test_path": F.when(F.col("path").rlike(TEST_PATH), 1.0).otherwise(0.0),
        "f_path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "f_named": F.when(F.col("before").rlike(NAMED), 1.0).otherwise(0.0),
        "f_digest": F.when(F.col("before").rlike(DIGEST), 1.0).otherwise(0.0),
        "f_quoted": F.when(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']"), 1.0).otherwise(0.0),
        "f_assigned": F.when(F.col("before").rlike("[=:]\\s*[\"']?$"), 1.0).otherwise(0.0),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def rule_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 a secret, 0 none, null where the rules say nothing."""
    value, before = F.col("value"), F.col("before")
    harmless = (
        value.rlike(PLACEHOLDER)
        | value.rlike(UUID)
        | value.rlike("^[0-9+/_-]+$")
        | before.rlike(DIGEST)
    )
    named = before.rlike(NAMED) & ~value.rlike(PLAIN_WORD)
    label = F.when(value.rlike(ISSUED), 1).when(harmless, 0).when(named, 1)
    return found.withColumn("label", label)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS):
    """A forest from ``described`` findings with ``label``; None if they are of one class."""
    order = F.xxhash64("doc_id", "start", "value")
    sample = cut(
        labelled.where("label IN (0, 1)")
        .select(F.col("label").cast("double").alias("label"), *FEATURES, order.alias("o"))
        .orderBy("o", *FEATURES)
        .limit(max_rows)
        .coalesce(1),
        "findings",
    )
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_assembled(sample))


def held_out_quality(labelled: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(found, precision, recall)`` of a forest on one of ``folds`` parts it was not fitted on.

    ``labelled`` are ``described`` findings with ``label``; equal values fall in the same part. One row;
    rates without a denominator are null, as are all where the fitted findings are of one class.
    """
    rows = labelled.where("label IN (0, 1)").withColumn("_fold", F.pmod(F.xxhash64("value"), F.lit(folds)))
    model = fit(rows.where("_fold <> 0"), max_rows)
    if model is None:
        return labelled.sparkSession.sql(
            "SELECT 0L AS found, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall"
        )
    said = _probability(model, rows.where("_fold = 0")).select("label", F.col("probability") >= KEEP)
    said = said.toDF("label", "kept")
    right = F.count_if(F.col("kept") & (F.col("label") == 1))
    return said.agg(
        F.count(F.lit(1)).alias("found"),
        F.try_divide(right, F.count_if("kept")).alias("precision"),
        F.try_divide(right, F.count_if(F.col("label") == 1)).alias("recall"),
    )


def _probability(model, found: DataFrame) -> DataFrame:
    """``found`` with the forest's ``probability`` of a secret."""
    return model.transform(_assembled(found)).withColumn(
        "probability", F.get(vector_to_array(F.col("probability")), F.lit(1))
    )


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, keep: float = KEEP, **columns: str) -> DataFrame:
    """Every finding of ``docs`` with its ``probability`` and ``is_secret``.

    ``labelled`` holds findings with ``label``; by default the findings of ``docs`` labelled by rule.
    ``doc_id``, ``start``, ``end``, ``value``, ``path``, ``probability``, ``is_secret``.
    """
    found = cut(described(findings(docs, **columns)), "candidates")
    model = fit(rule_labels(found) if labelled is None else described(labelled))
    if model is None:
        scored = found.withColumn("probability", F.lit(1.0))
    else:
        scored = _probability(model, found)
    return scored.select(
        "doc_id",
        "start",
        "end",
        "value",
        "path",
        "probability",
        (F.col("probability") >= keep).alias("is_secret"),
    )
