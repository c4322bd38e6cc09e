import pytest
from pyspark.sql import functions as F

from kindred.functions.labels import default_score, method_label, none_if_missing
from kindred.functions.schema import (
    ITEM_ALIASES,
    RULES,
    MissingColumnsError,
    Rule,
    align_key,
    find_columns,
    join_all_strings,
    join_text,
    normalize_header,
    pin_feedback,
    pin_items,
    rename_by_alias,
    require_columns,
    resolve_roles,
    trim_headers,
)


def empty(spark, *names):
    return spark.createDataFrame([tuple("x" for _ in names)], list(names))


def test_headers(spark):
    assert normalize_header("  Hotel - ID (No.) ") == "hotel_id_no"
    assert trim_headers(empty(spark, " a ", "b")).columns == ["a", "b"]
    assert find_columns(empty(spark, "HOTEL_ID", "x", "my_hotel_id"), "Hotel_ID") == [
        "HOTEL_ID", "my_hotel_id",
    ]


def test_rename_takes_the_first_alias_that_exists(spark):
    df = empty(spark, "Hotel Id", "Name", "Stars", "other")
    assert rename_by_alias(df, ITEM_ALIASES).columns == ["item_id", "item_name", "rank", "other"]


def test_of_headers_that_normalise_alike_the_later_is_used(spark):
    df = spark.createDataFrame([(1, 2)], ["hotel id", "hotel-id"])
    out = rename_by_alias(df, {"item_id": ["hotel_id"]})
    assert out.columns == ["hotel id", "item_id"] and out.first()["item_id"] == 2


def test_a_column_that_bears_a_filled_name_goes(spark):
    df = spark.createDataFrame([(1, 2)], ["rank", "hotel_rank"])
    out = rename_by_alias(df, ITEM_ALIASES)
    assert out.columns == ["rank"] and out.first()["rank"] == 2


def test_required_columns(spark):
    with pytest.raises(MissingColumnsError, match="items lacks required columns: b, c"):
        require_columns(empty(spark, "a"), ["a", "b", "c"], "items")
    with pytest.raises(MissingColumnsError):
        pin_feedback(empty(spark, "Score", "Hotel_ID"))


def test_roles(spark):
    items = empty(spark, "Hotel_ID", "Hotel_Name", "Hotel_Description")
    feedback = empty(spark, "Hotel ID", "Reviewer Name", "Score", "Score Level")
    roles = resolve_roles(items, feedback)
    assert (roles.item_id, roles.item_name, roles.text) == (
        "Hotel_ID", "Hotel_Name", ["Hotel_Description"],
    )
    assert (roles.join_key, roles.feedback_item) == ("Hotel ID", "Hotel ID")
    assert (roles.user, roles.rating) == ("Reviewer Name", "Score")


def test_role_fall_backs(spark):
    roles = resolve_roles(empty(spark, "key", "title"), empty(spark, "x", "y"))
    assert (roles.item_id, roles.item_name) == ("key", "title")
    assert (roles.join_key, roles.user, roles.feedback_item, roles.rating) == (None,) * 4
    assert resolve_roles(empty(spark, "key"), empty(spark, "key")).item_name == "key"
    assert resolve_roles(empty(spark, "a"), empty(spark, "Hotel_ID")).feedback_item == "Hotel_ID"


def test_own_role_rules(spark):
    rules = RULES | {"user": Rule("feedback", "guest", positions=(0,))}
    assert resolve_roles(empty(spark, "key"), empty(spark, "x", "Guest"), rules).user == "Guest"
    assert resolve_roles(empty(spark, "key"), empty(spark, "x", "y"), rules).user == "x"


def test_row_text(spark):
    df = spark.createDataFrame([("a", 1, None)], "x string, n int, y string")
    out = df.select(
        join_text(["x", "y"]).alias("clean"),
        join_text(["x", "y"], "nan").alias("parity"),
        join_all_strings(df, "nan").alias("every"),
        join_text([]).alias("none"),
    ).first()
    assert tuple(out) == ("a ", "a nan", "a nan", "")


def test_defaults(spark):
    bare = spark.createDataFrame([(1, "n", None)], "hotel_id int, name string, address string")
    row = pin_items(bare, null_text="nan").first()
    assert row["description"] == "n nan" and 7.5 <= row["score"] <= 9.8
    full = spark.createDataFrame([(1, "n", "d", 3.0)], "hotel_id int, name string, description string, score double")
    assert tuple(pin_items(full).first()) == (1, "n", "d", 3.0)


def test_default_score_is_fixed_and_varied(spark):
    rows = spark.range(1000).select(default_score(F.col("id")).alias("s")).collect()
    scores = {r["s"] for r in rows}
    assert min(scores) >= 7.5 and max(scores) <= 9.8 and len(scores) > 20


def test_labels(spark):
    df = spark.createDataFrame([(" No Info ",), ("n/A x",), (" 4 ",), (None,)], "r string")
    assert [r[0] for r in df.select(none_if_missing(F.col("r"))).collect()] == [None, None, "4", None]
    label = spark.range(1).select(method_label(F.lit("tfidf"), F.lit(5))).first()[0]
    assert label == "tfidf_5"


def test_align_key(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id bigint")
    said = spark.createDataFrame([("1",), ("x",), (" 2",)], "item_id string")
    out = align_key(said, "item_id", items, "item_id")
    assert out.dtypes == [("item_id", "bigint")]
    assert [r[0] for r in out.collect()] == [1, None, 2]


def test_feedback_without_users_is_dropped(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], ["Reviewer Name", "Hotel ID"])
    assert [tuple(r) for r in pin_feedback(df).collect()] == [("a", 2)]
