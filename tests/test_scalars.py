import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, number", [(" 42abc", 42), ("-7.9", -7), ("+3", 3), ("abc", 0), ("", 0), (None, 0),
                                          ("0x1F", 31), ("-0x10", -16), ("150", 150), ("1e3", 1)])
def test_leading_integer(spark, text, number):
    assert one(spark, text, scalars.leading_integer) == number


@pytest.mark.parametrize("slug, ok", [("ok-1_", True), ("bad slug", False), ("", False), ("a\n", False), (None, False)])
def test_valid_slug(spark, slug, ok):
    assert one(spark, slug, scalars.valid_slug) is ok


@pytest.mark.parametrize("value, label", [("true", "NYALA"), ("1", "MATI"), ("TRUE", "MATI"), (None, "MATI")])
def test_toggle(spark, value, label):
    assert one(spark, value, scalars.toggle_label) == label


@pytest.mark.parametrize("url, key", [("/?key=0Ly6kU", "0Ly6kU"), ("/?token=a&key=b%20c", "b c"), ("/?key=", None),
                                      ("/", None), ("/?monkey=1", None), ("ws://h/p?key=x#key=y", "x"),
                                      ("/#?key=z", None), ("/?key=%zz", "%zz")])
def test_query_field(spark, url, key):
    assert one(spark, url, lambda c: scalars.query_field(c, "key")) == key


@pytest.mark.parametrize("path, slug", [("/garden", "garden"), ("/api/public/view/garden", "garden"), ("/", "")])
def test_page_slug(spark, path, slug):
    assert one(spark, path, scalars.page_slug) == slug
    assert one(spark, slug, scalars.page_url) == "/" + slug


@pytest.mark.parametrize("text, number", [("12", 12), (" 12 ", 12), ("x", None), ("", None), ("1.5", None)])
def test_ids(spark, text, number):
    assert one(spark, text, scalars.as_id) == number
