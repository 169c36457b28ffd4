import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstock.functions.keys import float_id_text, key_form, key_text, target_key_text

FORMS = {
    "1691": "1691", " 1691 ": "1691", "1691.0": "1691", "1691.": "1691", "01691": "1691", "+5": "5", "-5": "-5", "-05.00": "-5", "-0": "0", "000": "0", "0.0": "0", "4.2e1": "42", "1e3": "1000", "4.25e1": "4.25e1",
    "1.5": "1.5", "abc": "abc", "": None, "  ": None, "nan": None, "NaN": None, "NONE": None, "<NA>": None, "null": "null", "\t7.0 ": "7", "99999999999999999999": "99999999999999999999", " 8": "8", "1 2": "1 2",
}


def test_key_form_of_text(spark):
    df = spark.createDataFrame([(k,) for k in [*FORMS, None]], "k string")
    got = {r.k: r.f for r in df.select("k", key_form(F.col("k"), T.StringType()).alias("f")).collect()}
    assert got == FORMS | {None: None}


def test_key_form_of_numbers(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 1.5), (None, None)], "i bigint, d double")
    rows = df.select(key_form(F.col("i"), T.LongType()).alias("i"), key_form(F.col("d"), T.DoubleType()).alias("d")).collect()
    assert [(r.i, r.d) for r in rows] == [("1", "1"), ("2", None), ("3", "1.5"), (None, None)]


def test_plain_and_target_keys(spark):
    with pytest.raises(ValueError, match="float"):
        key_text(F.lit(1.0), T.DoubleType())
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "d double")
    assert [r[0] for r in df.select(target_key_text(F.col("d"), T.DoubleType())).collect()] == ["1", None, None]
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(1.5,)], "d double").select(target_key_text(F.col("d"), T.DoubleType())).collect()
    assert [r[0] for r in spark.createDataFrame([(123.0,), (123.5,), (None,)], "d double").select(float_id_text(F.col("d"))).collect()] == ["123", "123.5", None]
