"""Golden cases of the column functions."""

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t")).first()[0]


def test_tokenize(spark):
    assert one(spark, "El NFC-é, x 42!", T.tokenize) == ["el", "nfc", "42"]
    assert one(spark, None, T.tokenize) == []


def test_language_name(spark):
    for text, name in [("Cuales son los elemento de juego", "Spanish"), ("What is this project?", "English"), ("Qué es X", "English"), ("¿X", "Spanish"), (None, "English")]:
        assert one(spark, text, T.language_name) == name


def test_excerpt(spark):
    assert one(spark, "a" * 200, T.excerpt) == "a" * 200
    assert one(spark, "a" * 260, T.excerpt) == "a" * 200 + "…"
    assert one(spark, "a" * 180 + " " + "b" * 60, T.excerpt) == "a" * 180 + "…"
    assert one(spark, "a" * 150 + " " + "b" * 60, T.excerpt) == "a" * 150 + " " + "b" * 49 + "…"
    assert one(spark, "é" * 99 + "a" + "é" * 20, T.excerpt) == "é" * 99 + "a" + "…"
    assert one(spark, None, T.excerpt) == ""


def test_uuid5(spark):
    for s in ("", "a|b", "ñandú", "x" * 500):
        assert one(spark, s, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, s))


def test_cache_key(spark):
    import hashlib

    assert one(spark, "h", lambda c: T.cache_key("p", c)) == hashlib.sha256(b"p:h").hexdigest()
    assert one(spark, "h", lambda c: T.cache_key("", c)) == "h"


def test_trim_and_tail(spark):
    assert one(spark, "　 a b \n", T.trim_all) == "a b"
    assert one(spark, "añb", lambda c: T.tail(c, 2)) == "ñb"
    assert one(spark, "ab", lambda c: T.tail(c, 0)) == ""
    assert one(spark, "ab", lambda c: T.tail(c, 9)) == "ab"


def test_section_key_of_null(spark):
    df = spark.range(1).select(F.lit(None).cast("array<string>").alias("p"))
    assert df.select(T.section_key("p"), T.section_label("p")).first() == ("", "")
