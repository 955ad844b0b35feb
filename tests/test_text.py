import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litprops.functions import hashing, text, variants


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [("97-99", 98.0), ("50", 50.0), ("1e-3", 0.001), ("-5--3", -4.0), ("-5", -5.0), (" 98 ", 98.0), ("abc", None), ("1d", None), (None, None), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("a-b", None)],
)
def test_ratio(spark, value, expected):
    assert one(spark, value, text.parse_ratio) == expected


def test_ratio_strict_fails(spark):
    with pytest.raises(Exception, match="bad ratio"):
        one(spark, "abc", lambda c: text.parse_ratio(c, strict=True))
    assert one(spark, None, lambda c: text.parse_ratio(c, strict=True)) is None


@pytest.mark.parametrize(
    "md, title",
    [
        ("# A title\nx", "A title"),
        ("\n\n  # Late \nx", "Late"),
        ("## no\n### no", None),
        ("#\ntext", None),
        ("# # x", "# x"),
        ("# one\n# two", "one"),
        ("x\r\n# win\r\ny", "win"),
        ("# nbsp", "nbsp"),
        ("#nospace", None),
        ("a # b", None),
        ("", None),
        ("text\n#  spaced   title  ", "spaced   title"),
    ],
)
def test_title(spark, md, title):
    assert one(spark, md, text.h1_title) == title


@pytest.mark.parametrize(
    "raw, extractor, generator",
    [
        ("```json\n[1]\n```", "[1]", "[1]"),
        ("```\n[1]\n```", "[1]", "```\n[1]"),
        ("  [1]  ", "[1]", "[1]"),
        ("```json```x```", "x", "```x"),
    ],
)
def test_fences(spark, raw, extractor, generator):
    assert one(spark, raw, text.strip_fences) == extractor
    assert one(spark, raw, lambda c: text.strip_fences(c, "generator")) == generator


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('[{"a":1}]', '[{"a":1}]'),
        ('{"a":1}', '[{"a":1}]'),
        ("5", None),
        ('"x"', None),
        ("null", None),
        ("  ", None),
        (None, None),
        ("so: [1, 2] done", "[1,2]"),
        ("[1] and [2]", None),
        ('{"a":1} [2]', "[2]"),
        ("[1,", None),
        ("]x[", None),
        ("[]", "[]"),
        ('[1]],[2', None),
    ],
)
def test_lenient_array(spark, raw, expected):
    got = one(spark, raw, lambda c: F.to_json(variants.lenient_json_array(c)))
    assert (None if got is None else json.loads(got)) == (None if expected is None else json.loads(expected))


@pytest.mark.parametrize(
    "raw, expected",
    [("https://doi.org/10.1/A ", "10.1/a"), ("doi:10.1/A", "10.1/a"), ("  ", None), ("10.1/x", "10.1/x"), ("http://dx.doi.org/10.5/Q", "10.5/q")],
)
def test_doi(spark, raw, expected):
    assert one(spark, raw, text.normalize_doi) == expected


@pytest.mark.parametrize(
    "name, plain, parts",
    [("val_Tg_1.json", "Tg", "Tg"), ("Tg.json", "Tg", "Tg"), ("val_E_article_2.json", "E_article", "E_article"), ("val_Tg_1_train.json", "Tg_1_train", "Tg"), ("Tg_test.json", "Tg_test", "Tg")],
)
def test_dataset_name(spark, name, plain, parts):
    assert one(spark, f"/a/b.c/{name}", text.dataset_name) == plain
    assert one(spark, name, lambda c: text.dataset_name(c, True)) == parts


def test_strip_is_unicode(spark):
    assert one(spark, "   x\x1c\t", text.strip) == "x"


_json = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc")), max_size=8) | st.sampled_from(['a"b', "c\\d", "x: y, z", "\\\\\"", "\n\t"]),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", 'k"', "b,c", "d:e", "\\"]), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_json, min_size=1, max_size=20))
def test_spacing_equals_python(spark, values):
    compact = [(json.dumps(v, ensure_ascii=False, separators=(",", ":")), json.dumps(v, ensure_ascii=False)) for v in values]
    df = spark.createDataFrame(compact, "c string, want string")
    assert df.filter(text.python_json_spacing("c") != F.col("want")).collect() == []


def test_hash_order_is_stable(spark):
    df = spark.range(50).select("id", hashing.hash_number(3, "id").alias("h"), hashing.hash_text(3, "id").alias("t"), hashing.pick(["a", "b"], 3, "id").alias("p"))
    import hashlib

    for r in df.collect():
        digest = hashlib.md5(f"3:{r['id']}".encode()).hexdigest()
        assert (r["t"], r["h"], r["p"]) == (digest, int(digest[:13], 16), "ab"[int(digest[:13], 16) % 2])
