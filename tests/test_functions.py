import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import keys, stats, text
from lumenfold.operators import evaluate


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "a, b",
    [("O%27Neil", "o'neil"), ("a%2520b", "A b"), ("x/* note */y", "xy"), ("a${IFS}b", "a  b"), ("&lt;b&gt;", "<B>"), ("\\u003cb", "<b"), ("a b", "a b")],
)
def test_canonical_pairs(spark, a, b):
    assert one(spark, keys.canonical_key, a) == one(spark, keys.canonical_key, b)


def test_family_and_equivalence_keys(spark):
    assert one(spark, keys.family_key, "see http://a.b/x?id=123 loooooong") == "seehttp://H/x?id=0looong"
    assert one(spark, keys.equivalence_key, "Straße é") == "strasse é"
    assert one(spark, keys.canonical_key, None) is None


def test_null_parts_do_not_collide(spark):
    d = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "x string, y string")
    assert d.select(keys.nul_sha256(F.col("x"), F.col("y")).alias("k")).distinct().count() == 3


def test_shingles(spark):
    assert one(spark, keys.shingles, "abcabc") == ["abca", "bcab", "cabc"]
    assert one(spark, keys.shingles, "abc") is None


@pytest.mark.parametrize(
    "value, want",
    [
        ("A plain sentence.", "accepted"), ("", "empty"), (None, "empty"), ("ab", "too_short"), ("x" * 201, "too_long"), ("write to a@b.org now", "email_like"), ("see @me", "at_sign"),
        ("at www.here", "url_like"), ("code 123456", "digit_run_ge6"), ("call 1 23 45 6 7 8 9", "phone_like"), ("in March 2021", "dated_event"), ("on 3 may 4th, 1999", "dated_event"), ("met Anna Smith there", "possible_full_name"), ("bad\x01", "control_char"),
    ],
)
def test_prose_ladder(spark, value, want):
    assert one(spark, text.prose_reason, value) == want


@pytest.mark.parametrize(
    "value, want",
    [("Anna", "accepted"), ("anna", "not_capitalised"), ("Anna Maria", "looks_like_full_name"), ("Ann4", "contains_digit"), ("Ann (x)", "parenthesis_or_disambiguation"), ("given name", "descriptive_label"), ("A*", "non_name_char")],
)
def test_name_ladder(spark, value, want):
    assert one(spark, text.name_reason, value) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("/path", "RELATIVE"), ("javascript:x", "SCHEME"), ("http://2130706433/", "OBFUSCATED"), ("http://u@example.org/", "OBFUSCATED"), ("http://169.254.169.254/x", "META"), ("//example.org/", "DIFF"),
        ("https:example.org", "DIFF"), ("http://127.0.0.1/", "LOOPBACK"), ("http://localhost/", "LOOPBACK"), ("http://10.1.2.3/", "PRIVATE"), ("http://intranet/", "PRIVATE"), ("https://example.org/", "OPEN_REDIRECT"),
    ],
)
def test_url_classes(spark, value, want):
    assert one(spark, text.url_class, value) == want
    if want == "OPEN_REDIRECT":
        assert one(spark, lambda c: text.url_class(c, navigation=False), value) == "PUBLIC"


@pytest.mark.parametrize("body, want", [("{}", (True, 0, 0)), ('{"a":1,"a":2}', (True, 2, 1)), ('[[{"b":[1]}]]', (True, 1, 4)), ("{", (False, 0, 0)), ("3", (True, 0, 0))])
def test_json_shape(spark, body, want):
    got = one(spark, text.json_shape, body)
    assert (got["valid"], got["members"]) == want[:2]
    if body != "{}":
        assert got["depth"] == want[2]


def test_request_features(spark):
    request = "POST /a/b%20c?x=1&x=2&&flag HTTP/1.1\nContent-Type: application/x-www-form-urlencoded; q\n\nx=aaa%&y='"
    rows = spark.createDataFrame([(1, request), (2, "")], "id long, r string")
    got = {r["id"]: r for r in text.request_features(rows, F.col("r"), ["id"]).collect()}
    f = got[1].asDict()
    assert len(f) == 35
    assert (f["method"], f["path_length"], f["query_length"], f["body_length"]) == ("POST", 8, 13, 10)
    assert (f["query_param_count"], f["body_param_count"], f["total_param_count"], f["repeated_param_name_count"]) == (3, 2, 5, 1)
    assert (f["percent_encoded_count"], f["longest_char_run"], f["path_depth"], f["body_format"]) == (1, 3, 2, "form")
    assert (f["content_type"], f["single_quote_count"], f["ampersand_count"]) == ("application/x-www-form-urlencoded", 1, 4)
    surface = "/a/b%20c" + "x=1&x=2&&flag" + "x=aaa%&y='"
    want = -sum(surface.count(c) / len(surface) * math.log2(surface.count(c) / len(surface)) for c in set(surface))
    assert abs(f["entropy_bits_per_char"] - want) < 1e-9
    empty = got[2].asDict()
    assert (empty["method"], empty["alnum_ratio"], empty["entropy_bits_per_char"], empty["body_format"]) == ("", 0.0, 0.0, "none")


def test_longest_run(spark, sf_dir):
    import itertools

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", text.longest_run(F.col("text")).alias("n")).collect()
    assert all(r["n"] == max((len(list(g)) for _, g in itertools.groupby(r["text"])), default=0) for r in rows)
    assert one(spark, text.longest_run, "") == 0


def test_intervals(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", stats.wilson(F.lit(0), F.lit(0)))]).first()
    assert tuple(row) == (0.0, 1.0)
    d = spark.createDataFrame([(3, 20), (0, 10), (10, 10)], "k long, n long").select(evaluate.clopper_pearson("k", "n").alias("c")).select("c.*").collect()
    want = [(0.0320709, 0.3789268), (0.0, 0.3084971), (0.6915029, 1.0)]
    assert all(abs(a - b) < 1e-6 for g, w in zip(d, want) for a, b in zip(g, w))
