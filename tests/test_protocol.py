import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import protocol


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "wire, reject",
    [
        (b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", None), (b"GET / HTTP/1.0\r\n\r\n", None), (b"GET  / HTTP/1.1\r\n\r\n", "request_line"), (b"GET / HTTP/1.1\r\nHost: a", "head_incomplete"),
        (b"GET / HTTP/1.1\r\nHost: a\r\n folded\r\n\r\n", "obs_fold"), (b"GET / HTTP/1.1\r\nHo st: a\r\n\r\n", "header_name"), (b"GET / HTTP/1.1\r\n\r\n", "host"),
        (b"POST / HTTP/1.1\r\nHost: a\r\nContent-Length: 2\r\n\r\nab", None), (b"POST / HTTP/1.1\r\nHost: a\r\nContent-Length: 3\r\n\r\nab", "body_incomplete"),
        (b"POST / HTTP/1.1\r\nHost: a\r\nContent-Length: 1\r\n\r\nab", "excess_bytes"), (b"POST / HTTP/1.1\r\nHost: a\r\nContent-Length: +1\r\n\r\na", "content_length"),
        (b"POST / HTTP/1.1\r\nHost: a\r\nContent-Length: 1\r\nTransfer-Encoding: chunked\r\n\r\n0\r\n\r\n", "length_and_coding"),
        (b"POST / HTTP/1.1\r\nHost: a\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\n0\r\n\r\n", None), (b"POST / HTTP/1.1\r\nHost: a\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", "chunk_size"),
        (b"POST / HTTP/1.1\r\nHost: a\r\nTransfer-Encoding: gzip\r\n\r\n", "coding"), (None, None),
    ],
)
def test_wire_grammar(spark, wire, reject):
    got = one(spark, protocol.http1_request, wire, "binary")
    assert got["reject"] == reject
    if wire and b"\r\n2\r\nab" in wire:
        assert got["body_bytes"] == 2


def test_bodies(spark):
    raw = b"hello " * 20
    rows = [("gzip", gzip.compress(raw)), ("deflate", zlib.compress(raw)), ("deflate", zlib.compress(raw)[2:-4]), (None, raw), ("br", raw), ("gzip", b"junk"), ("gzip", gzip.compress(b"0" * (2 << 20)))]
    got = spark.createDataFrame(rows, "c string, b binary").select(protocol.decoded_body("c", "b").alias("x")).select("x.*").collect()
    assert [None if r["body"] is None else bytes(r["body"]) == raw for r in got] == [True, True, True, True, None, None, None]
    assert [r["reject"] for r in got] == [None, None, None, None, "unsupported", "corrupt", "too_large"]


def test_layers_and_signals(spark):
    assert tuple(one(spark, protocol.decode_layers, "a%2527b")) == ("a'b", 2)
    assert tuple(one(spark, protocol.decode_layers, "plain")) == ("plain", 0)
    assert one(spark, protocol.encoding_signals, "x%2527") == ["multi_encoding"]
    assert one(spark, protocol.encoding_signals, "%00%u0041") == ["null_byte", "percent_u"]
    assert one(spark, protocol.encoding_signals, "%c0%af") == ["overlong_utf8"]
    assert one(spark, protocol.backslash_rendered, b"a\xff", "binary") == "a\\xff"


def test_spans(spark):
    rows = [("abcdef", [(1, 2), (3, 5)]), ("abc", [(0, 2), (1, 3)]), ("abc", [(2, 9)]), (None, [])]
    d = spark.createDataFrame(rows, "t string, s array<struct<a: long, b: long>>")
    assert [r[0] for r in d.select(protocol.masked_spans("t", "s")).collect()] == ["a VALUE c VALUE f", None, None, None]


def test_outputs(spark):
    d = spark.createDataFrame([("block | Too Fast.",), ("ALLOW",), ("maybe | x",), ("BLOCK|",)], "o string")
    assert [tuple(r) for r in d.select(*protocol.output_decision(F.col("o"))).collect()] == [("BLOCK", "too fast"), ("ALLOW", None), (None, "x"), ("BLOCK", None)]


def test_small_parsers(spark):
    assert one(spark, protocol.neutral_path, "GET /a/b?x=1 HTTP/1.1") == "GET /?x=1 HTTP/1.1"
    assert one(spark, lambda c: F.struct(*[x.alias(n) for n, x in zip("ab", protocol.media_parts(c))]), "Text/HTML; charset=x") == ("text/html", "charset=x")
    assert one(spark, protocol.sanitised, "Bad Label") == "other"
    assert one(spark, protocol.http_date, "Sun, 06 Nov 1994 08:49:37 GMT") is not None
    assert one(spark, protocol.http_date, "Mon, 06 Nov 1994 08:49:37 GMT") is None
    assert one(spark, lambda c: protocol.size_class(F.length(c), 5, 4), "x" * 6) == "NEEDS_EXACT_COUNT"
    headers = spark.createDataFrame([("post", [("a", "x-evil")])], "m string, h array<struct<name: string, value: string>>")
    assert headers.select(protocol.header_guard(F.col("m"), F.col("h"), "evil")).first()[0]
    assert one(spark, lambda c: protocol.reject_ladder(F.length(c), c.contains("\x01"), F.lit("GET"), c, F.lit(True), F.lit(True)), "/ok") is None
    assert one(spark, lambda c: protocol.reject_ladder(F.length(c), c.contains("\x01"), F.lit("CONNECT"), c, F.lit(True), F.lit(True)), "h:1") == "CONNECT"
