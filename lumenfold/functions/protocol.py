"""Request grammar, bodies, outputs of models: what is parsed from wires and replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import first_reason

#: Reasons of the wire grammar, in no order; the parser gives the first that it meets.
WIRE = T.StructType([T.StructField(n, T.StringType()) for n in ("method", "target", "version", "reject")] + [T.StructField("body_bytes", T.LongType())])


@F.pandas_udf(WIRE)
def http1_request(wires: pd.Series) -> pd.DataFrame:
    """One HTTP/1 request from bytes: its line, the length of its body and, if it is not well formed, why."""
    import re

    token, line = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+"), re.compile(rb"([^ ]+) ([^ ]+) (HTTP/1\.[01])")

    def chunks(body: bytes) -> tuple[int, str | None]:
        total, at = 0, 0
        while True:
            end = body.find(b"\r\n", at)
            if end < 0:
                return total, "chunk_incomplete"
            size = body[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
                return total, "chunk_size"
            n, at = int(size, 16), end + 2
            if n == 0:
                return total, None if body[at : at + 2] == b"\r\n" else "chunk_trailer"
            if body[at + n : at + n + 2] != b"\r\n":
                return total, "chunk_incomplete"
            total, at = total + n, at + n + 2

    def parse(wire):
        if wire is None:
            return (None,) * 4 + (0,)
        head, sep, body = bytes(wire).partition(b"\r\n\r\n")
        rows = head.split(b"\r\n")
        m = line.fullmatch(rows[0])
        names = tuple(x.decode("latin-1") for x in m.groups()) if m else (None,) * 3
        fail = lambda why, n=0: (*names, why, n)
        if not m:
            return fail("request_line")
        if not sep:
            return fail("head_incomplete")
        if not token.fullmatch(m.group(1)):
            return fail("method")
        headers: dict[bytes, list[bytes]] = {}
        for row in rows[1:]:
            name, colon, value = row.partition(b":")
            if row[:1] in (b" ", b"\t"):
                return fail("obs_fold")
            if not colon or not token.fullmatch(name):
                return fail("header_name")
            if re.search(rb"[\x00\r\n]", value):
                return fail("header_value")
            headers.setdefault(name.lower(), []).append(value.strip())
        if m.group(3) == b"HTTP/1.1" and len(headers.get(b"host", [])) != 1:
            return fail("host")
        lengths, codings = headers.get(b"content-length", []), headers.get(b"transfer-encoding", [])
        if lengths and codings:
            return fail("length_and_coding")
        if codings:
            if [c.lower() for c in codings] != [b"chunked"]:
                return fail("coding")
            n, why = chunks(body)
            return fail(why, n)
        if len(set(lengths)) > 1 or any(not re.fullmatch(rb"[0-9]{1,18}", x) for x in lengths):
            return fail("content_length")
        want = int(lengths[0]) if lengths else 0
        return fail(None if len(body) == want else "body_incomplete" if len(body) < want else "excess_bytes", len(body))

    return pd.DataFrame([parse(w) for w in wires], columns=WIRE.names).astype({"body_bytes": "int64"})


@F.pandas_udf(T.StructType([T.StructField("body", T.BinaryType()), T.StructField("reject", T.StringType())]))
def decoded_body(coding: pd.Series, body: pd.Series) -> pd.DataFrame:
    """A gzip, deflate or (where its package is installed) zstd body, at most 1 MiB decoded; identity passes; else unsupported, corrupt or too_large."""
    import zlib

    try:
        import zstandard
    except ImportError:
        zstandard = None
    most = 1 << 20

    def frame(data):
        try:
            out = zstandard.ZstdDecompressor().stream_reader(data).read(most + 1)
        except zstandard.ZstdError:
            return None, "corrupt"
        return (None, "too_large") if len(out) > most else (out, None)

    def decode(kind, data):
        if kind in (None, "", "identity"):
            return data, None
        if kind == "zstd" and zstandard:
            return frame(bytes(data))
        if kind not in ("gzip", "x-gzip", "deflate"):
            return None, "unsupported"
        for wbits in (31,) if kind != "deflate" else (15, -15):
            d = zlib.decompressobj(wbits)
            try:
                out = d.decompress(bytes(data), most + 1)
            except zlib.error:
                continue
            if len(out) > most:
                return None, "too_large"
            return (out, None) if d.eof and not d.unused_data else (None, "corrupt")
        return None, "corrupt"

    return pd.DataFrame([decode(k, b) for k, b in zip(coding, body)], columns=["body", "reject"])


LAYERS = T.StructType([T.StructField("text", T.StringType()), T.StructField("layers", T.IntegerType())])


def _layers(texts: pd.Series, form: bool) -> pd.DataFrame:
    import re
    from urllib.parse import unquote

    triplet = re.compile(r"%[0-9A-Fa-f]{2}")

    def decode(t):
        n = 0
        while t is not None and n < 3:
            encoded = triplet.search(t) is not None
            plain = unquote(t.replace("+", " ") if form and not n else t, errors="replace")
            if not encoded or plain == t:
                return plain, n + encoded
            t, n = plain, n + 1
        return t, n

    return pd.DataFrame([decode(t) for t in texts], columns=["text", "layers"]).astype({"layers": "int32"})


@F.pandas_udf(LAYERS)
def decode_layers(texts: pd.Series) -> pd.DataFrame:
    """Percent-decodes up to three times, while there is a triplet to decode: the text and how many rounds decoded one."""
    return _layers(texts, False)


@F.pandas_udf(LAYERS)
def decode_form_layers(texts: pd.Series) -> pd.DataFrame:
    """The same for a form's field: in the first round '+' is a space."""
    return _layers(texts, True)


@F.pandas_udf(T.StringType())
def backslash_rendered(wires: pd.Series) -> pd.Series:
    """Bytes as text; what is not UTF-8 as \\xNN."""
    return wires.map(lambda b: bytes(b).decode("utf-8", "backslashreplace"), na_action="ignore")


@F.pandas_udf(T.StringType())
def masked_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each [a, b) of spans replaced by ' VALUE '; null where spans overlap or leave the text."""

    def mask(text, cuts):
        cuts = sorted((int(c["a"]), int(c["b"])) for c in (cuts if cuts is not None else []))
        if text is None or any(a < 0 or b < a or b > len(text) for a, b in cuts) or any(x[1] > y[0] for x, y in zip(cuts, cuts[1:])):
            return None
        for a, b in reversed(cuts):
            text = f"{text[:a]} VALUE {text[b:]}"
        return text

    return pd.Series([mask(t, s) for t, s in zip(texts, spans)])


def encoding_signals(text: Column) -> Column:
    """Codes of encodings that hide characters, sorted: %u escapes, %00, a triplet left after one decoding, overlong UTF-8."""
    again = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.lit(""))
    rules = [("multi_encoding", again.rlike("%[0-9A-Fa-f]{2}")), ("null_byte", text.contains("%00")), ("overlong_utf8", text.rlike("(?i)%c[01]%[89ab][0-9a-f]")), ("percent_u", text.rlike("(?i)%u[0-9a-f]{4}"))]
    return F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in rules]), lambda x: x.isNotNull())


def reject_ladder(size: Column, controls: Column, method: Column, target: Column, headers_ok: Column, body_ok: Column) -> Column:
    """First reason to reject a canonical request, or null."""
    return first_reason(
        [
            ("R6_TOO_LARGE", size > 65_536), ("R5_CONTROL", controls), ("R4_HEADERS", ~headers_ok), ("R7_BODY", ~body_ok), ("R1_METHOD", ~method.rlike("^[A-Z]+$")), ("R2_TARGET", target == ""),
            ("CONNECT", method == "CONNECT"), ("R3_FORM", ~target.rlike(r"^(/|\*$|[a-z]+://)")),
        ]
    )


def size_class(octets: Column, limit: int, margin: int) -> Column:
    """WITHIN, OVER or NEEDS_EXACT_COUNT: tokens never exceed bytes."""
    return F.when(octets <= limit, "WITHIN").when(octets > limit * margin, "OVER").otherwise("NEEDS_EXACT_COUNT")


def header_guard(method: Column, headers: Column, pattern: str) -> Column:
    """POST with any header value that matches."""
    return (F.upper(method) == "POST") & F.exists(headers, lambda h: h["value"].rlike(pattern))


def output_decision(output: Column) -> tuple[Column, Column]:
    """(decision, reason) of 'DECISION | reason'; strict: any other decision is null."""
    decision = F.upper(F.trim(F.element_at(F.split(output, r"\|", 2), 1)))
    reason = F.trim(F.get(F.split(output, r"\|", 2), F.lit(1)))
    return F.when(decision.isin("ALLOW", "BLOCK"), decision), F.nullif(F.rtrim(F.regexp_replace(F.lower(reason), r"\.+$", "")), F.lit(""))


def neutral_path(request: Column) -> Column:
    """The target's path as '/', its query kept."""
    return F.regexp_replace(request, r"^([A-Z]+) [^ ?]*", "$1 /")


def media_parts(value: Column) -> tuple[Column, Column]:
    """type/subtype in lower case, and its parameters or null."""
    return F.lower(F.trim(F.substring_index(value, ";", 1))), F.nullif(F.trim(F.regexp_replace(value, r"^[^;]*;?", "")), F.lit(""))


def sanitised(label: Column) -> Column:
    return F.when(label.rlike("^[a-z0-9_]{1,32}$"), label).otherwise("other")


def http_date(value: Column) -> Column:
    """A date of the fixed form, if writing it again gives the same text."""
    at = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.when(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") == value, at)




def augmented(text: Column, group: Column) -> Column:
    """One of four meaning-preserving variants, by the group's hash: percent-encoded spaces, case, comments for spaces, tabs."""
    from .keys import hash60

    kind = hash60(group) % 4
    return F.when(kind == 0, F.replace(text, F.lit(" "), F.lit("%20"))).when(kind == 1, F.upper(text)).when(kind == 2, F.replace(text, F.lit(" "), F.lit("/**/"))).otherwise(F.replace(text, F.lit(" "), F.lit("\t")))


def training_steps(rows: Column, batch: int, accumulate: int, epochs: int, warmup: float) -> tuple[Column, Column]:
    """(optimiser steps, warm-up steps) of a schedule: ceilings for what is left over, at least one step."""
    per_epoch = F.greatest(F.ceil(F.ceil(rows / batch) / accumulate), F.lit(1))
    steps = per_epoch * epochs
    return steps.cast("long"), F.floor(steps * warmup).cast("long")
