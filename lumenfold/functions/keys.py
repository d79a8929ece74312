"""Identity keys: hashes, buckets, canonical and family keys, shingles. Column -> Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = "\u0001absent"


def nul_sha256(*parts: Column) -> Column:
    """sha256 of the parts joined by NUL. A null part counts as ABSENT, so that it can't shift the others."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit(ABSENT)) for p in parts]), 256)


def hash60(text: Column) -> Column:
    """First 60 bits of sha256, as a long: an order that no engine, partitioning or seed changes."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def bucket(text: Column, buckets: int = 10_000) -> Column:
    """First 8 bytes of sha256 as an unsigned number, modulo buckets."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("long")


def split_of(key: Column, salt: str, test: int = 1000, val: int = 1000) -> Column:
    """test, val or train by the salted key's bucket of 10,000."""
    b = bucket(F.concat(F.lit(salt + "|"), key))
    return F.when(b < test, "test").when(b < test + val, "val").otherwise("train")


def plain_key(text: Column) -> Column:
    """Lower case, ASCII white space collapsed and trimmed: the SQL-expressible canonical key."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x0B]+", " "))


def masked_key(text: Column) -> Column:
    """plain_key with digit runs as one 0, runs of over three of a letter as three, and no white space."""
    digits = F.regexp_replace(plain_key(text), r"[0-9]+", "0")
    return F.regexp_replace(F.regexp_replace(digits, r"([a-z])\1{3,}", "$1$1$1"), r" ", "")


def bind(value: Column, f) -> Column:
    """f(value) with value computed once a row: an expression used inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct n-grams of code points; null if the text is shorter: it can't be compared."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    gram = lambda cs: lambda i: F.concat(*[F.element_at(cs, i + k) for k in range(n)])
    grams = lambda cs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(cs) - (n - 1), F.lit(1))), gram(cs))
    return F.when(F.length(text) >= n, F.array_distinct(bind(chars, grams)))


@F.pandas_udf(T.StringType())
def canonical_key(texts: pd.Series) -> pd.Series:
    """The exact canonical key: up to three rounds of percent-decoding with '+' as space, escapes, comments, white space, case."""
    import re
    from urllib.parse import unquote_plus

    #: Escapes and entities that are read as their characters.
    escapes = {"\\u003c": "<", "\\u003e": ">", "\\u0027": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"'}
    comment, space = re.compile(r"/\*.*?\*/"), re.compile(r"\s+")

    def key(text):
        if text is None:
            return None
        for _ in range(3):
            decoded = unquote_plus(text)
            if decoded == text:
                break
            text = decoded
        for escape, plain in escapes.items():
            text = re.sub(re.escape(escape), plain, text, flags=re.I)
        return space.sub(" ", comment.sub("", text).replace("${IFS}", " ")).strip().lower()

    return texts.map(key)


@F.pandas_udf(T.StringType())
def family_key(texts: pd.Series) -> pd.Series:
    """Of canonical keys: digit runs 0, e-mail, address and host H, runs over three cut to three, no white space."""
    import re

    steps = [
        (re.compile(r"[^\s@/]+@[^\s@/]+\.[^\s@/]+"), "H"),
        (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "H"),
        (re.compile(r"(?<=://)[^/?#\s]+"), "H"),
        (re.compile(r"\d+"), "0"),
        (re.compile(r"(.)\1{3,}"), r"\1\1\1"),
        (re.compile(r"\s+"), ""),
    ]

    def key(text):
        for pattern, by in steps:
            text = pattern.sub(by, text)
        return text

    return texts.map(key, na_action="ignore")


@F.pandas_udf(T.StringType())
def equivalence_key(values: pd.Series) -> pd.Series:
    """NFC, then full case folding."""
    import unicodedata

    return values.map(lambda v: unicodedata.normalize("NFC", v).casefold(), na_action="ignore")


def shape_key(query: Column) -> Column:
    """Sorted parameters, decoded where they decode, digits as #, values cut at 120."""
    pair = lambda p: F.substring(F.regexp_replace(F.coalesce(F.try_url_decode(p), p), r"[0-9]", "#"), 1, 120)
    return F.array_join(F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)), "&")
