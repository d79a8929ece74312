"""Request and text features, flags and ordered reasons. Column -> Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import bind

PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
#: Names of the symbol counts and their characters.
SYMBOLS = {
    "single_quote": "'", "double_quote": '"', "parenthesis": "()", "semicolon": ";", "slash": "/", "backslash": "\\",
    "angle_bracket": "<>", "pipe": "|", "ampersand": "&", "equals": "=", "percent": "%", "brace": "{}",
}


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def share(n: Column, of: Column) -> Column:
    """n / of, 0.0 of nothing."""
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0.0 for the empty text."""

    def bits(t):
        n = F.length(t).cast("double")
        chars = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        counts = F.transform(chars, lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double") / n)
        return F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))

    return F.when(F.length(text) > 0, bind(text, bits)).otherwise(0.0)


def longest_run(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), 1), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0)).cast("long")


@F.pandas_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("members", T.LongType()), T.StructField("depth", T.LongType())]))
def json_shape(bodies: pd.Series) -> pd.DataFrame:
    """Validity, members (repeated keys counted) and nesting of JSON texts; over 1,000 levels is invalid."""
    import json

    def shape(text):
        members = 0

        def pairs(items):
            nonlocal members
            members += len(items)
            return [v for _, v in items]

        try:
            value = json.loads(text, object_pairs_hook=pairs)
        except (ValueError, RecursionError):
            return False, 0, 0
        depth, layer = 0, [value] if isinstance(value, list) else []
        while layer:
            depth += 1
            layer = [v for node in layer for v in node if isinstance(v, list)]
        return (True, members, depth) if depth <= 1000 else (False, 0, 0)

    rows = [(None,) * 3 if t is None else shape(t) for t in bodies]
    return pd.DataFrame(rows, columns=["valid", "members", "depth"])


def request_parts(text: Column) -> dict[str, Column]:
    """method, target, path, query, headers, body of 'METHOD target VERSION\\nName: value\\n\\nbody'."""
    at = F.instr(text, "\n\n")
    head = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    body = F.when(at > 0, F.substr(text, at + 2)).otherwise(F.lit(""))
    lines = F.split(head, "\n")
    first = F.element_at(lines, 1)
    rest = F.when(F.instr(first, " ") > 0, F.substr(first, F.instr(first, " ") + 1)).otherwise(F.lit(""))
    target = F.when(F.instr(rest, " ") > 0, F.regexp_replace(rest, r" [^ ]*$", "")).otherwise(rest)
    mark = F.instr(target, "?")
    return {
        "method": F.substring_index(first, " ", 1),
        "target": target,
        "path": F.when(mark > 0, F.substr(target, F.lit(1), mark - 1)).otherwise(target),
        "query": F.when(mark > 0, F.substr(target, mark + 1)).otherwise(F.lit("")),
        "headers": F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        "body": body,
    }


def media_type(headers: Column) -> Column:
    """Of the first content-type header, before ';', trimmed and lower-cased; '' without one."""
    found = F.filter(headers, lambda h: F.lower(F.trim(F.substring_index(h, ":", 1))) == "content-type")
    value = F.substring_index(F.regexp_replace(F.get(found, F.lit(0)), r"^[^:]*:", ""), ";", 1)
    return F.coalesce(F.lower(F.trim(value)), F.lit(""))


def param_names(query: Column) -> Column:
    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))


def request_features(rows: DataFrame, request: Column, keep: list[str]) -> DataFrame:
    """keep, and the 34 features of a request. Parts are computed once, in a projection of their own; patterns are counted part by part; an
    empty text has empty parts."""
    p = request_parts(request)
    staged = rows.select(*keep, *[p[k].alias(f"_{k}") for k in ("method", "path", "query", "headers", "body")])
    staged = staged.select("*", media_type(F.col("_headers")).alias("_kind"), F.concat("_path", "_query", "_body").alias("_surface"))
    path, query, body, kind, surface = (F.col(f"_{k}") for k in ("path", "query", "body", "kind", "surface"))
    form = kind == "application/x-www-form-urlencoded"
    is_json = (kind == "application/json") | kind.endswith("+json")
    form_names = F.when(form & (body != ""), param_names(body)).otherwise(F.array().cast("array<string>"))
    staged = staged.select("*", json_shape(F.when(is_json & (body != ""), body)).alias("_shape"), param_names(query).alias("_names"), form_names.alias("_form"))
    shape, names = F.col("_shape"), F.col("_names")
    n = F.length(surface)
    in_body = F.when(form, F.size("_form")).when(is_json, F.coalesce(shape["members"], F.lit(0))).otherwise(0).cast("long")
    repeated = bind(F.concat("_names", "_form"), lambda every: F.size(F.filter(F.array_distinct(every), lambda x: F.size(F.filter(every, lambda y: y == x)) > 1)))
    encoded = sum((F.regexp_count(part, F.lit("%[0-9A-Fa-f]{2}")) for part in (path, query, body)), F.lit(0)).cast("long")
    symbols = F.regexp_count(surface, F.lit(PUNCTUATION)).cast("long")
    format_ = (
        F.when(body == "", "none").when(form, "form").when(is_json & shape["valid"], "json").when(is_json, "json_invalid").otherwise("other")
    )
    out = {
        "method": F.col("_method"),
        "path_length": F.length(path).cast("long"),
        "query_length": F.length(query).cast("long"),
        "body_length": F.length(body).cast("long"),
        "has_body": body != "",
        "content_type": kind,
        "body_format": format_,
        "query_param_count": F.size(names).cast("long"),
        "body_param_count": in_body,
        "total_param_count": F.size(names) + in_body,
        "repeated_param_name_count": repeated.cast("long"),
        "alnum_ratio": share(F.regexp_count(surface, F.lit("[A-Za-z0-9]")), n),
        "symbol_count": symbols,
        "symbol_ratio": share(symbols, n),
        "non_ascii_count": F.regexp_count(surface, F.lit(r"[^\x00-\x7F]")).cast("long"),
        "percent_encoded_count": encoded,
        "percent_encoded_ratio": share(3 * encoded, n),
        "has_percent_encoding": encoded > 0,
        "longest_char_run": F.greatest(longest_run(path), longest_run(query), longest_run(body)),
        "entropy_bits_per_char": entropy(surface),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("long"),
        "json_depth": F.when(is_json, F.coalesce(shape["depth"], F.lit(0))).otherwise(0).cast("long"),
    }
    out |= {f"{name}_count": count_of(surface, characters) for name, characters in SYMBOLS.items()}
    return staged.select(*keep, *[c.alias(k) for k, c in out.items()])


def first_reason(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The first rule that holds; the order is part of the meaning."""
    out = F.lit(otherwise).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def all_flags(rules: list[tuple[str, Column]]) -> Column:
    """Every rule that holds, in order."""
    return F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]), lambda x: x.isNotNull())


#: Patterns of the prose ladder. Java and RE2 agree on them.
PROSE = [
    ("control_char", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"),
    ("email_like", r"[^\s@]+@[^\s@]+\.[^\s@]+"),
    ("at_sign", r"@"),
    ("url_like", r"(?i)[a-z][a-z0-9+.-]*://|\bwww\."),
    ("digit_run_ge6", r"[0-9]{6,}"),
    ("phone_like", r"\+?[0-9]([ ().-]?[0-9]){7,}"),
    ("dated_event", r"(?i)\b(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)\b\.?,?\s+([0-9]{1,2}(st|nd|rd|th)?,?\s+)?(1[0-9]{3}|20[0-9]{2})\b"),
    ("possible_full_name", r"\b[A-Z][a-z]+(['’]s)?\s+[A-Z][a-z]+"),
]


def prose_reason(text: Column, least: int = 3, most: int = 200) -> Column:
    """First reason to leave a text out of a prose pool; 'accepted' if none holds."""
    at = text.contains("@")
    low = F.lower(text)
    #: what a text must hold for a pattern to match: cheap tests before dear ones
    needs = {"email_like": at, "at_sign": at, "url_like": text.contains("://") | low.contains("www."), "digit_run_ge6": text.rlike("[0-9]{3}"), "phone_like": text.rlike("[0-9]"), "dated_event": text.rlike("[0-9]{4}")}
    rules = [("empty", F.coalesce(text, F.lit("")) == ""), PROSE[0], ("too_short", F.length(text) < least), ("too_long", F.length(text) > most), *PROSE[1:]]
    return first_reason([(n, (needs[n] & text.rlike(r) if n in needs else text.rlike(r)) if isinstance(r, str) else r) for n, r in rules], "accepted")


def name_reason(value: Column, given: bool = True) -> Column:
    """First reason to leave a value out of a name pool; 'accepted' if none holds."""
    rules = [
        ("empty", F.coalesce(value, F.lit("")) == ""),
        ("control_char", value.rlike(r"[\x00-\x1F\x7F]")),
        ("contains_digit", value.rlike(r"\d")),
        ("parenthesis_or_disambiguation", value.rlike(r"[()\[\]{}]")),
        ("at_or_url", value.rlike(r"(?i)@|://|\bwww\.")),
        ("contains_colon", value.contains(":")),
        ("non_name_char", value.rlike(r"[^\p{L}\p{M}'’ʼ\-‐‑. ]")),
        ("too_long", F.length(value) > 40),
        ("descriptive_label", value.rlike(r"(?i)\bnames?\b")),
    ]
    words = F.split(F.trim(value), " +")
    if given:
        capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        rules += [("not_capitalised", ~value.rlike(r"^\p{Lu}")), ("looks_like_full_name", (F.size(words) >= 2) & (capital >= 2))]
    else:
        rules += [("too_many_tokens", F.size(words) > 4)]
    return first_reason(rules, "accepted")


#: Kinds of values, in the order in which they are tried.
VALUE_KINDS = [
    ("empty", r"^$"),
    ("null", r"^(?i:null|none)$"),
    ("bool", r"^(?i:true|false)$"),
    ("int", r"^[+-]?[0-9]+$"),
    ("decimal", r"^[+-]?[0-9]+\.[0-9]+$"),
    ("scientific", r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"),
    ("url", r"^[A-Za-z][A-Za-z0-9+.-]*://"),
]


def value_kind(value: Column) -> Column:
    return first_reason([(n, value.rlike(p)) for n, p in VALUE_KINDS], "text")


@F.pandas_udf(T.StructType([T.StructField("address", T.LongType()), T.StructField("canonical", T.BooleanType())]))
def numeric_ipv4(hosts: pd.Series) -> pd.DataFrame:
    """IPv4 hosts of one to four decimal, octal or hexadecimal parts, as URL parsers read them; null if it is none."""
    import re

    def part(p):
        if re.fullmatch(r"0[xX][0-9a-fA-F]*", p):
            return int(p[2:] or "0", 16)
        if re.fullmatch(r"0[0-7]+", p):
            return int(p, 8)
        return int(p) if re.fullmatch(r"[0-9]+", p) and (p == "0" or p[0] != "0") else None

    def parse(host):
        pieces = (host or "").rstrip(".").split(".")
        numbers = [part(p) for p in pieces]
        if not 1 <= len(pieces) <= 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(pieces)):
            return None, None
        value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
        return value, ".".join(str(value >> s & 255) for s in (24, 16, 8, 0)) == host

    return pd.DataFrame([parse(h) for h in hosts], columns=["address", "canonical"])


def in_network(address: Column, cidrs: list[str]) -> Column:
    """Numeric IPv4 address in any of the networks."""
    import ipaddress

    out = F.lit(False)
    for net in map(ipaddress.ip_network, cidrs):
        out = out | address.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(out, F.lit(False))


#: Networks and hosts of the url classes.
LOOPBACK, PRIVATE, METADATA = ["127.0.0.0/8"], ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16"], ["169.254.169.254/32"]


def url_class(value: Column, navigation: bool = True) -> Column:
    """META, SCHEME, OBFUSCATED, DIFF, RELATIVE, LOOPBACK, PRIVATE, OPEN_REDIRECT or PUBLIC: the first that holds."""
    v = F.trim(value)
    scheme = F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(v, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"([^@]*)$", 1), r":[0-9]*$", ""))
    ip = numeric_ipv4(host)
    relative = (scheme == "") & ~v.rlike(r"^[/\\]{2}")
    return first_reason(
        [
            ("META", in_network(ip["address"], METADATA) | (host == "metadata.internal")),
            ("SCHEME", (scheme != "") & ~scheme.isin("http", "https")),
            ("OBFUSCATED", authority.contains("@") | (ip["address"].isNotNull() & ~ip["canonical"])),
            ("DIFF", value.rlike(r"[\r\n\t]") | v.rlike(r"^[/\\]{2}") | ((scheme != "") & ~v.rlike(r"^[A-Za-z0-9+.-]+://"))),
            ("RELATIVE", relative),
            ("LOOPBACK", in_network(ip["address"], LOOPBACK) | host.rlike(r"(^|\.)localhost\.?$")),
            ("PRIVATE", in_network(ip["address"], PRIVATE) | (ip["address"].isNull() & ~host.contains("."))),
            ("OPEN_REDIRECT", F.lit(navigation)),
        ],
        "PUBLIC",
    )


#: Html features of pages.
MARKERS = [("has_script", r"(?i)<script\b"), ("has_form", r"(?i)<form\b"), ("has_link", r"(?i)<a\s"), ("has_table", r"(?i)<table\b"), ("has_comment", r"<!--")]


def markers(text: Column) -> Column:
    return all_flags([(n, text.rlike(p)) for n, p in MARKERS])
