"""Forms of requests and of their parts: encodings, canonical requests, header profiles, field classes. Columns, but for the exact canonical key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import canonical_key
from .text import all_flags, first_reason

TRIPLET = "%[0-9A-Fa-f]{2}"


def _entity_names() -> list[str]:
    """The names of HTML's character references, from the standard library's table."""
    import html.entities

    return sorted(name[:-1] for name in html.entities.html5 if name.endswith(";"))


def hex_case_profile(wire: Column) -> Column:
    """How the hex letters of a text's percent triplets are written: none, digits_only, upper, lower, mixed_within_token or mixed_across_tokens."""
    upper, lower = wire.rlike("%([A-F][0-9A-F]|[0-9][A-F])"), wire.rlike("%([a-f][0-9a-f]|[0-9][a-f])")
    rules = [("mixed_within_token", wire.rlike("%([A-F][a-f]|[a-f][A-F])")), ("mixed_across_tokens", upper & lower), ("upper", upper), ("lower", lower), ("digits_only", wire.rlike(TRIPLET))]
    return first_reason(rules, "none")


def native_forms(wire: Column) -> Column:
    """The encoded forms in a text, in a fixed order: double_encoding, unicode_escape, html_entity, ifs, mixed_case_hex."""
    names = F.regexp_extract_all(wire, F.lit("&([A-Za-z][A-Za-z0-9]{1,31});"), F.lit(1))
    entity = wire.rlike("&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});") | F.arrays_overlap(names, F.array(*[F.lit(n) for n in _entity_names()]))
    return all_flags(
        [("double_encoding", wire.rlike("%25[0-9A-Fa-f]{2}")), ("unicode_escape", wire.rlike(r"\\u[0-9A-Fa-f]{4}")), ("html_entity", entity), ("ifs", wire.contains("${IFS}")), ("mixed_case_hex", hex_case_profile(wire) == "mixed_within_token")]
    )


def wire_form(wire: Column) -> Column:
    return F.when(wire.rlike(TRIPLET), "pre_encoded").otherwise("plain")


def logical_of(wire: Column) -> tuple[Column, Column]:
    """(text, how): a plain text as it is, a pre-encoded one decoded once by strict UTF-8 ('+' stays), or kept where that is no UTF-8."""
    # what is no triplet, and '+', must pass the decoder as they are
    closed = F.regexp_replace(F.regexp_replace(wire, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    decoded = F.try_url_decode(closed)
    strict = decoded.isNotNull() & (F.encode(decoded, "UTF-8") == _octets(closed))
    encoded = wire.rlike(TRIPLET)
    how = F.when(~encoded, "plain").when(strict, "decoded_once").otherwise("invalid_utf8_kept_verbatim")
    return F.when(encoded & strict, decoded).otherwise(wire), how


def _octets(closed: Column) -> Column:
    """The bytes that triplets stand for, and of the characters between them."""
    parts = F.regexp_extract_all(closed, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+"), F.lit(0))
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.when(p.startswith("%"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))), ""))


def request_text_parts(text: Column) -> dict[str, Column]:
    """method, path, query, content_type and body of a request text: head and body are parted by the first blank line."""
    at = F.instr(text, "\n\n")
    head = F.when(at > 0, F.substring_index(text, "\n\n", 1)).otherwise(text)
    body = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("")
    line = F.substring_index(head, "\n", 1)
    rest = F.when(F.instr(line, " ") > 0, F.regexp_replace(line, "^[^ ]* ", "")).otherwise("")
    target = F.when(F.instr(rest, " ") > 0, F.regexp_replace(rest, "(?s) [^ ]*$", "")).otherwise(rest)
    fields = F.filter(F.slice(F.split(head, "\n"), 2, 1 << 20), lambda h: F.lower(F.trim(F.substring_index(h, ":", 1))) == "content-type")
    value = F.regexp_replace(F.get(fields, F.lit(0)), r"^[^:]*:?", "")
    return {
        "method": F.substring_index(line, " ", 1), "path": F.substring_index(target, "?", 1), "query": F.when(F.instr(target, "?") > 0, F.regexp_replace(target, r"(?s)^[^?]*\?", "")).otherwise(""),
        "content_type": F.coalesce(F.lower(F.trim(F.substring_index(value, ";", 1))), F.lit("")), "body": body,
    }


def canonical_request(text: Column) -> Column:
    """The canonical key of a request without its headers but the content type."""
    p = request_text_parts(text)
    return canonical_key(F.concat(p["method"], F.lit(" "), p["path"], F.lit("?"), p["query"], F.lit("\n"), p["content_type"], F.lit("\n"), p["body"]))


def parse_canonical(text: Column) -> dict[str, Column]:
    """method, target, content_type (null if there is none), body and reject (null if well formed) of a text of the canonical grammar: a request line
    of HTTP/1.1, at most a Content-Type line, then nothing, or a blank line and a body that isn't empty. Only LF parts lines."""
    newline = F.instr(text, "\n")
    line, rest = F.substring_index(text, "\n", 1), F.substring(text, newline + 1, F.length(text))
    typed = rest.startswith("Content-Type: ")
    end = F.instr(rest, "\n")
    after = F.when(typed, F.substring(rest, end + 1, F.length(rest))).otherwise(rest)
    start = F.regexp_replace(line, r" HTTP/1\.1$", "")
    target = F.regexp_replace(start, "^[^ ]* ", "")
    reject = first_reason(
        [
            ("no_request_line", newline == 0), ("malformed_request_line", ~line.endswith(" HTTP/1.1") | (F.instr(start, " ") == 0)), ("space_in_target", F.instr(target, " ") > 0),
            ("unterminated_content_type", typed & (end == 0)), ("body_without_blank_line", (after != "") & (~after.startswith("\n") | (F.length(after) == 1))),
        ]
    )
    good = text.isNotNull() & reject.isNull()
    return {
        "method": F.when(good, F.substring_index(start, " ", 1)), "target": F.when(good, target), "content_type": F.when(good & typed, F.substring(rest, 15, F.greatest(end - 15, F.lit(0)))),
        "body": F.when(good, F.substring(after, 2, F.length(after))), "reject": reject,
    }


def kept_headers(text: Column, keep: tuple[str, ...] = ("content-type",)) -> Column:
    """The approximate canonical request: the first line, the kept headers' lines as written and in their order, a blank line and the body if there is one."""
    at = F.instr(text, "\n\n")
    lines = F.split(F.when(at > 0, F.substring_index(text, "\n\n", 1)).otherwise(text), "\n")
    named = F.filter(F.slice(lines, 2, 1 << 20), lambda h: F.lower(F.trim(F.substring_index(h, ":", 1))).isin(*keep))
    body = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("")
    return F.concat(F.array_join(F.concat(F.slice(lines, 1, 1), named), "\n"), F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(""))


def vector_hash(fields: list[Column]) -> Column:
    """sha256 of a vector's JSON list: numbers as Spark writes them, null as null. A stable encoding of this engine's own."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in fields]), F.lit("]")), 256)


#: The languages that a language preference may name.
LANGUAGES = ("es-CR", "es", "es-419", "es-ES", "es-MX", "en-US", "en", "en-GB", "pt-BR", "fr", "de")
#: The grammars of bounded headers.
CLIENT_HINTS = r'^"[A-Za-z0-9 .;:()?_=/-]{1,32}";v="[0-9]{1,3}"(, "[A-Za-z0-9 .;:()?_=/-]{1,32}";v="[0-9]{1,3}"){2}$'
ENTITY_TAG = r'^((W/)?"[A-Za-z0-9._-]{1,128}"|\*)$'


def header_profiles(value: Column, origins: tuple[str, ...] = (), paths: tuple[str, ...] = (), relative_root: bool = False) -> Column:
    """The profiles that a header's value fits, in a fixed order; printable ASCII of 1 to 512 characters only.

    language_preferences: up to four known languages, each once, with one-digit weights. client_hints: three brands with versions. question_cookie: one
    client-side value. http_date: a date of the fixed form that is written the same again, 1970 to 2100. entity_tag. public_referer: an allowed
    origin and path without query or fragment, or '/' where that is allowed.
    """
    parts = F.transform(F.split(value, ","), lambda p: F.trim(p))
    tags = F.transform(parts, lambda p: F.substring_index(p, ";q=", 1))
    weights = F.forall(parts, lambda p: p.rlike(r"^[A-Za-z0-9-]+(;q=0\.[1-9])?$"))
    preferred = (F.size(parts) <= 4) & weights & F.forall(tags, lambda x: x.isin(*LANGUAGES)) & (F.size(F.array_distinct(tags)) == F.size(tags))
    cookie = value.startswith("question=") & (F.length(value) <= 256) & ~F.substring(value, 10, 512).rlike(r'[;{}\\"]')
    at = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    dated = (F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") == value) & F.year(at).between(1970, 2100)
    allowed = reduce(lambda a, b: a | b, [value == o + p for o in origins for p in paths], F.lit(False))
    referer = F.when(value == "/", F.lit(relative_root)).otherwise(allowed & ~value.rlike(r"[\s%#\\]"))
    bounded = F.coalesce(value.rlike(r"^[\x20-\x7E]{1,512}$"), F.lit(False))
    rules = [("language_preferences", preferred), ("client_hints", (F.length(value) <= 160) & value.rlike(CLIENT_HINTS)), ("question_cookie", cookie), ("http_date", dated), ("entity_tag", value.rlike(ENTITY_TAG)), ("public_referer", referer)]
    return F.when(bounded, all_flags([(n, F.coalesce(r, F.lit(False))) for n, r in rules])).otherwise(F.array().cast("array<string>"))


#: Classes of field names, by what a lower-case name contains.
FIELD_CLASSES = {
    "username": ("user", "login", "uname", "nick", "account"), "password": ("pass", "pwd", "contrase", "clave"), "email": ("mail",),
    "address": ("addr", "direcc", "street", "calle", "city", "ciudad", "zip", "postal", "provinc", "country", "pais"),
    "free_text_name": ("comment", "message", "msg", "note", "body", "text", "title", "subject", "descr", "content", "feedback", "review", "bio"),
    "payment": ("card", "tarjeta", "ntc", "cvv", "iban"),
    "security_sensitive_name": ("cmd", "exec", "file", "path", "url", "uri", "redirect", "callback", "return", "next", "dest", "target", "template", "tpl", "include", "host", "domain", "src"),
}


def field_classes(name: Column) -> Column:
    """The classes that a field's name suggests, sorted."""
    low = F.lower(name)
    return all_flags([(c, reduce(lambda a, b: a | b, [low.contains(k) for k in FIELD_CLASSES[c]])) for c in sorted(FIELD_CLASSES)])


#: Families of user agents, first match.
AGENTS = [("curl", ("curl/",)), ("wget", ("wget",)), ("python", ("python", "httpx", "aiohttp", "urllib")), ("mobile_app", ("mobileapp",)), ("browser", ("mozilla",))]


def agent_family(agent: Column) -> Column:
    low = F.lower(agent)
    return F.when(agent.isNull(), "absent").otherwise(first_reason([(n, reduce(lambda a, b: a | b, [low.contains(k) for k in ks])) for n, ks in AGENTS], "other"))


def host_parts(host: Column) -> tuple[Column, Column]:
    """(name, port): '[v6]:port', 'name:port', or a name with no or many colons and no port."""
    colons = F.length(host) - F.length(F.replace(host, F.lit(":"), F.lit("")))
    split = (colons == 1) & ~host.startswith(":")
    after = F.regexp_extract(host, r"^\[[^\]]*\]:(.*)$", 1)
    name = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).when(split, F.substring_index(host, ":", 1)).otherwise(host)
    return name, F.when(host.startswith("["), after).when(split, F.substring_index(host, ":", -1)).otherwise("")


def free_text(value: Column) -> Column:
    """Whether a value reads as prose: three words or more, three runs of two letters or more."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return (F.size(words) >= 3) & (F.size(F.regexp_extract_all(value, F.lit(r"\p{L}{2,}"), F.lit(0))) >= 3)


def whole_term(value: Column, term: str) -> Column:
    """Whether a term stands in a value without a letter or digit beside it; case doesn't matter."""
    import re

    return value.rlike(rf"(?i)(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])")


def body_syntax(body: Column) -> Column:
    """none, json_object, json_array, xml, form_pairs or other, whatever the declared type."""
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")
    valid = F.try_parse_json(bare).isNotNull()
    pairs = F.filter(F.split(body, "&"), lambda s: s != "")
    return first_reason(
        [
            ("none", F.coalesce(bare, F.lit("")) == ""), ("json_object", bare.startswith("{") & valid), ("json_array", bare.startswith("[") & valid), ("other", bare.rlike(r"^[{\[]")), ("xml", bare.startswith("<")),
            ("form_pairs", (F.size(pairs) > 0) & F.forall(pairs, lambda s: s.rlike(r"^[A-Za-z0-9_.~%+\-\[\]]+=[^\s<>]*$"))),
        ],
        "other",
    )


#: Categories whose payloads are looked at for residues of documentation, and marks of such residues.
FOCUS = ("SQL Injection", "XSS Injection", "Command Injection", "Server Side Template Injection")
PLACEHOLDER = r"\[(RANDNUM[0-9]*|RANDSTR[0-9]*|SLEEPTIME|ATTACKER\.DOMAIN\.TLD)\]|<DBNAME>"
SUFFIX = r"^(.*(?:\}\}|%\}|%>))\s+(?://|#)\s+(?:Error-Based|Boolean-Based) RCE(?:\s+[<>]=?\s*[0-9]+(?:\.[0-9]+)*(?:,\s*[<>]=?\s*[0-9]+(?:\.[0-9]+)*)*|\s+with sandbox bypass using CVE-[0-9]{4}-[0-9]+)\s*$"
STRINGS = r"""'(?:''|[^'])*'|"(?:""|[^"])*\""""


def residue_proposal(payload: Column, category: Column, kind: Column) -> dict[str, Column]:
    """What to do about residues of documentation in a payload: exclude and review (reasons, in order), transformed and transform. Proposals only."""
    focus, prose = category.isin(*FOCUS), kind == "md"
    sql, template = category == "SQL Injection", category == "Server Side Template Injection"
    outside = F.regexp_replace(payload, STRINGS, " ")
    quoted = F.when(payload.startswith("'"), F.concat(outside, F.lit(" "), F.regexp_replace(F.substring(payload, 2, 1 << 30), STRINGS, " "))).otherwise(outside)
    paged = prose & sql & quoted.rlike(r"(?i)\b(LIMIT|OFFSET)\s+data_offset\b")
    exclude = all_flags(
        [
            ("explicit_documentation_metavariable", focus & payload.rlike(PLACEHOLDER)), ("interactive_tool_prompt", focus & payload.rlike(r"^(sqlite|mysql|psql)>\s")),
            ("passwd_output_record", (category == "Command Injection") & payload.rlike(r"^[A-Za-z_][\w-]*:[^:\n]*:[0-9]+:[0-9]+:[^:\n]*:[^:\n]*:[^:\n]*$")),
            ("markdown_heading", focus & prose & payload.rlike(r"^\*\*[^*\n]+\*\*:$")), ("versioned_tool_invocation", prose & (sql | template) & payload.rlike(r"^(python[0-9]*(\.[0-9]+)*|sqlmap)(\s|$)")),
            ("sql_pagination_metavariable_requires_context", paged),
        ]
    )
    cut = prose & template & payload.rlike(SUFFIX)
    review = all_flags(
        [
            ("possible_host_language_source", prose & template & payload.rlike(r"^(foreach\s*\(|\$\w+\s*(=&|=|->))")),
            ("possible_implicit_documentation_metavariable", prose & sql & ~paged & payload.rlike(r"\bdata_(offset|column|table|info)\b")),
        ]
    )
    return {"exclude": exclude, "review": review, "transformed": F.when(cut, F.regexp_extract(payload, SUFFIX, 1)).otherwise(payload), "transform": F.when(cut, "strip_versioned_documentation_suffix")}
