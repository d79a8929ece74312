"""Encoded forms, canonical requests, header profiles and field classes: functions of single values, over urls with planted forms and fixed lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms, keys, protocol
from .registry import query


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else quoted(v) for v in r) + ")" for r in rows) + f") v({names}))"


def values(t, rows: list[tuple], schema: str):
    """A fixed table, in the session of the tables that t reads."""
    return t("region").sparkSession.createDataFrame(rows, schema)


#: What is appended to a page's url, by its id: every encoded form, and texts that only look like one.
PLANTED = ["", "%41%4a", "%4A%4a%4B", "%2527", "\\u0041", "&amp;x", "${IFS}", "%4a%4A%41", "&nosuchname; %e9", "100% sure+%20", "&#x27;%C3%A9", "%31%32"]
WIRE = f"(SELECT page_id, url || ([{', '.join(map(quoted, PLANTED))}])[(page_id % {len(PLANTED)} + 1)::INT] AS wire FROM pages)"
ENTITY = f"regexp_matches(wire, '&#([0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});') OR len(list_intersect(regexp_extract_all(wire, '&([A-Za-z][A-Za-z0-9]{{1,31}});', 1), [{', '.join(map(quoted, forms._entity_names()))}])) > 0"
HEX = """CASE WHEN regexp_matches(wire, '%([A-F][a-f]|[a-f][A-F])') THEN 'mixed_within_token' WHEN regexp_matches(wire, '%([A-F][0-9A-F]|[0-9][A-F])') AND regexp_matches(wire, '%([a-f][0-9a-f]|[0-9][a-f])') THEN 'mixed_across_tokens'
  WHEN regexp_matches(wire, '%([A-F][0-9A-F]|[0-9][A-F])') THEN 'upper' WHEN regexp_matches(wire, '%([a-f][0-9a-f]|[0-9][a-f])') THEN 'lower' WHEN regexp_matches(wire, '%[0-9A-Fa-f]{2}') THEN 'digits_only' ELSE 'none' END"""


def wires(t):
    planted = F.element_at(F.array(*[F.lit(p) for p in PLANTED]), (F.col("page_id") % len(PLANTED) + 1).cast("int"))
    return t("pages").select("page_id", F.concat("url", planted).alias("wire"))


@query("encoded_forms", f"""
SELECT page_id, {HEX} AS hex_case, array_to_string(list_filter([CASE WHEN regexp_matches(wire, '%25[0-9A-Fa-f]{{2}}') THEN 'double_encoding' END, CASE WHEN regexp_matches(wire, '\\\\u[0-9A-Fa-f]{{4}}') THEN 'unicode_escape' END,
  CASE WHEN {ENTITY} THEN 'html_entity' END, CASE WHEN contains(wire, '${{IFS}}') THEN 'ifs' END, CASE WHEN ({HEX}) = 'mixed_within_token' THEN 'mixed_case_hex' END], lambda x: x IS NOT NULL), ',') AS forms,
  CASE WHEN regexp_matches(wire, '%[0-9A-Fa-f]{{2}}') THEN 'pre_encoded' ELSE 'plain' END AS wire_form, CASE WHEN regexp_matches(wire, '%[0-9A-Fa-f]{{2}}') THEN coalesce(TRY(url_decode(wire)), wire) ELSE wire END AS logical,
  CASE WHEN NOT regexp_matches(wire, '%[0-9A-Fa-f]{{2}}') THEN 'plain' WHEN TRY(url_decode(wire)) IS NULL THEN 'invalid_utf8_kept_verbatim' ELSE 'decoded_once' END AS how FROM {WIRE}""")
def encoded_forms(t):
    """Encoded forms of urls with planted ones, their hex case, and the text that they stand for."""
    wire = F.col("wire")
    logical, how = forms.logical_of(wire)
    return wires(t).select("page_id", forms.hex_case_profile(wire).alias("hex_case"), F.array_join(forms.native_forms(wire), ",").alias("forms"), forms.wire_form(wire).alias("wire_form"), logical.alias("logical"), how.alias("how"))


UNQUOTE = "coalesce(TRY(url_decode({0})), {0})"


def canonical_sql(x: str) -> str:
    """The canonical key: three rounds of decoding with '+' as space, escapes, comments, white space, case. (For values that are UTF-8 at each round.)"""
    for _ in range(3):
        x = UNQUOTE.format(f"replace({x}, '+', ' ')")
    for escape, plain in (("\\\\u003c", "<"), ("\\\\u003e", ">"), ("\\\\u0027", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        x = f"regexp_replace({x}, '{escape}', '{plain}', 'gi')"
    return f"lower(trim(regexp_replace(replace(regexp_replace({x}, '/\\*.*?\\*/', '', 'g'), '${{IFS}}', ' '), '\\s+', ' ', 'g')))"


#: Planted tails that decode to UTF-8 at every round, as the SQL needs.
TAILS = ["", "%253Cb%253E", "+a%2Bb", "/*x*/y", "&LT;i&gt;", "${IFS}cat", "  Two  Spaces", "\\u003Cs\\u003e"]


@query("canonical_keys", f"SELECT page_id, {canonical_sql('w')} AS key FROM (SELECT page_id, url || ([{', '.join(map(quoted, TAILS))}])[(page_id % {len(TAILS)} + 1)::INT] AS w FROM pages)")
def canonical_keys(t):
    tail = F.element_at(F.array(*[F.lit(p) for p in TAILS]), (F.col("page_id") % len(TAILS) + 1).cast("int"))
    return t("pages").select("page_id", keys.canonical_key(F.concat("url", tail)).alias("key"))


FAMILY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(key, '[^\\s@/]+@[^\\s@/]+\\.[^\\s@/]+', 'H', 'g'), '\\b\\d{1,3}(?:\\.\\d{1,3}){3}\\b', 'H', 'g'), '(://)[^/?#\\s]+', '\\1H', 'g'), '\\d+', '0', 'g')"


@query("family_keys", f"""
WITH k AS (SELECT page_id, string_split({FAMILY}, '') AS c FROM (SELECT page_id, {canonical_sql("url || '/' || repeat('o', (page_id % 7)::INT) || '/a.b@mail.example.com 10.0.0.12'")} AS key FROM pages)),
r AS (SELECT page_id, list_filter(c, lambda x, i: NOT (i > 3 AND x = c[i - 1] AND x = c[i - 2] AND x = c[i - 3])) AS c FROM k)
SELECT page_id, regexp_replace(array_to_string(c, ''), '\\s+', '', 'g') AS family FROM r""")
def family_keys(t):
    """Family keys of canonical keys: digits, addresses, hosts and long runs masked."""
    planted = F.concat("url", F.lit("/"), F.repeat(F.lit("o"), (F.col("page_id") % 7).cast("int")), F.lit("/a.b@mail.example.com 10.0.0.12"))
    return t("pages").select("page_id", keys.family_key(keys.canonical_key(planted)).alias("family"))


#: Request texts, by a page's id; {0} is its path and query.
REQUESTS = ["GET {0} HTTP/1.1\nHost: a\n\n", "POST {0} HTTP/1.1\nHost: a\nCONTENT-TYPE : Application/JSON; charset=utf-8\nX-Y: 1\n\n{{\"a\": \"B %41\"}}", "PUT {0} HTTP/1.1\ncontent-type: text/plain\n\na+b  c\n\nmore", "DELETE {0} HTTP/1.1", "BAD", "GET  {0}"]
PARTS = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"
REQUEST = f"(SELECT page_id, replace(([{', '.join(quoted(r.replace('{{', '{').replace('}}', '}')) for r in REQUESTS)}])[(page_id % {len(REQUESTS)} + 1)::INT], '{{0}}', {PARTS}) AS r FROM pages)"


def requests_of(t):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    form = F.element_at(F.array(*[F.lit(r.replace("{{", "{").replace("}}", "}")) for r in REQUESTS]), (F.col("page_id") % len(REQUESTS) + 1).cast("int"))
    return t("pages").select("page_id", F.replace(form, F.lit("{0}"), path).alias("r"))


@query("canonical_requests", f"""
WITH h AS (SELECT page_id, CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN split_part(r, chr(10) || chr(10), 1) ELSE r END AS head, CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN substr(r, instr(r, chr(10) || chr(10)) + 2) ELSE '' END AS body FROM {REQUEST}),
l AS (SELECT *, split_part(head, chr(10), 1) AS line, string_split(head, chr(10))[2:] AS fields FROM h),
m AS (SELECT *, split_part(line, ' ', 1) AS method, CASE WHEN instr(line, ' ') > 0 THEN substr(line, instr(line, ' ') + 1) ELSE '' END AS rest FROM l),
n AS (SELECT *, CASE WHEN instr(rest, ' ') > 0 THEN regexp_replace(rest, ' [^ ]*$', '') ELSE rest END AS target, list_filter(fields, lambda f: lower(trim(split_part(f, ':', 1))) = 'content-type') AS types FROM m),
p AS (SELECT page_id, method, split_part(target, '?', 1) AS path, CASE WHEN instr(target, '?') > 0 THEN substr(target, instr(target, '?') + 1) ELSE '' END AS query, coalesce(lower(trim(split_part(regexp_replace(types[1], '^[^:]*:?', ''), ';', 1))), '') AS ctype, body FROM n)
SELECT page_id, method, path, query, ctype AS content_type, {canonical_sql("method || ' ' || path || '?' || query || chr(10) || ctype || chr(10) || body")} AS canonical FROM p""")
def canonical_requests(t):
    """Parts of request texts, and the key that every comparison of requests goes by."""
    p = forms.request_text_parts(F.col("r"))
    return requests_of(t).select("page_id", *[p[c].alias(c) for c in ("method", "path", "query", "content_type")], forms.canonical_request(F.col("r")).alias("canonical"))


#: Texts of the canonical grammar and texts that break one rule of it.
GRAMMAR = ["GET {0} HTTP/1.1\n", "POST {0} HTTP/1.1\nContent-Type: text/plain\n\nbody\nwith lines", "POST {0} HTTP/1.1\n\n\nx", "GET {0} HTTP/1.1", "GET {0}\n", "GET {0} b HTTP/1.1\n", "GET HTTP/1.1\n", "PUT {0} HTTP/1.1\nContent-Type: a", "PUT {0} HTTP/1.1\nbody", "PUT {0} HTTP/1.1\n\n", "PUT {0} HTTP/1.1\nContent-Type: a\n", "PUT {0} HTTP/1.1\nContent-Type: \n\n\n"]
GRAMMAR_SQL = f"(SELECT page_id, replace(([{', '.join(map(quoted, GRAMMAR))}])[(page_id % {len(GRAMMAR)} + 1)::INT], '{{0}}', {PARTS}) AS x FROM pages)"


@query("canonical_grammar", f"""
WITH a AS (SELECT page_id, x, split_part(x, chr(10), 1) AS line, substr(x, instr(x, chr(10)) + 1) AS rest FROM {GRAMMAR_SQL}),
b AS (SELECT *, starts_with(rest, 'Content-Type: ') AS typed, instr(rest, chr(10)) AS e, regexp_replace(line, ' HTTP/1\\.1$', '') AS start FROM a),
c AS (SELECT *, CASE WHEN typed THEN substr(rest, e + 1) ELSE rest END AS after, CASE WHEN instr(start, ' ') > 0 THEN substr(start, instr(start, ' ') + 1) ELSE start END AS target FROM b),
d AS (SELECT *, CASE WHEN instr(x, chr(10)) = 0 THEN 'no_request_line' WHEN NOT ends_with(line, ' HTTP/1.1') OR instr(start, ' ') = 0 THEN 'malformed_request_line' WHEN instr(target, ' ') > 0 THEN 'space_in_target'
  WHEN typed AND e = 0 THEN 'unterminated_content_type' WHEN after <> '' AND (NOT starts_with(after, chr(10)) OR length(after) = 1) THEN 'body_without_blank_line' END AS reject FROM c)
SELECT page_id, reject, CASE WHEN reject IS NULL THEN split_part(start, ' ', 1) END AS method, CASE WHEN reject IS NULL THEN target END AS target, CASE WHEN reject IS NULL AND typed THEN substr(rest, 15, e - 15) END AS content_type, CASE WHEN reject IS NULL THEN substr(after, 2) END AS body FROM d""")
def canonical_grammar(t):
    """The canonical grammar read back: parts, or the first rule that a text breaks."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    text = F.replace(F.element_at(F.array(*[F.lit(g) for g in GRAMMAR]), (F.col("page_id") % len(GRAMMAR) + 1).cast("int")), F.lit("{0}"), path)
    p = forms.parse_canonical(F.col("x"))
    return t("pages").select("page_id", text.alias("x")).select("page_id", *[p[c].alias(c) for c in ("reject", "method", "target", "content_type", "body")])


@query("kept_headers", f"""
WITH a AS (SELECT page_id, CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN split_part(r, chr(10) || chr(10), 1) ELSE r END AS head, CASE WHEN instr(r, chr(10) || chr(10)) > 0 THEN substr(r, instr(r, chr(10) || chr(10)) + 2) ELSE '' END AS body FROM {REQUEST}),
b AS (SELECT page_id, body, string_split(head, chr(10)) AS l FROM a)
SELECT page_id, array_to_string(l[1:1] || list_filter(l[2:], lambda h: lower(trim(split_part(h, ':', 1))) = 'content-type'), chr(10)) || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END AS approx FROM b""")
def kept_headers(t):
    return requests_of(t).select("page_id", forms.kept_headers(F.col("r")).alias("approx"))


@query("vector_hashes", "SELECT page_id, sha256('[' || length(url) || ', ' || length(html) || ', ' || CASE WHEN page_id % 5 = 0 THEN 'null' ELSE (page_id % 5)::VARCHAR END || ', true]') AS vector FROM pages")
def vector_hashes(t):
    fields = [F.length("url"), F.length("html"), F.nullif(F.col("page_id") % 5, F.lit(0)), F.lit(True)]
    return t("pages").select("page_id", forms.vector_hash(fields).alias("vector"))


#: Header values that fit a profile, and near misses.
HEADERS = [
    "es-CR,es;q=0.9,en;q=0.8", "en-US", "en,en;q=0.5", "es;q=1.0", "fr, de;q=0.3", "a,b", "fr,de,en,es,es-MX", '"Chromium";v="120", "Not A;Brand";v="8", "Google Chrome";v="120"', '"One";v="1"', "question=what is it", "question=a;b", "question=", "Sun, 06 Nov 1994 08:49:37 GMT",
    "Mon, 06 Nov 1994 08:49:37 GMT", "Sun, 6 Nov 1994 08:49:37 GMT", "Tue, 01 Jan 2199 00:00:00 GMT", 'W/"abc-1.2"', '"x"', "*", "abc", "/", "https://shop.example/list", "https://shop.example/list?x=1", "https://other.example/list", "", None, "tab\there", "é", "x" * 513,
]
ORIGINS, HEADER_PATHS = ("https://shop.example",), ("/list", "/")
HEADER_ROWS = [(i, h) for i, h in enumerate(HEADERS)]
DATED = "try_strptime(h, '%a, %d %b %Y %H:%M:%S GMT')"
TAGS = "list_transform(string_split(h, ','), lambda p: split_part(trim(p), ';q=', 1))"


@query("header_profiles", f"""
SELECT i, CASE WHEN h IS NULL OR NOT regexp_full_match(h, '[\\x20-\\x7E]{{1,512}}') THEN '' ELSE array_to_string(list_filter([
  CASE WHEN len(string_split(h, ',')) <= 4 AND len(list_filter(string_split(h, ','), lambda p: NOT regexp_full_match(trim(p), '[A-Za-z0-9-]+(;q=0\\.[1-9])?'))) = 0 AND len(list_filter({TAGS}, lambda x: x NOT IN ({', '.join(map(quoted, forms.LANGUAGES))}))) = 0 AND len(list_distinct({TAGS})) = len({TAGS}) THEN 'language_preferences' END,
  CASE WHEN length(h) <= 160 AND regexp_matches(h, {quoted(forms.CLIENT_HINTS)}) THEN 'client_hints' END, CASE WHEN starts_with(h, 'question=') AND length(h) <= 256 AND NOT regexp_matches(substr(h, 10), '[;{{}}\\\\"]') THEN 'question_cookie' END,
  CASE WHEN strftime({DATED}, '%a, %d %b %Y %H:%M:%S GMT') = h AND year({DATED}) BETWEEN 1970 AND 2100 THEN 'http_date' END, CASE WHEN regexp_matches(h, {quoted(forms.ENTITY_TAG)}) THEN 'entity_tag' END,
  CASE WHEN h IN ('/', 'https://shop.example/list', 'https://shop.example/') THEN 'public_referer' END], lambda x: x IS NOT NULL), ',') END AS profiles FROM {values_sql(HEADER_ROWS, 'i, h')}""")
def header_profiles(t):
    return values(t, HEADER_ROWS, "i int, h string").select("i", F.array_join(forms.header_profiles(F.col("h"), ORIGINS, HEADER_PATHS, True), ",").alias("profiles"))


FIELDS = [(n,) for n in ("UserName", "passwd", "e-mail", "cardNumber", "callback_url", "title", "q", "ciudad", "Message body", "nextTarget", "id", "", "iban", "loginHost", "zip_code")]


@query("field_classes", "SELECT n, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(n), '{k}')" for k in forms.FIELD_CLASSES[c]) + f" THEN '{c}' END" for c in sorted(forms.FIELD_CLASSES)) + f"], lambda x: x IS NOT NULL), ',') AS classes FROM {values_sql(FIELDS, 'n')}")
def field_classes(t):
    return values(t, FIELDS, "n string").select("n", F.array_join(forms.field_classes(F.col("n")), ",").alias("classes"))


AGENT_ROWS = [(a, h) for a, h in (("curl/8.1", "a.example:80"), ("Wget/1", "a.example"), ("python-requests", "[::1]:8080"), ("MobileApp 2", "[::1]"), ("Mozilla/5.0 (X11)", ":80"), ("Other", "a:b:c"), (None, "x:"), ("mozilla curl/7", ""))]


@query("agents_and_hosts", f"""
SELECT agent, host, CASE WHEN agent IS NULL THEN 'absent' {" ".join("WHEN " + " OR ".join(f"contains(lower(agent), '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in forms.AGENTS)} ELSE 'other' END AS family,
  CASE WHEN starts_with(host, '[') THEN regexp_extract(host, '^\\[([^\\]]*)', 1) WHEN len(string_split(host, ':')) = 2 AND NOT starts_with(host, ':') THEN split_part(host, ':', 1) ELSE host END AS name,
  CASE WHEN starts_with(host, '[') THEN regexp_extract(host, '^\\[[^\\]]*\\]:(.*)$', 1) WHEN len(string_split(host, ':')) = 2 AND NOT starts_with(host, ':') THEN split_part(host, ':', 2) ELSE '' END AS port FROM {values_sql(AGENT_ROWS, 'agent, host')}""")
def agents_and_hosts(t):
    name, port = forms.host_parts(F.col("host"))
    return values(t, AGENT_ROWS, "agent string, host string").select("agent", "host", forms.agent_family(F.col("agent")).alias("family"), name.alias("name"), port.alias("port"))


TERMS = ["the", "or", "and"]


@query("lexical_terms", "SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 3 AND len(regexp_extract_all(text, '\\p{L}{2,}')) >= 3 AS free_text, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN '{w}' END" for w in TERMS) + "], lambda x: x IS NOT NULL), ',') AS terms FROM conversations")
def lexical_terms(t):
    """Whether a turn reads as prose, and which whole terms it holds."""
    found = F.filter(F.array(*[F.when(forms.whole_term(F.col("text"), w), F.lit(w)) for w in TERMS]), lambda x: x.isNotNull())
    return t("conversations").select("conv_id", "turn", forms.free_text(F.col("text")).alias("free_text"), F.array_join(found, ",").alias("terms"))


BODIES = [(b,) for b in ("", "  ", '{"a": 1}', "[1, 2]", "{bad", "[", " <x/>", "a=1&b=2", "a=1&&", "flag", "a b=1", "&", '{"a": {"a": 1}} ')]


@query("body_syntax", f"""
SELECT b, CASE WHEN trim(b) = '' THEN 'none' WHEN starts_with(trim(b), '{{') AND json_valid(trim(b)) THEN 'json_object' WHEN starts_with(trim(b), '[') AND json_valid(trim(b)) THEN 'json_array' WHEN regexp_matches(trim(b), '^[{{\\[]') THEN 'other' WHEN starts_with(trim(b), '<') THEN 'xml'
  WHEN len(list_filter(string_split(b, '&'), lambda s: s <> '')) > 0 AND len(list_filter(string_split(b, '&'), lambda s: s <> '' AND NOT regexp_matches(s, '^[A-Za-z0-9_.~%+\\-\\[\\]]+=[^\\s<>]*$'))) = 0 THEN 'form_pairs' ELSE 'other' END AS kind FROM {values_sql(BODIES, 'b')}""")
def body_syntax(t):
    return values(t, BODIES, "b string").select("b", forms.body_syntax(F.col("b")).alias("kind"))


SQLI, SSTI, CMD = "SQL Injection", "Server Side Template Injection", "Command Injection"
RESIDUES = [
    ("id=[RANDNUM1]", SQLI, "md"), ("<DBNAME>.t", "Other", "md"), ("mysql> select 1", SQLI, "txt"), ("root:x:0:0:r:/root:/bin/sh", CMD, "txt"), ("root:x:0:0:r:/root:/bin/sh", SQLI, "txt"), ("**Heading**:", SQLI, "md"), ("**Heading**:", SQLI, "txt"),
    ("python3.8 -c x", SSTI, "md"), ("{{7*7}} // Error-Based RCE >=1.2, <3", SSTI, "md"), ("{{7*7}} # Boolean-Based RCE with sandbox bypass using CVE-2020-1", SSTI, "md"), ("{{7*7}} // Error-Based RCE >=1.2", SSTI, "txt"), ("foreach (x)", SSTI, "md"), ("$a = 1", SSTI, "md"),
    ("select 1 limit data_offset", SQLI, "md"), ("select 'limit data_offset'", SQLI, "md"), ("' OR 1 LIMIT data_offset -- '", SQLI, "md"), ("select data_column", SQLI, "md"), ("plain", SQLI, "md"),
]
FOCUS = "c IN (" + ", ".join(map(quoted, forms.FOCUS)) + ")"
OUTSIDE = f"regexp_replace(p, {quoted(forms.STRINGS)}, ' ', 'g')"
PAGED = f"(k = 'md' AND c = '{SQLI}' AND regexp_matches({OUTSIDE} || CASE WHEN starts_with(p, '''') THEN ' ' || regexp_replace(substr(p, 2), {quoted(forms.STRINGS)}, ' ', 'g') ELSE '' END, '(?i)\\b(LIMIT|OFFSET)\\s+data_offset\\b'))"


def flags_sql(rules):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules) + "], lambda x: x IS NOT NULL), ',')"


@query("residue_proposals", f"""
SELECT p, c, k, {flags_sql([
    ("explicit_documentation_metavariable", f"{FOCUS} AND regexp_matches(p, {quoted(forms.PLACEHOLDER)})"), ("interactive_tool_prompt", f"{FOCUS} AND regexp_matches(p, '^(sqlite|mysql|psql)>\\s')"),
    ("passwd_output_record", f"c = '{CMD}' AND regexp_matches(p, '^[A-Za-z_][\\w-]*:[^:\\n]*:[0-9]+:[0-9]+:[^:\\n]*:[^:\\n]*:[^:\\n]*$')"), ("markdown_heading", f"{FOCUS} AND k = 'md' AND regexp_matches(p, '^\\*\\*[^*\\n]+\\*\\*:$')"),
    ("versioned_tool_invocation", f"k = 'md' AND c IN ('{SQLI}', '{SSTI}') AND regexp_matches(p, '^(python[0-9]*(\\.[0-9]+)*|sqlmap)(\\s|$)')"), ("sql_pagination_metavariable_requires_context", PAGED)])} AS exclude,
  {flags_sql([("possible_host_language_source", f"k = 'md' AND c = '{SSTI}' AND regexp_matches(p, '^(foreach\\s*\\(|\\$\\w+\\s*(=&|=|->))')"), ("possible_implicit_documentation_metavariable", f"k = 'md' AND c = '{SQLI}' AND NOT {PAGED} AND regexp_matches(p, '\\bdata_(offset|column|table|info)\\b')")])} AS review,
  CASE WHEN k = 'md' AND c = '{SSTI}' AND regexp_matches(p, {quoted(forms.SUFFIX)}) THEN regexp_extract(p, {quoted(forms.SUFFIX)}, 1) ELSE p END AS transformed,
  CASE WHEN k = 'md' AND c = '{SSTI}' AND regexp_matches(p, {quoted(forms.SUFFIX)}) THEN 'strip_versioned_documentation_suffix' END AS transform FROM {values_sql(RESIDUES, 'p, c, k')}""")
def residue_proposals(t):
    """Proposals about residues of documentation: exclude, review, transform. Nothing is changed or dropped."""
    found = forms.residue_proposal(F.col("p"), F.col("c"), F.col("k"))
    return values(t, RESIDUES, "p string, c string, k string").select("p", "c", "k", *[F.array_join(found[n], ",").alias(n) for n in ("exclude", "review")], found["transformed"].alias("transformed"), found["transform"].alias("transform"))


LAYERED = [("a%2541",), ("a+b%2B",), ("plain",), ("%25252541",), ("100%",), ("a%20b+c",), ("",)]


@query("decoded_layers", "WITH a AS (SELECT s, f, regexp_matches(s, '%[0-9A-Fa-f]{2}') AS p0, CASE WHEN f THEN url_decode(replace(s, '+', ' ')) ELSE url_decode(s) END AS s1 FROM " + values_sql(LAYERED, "s") + """, (VALUES (true), (false)) w(f)),
b AS (SELECT *, regexp_matches(s1, '%[0-9A-Fa-f]{2}') AND s1 <> s AS p1, url_decode(s1) AS s2 FROM a), c AS (SELECT *, p1 AND regexp_matches(s2, '%[0-9A-Fa-f]{2}') AS p2, url_decode(s2) AS s3 FROM b)
SELECT s, f AS form, CASE WHEN p2 THEN s3 WHEN p1 THEN s2 ELSE s1 END AS text, (p0::INT + p1::INT + p2::INT)::INT AS layers FROM c""")
def decoded_layers(t):
    """Up to three layers of percent-encoding; a form's first layer reads '+' as a space."""
    both = values(t, LAYERED, "s string").select("s", F.explode(F.array(F.lit(True), F.lit(False))).alias("form"))
    x = F.when(F.col("form"), protocol.decode_form_layers("s")).otherwise(protocol.decode_layers("s"))
    return both.select("s", "form", x["text"].alias("text"), x["layers"].alias("layers"))
