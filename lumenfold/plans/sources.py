"""Readers and writers on round trips: tables are written to the shared folder in a reader's format, and what comes back is held against the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, protocol
from ..operators import curate, split
from ..sources import files, sinks
from ..storage import scratch
from .forms import quoted, values, values_sql
from .registry import h60, query


def folder(t) -> str:
    return scratch(t("region").sparkSession)


def written(t, lines, path: str | None = None) -> str:
    """Lines (column value) as text files."""
    path = path or folder(t)
    lines.select("value").write.text(path)
    return path


def session(t):
    return t("region").sparkSession


@query("jsonl_round_trip", "SELECT doc_id, lang, text FROM documents")
def jsonl_round_trip(t):
    """Documents as sorted JSON lines and strictly back; line breaks inside a text are no line ends."""
    path = folder(t)
    sinks.sorted_jsonl(t("documents").select("doc_id", "lang", "text"), path, ["doc_id"])
    return files.jsonl(session(t), path, "doc_id long, lang string, text string")


@query("jsonl_order", f"SELECT count(*)::BIGINT AS rows, sum({h60("'{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}'")})::VARCHAR AS digest, true AS sorted FROM documents")
def jsonl_order(t):
    """The manifest of sorted JSON lines, and that ids ascend through the files in order of their names."""
    path = folder(t)
    manifest = sinks.sorted_jsonl(t("documents").select("doc_id", "lang"), path, ["doc_id"])
    back = files.jsonl(session(t), path, "doc_id long, lang string").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    other = back.select(F.col("f").alias("g"), F.col("lo").alias("next"))
    wrong = back.join(other, (F.col("f") < F.col("g")) & (F.col("next") <= F.col("hi"))).agg((F.count(F.lit(1)) == 0).alias("sorted"))  # a row a file
    return manifest.crossJoin(wrong)


@query("jsonl_bad_lines", "SELECT lang, count(*) FILTER (WHERE doc_id % 7 <> 0)::BIGINT AS good FROM documents WHERE doc_id % 7 <> 0 GROUP BY lang UNION ALL SELECT NULL, count(*)::BIGINT FROM documents WHERE doc_id % 7 = 0")
def jsonl_bad_lines(t):
    """A bad line costs itself only, and is counted."""
    line = F.to_json(F.struct("doc_id", "lang"))
    path = written(t, t("documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), line)).otherwise(line).alias("value")))
    return files.jsonl_counted(session(t), path, "doc_id long, lang string").groupBy("lang").agg(F.count(F.lit(1)).alias("good"))


@query("raw_filter", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def raw_filter(t):
    path = written(t, t("documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value")))
    return files.raw_filtered(session(t), path, '"lang":"fr"', "doc_id long, lang string").select("doc_id")


@query("verified_files", "SELECT * FROM (VALUES ('ok', 5), ('sha_mismatch', 1), ('bytes_mismatch', 1), ('malformed', 1), ('missing', 1), ('unsafe_path', 1)) v(status, n)")
def verified_files(t):
    """Eight files and their manifest, with one fault of each kind planted in it."""
    path = written(t, t("nation").repartition(8, "n_nationkey").select(F.lit("x").alias("value")).union(values(t, [(str(i),) for i in range(8)], "value string")).repartition(8))
    names = sinks.manifest(session(t), path).where("name like 'part-%'").withColumn("i", F.substring("name", 6, 5).cast("int"))
    planted = names.select(
        "name", F.when(F.col("i") == 0, F.lit("0" * 64)).when(F.col("i") == 1, "not a hash").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("i") == 2, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes")
    )
    more = values(t, [("gone.txt", "0" * 64, 3), ("../up.txt", "0" * 64, 3)], "name string, sha256 string, bytes long")
    return files.verified(session(t), path, planted.unionByName(more)).groupBy("status").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("request_csv", r"""
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE (['GET', 'POST'])[(page_id % 2 + 1)::INT] END AS method, split_part(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?', 1) AS path,
  CASE WHEN contains(regexp_replace(url, '^[a-z]+://[^/]*', ''), '?') THEN regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?]*\?', '') ELSE '' END AS query, CASE WHEN page_id % 4 > 0 THEN (page_id % 4)::VARCHAR END AS label, page_id % 9 = 0 AS malformed FROM pages""")
def request_csv(t):
    """A labelled request log; the page's id travels in the label's column, after a bar."""
    i = F.col("page_id")
    rows = t("pages").select(F.when(i % 9 != 0, F.when(i % 2 == 0, "GET").otherwise("POST")).alias("Method"), F.concat("url", F.lit(" HTTP/1.1")).alias("URL"), F.concat(i.cast("string"), F.lit("|"), F.when(i % 4 > 0, (i % 4).cast("string")).otherwise("")).alias("classification"))
    path = folder(t)
    rows.write.option("header", "true").csv(path)
    back = files.request_csv(session(t), path)
    return back.select(F.substring_index("label", "|", 1).cast("long").alias("page_id"), "method", "path", "query", F.nullif(F.substring_index("label", "|", -1), F.lit("")).alias("label"), "malformed")


@query("sentence_tsv", """
SELECT CASE WHEN conv_id % 5 <> 1 THEN conv_id * 100 + turn END AS id, CASE WHEN conv_id % 5 = 2 THEN 'XX' ELSE 'eng' END AS lang, role AS text, CASE WHEN turn % 2 = 0 THEN '2024-01-01' END AS date, CASE conv_id % 5 WHEN 1 THEN 'id' WHEN 2 THEN 'lang' END AS reason, count(*)::BIGINT AS n FROM conversations WHERE conv_id % 5 <> 3 GROUP BY ALL
UNION ALL SELECT conv_id * 100 + turn, 'eng', NULL, NULL, 'columns', count(*)::BIGINT FROM conversations WHERE conv_id % 5 = 3 GROUP BY ALL""")
def sentence_tsv(t):
    """Four-column lines, some with a bad id or language or too few columns: each keeps its reason, none is lost."""
    k = F.col("conv_id") % 5
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    line = F.when(k == 3, F.concat_ws("\t", number, F.lit("eng"))).otherwise(
        F.concat_ws("\t", F.when(k == 1, F.concat(F.lit("n"), number)).otherwise(number), F.when(k == 2, "XX").otherwise("eng"), "role", F.when(F.col("turn") % 2 == 0, "2024-01-01").otherwise(" "))
    )
    path = written(t, t("conversations").select(line.alias("value")))
    return files.tsv_with_reasons(session(t), path).groupBy("id", "lang", "text", "date", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("query_service_bindings", "SELECT 'http://x/' || n_nationkey AS item, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS label, CASE WHEN n_nationkey % 4 = 0 THEN 'malformed_binding' END AS reason FROM nation")
def query_service_bindings(t):
    one = F.struct(F.struct(F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string")).alias("value")).alias("item"), F.when(F.col("n_nationkey") % 4 > 0, F.struct(F.col("n_name").alias("value"))).alias("itemLabel"))
    bindings = t("nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.collect_list(one).alias("bindings")).alias("results"))).alias("value"))
    path = folder(t)
    bindings.repartitionByRange(5, "n_regionkey").select("value").write.partitionBy().text(path)
    return files.bindings(session(t), path)


@query("markdown_blocks", "SELECT 0 AS block, 'sql' AS language, 'select ' || r_regionkey || chr(10) AS body FROM region UNION ALL SELECT 1, '', r_name || chr(10) || 'two' || chr(10) FROM region")
def markdown_blocks(t):
    """Two fenced blocks a document."""
    text = F.concat(F.lit("# "), "r_name", F.lit("\n```sql\nselect "), F.col("r_regionkey").cast("string"), F.lit("\n```\ntext\n```\n"), "r_name", F.lit("\ntwo\n```\n"))
    path = folder(t)
    t("region").select(text.alias("value"), F.col("r_regionkey").alias("k")).write.partitionBy("k").text(path)
    return files.fenced_blocks(session(t), path, "*.txt").select("block", "language", "body")


YAML = [(1, "tests:\n  - id: 1\n    uri: \"/x\"\n  - id: 2\n"), (2, "a: 'it''s'\nb:\n  - c\n  - d: |\n      one\n        two\n"), (3, "x: &a 1\n"), (4, "# nothing\n")]


@query("yaml_corpus", "SELECT * FROM (VALUES ('1', 'tests/0/id', '1', true), ('1', 'tests/0/uri', '/x', true), ('1', 'tests/1/id', '2', true), ('2', 'a', 'it''s', true), ('2', 'b/0', 'c', true), ('2', 'b/1/d', 'one' || chr(10) || '  two' || chr(10), true), ('3', NULL, NULL, false)) v(file, path, value, readable)")
def yaml_corpus(t):
    """Leaves of YAML files; one that can't be read is listed."""
    rows = values(t, [(str(i), y) for i, y in YAML], "file string, y string").select("file", F.encode("y", "UTF-8").alias("content"))
    x = files.exploded(rows, files.YamlLeaves, "yaml_corpus")
    return x.select("file", "path", "value", F.col("reason").isNull().alias("readable"))


@F.pandas_udf(T.BinaryType())
def zipped_log(number: pd.Series, name: pd.Series) -> pd.Series:
    import io
    import zipfile

    def pack(i, n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("audit.log", f"--{int(i):04x}-A--\n{n}\n--{int(i):04x}-B--\nGET /{n}\nHost: h\n--{int(i):04x}-Z--\n")
        return out.getvalue()

    return pd.Series([pack(i, n) for i, n in zip(number, name)])


@query("audit_log_sections", "SELECT printf('%04x', n_nationkey) AS entry, 'A' AS section, n_name AS value FROM nation UNION ALL SELECT printf('%04x', n_nationkey), 'B', 'GET /' || n_name || chr(10) || 'Host: h' FROM nation")
def audit_log_sections(t):
    rows = t("nation").select("n_name", "n_nationkey").select(F.col("n_name").alias("file"), zipped_log("n_nationkey", "n_name").alias("content"))
    return files.exploded(rows, files.SectionedLog, "audit_log_sections").select("entry", "section", "value")


@F.pandas_udf(T.BinaryType())
def workbook(name: pd.Series, number: pd.Series) -> pd.Series:
    import io
    import zipfile

    def pack(n, i):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="urn:x"><si><t>{n}</t></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<w xmlns="urn:x"><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>{int(i)}</v></c></row></w>')
        return out.getvalue()

    return pd.Series([pack(n, i) for n, i in zip(name, number)])


@query("workbook_cells", "SELECT n_name AS file, 1::INT AS row, 'A1' AS cell, n_name AS value FROM nation UNION ALL SELECT n_name, 1, 'B1', n_nationkey::VARCHAR FROM nation")
def workbook_cells(t):
    rows = t("nation").select(F.col("n_name").alias("file"), workbook("n_name", "n_nationkey").alias("content"))
    return files.exploded(rows, files.Workbook, "workbook_cells").select("file", "row", "cell", "value")


@query("one_hot_combinations", "SELECT combination, count(*)::BIGINT AS n FROM (SELECT array_to_string(list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ' + ') AS combination FROM labels) GROUP BY combination")
def one_hot_combinations(t):
    return files.one_hot_labels(t("labels"), "doc_id", ["toxic", "quality"]).groupBy("combination").agg(F.count(F.lit(1)).alias("n"))


@query("human_label_csv", "SELECT doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 4 = 0 THEN 'PENDING' WHEN toxic = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS label FROM labels")
def human_label_csv(t):
    """Human labels; one that is not given yet is PENDING."""
    path = folder(t)
    label = F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("toxic") == 1, "BLOCK").otherwise("ALLOW")
    t("labels").select(F.col("doc_id").cast("string").alias("sample_id"), label.alias("label")).write.option("header", "true").csv(path)
    return files.human_labels(session(t), path)


@query("log_line_fields", "SELECT 'user=' || user_id || CASE WHEN event_id % 5 > 0 THEN ' took ' || (event_id % 100) || '.5 ms' ELSE '' END AS value, user_id::DOUBLE AS user, CASE WHEN event_id % 5 > 0 THEN (event_id % 100 + 0.5)::DOUBLE END AS ms, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def log_line_fields(t):
    """Numbers read from log lines by patterns; a line without one has null."""
    took = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(" took "), (F.col("event_id") % 100).cast("string"), F.lit(".5 ms"))).otherwise("")
    path = written(t, t("events").select(F.concat(F.lit("user="), F.col("user_id").cast("string"), took).alias("value")))
    return files.log_fields(session(t), path, {"user": "user=([0-9]+)", "ms": "took ([0-9.]+) ms"}).groupBy("value", "user", "ms").agg(F.count(F.lit(1)).alias("n"))


@query("metrics_text", "SELECT 'events_total' AS name, event_type || ',' || (user_id % 3) AS kind, count(*)::DOUBLE AS value FROM events GROUP BY ALL UNION ALL SELECT 'up', '', 1.0")
def metrics_text(t):
    """A metrics text: labels with commas, comments and histogram series left out."""
    by = t("events").groupBy("event_type", (F.col("user_id") % 3).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    lines = by.select(F.concat(F.lit('events_total{kind="'), "event_type", F.lit(","), F.col("u").cast("string"), F.lit('"} '), F.col("n").cast("string")).alias("value"))
    more = values(t, [("# HELP up x",), ("up 1",), ('wait_bucket{le="1"} 4',), ("wait_sum 9",)], "value string")
    x = files.prometheus(session(t), written(t, lines.unionByName(more)))
    return x.select("name", F.coalesce(F.col("labels")["kind"], F.lit("")).alias("kind"), "value")


@query("run_documents", "SELECT r_regionkey::BIGINT AS n, r_name AS name, true AS named FROM region")
def run_documents(t):
    """A JSON document a run; the run's name is its file's."""
    path = folder(t)
    t("region").select(F.col("r_regionkey").cast("long").alias("n"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")).write.partitionBy("k").json(path)
    return files.run_documents(session(t), path, "n long, name string").select("n", "name", F.col("run").startswith("part-").alias("named"))


@query("log_tail", "SELECT 'first' AS call, doc_id, text FROM (SELECT doc_id, replace(lang, chr(10), ' ') AS text FROM documents) UNION ALL SELECT 'second', NULL, NULL WHERE false")
def log_tail(t):
    """Complete lines of log files by byte offset: a second call from where the first ended finds nothing more."""
    from ..streaming import jobs

    path = written(t, t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "lang").alias("value")))
    lines, offsets = jobs.log_tail(session(t), path)
    again, _ = jobs.log_tail(session(t), path, offsets)
    both = lines.select(F.lit("first").alias("call"), "line").unionByName(again.select(F.lit("second").alias("call"), "line"))
    return both.select("call", F.substring_index("line", "\t", 1).cast("long").alias("doc_id"), F.substring_index("line", "\t", -1).alias("text"))


@query("synthetic_rows", f"SELECT i AS id, (['a', 'b', 'c'])[({h60("'s|' || i")} % 3 + 1)::INT] AS kind, sha256('s|k|' || i) AS key FROM (SELECT unnest(range(0, 500))::BIGINT AS i)")
def synthetic_rows(t):
    return files.synthetic(session(t), 500, "s", ["a", "b", "c"])


@query("allowed_columns", "SELECT doc_id, substr(text, 1, 40) AS text, array_to_string(string_split(text, ' ')[1:32], ' ') AS words FROM documents")
def allowed_columns(t):
    """What may leave: the listed columns, strings bounded, arrays cut at 32; what isn't listed can't."""
    rows = t("documents").withColumn("words", F.split("text", " ")).withColumn("_secret", F.lit("x"))
    return sinks.allowed(sinks.without_private(rows), ["doc_id", "text", "words"], 40).withColumn("words", F.array_join("words", " "))


@query("without_forbidden_fields", "SELECT doc_id, '{\"keep\":' || n_chars || ',\"l\":[{\"n\":1}]}' AS r FROM documents")
def without_forbidden_fields(t):
    """Fields that are named body are gone at any depth."""
    nested = F.struct(F.col("n_chars").alias("keep"), F.col("text").alias("body"), F.array(F.struct(F.col("text").alias("body"), F.lit(1).alias("n"))).alias("l")).alias("r")
    return sinks.without_keys(t("documents").select("doc_id", F.col("text").alias("body"), nested), "^body$").select("doc_id", F.to_json("r").alias("r"))


@query("csv_report", "SELECT * FROM (SELECT 'lang' AS kind, lang AS key, count(*)::VARCHAR AS n, NULL AS chars FROM documents GROUP BY lang UNION ALL SELECT 'source', source, NULL, sum(n_chars)::VARCHAR FROM documents GROUP BY source)")
def csv_report(t):
    """Two tables under one header."""
    path, d = folder(t), t("documents")
    one = d.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("lang"))
    two = d.groupBy(F.col("source").alias("key")).agg(F.sum("n_chars").alias("chars")).withColumn("kind", F.lit("source"))
    sinks.csv_table([one, two], path, ["kind", "key"])
    return session(t).read.option("header", "true").csv(path)


@query("rows_and_sidecar", "SELECT split, slice, count(*)::BIGINT AS rows, count(*)::BIGINT AS written, count(*)::BIGINT AS described FROM (SELECT lang AS slice, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY ALL")
def rows_and_sidecar(t):
    """Rows and their metadata by split and slice, and the counts that were returned."""
    path = folder(t)
    rows = t("documents").select("doc_id", "text", F.col("source").alias("_source"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"), F.col("lang").alias("slice"))
    counts = sinks.by_split_and_slice(rows, path, "doc_id")
    back = [session(t).read.parquet(f"{path}/{p}").groupBy("split", "slice").agg(F.count(c).alias(n)) for p, c, n in (("rows", "text", "written"), ("meta", "source", "described"))]
    return counts.join(back[0], ["split", "slice"]).join(back[1], ["split", "slice"])


@query("exclusive_report", "SELECT count(*)::BIGINT AS rows, true AS refused FROM region")
def exclusive_report(t):
    """A report is written once; the second time is refused."""
    from pyspark.errors import AnalysisException

    path, rows = folder(t), t("region").select("r_name")
    sinks.exclusive_report(rows, path)
    try:
        sinks.exclusive_report(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    return session(t).read.json(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("refused"))


@query("path_guard", "SELECT * FROM (VALUES ('/data/open/x', false), ('/data/held', true), ('/data/held/x', true), ('/data/open/../held/y', true), ('/data/held2', false), ('/data/./held/', true)) v(path, refused)")
def path_guard(t):
    """Which paths a run that must not read /data/held refuses."""
    from ..sources.tables import ProtectedInput, guard

    def refused(path):
        try:
            guard(path, ("/data/held",))
        except ProtectedInput:
            return True
        return False

    return values(t, [(p, refused(p)) for p in ("/data/open/x", "/data/held", "/data/held/x", "/data/open/../held/y", "/data/held2", "/data/./held/")], "path string, refused boolean")


@query("row_batches", "SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16)::BIGINT AS batch FROM documents")
def row_batches(t):
    return curate.batches(t("documents").select("doc_id", "lang"), ["doc_id"], 16, ["lang"]).select("doc_id", "lang", F.col("batch").cast("long").alias("batch"))


CELLS = [("a", 90), ("b", 5), ("c", 5)]


@query("weighted_choices", "SELECT doc_id, CASE WHEN doc_id % 100 < 90 THEN 'a' WHEN doc_id % 100 < 95 THEN 'b' ELSE 'c' END AS cell FROM documents")
def weighted_choices(t):
    return t("documents").select("doc_id", split.weighted_choice(F.col("doc_id"), CELLS).alias("cell"))


@query("water_fill", "SELECT * FROM (VALUES ('a', 12::BIGINT), ('b', 4::BIGINT), ('c', 4::BIGINT)) v(cell, given)")
def water_fill(t):
    """Twenty dealt to cells of weight 90, 5 and 5, none over 12."""
    return values(t, sorted(split.water_fill(CELLS, 20, 12).items()), "cell string, given long")


@query("row_identities", "SELECT doc_id, sha256(doc_id::VARCHAR || chr(0) || lang || chr(0) || source) AS id FROM documents")
def row_identities(t):
    return t("documents").select("doc_id", keys.nul_sha256(F.col("doc_id"), F.col("lang"), F.col("source")).alias("id"))


@query("equivalence_keys", "SELECT doc_id, sha256(replace(lower(nfc_normalize(source || ' ' || lang || ' STRASSE é ẞ ß')), 'ß', 'ss')) AS key FROM documents")
def equivalence_keys(t):
    """Normal form C, then full case folding; the accent is written in two characters here."""
    return t("documents").select("doc_id", F.sha2(keys.equivalence_key(F.concat_ws(" ", "source", "lang", F.lit("Strasse é ẞ ß"))), 256).alias("key"))


@query("shape_keys", """
WITH q AS (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) || '&id=' || page_id || '&n%61me=%4a+x&' AS q FROM pages)
SELECT page_id, array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: substr(regexp_replace(url_decode(replace(p, '+', ' ')), '[0-9]', '#', 'g'), 1, 120))), '&') AS shape FROM q""")
def shape_keys(t):
    q = F.concat(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&id="), F.col("page_id").cast("string"), F.lit("&n%61me=%4a+x&"))
    return t("pages").select("page_id", keys.shape_key(q).alias("shape"))


WIRES = [("GET / HTTP/1.1", "valid"), ("caf\\xE9", "cut"), ("\\xFF\\xFEz", "cut")]


@query("backslash_rendered", "SELECT * FROM (VALUES (0, 'GET / é'), (1, 'caf\\xe9!'), (2, '\\xff\\xfez')) v(i, text)")
def backslash_rendered(t):
    """Bytes as text; what is no UTF-8 as \\xNN."""
    rows = values(t, [(0, bytearray("GET / é".encode())), (1, bytearray(b"caf\xe9!")), (2, bytearray(b"\xff\xfez"))], "i int, wire binary")
    return rows.select("i", protocol.backslash_rendered("wire").alias("text"))


@query("media_types", "SELECT doc_id, 'text/' || lang AS media, CASE WHEN doc_id % 2 = 0 THEN 'charset=UTF-8; q=1' END AS parameters FROM documents")
def media_types(t):
    kind, parameters = protocol.media_parts(F.concat(F.lit(" Text/"), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, " ; charset=UTF-8; q=1").otherwise("")))
    return t("documents").select("doc_id", kind.alias("media"), parameters.alias("parameters"))


@query("masked_spans", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(source) > 2 THEN NULL WHEN doc_id % 3 = 0 THEN NULL ELSE ' VALUE ' || substr(source, 2) END AS masked FROM documents")
def masked_spans(t):
    """The first character masked; overlapping spans give null."""
    one = F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))
    spans = F.when(F.col("doc_id") % 3 == 0, F.array(one, F.struct(F.lit(0).alias("a"), F.lit(2).alias("b")))).otherwise(F.array(one))
    return t("documents").select("doc_id", protocol.masked_spans("source", spans).alias("masked"))


@query("neutral_paths", "SELECT page_id, 'GET /' || regexp_extract(url, '(\\?.*)$', 1) || ' HTTP/1.1' AS request FROM pages")
def neutral_paths(t):
    return t("pages").select("page_id", protocol.neutral_path(F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1"))).alias("request"))


DATES = [(d,) for d in ("Sun, 06 Nov 1994 08:49:37 GMT", "Mon, 06 Nov 1994 08:49:37 GMT", "Sun, 6 Nov 1994 08:49:37 GMT", "x", "Thu, 29 Feb 2024 00:00:00 GMT", "Fri, 30 Feb 2024 00:00:00 GMT")]


@query("http_dates", f"SELECT d, strftime(CASE WHEN strftime(try_strptime(d, '%a, %d %b %Y %H:%M:%S GMT'), '%a, %d %b %Y %H:%M:%S GMT') = d THEN try_strptime(d, '%a, %d %b %Y %H:%M:%S GMT') END, '%Y-%m-%d %H:%M:%S') AS at FROM {values_sql(DATES, 'd')}")
def http_dates(t):
    return values(t, DATES, "d string").select("d", F.date_format(protocol.http_date(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("sanitised_labels", "SELECT source, CASE WHEN regexp_matches(source, '^[a-z0-9_]{1,32}$') THEN source ELSE 'other' END AS label, CASE WHEN regexp_matches(upper(source), '^[a-z0-9_]{1,32}$') THEN upper(source) ELSE 'other' END AS upper_label FROM documents GROUP BY source")
def sanitised_labels(t):
    s = t("documents").select("source").distinct()
    return s.select("source", protocol.sanitised(F.col("source")).alias("label"), protocol.sanitised(F.upper("source")).alias("upper_label"))


@query("token_budgets", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1000 THEN 'WITHIN' WHEN octet_length(encode(text)) > 4000 THEN 'OVER' ELSE 'NEEDS_EXACT_COUNT' END AS size FROM documents")
def token_budgets(t):
    return t("documents").select("doc_id", protocol.size_class(F.octet_length("text"), 1000, 4).alias("size"))


AUGMENTED = [(i, g, "a b") for i, g in enumerate("abcdefgh")]


@query("augmented_variants", f"SELECT i, CASE {h60('g')} % 4 WHEN 0 THEN 'a%20b' WHEN 1 THEN 'A B' WHEN 2 THEN 'a/**/b' ELSE 'a' || chr(9) || 'b' END AS variant FROM {values_sql(AUGMENTED, 'i, g, x')}")
def augmented_variants(t):
    """Variants that mean the same; a group's members all get the same kind."""
    return values(t, AUGMENTED, "i int, g string, x string").select("i", protocol.augmented(F.col("x"), F.col("g")).alias("variant"))


WIRE_ROWS = [
    ("GET / HTTP/1.1\r\nHost: a\r\n\r\n", "GET", None), ("POST /x HTTP/1.1\r\nHost: a\r\nContent-Length: 3\r\n\r\nabc", "POST", None), ("POST /x HTTP/1.1\r\nHost: a\r\nContent-Length: 4\r\n\r\nabc", "POST", "body_incomplete"), ("GET / HTTP/1.1\r\n\r\n", "GET", "host"),
    ("GET / HTTP/1.1\r\nHost: a\r\nTransfer-Encoding: chunked\r\n\r\n1\r\na\r\n0\r\n\r\n", "GET", None), ("GET / HTTP/1.1\r\nHost: a\r\nTransfer-Encoding: chunked\r\nContent-Length: 1\r\n\r\n", "GET", "length_and_coding"), ("G T / HTTP/1.1\r\n\r\n", None, "request_line"), ("GET / HTTP/1.1\r\nHost: a\r\n x\r\n\r\n", "GET", "obs_fold"),
]


@query("wire_grammar", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(m)}, {quoted(r)})" for i, (_, m, r) in enumerate(WIRE_ROWS)) + ") v(i, method, reject)")
def wire_grammar(t):
    """Well-formed requests and one of several faults each, with the reason that the grammar gives."""
    rows = values(t, [(i, bytearray(w.encode())) for i, (w, _, _) in enumerate(WIRE_ROWS)], "i int, wire binary").withColumn("r", protocol.http1_request("wire"))
    return rows.select("i", F.col("r.method").alias("method"), F.col("r.reject").alias("reject"))


def packed_bodies() -> Iterator[tuple]:
    import gzip
    import zlib

    yield 0, "gzip", bytearray(gzip.compress(b"hello", mtime=0))
    yield 1, "deflate", bytearray(zlib.compress(b"hello"))
    yield 2, "deflate", bytearray(zlib.compress(b"hello")[2:-4])
    yield 3, None, bytearray(b"hello")
    yield 4, "br", bytearray(b"x")
    yield 5, "gzip", bytearray(b"nonsense")
    yield 6, "gzip", bytearray(gzip.compress(b"a" * (1 << 21), mtime=0))
    yield 7, "zstd", bytearray.fromhex("28b52ffd2005290000" + b"hello".hex())  # one frame with one raw block
    yield 8, "zstd", bytearray(b"nonsense")


@query("decoded_bodies", "SELECT * FROM (VALUES (0, 'hello', NULL), (1, 'hello', NULL), (2, 'hello', NULL), (3, 'hello', NULL), (4, NULL, 'unsupported'), (5, NULL, 'corrupt'), (6, NULL, 'too_large'), (7, 'hello', NULL), (8, NULL, 'corrupt')) v(i, body, reject)")
def decoded_bodies(t):
    rows = values(t, list(packed_bodies()), "i int, coding string, body binary").withColumn("r", protocol.decoded_body("coding", "body"))
    return rows.select("i", F.decode("r.body", "UTF-8").alias("body"), F.col("r.reject").alias("reject"))
