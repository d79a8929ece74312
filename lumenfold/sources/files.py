"""Readers of files: strict and tolerant JSON lines, verified bytes, delimited text, corpora, logs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.decide import wire_sections


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad one fails the read. Lines end at LF (a CR before it is allowed), not at other separators."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def jsonl_counted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but a bad line is a row with its text in _corrupt_record, to be counted."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("lineSep", "\n").json(path)


def raw_filtered(spark: SparkSession, path: str, contains: str, schema: str) -> DataFrame:
    """Tests the raw line before it is parsed: other lines are never parsed."""
    return spark.read.text(path).where(F.contains("value", F.lit(contains))).select(F.from_json("value", schema).alias("r")).select("r.*")


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, status, content) of the files that a manifest (name, sha256, bytes) lists: ok, sha_mismatch, bytes_mismatch, missing, malformed or unsafe_path.
    What is hashed is what is returned: one read of the bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = F.lit(path.rstrip("/").split(":")[-1] + "/")
    named = files.select(F.element_at(F.split("path", base), -1).alias("name"), "content", F.sha2("content", 256).alias("_h"), F.length("content").alias("_b"))
    j = manifest.join(named, "name", "left")
    status = (
        F.when(F.col("name").rlike(r"(^/)|(^|/)\.\.(/|$)"), "unsafe_path").when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | F.col("bytes").isNull(), "malformed")
        .when(F.col("_h").isNull(), "missing").when(F.col("_b") != F.col("bytes"), "bytes_mismatch").when(F.col("_h") != F.col("sha256"), "sha_mismatch").otherwise("ok")
    )
    return j.select("name", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))


def request_csv(spark: SparkSession, path: str) -> DataFrame:
    """method, path, query, label, malformed of a labelled request log (Method, URL, classification); a null method or url is malformed."""
    rows = spark.read.option("header", "true").csv(path, schema="Method string, URL string, classification string")
    url = F.regexp_replace("URL", r" HTTP/[0-9.]+$", "")
    bare = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    return rows.select(
        F.col("Method").alias("method"), F.substring_index(bare, "?", 1).alias("path"), F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("").alias("query"),
        F.nullif(F.trim("classification"), F.lit("")).alias("label"), (F.col("Method").isNull() | F.col("URL").isNull()).alias("malformed"),
    )


def tsv_with_reasons(spark: SparkSession, path: str) -> DataFrame:
    """id, lang, text, date, reason of four-column lines; a bad line keeps its reason and loses nothing."""
    raw = spark.read.text(path).select("value", F.split("value", "\t").alias("c"))
    c = lambda i: F.get("c", F.lit(i))
    reason = (
        F.when(F.contains("value", F.lit("�")), "invalid_utf8").when(F.size("c") != 4, "columns").when(~c(0).rlike("^[0-9]+$"), "id").when(~c(1).rlike("^[a-z]{2,3}$"), "lang")
    )
    return raw.select(F.expr("try_cast(c[0] as bigint)").alias("id"), c(1).alias("lang"), c(2).alias("text"), F.nullif(F.trim(c(3)), F.lit("")).alias("date"), reason.alias("reason"), "value")


def bindings(spark: SparkSession, path: str) -> DataFrame:
    """item, label, reason: result bindings of a query service's JSON, exploded; a malformed binding keeps a reason."""
    b = spark.read.schema("results struct<bindings: array<struct<item: struct<value: string>, itemLabel: struct<value: string>>>>").option("multiLine", "true").json(path)
    x = b.select(F.explode("results.bindings").alias("b")).select(F.col("b.item.value").alias("item"), F.col("b.itemLabel.value").alias("label"))
    return x.withColumn("reason", F.when(F.col("item").isNull() | F.col("label").isNull(), "malformed_binding"))


def fenced_blocks(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """file, block (from 0), language, body: the fenced blocks of a tree of Markdown files."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    fence = r"(?s)```([A-Za-z0-9_+-]*)\n(.*?)```"
    both = texts.select(F.col("_metadata.file_name").alias("file"), F.regexp_extract_all("value", F.lit(fence), 1).alias("l"), F.regexp_extract_all("value", F.lit(fence), 2).alias("b"))
    return both.select("file", F.posexplode(F.arrays_zip("l", "b")).alias("block", "x")).select("file", "block", F.col("x.l").alias("language"), F.col("x.b").alias("body"))


@F.udtf(returnType="entry string, section string, value string")
class SectionedLog:
    """Sections of a zip of audit logs: lines '--id-A--' open section A of a transaction."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import io
        import re
        import zipfile

        mark = re.compile(r"^--([0-9a-fA-F]+)-([A-Z])--$")
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            for name in sorted(z.namelist()):
                entry = section = None
                lines: list[str] = []
                for line in [*z.read(name).decode("utf-8", "replace").split("\n"), "--0-Z--"]:
                    m = mark.match(line.rstrip("\r"))
                    if not m:
                        lines.append(line)
                        continue
                    if section and section != "Z":
                        yield entry, section, "\n".join(lines)
                    (entry, section), lines = m.groups(), []


@F.udtf(returnType="sheet string, row int, cell string, value string")
class Workbook:
    """Cells of an xlsx file, shared strings resolved."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            texts = []
            if "xl/sharedStrings.xml" in z.namelist():
                root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
                texts = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in root]
            for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                for c in ElementTree.fromstring(z.read(name)).iter():
                    if c.tag.endswith("}c"):
                        value = next((v.text for v in c if v.tag.endswith("}v")), None)
                        place = c.get("r", "")
                        value = texts[int(value)] if c.get("t") == "s" and value is not None else value
                        yield name, int(re.sub(r"\D", "", place) or 0), place, value


def yaml_leaves(text: str) -> list[tuple[str, str]]:
    """(path, value) of the leaves of the plain YAML that corpora use: nested maps, lists of maps or scalars, quoted and bare scalars, comments, literal ('|')
    and folded ('>') blocks with their indentation. Anchors, tags, flow collections and tabs as indentation raise ValueError."""
    import re

    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}
    out: list[tuple[str, str]] = []
    block = None  # [indent of its key, path, folded, chomped, lines]

    def close():
        lines = block[4]
        while lines and not lines[-1].strip():
            lines.pop()
        own = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
        lines = [x[own:] for x in lines]
        joined = "\n".join(lines)
        if block[2]:
            joined = re.sub(r"(?<=[^\n])\n(?=[^\n ])", " ", joined)
            joined = re.sub(r"\n(\n+)", r"\1", joined)
        out.append((block[1], joined + ("" if block[3] or not lines else "\n")))

    def scalar(value: str) -> str:
        quoted = re.match(r"""('(?:[^']|'')*'|"(?:[^"\\]|\\.)*")\s*(?:#.*)?$""", value)
        if quoted and value[0] == "'":
            return quoted.group(1)[1:-1].replace("''", "'")
        if quoted:
            import json

            return json.loads(re.sub(r"\\x([0-9A-Fa-f]{2})", r"\\u00\1", quoted.group(1)))
        value = re.split(r"\s+#", value, maxsplit=1)[0].rstrip()
        if value[:1] in "&*!{[%@`" and value not in ("{}", "[]"):
            raise ValueError(f"not plain: {value}")
        return value

    for line in [*text.split("\n"), "..."]:
        line = line.rstrip("\r")
        indent = len(line) - len(line.lstrip(" "))
        if block:
            if line.strip() and indent <= block[0]:
                close()
                block = None
            else:
                block[4].append(line)
                continue
        if line[indent : indent + 1] == "\t":
            raise ValueError("a tab as indentation")
        plain = line.strip()
        if not plain or plain.startswith("#") or plain in ("---", "..."):
            continue
        while plain.startswith("- ") or plain == "-":
            while stack and stack[-1][0] >= indent:
                stack.pop()
            parent = "/".join(k for _, k in stack)
            counts[parent] = counts.get(parent, -1) + 1
            stack.append((indent, str(counts[parent])))
            rest = plain[1:]
            indent, plain = indent + 1 + len(rest) - len(rest.lstrip(" ")), rest.strip()
        if not plain:
            continue
        m = re.match(r"""("[^"]*"|'[^']*'|[^"'{\[&*!][^:]*?|[^"'{\[&*!]):(?:\s+(.*))?$""", plain)
        key, value = (m.group(1).strip("\"' "), m.group(2)) if m else (None, plain)
        while stack and stack[-1][0] >= indent:
            stack.pop()
        path = "/".join([*(k for _, k in stack), *([key] if key is not None else [])])
        head = re.match(r"([|>])([+-]?)$", value or "")
        if head:
            block = [indent, path, head.group(1) == ">", head.group(2) == "-", []]
        elif value and not value.startswith("#"):
            out.append((path, scalar(value)))
        elif key is not None:
            stack.append((indent, key))
    return out


@F.udtf(returnType="path string, value string, reason string")
class YamlLeaves:
    """Leaves of a YAML file (see yaml_leaves); a file that can't be read is one row with the reason."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for path, value in yaml_leaves(bytes(content).decode("utf-8")):
                yield path, value, None
        except ValueError as e:
            yield None, None, f"unparseable: {e}"[:200]


def exploded_files(spark: SparkSession, path: str, glob: str, reader, name: str) -> DataFrame:
    """file and what a table function (SectionedLog, Workbook, YamlLeaves) makes of each file's bytes. name: to register it by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return exploded(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"), reader, name)


def exploded(files: DataFrame, reader, name: str) -> DataFrame:
    """The same of a table (file, content)."""
    spark = files.sparkSession
    spark.udtf.register(name, reader)
    files.select("file", "content").createOrReplaceTempView(f"{name}_files")
    return spark.sql(f"SELECT f.file, t.* FROM {name}_files f, LATERAL {name}(f.content) t")


def one_hot_labels(rows: DataFrame, row_id: str, labels: list[str]) -> DataFrame:
    """row_id, labels: the sorted names of the 0/1 columns that are 1, and combination, joined by ' + '."""
    named = F.array_sort(F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in labels]), lambda x: x.isNotNull()))
    return rows.select(row_id, named.alias("labels"), F.array_join(named, " + ").alias("combination"))


def human_labels(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, label: an empty label is PENDING, never a default class."""
    rows = spark.read.option("header", "true").csv(path, schema="sample_id string, label string")
    return rows.select("sample_id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("PENDING")).alias("label"))


def log_fields(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """value, and for each field the number that its pattern's first group finds in the line, or null."""
    return spark.read.text(path).select("value", *[F.expr(f"try_cast(regexp_extract(value, '{p}', 1) as double)").alias(n) for n, p in fields.items()])


def prometheus(spark: SparkSession, path: str) -> DataFrame:
    """name, labels, value of a metrics text; histogram series are left out."""
    line = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})? ([^ ]+)$"
    x = spark.read.text(path).where("value not like '#%'").select(*[F.regexp_extract("value", line, i).alias(n) for i, n in ((1, "name"), (2, "_l"), (3, "_v"))])
    x = x.where(F.col("name") != "").where(~F.col("name").rlike("_(bucket|sum|count)$"))
    one = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    names, values = (F.regexp_extract_all("_l", F.lit(one), F.lit(i)) for i in (1, 2))
    plain = F.transform(values, lambda v: F.replace(F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\")))
    return x.select("name", F.map_from_arrays(names, plain).alias("labels"), F.expr("try_cast(_v as double)").alias("value"))


def run_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run (file name without suffix) and the fields of each run's JSON document."""
    x = spark.read.schema(schema).option("multiLine", "true").json(path)
    return x.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("run"), *x.columns)


def key_values(line: Column) -> Column:
    return wire_sections(line)


def synthetic(spark: SparkSession, n: int, salt: str, kinds: list[str]) -> DataFrame:
    """n deterministic rows (id, kind, key): hash-derived, the same at any parallelism."""
    from ..functions.keys import hash60

    h = hash60(F.concat(F.lit(salt + "|"), F.col("id").cast("string")))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (h % len(kinds) + 1).cast("int"))
    return spark.range(n).select("id", kind.alias("kind"), F.sha2(F.concat(F.lit(salt + "|k|"), F.col("id").cast("string")), 256).alias("key"))
