import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import files, sinks, tables


def put(tmp_path, name, content):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"a": "x y"}\r\n\n{"a": "z"}\n')
    assert {r["a"] for r in files.jsonl(spark, path, "a string").collect()} == {"x y", "z"}
    bad = put(tmp_path, "b.jsonl", '{"a": "x"}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl(spark, bad, "a string").collect()
    assert [r["_corrupt_record"] for r in files.jsonl_counted(spark, bad, "a string").collect()] == [None, "not json"]
    assert files.raw_filtered(spark, bad, '"x"', "a string").count() == 1


def test_verified(spark, tmp_path):
    for n, c in (("m/ok.txt", "one"), ("m/sha.txt", "two"), ("m/long.txt", "three")):
        put(tmp_path, n, c)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("ok.txt", sha("one"), 3), ("sha.txt", sha("owt"), 3), ("long.txt", sha("three"), 4), ("gone.txt", sha("x"), 1), ("../x", sha("x"), 1), ("m.txt", "nothex", 1)]
    got = {r["name"]: r["status"] for r in files.verified(spark, str(tmp_path / "m"), spark.createDataFrame(rows, "name string, sha256 string, bytes long")).collect()}
    assert got == {"ok.txt": "ok", "sha.txt": "sha_mismatch", "long.txt": "bytes_mismatch", "gone.txt": "missing", "../x": "unsafe_path", "m.txt": "malformed"}
    assert files.verified(spark, str(tmp_path / "m"), sinks.manifest(spark, str(tmp_path / "m"))).where("status <> 'ok'").count() == 0


def test_delimited(spark, tmp_path):
    path = put(tmp_path, "log.csv", "Method,URL,classification\nGET,http://h:1/a/b?x=1 HTTP/1.1,1\n,,0\n")
    rows = files.request_csv(spark, path).collect()
    assert (rows[0]["path"], rows[0]["query"], rows[0]["malformed"], rows[1]["malformed"]) == ("/a/b", "x=1", False, True)
    path = put(tmp_path, "s.tsv", "1\teng\tHi\t\nx\teng\tHo\t\n2\teng\n")
    assert [r["reason"] for r in files.tsv_with_reasons(spark, path).collect()] == [None, "id", "columns"]
    path = put(tmp_path, "h.csv", "sample_id,label\na,VERIFIABLE\nb, \n")
    assert {r["label"] for r in files.human_labels(spark, path).collect()} == {"VERIFIABLE", "PENDING"}


def test_nested(spark, tmp_path):
    path = put(tmp_path, "b.json", '{"results": {"bindings": [{"item": {"value": "i"}, "itemLabel": {"value": "l"}}, {"item": {"value": "j"}}]}}')
    assert [r["reason"] for r in files.bindings(spark, path).collect()] == [None, "malformed_binding"]
    put(tmp_path, "docs/x.md", "a\n```sh\nls\n```\nb\n```\nplain\n```\n")
    assert [(r["language"], r["body"]) for r in files.fenced_blocks(spark, str(tmp_path / "docs")).collect()] == [("sh", "ls\n"), ("", "plain\n")]
    put(tmp_path, "runs/r1.json", '{"n": 3}')
    assert files.run_documents(spark, str(tmp_path / "runs"), "n long").collect()[0].asDict() == {"run": "r1", "n": 3}


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("audit.log", "--ab12-A--\nhead\n--ab12-B--\nGET /\n--ab12-Z--\n")
    put(tmp_path, "z/a.zip", buffer.getvalue())
    got = files.exploded_files(spark, str(tmp_path / "z"), "*.zip", files.SectionedLog, "sectioned").collect()
    assert [(r["entry"], r["section"], r["value"]) for r in got] == [("ab12", "A", "head"), ("ab12", "B", "GET /")]
    put(tmp_path, "y/a.yaml", "tests:\n  - id: 1\n    stages:\n      - uri: \"/x\"\n      - uri: /y\n  - id: 2\nbody: |\n  two\n  lines\n")
    got = files.exploded_files(spark, str(tmp_path / "y"), "*.yaml", files.YamlLeaves, "leaves").collect()
    assert [(r["path"], r["value"]) for r in got] == [("tests/0/id", "1"), ("tests/0/stages/0/uri", "/x"), ("tests/0/stages/1/uri", "/y"), ("tests/1/id", "2"), ("body", "two\nlines\n")]
    put(tmp_path, "y/b.yaml", "a: &x 1\nb: *x\n")
    got = files.exploded_files(spark, str(tmp_path / "y"), "b.yaml", files.YamlLeaves, "leaves").collect()
    assert [(r["path"], r["reason"][:12]) for r in got] == [(None, "unparseable:")]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="urn:x"><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="urn:x"><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>4</v></c></row></w>')
    put(tmp_path, "x/a.xlsx", buffer.getvalue())
    got = files.exploded_files(spark, str(tmp_path / "x"), "*.xlsx", files.Workbook, "workbook").collect()
    assert [(r["cell"], r["value"]) for r in got] == [("A1", "hello"), ("B1", "4")]


def test_logs(spark, tmp_path):
    path = put(tmp_path, "l.log", "took 12.5 ms\nnothing\n")
    assert [r["ms"] for r in files.log_fields(spark, path, {"ms": "took ([0-9.]+) ms"}).collect()] == [12.5, None]
    path = put(tmp_path, "m.txt", '# HELP x\nup{job="a",zone="b"} 1\nh_bucket{le="1"} 3\nq 2.5\n')
    got = {r["name"]: (r["labels"], r["value"]) for r in files.prometheus(spark, path).collect()}
    assert got["up"] == ({"job": "a", "zone": "b"}, 1.0) and set(got) == {"up", "q"}
    row = spark.createDataFrame([("a=1 b=2 c",)], "v string").select(files.key_values(F.col("v")).alias("m")).first()
    assert row["m"] == {"a": "1", "b": "2", "c": None}


def test_one_hot(spark):
    d = spark.createDataFrame([(1, 1, 0, 1), (2, 0, 0, 0)], "id long, b int, c int, a int")
    assert [r["combination"] for r in files.one_hot_labels(d, "id", ["b", "c", "a"]).orderBy("id").collect()] == ["a + b", ""]


def test_synthetic(spark):
    a = files.synthetic(spark, 50, "s", ["x", "y"]).orderBy("id").collect()
    assert a == files.synthetic(spark, 50, "s", ["x", "y"]).repartition(7).orderBy("id").collect()


def test_sinks(spark, tmp_path):
    d = spark.range(100).select("id", F.lit("s").alias("_private"), F.struct(F.lit(1).alias("keep"), F.lit(2).alias("body")).alias("r"), F.array(F.struct(F.lit(3).alias("body"), F.lit(4).alias("n"))).alias("l"))
    one = sinks.sorted_jsonl(d.select("id"), str(tmp_path / "a"), ["id"], 3).first()
    two = sinks.sorted_jsonl(d.select("id").repartition(5), str(tmp_path / "b"), ["id"], 2).first()
    assert one == two and one["rows"] == 100
    sinks.exclusive_report(d.select("id"), str(tmp_path / "r"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.exclusive_report(d.select("id"), str(tmp_path / "r"))
    assert sinks.without_private(d).columns == ["id", "r", "l"]
    clean = sinks.without_keys(d, "^body$").first()
    assert clean["r"].asDict() == {"keep": 1} and clean["l"][0].asDict() == {"n": 4}
    assert sinks.allowed(d.withColumn("t", F.repeat(F.lit("x"), 999)), ["id", "t"]).first()["t"] == "x" * 256
    counts = sinks.by_split_and_slice(d.select("id", "_private", F.lit("train").alias("split"), F.lit("s").alias("slice")), str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p/rows")).columns == ["id", "split", "slice"] and counts.first()["rows"] == 100
    assert spark.read.parquet(str(tmp_path / "p/meta")).where("private = 's'").count() == 100
    assert sinks.csv_table([d.select("id"), d.select("id", F.lit(1).alias("x"))], str(tmp_path / "c"), ["id"]) == ["id", "x"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).where("x is null").count() == 100


def test_guard():
    assert tables.guard("/data/open/x") == "/data/open/x"
    with pytest.raises(tables.ProtectedInput):
        tables.guard("/data/open/../held/x", ("/data/held",))


def test_yaml_leaves():
    text = "a:\n  - 'it''s'\n  - \"x\\ty\" # comment\n  -\n    b: |-\n      def f():\n        return 1\n\n      f()\n    c: >\n      one\n      two\n\n      three\nd: {}\ne: http://x:1/y #z\n"
    assert files.yaml_leaves(text) == [("a/0", "it's"), ("a/1", "x\ty"), ("a/2/b", "def f():\n  return 1\n\nf()"), ("a/2/c", "one two\nthree\n"), ("d", "{}"), ("e", "http://x:1/y")]
    for bad in ("a: &x 1", "a: [1, 2]", "\ta: 1", "a: !t x"):
        with pytest.raises(ValueError):
            files.yaml_leaves(bad)


def test_metric_labels_keep_commas_and_escapes(spark, tmp_path):
    path = put(tmp_path, "m.txt", 'up{job="a,b",path="C:\\\\x \\"q\\""} 1\nplain 2\n')
    got = {r["name"]: r["labels"] for r in files.prometheus(spark, path).collect()}
    assert got == {"up": {"job": "a,b", "path": 'C:\\x "q"'}, "plain": {}}


def test_shared_folder_is_required_on_clusters(spark):
    from lumenfold import storage

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://h:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
