"""Streaming jobs that keep files: rotation with counted outcomes, a switch read for each batch, a tail by byte offset."""

import json
import math
import os

from pyspark.sql import functions as F

from lumenfold.operators import evaluate
from lumenfold.streaming import jobs


def source(spark, tmp_path, batches):
    """A stream with one file a micro-batch."""
    for k, rows in enumerate(batches):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{k:03d}.json").write_text("".join(json.dumps({"i": i, "t": t}) + "\n" for i, t in rows))
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + 10 * k,) * 2)  # files are taken by age
    return spark.readStream.schema("i long, t string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_rotating_sink_counts_what_it_drops(spark, tmp_path):
    rows = [[(k * 10 + i, "x" * (500 if i == 2 else 5)) for i in range(6)] for k in range(3)]
    stream = source(spark, tmp_path, rows)
    out = str(tmp_path / "out")
    jobs.rotating_sink(stream, out, str(tmp_path / "check"), 4, 700, ["i"], keep=2).awaitTermination()
    kept = {r["i"] for r in spark.read.schema("i long, t string").json(f"{out}/batch=*").collect()}
    assert kept == {10, 11, 12, 13, 20, 21, 22, 23}
    got = {r["outcome"]: r["n"] for r in jobs.outcomes(spark, out).collect()}
    assert got == {"WRITTEN": 12, "DROPPED_ITEMS": 6}
    tight = str(tmp_path / "tight")
    jobs.rotating_sink(stream, tight, str(tmp_path / "check2"), 100, 300, ["i"]).awaitTermination()
    got = {r["outcome"]: r["n"] for r in jobs.outcomes(spark, tight).collect()}
    assert got == {"WRITTEN": 6, "DROPPED_BYTES": 12}


def test_switch_is_read_for_each_run(spark, tmp_path):
    stream, flag = source(spark, tmp_path, [[(1, "a")]]), tmp_path / "rollback"
    out, check = str(tmp_path / "modes"), str(tmp_path / "check")
    jobs.switched(stream, str(flag), out, check, "rollback", "v5").awaitTermination()
    flag.write_text("")
    (tmp_path / "in" / "900.json").write_text('{"i": 2, "t": "b"}\n')
    jobs.switched(stream, str(flag), out, check, "rollback", "v5").awaitTermination()
    assert {(r["i"], r["mode"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()} == {(1, "v5"), (2, "rollback")}


def test_tail_reads_complete_lines_once(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes("één\ntwo\npart".encode())
    (folder / "b.log").write_bytes(b"")
    lines, offsets = jobs.log_tail(spark, str(folder))
    assert {(r["file"], r["at"], r["line"]) for r in lines.collect()} == {("a.log", 0, "één"), ("a.log", 6, "two")}
    known = {r["file"]: r["offset"] for r in offsets.collect()}
    assert known == {"a.log": 10}  # Spark lists no empty files; their offset is 0
    with open(folder / "a.log", "ab") as f:
        f.write("ial\n\nlast".encode())
    (folder / "b.log").write_bytes(b"x\n")
    lines, offsets = jobs.log_tail(spark, str(folder), spark.createDataFrame(list(known.items()), "file string, offset long"))
    assert sorted((r["file"], r["at"], r["line"]) for r in lines.collect()) == [("a.log", 10, "partial"), ("a.log", 18, ""), ("b.log", 0, "x")]
    (folder / "a.log").write_bytes(b"new\n")
    lines, _ = jobs.log_tail(spark, str(folder), spark.createDataFrame([("a.log", 19), ("b.log", 2)], "file string, offset long"))
    assert [(r["file"], r["line"]) for r in lines.collect()] == [("a.log", "new")]


def test_clopper_pearson_matches_binomial_tails(spark):
    rows = [(0, 5), (5, 5), (1, 10), (30, 100), (7, 8), (0, 0)]
    x = evaluate.clopper_pearson(F.col("k"), F.col("n"))
    got = {(r["k"], r["n"]): (r["low"], r["high"]) for r in spark.createDataFrame(rows, "k long, n long").select("k", "n", x["low"].alias("low"), x["high"].alias("high")).collect()}
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    for (k, n), (low, high) in got.items():
        assert low == 0.0 if k == 0 else abs(tail(k, n, low) - 0.025) < 1e-9
        assert high == 1.0 if k == n else abs(1 - tail(k + 1, n, high) - 0.025) < 1e-9
