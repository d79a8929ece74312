"""Gates: assertions over tables as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bind, hash60
from ..functions.stats import ratio
from ..storage import materialize


def leakage(rows: DataFrame, key: str, split: str, train: str) -> DataFrame:
    """For each other split: rows, distinct keys, and rows whose key train has. Keys are hashed before they are shuffled, and counted by key first."""
    hashed = rows.select(F.sha2(key, 256).alias("k"), F.col(split).alias("split"))
    by_key = hashed.groupBy("k", "split").agg(F.count(F.lit(1)).alias("n"))
    in_train = by_key.where(F.col("split") == train).select("k", F.lit(True).alias("hit"))
    other = by_key.where(F.col("split") != train).join(in_train, "k", "left")
    sums = other.groupBy("split").agg(F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).cast("long").alias("leaked"))
    return sums.withColumn("leakage_rate", F.round(ratio(F.col("leaked"), F.col("n_rows")), 6))


def label_consistency(rows: DataFrame, key: str, label: str, split: str) -> DataFrame:
    """One row: keys, keys with more than one label, those of them that span splits, and their rows."""
    by_key = rows.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.min(split).alias("s0"), F.max(split).alias("s1"), F.count(F.lit(1)).alias("n"))
    bad = F.col("lo") != F.col("hi")
    return by_key.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(bad).alias("conflicts"), F.count_if(bad & (F.col("s0") != F.col("s1"))).alias("across_splits"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).cast("long").alias("conflict_rows"),
    )


def identity_splits(rows: DataFrame, keys: list[str], split: str) -> DataFrame:
    """How many identities live in which set of splits."""
    sets = rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"))
    return sets.groupBy("splits").agg(F.count(F.lit(1)).alias("n_keys"))


#: A side of a join is broadcast up to so many rows (of a key and an id each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
#: Probes that no run of words identifies are searched in one scan of the rows for each so many bytes of them.
PROBE_BYTES = 32 << 20


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if its rows are at most limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def run_hashes(words: Column, n: int) -> Column:
    """Hash of each run of n consecutive words, in order; empty for fewer words. Each word is hashed once."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
    return bind(hashed, lambda h: F.when(F.size(h) >= n, runs(h)).otherwise(F.array().cast("array<bigint>")))


class Runs:
    """Hashes of runs of consecutive words, in numpy: a word is hashed once while it is remembered, a run's hash is a weighted sum of its words'."""

    def __init__(self, pattern: str | None):
        import re

        self.find, self.memo = re.compile(pattern).findall if pattern else None, {}

    def words(self, text: str) -> list[str]:
        return self.find(text.lower()) if self.find else text.split(" ")

    def hashes(self, words: list[str]):
        import hashlib

        import numpy as np

        memo = self.memo
        if len(memo) > 1_000_000:
            memo.clear()
        for w in (w for w in set(words) if w not in memo):
            memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def of(hashes, n: int):
        """Hash of each run of n."""
        import numpy as np

        at = len(hashes) - n + 1
        out, weight = np.zeros(max(at, 0), dtype=np.uint64), 1
        for k in range(n if at > 0 else 0):
            weight = weight * 0x9E3779B97F4A7C15 % 2**64
            out += hashes[k : k + at] * np.uint64(weight)
        return out


def met_by_runs(rows: DataFrame, row_id: str, wanted: dict[int, dict[int, list]], item_type, pattern: str | None) -> DataFrame:
    """(row_id, _i): candidates, rows with a run of words whose hash is wanted: {length: {hash: items}}, a bounded table that is broadcast. Rows' runs never leave
    their task. pattern finds the words of a lower-case text; None: what stands between single spaces."""
    import numpy as np
    import pyarrow as pa

    tables = {n: (np.array(sorted(of), dtype=np.uint64), [of[h] for h in sorted(of)]) for n, of in wanted.items()}
    shared = rows.sparkSession.sparkContext.broadcast(tables)
    kind = pa.int64() if item_type.typeName() == "long" else pa.int32() if item_type.typeName() == "integer" else pa.string()

    def run(batches):
        runs = Runs(pattern)
        for batch in batches:
            found = set()
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    h = runs.hashes(runs.words(text))
                    for n, (known, items) in shared.value.items():
                        own = Runs.of(h, n)
                        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        found.update((row, i) for k in np.unique(at[known[at] == own]).tolist() for i in items[k])
            if found:
                found = sorted(found, key=lambda x: x[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found])), pa.array([i for _, i in found], kind)], [row_id, "_i"])

    id_type = rows.schema[row_id].dataType.simpleString()
    return rows.select(row_id, "text").mapInArrow(run, f"{row_id} {id_type}, _i {item_type.simpleString()}").distinct()


def contains_join(rows: DataFrame, row_id: str, probes: DataFrame, probe_id: str) -> DataFrame:
    """(probe_id, row_id) of all rows whose text contains a probe of one character or more.

    A probe with three words between spaces is found by the hash of the first such three, and contains() verifies. While probes are few, their hashes are
    broadcast and rows are read where they are; beyond, rows' runs of three words meet them in an equi join. Other probes are searched by one
    automaton in each task, which reads a text once whatever their number.
    """
    inner = F.slice(F.split("probe", " "), F.lit(2), F.greatest(F.size(F.split("probe", " ")) - 2, F.lit(0)))
    keyed = probes.where(F.length("probe") > 0).select(probe_id, "probe", F.when(F.size(inner) >= 3, F.slice(inner, 1, 3)).alias("_k"))
    anchored = keyed.where("_k is not null")
    if anchored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        runs, wanted = Runs(None), {}
        for i, words in anchored.select(probe_id, "_k").collect():
            wanted.setdefault(int(Runs.of(runs.hashes(list(words)), 3)[0]), []).append(i)
        hit = met_by_runs(rows, row_id, {3: wanted} if wanted else {}, probes.schema[probe_id].dataType, None).withColumnRenamed("_i", probe_id)
    else:
        theirs = rows.select(row_id, F.explode(F.array_distinct(run_hashes(F.split("text", " "), 3))).alias("_h"))
        hit = theirs.join(anchored.select(probe_id, F.get(run_hashes(F.col("_k"), 3), F.lit(0)).alias("_h")), "_h").select(row_id, probe_id).distinct()
    some = rows.join(few(materialize(hit)), row_id).join(few(keyed.select(probe_id, "probe")), probe_id).where(F.contains("text", "probe")).select(probe_id, row_id)
    return some.unionByName(_searched(rows, row_id, keyed.where("_k is null").select(probe_id, "probe"), probe_id)).distinct()


def _searched(rows: DataFrame, row_id: str, probes: DataFrame, probe_id: str) -> DataFrame:
    """The same by Aho-Corasick automata over groups of at most PROBE_BYTES of probes."""
    import pyarrow as pa

    spark = rows.sparkSession
    schema = f"{probe_id} {probes.schema[probe_id].dataType.simpleString()}, {row_id} {rows.schema[row_id].dataType.simpleString()}"
    size = probes.agg(F.sum(F.octet_length("probe"))).first()[0] or 0
    out = spark.createDataFrame([], schema)
    groups = -(-size // PROBE_BYTES)
    for g in range(groups):
        part = probes.where(F.pmod(F.xxhash64("probe"), F.lit(groups)) == g)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.select(probe_id, "probe").collect()])

        def run(batches, shared=shared):
            import ahocorasick

            found = ahocorasick.Automaton()
            ids: dict[str, list] = {}
            for i, probe in shared.value:
                ids.setdefault(probe, []).append(i)
            for probe, own in ids.items():
                found.add_word(probe, own)
            found.make_automaton()
            kinds = [pa.array([i for i, _ in shared.value[:1]]).type]
            for batch in batches:
                pairs = [(p, r) for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for own in {id(o): o for _, o in found.iter(text)}.values() for p in own]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], kinds[0]), pa.array([r for _, r in pairs], batch.column(0).type)], [probe_id, row_id])

        out = out.unionByName(rows.select(row_id, "text").mapInArrow(run, schema))
    return out


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9à-ÿ]+"), lambda w: w != "")


def word_ngrams(text: Column, n: int | Column) -> Column:
    """Distinct word n-grams; empty for a shorter text."""
    size = F.lit(n) if isinstance(n, int) else n
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return bind(plain_words(text), lambda w: F.when(F.size(w) >= size, F.array_distinct(grams(w))).otherwise(F.array().cast("array<string>")))


def ngram_overlap(rows: DataFrame, row_id: str, items: DataFrame, item_id: str, n: int) -> DataFrame:
    """(row_id, item_id, shared, overlap): share of an item's distinct word n-grams that a row holds, of all pairs that share one. An item of fewer words has
    one gram, its whole sequence. Candidates meet by hashes of grams: broadcast while items' words are few, else by an equi join; pairs that met are
    counted on the words."""
    mine = items.select(F.col(item_id).alias("_i"), plain_words(F.col("text")).alias("_w")).withColumn("_n", F.least(F.size("_w"), F.lit(n))).where("_n > 0")
    if (mine.agg(F.sum(F.size("_w"))).first()[0] or 0) <= BROADCAST_ROWS:
        runs, wanted = Runs(None), {}
        for i, words, size in mine.collect():
            for h in set(Runs.of(runs.hashes(words), size).tolist()):
                wanted.setdefault(size, {}).setdefault(h, []).append(i)
        met = met_by_runs(rows, row_id, wanted, items.schema[item_id].dataType, "[a-z0-9à-ÿ]+")
    else:
        grams = F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1), lambda i: F.xxhash64(F.slice(F.transform("_w", lambda w: F.xxhash64(w)), i, F.col("_n"))))
        sizes = sorted(r[0] for r in mine.select("_n").distinct().collect())  # n numbers at most
        theirs = rows.select(row_id, F.explode(F.array_distinct(bind(plain_words(F.col("text")), lambda w: F.concat(*[run_hashes(w, k) for k in sizes])))).alias("_g"))
        met = theirs.join(mine.select("_i", F.explode(F.array_distinct(grams)).alias("_g")), "_g").select(row_id, "_i").distinct()
    met = materialize(met)
    known = materialize(mine.select("_i", "_n", F.array_distinct(bind(F.col("_w"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - F.col("_n") + 1), lambda i: F.array_join(F.slice(w, i, F.col("_n")), " ")))).alias("_own")))
    pairs = rows.select(row_id, "text").join(few(met), row_id).join(few(known), "_i")
    counted = pairs.select(row_id, F.col("_i").alias(item_id), F.size(F.array_intersect("_own", word_ngrams(F.col("text"), F.col("_n")))).cast("long").alias("shared"), F.size("_own").alias("_n"))
    return counted.where("shared > 0").select(row_id, item_id, "shared", F.round(F.col("shared") / F.col("_n"), 6).alias("overlap"))


def shortcut_scores(rows: DataFrame, fields: list[str], label: str, score: float, margin: float) -> DataFrame:
    """A row a field: how much of the label (0, 1) its value alone gives away."""
    long = rows.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("_x"))
    cells = long.groupBy("_x.field", "_x.v").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    sums = cells.groupBy("field").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), F.sum(F.greatest("n0", "n1")).alias("m"), F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    s, d = F.col("m") / F.col("n"), (F.col("m") - F.greatest("a", "b")) / F.col("n")
    return sums.select("field", F.col("n").cast("long").alias("n"), F.round(s, 6).alias("score"), F.round(d, 6).alias("margin"), ((s >= score) & (d >= margin)).alias("blocks"))


def lookup_baseline(rows: DataFrame, value: str, label: str, split: str, train: str) -> DataFrame:
    seen = rows.where(F.col(split) == train).groupBy(value, label).agg(F.count(F.lit(1)).alias("_n"))
    best = seen.groupBy(value).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("_y"))
    every = seen.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("_g"))
    joined = rows.where(F.col(split) != train).join(best, value, "left").crossJoin(F.broadcast(every))  # one row
    right = F.count_if(F.coalesce("_y", "_g") == F.col(label))
    return joined.groupBy(split).agg(F.count(F.lit(1)).alias("n"), right.alias("correct")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


def token_purity(rows: DataFrame, text: str, label: str, coverage: float, purity: float, spans: str | None = None) -> DataFrame:
    """Tokens in at least that share of rows: document frequency, share of the larger class, and whether that blocks. With spans (a column of [a, b) places in
    code points) these are masked before tokens are counted; a row whose spans overlap or leave the text counts no token."""
    from ..functions.protocol import masked_spans

    whole = masked_spans(text, spans) if spans else F.col(text)
    words = F.array_distinct(F.filter(F.split(F.lower(whole), "[^a-z0-9à-ÿ]+"), lambda w: w != ""))
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    df = rows.select(label, F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col(label) == 1).alias("_1"))
    kept = df.crossJoin(F.broadcast(n)).where((F.col("df") * round(1 / coverage) >= F.col("_n")) & (F.col("df") >= 2))  # one row
    p = F.greatest(F.col("_1"), F.col("df") - F.col("_1")) / F.col("df")
    return kept.select("token", "df", F.round(p, 6).alias("purity"), (p >= purity).alias("blocks"))


def dominance(rows: DataFrame, element: str, warn: float, block: float) -> DataFrame:
    counts = rows.groupBy(element).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("_s", F.col("n") / F.col("_all"))  # one row
    verdict = F.when(F.col("_s") > block, "block").when(F.col("_s") > warn, "warn").otherwise("ok")
    return out.select(element, "n", F.round("_s", 6).alias("share"), verdict.alias("verdict"))


def digest(rows: DataFrame, row: Column, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(hash60(row).cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")


def check(name: str, violations: DataFrame, detail: str) -> DataFrame:
    """(check, ok, violations, detail): a table of violations as one gate row."""
    n = violations.agg(F.count(F.lit(1)).alias("violations"))
    return n.select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("ok"), "violations", F.lit(detail).alias("detail"))


def gate_rows(rows: DataFrame, checks: list[tuple[str, list[Column], str]]) -> DataFrame:
    """(check, scope, ok, violations, detail): row predicates as gates, one pass. A check's violations are those of all its predicates; a null predicate is none."""
    one = rows.agg(*[sum((F.count_if(F.coalesce(p, F.lit(False))) for p in broken), F.lit(0)).cast("long").alias(f"_{i}") for i, (_, broken, _) in enumerate(checks)])
    cells = [F.struct(F.lit(n).alias("check"), F.lit("rows").alias("scope"), (F.col(f"_{i}") == 0).alias("ok"), F.col(f"_{i}").alias("violations"), F.lit(d).alias("detail")) for i, (n, _, d) in enumerate(checks)]
    return one.select(F.inline(F.array(*cells)))


def tables_of(parts: list[DataFrame]) -> DataFrame:
    """Gate tables as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_invariants(statuses: list[str], exclusions: list[str], policies: list[str], reasons: list[str], allow_output: str, slices: list[str] | None = None) -> list[tuple[str, list[Column], str]]:
    """The label invariants M-1 to M-7 as checks for gate_rows, over columns label, label_status, exclusion_reason, policy_id, attack_category, payload_family_id,
    payload_record_id, reason_string, output. Rows of a slice file (slices: its exclusion reasons) must be excluded, rows of a split must not."""
    c = F.col
    status, reason, policy, block, allow = c("label_status"), c("exclusion_reason"), c("policy_id"), c("label") == "BLOCK", c("label") == "ALLOW"
    excluded, defined = status.eqNullSafe(F.lit("EXCLUDED")), status.eqNullSafe(F.lit("POLICY_DEFINED"))
    out_of = lambda x, names: ~F.coalesce(x.isin(*names), F.lit(False))
    misplaced = excluded if slices is None else ~excluded | out_of(reason, slices)
    return [
        ("M-1", [out_of(status, statuses), c("label").isNull() & ~excluded], "a known status; no label only if excluded"),
        ("M-2", [(reason.isNotNull() != excluded) | (reason.isNotNull() & out_of(reason, exclusions))], "an exclusion has a known reason, and only it"),
        ("M-3", [(policy.isNotNull() != defined) | (policy.isNotNull() & out_of(policy, policies))], "a policy label names a known policy, and only it"),
        ("M-4", [misplaced], "excluded rows are in slices only"),
        ("M-5", [block & ((F.coalesce(c("attack_category"), F.lit("")) == "") | (F.coalesce(c("payload_family_id"), F.lit("")) == "")), allow & c("payload_family_id").isNotNull()], "an attack has a category and a family, a benign row has none"),
        ("M-6", [allow & c("payload_record_id").isNotNull()], "a benign row has no payload record"),
        ("M-7", [block & (~c("output").eqNullSafe(F.concat(F.lit("BLOCK | "), c("reason_string"))) | out_of(c("reason_string"), reasons)), allow & ~c("output").eqNullSafe(F.lit(allow_output))], "the output says the label and a known reason"),
    ]


def label_census(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by all keys at once, '—' for null."""
    return rows.groupBy(*[F.coalesce(F.col(k), F.lit("—")).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"))


def identity_overlaps(rows: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(check, scope, ok, violations, detail): for each key, identities in more than one split. A list-valued key counts each of its elements; nulls are none."""
    parts = []
    for k in keys:
        kind = rows.schema[k].dataType.typeName()
        flat = rows.select(F.col(split).alias("_s"), (F.explode(k) if kind == "array" else F.col(k)).alias("_k")).where("_k is not null")
        over = flat.groupBy("_k").agg((F.min("_s") != F.max("_s")).alias("_x")).agg(F.count_if("_x").alias("violations"))
        parts.append(over.select(F.lit("disjoint").alias("check"), F.lit(k).alias("scope"), (F.col("violations") == 0).alias("ok"), "violations", F.lit("identities in two splits").alias("detail")))
    return tables_of(parts)


def spanning(rows: DataFrame, key: Column, split: str, check: str, scope: str) -> DataFrame:
    """One gate row: values of key that are in more than one split. Keys are hashed before they are shuffled."""
    by = rows.where(key.isNotNull()).groupBy(F.sha2(key.cast("string"), 256).alias("_k")).agg((F.min(split) != F.max(split)).alias("_x"))
    n = by.agg(F.count_if("_x").alias("violations"))
    return n.select(F.lit(check).alias("check"), F.lit(scope).alias("scope"), (F.col("violations") == 0).alias("ok"), "violations", F.lit("groups that span splits").alias("detail"))


def evaluability(rows: DataFrame, category: str, family: str, split: str, test: str, reserve: str, least: int, least_test: int) -> DataFrame:
    """(category, families, in_test, flag): EVALUABLE with enough families outside the reserve, and enough in test."""
    f = rows.select(category, family, split).distinct().where(F.col(split) != reserve)
    t = f.groupBy(category).agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col(split) == test).alias("in_test"))
    return t.withColumn("flag", F.when((F.col("families") >= least) & (F.col("in_test") >= least_test), "EVALUABLE").otherwise("NOT_EVALUABLE"))


#: The integrity gate's thresholds: (warn, fail).
THRESHOLDS = {"duplicates": (0.10, None), "leakage": (0.0, 0.01), "shortcut_accuracy": (0.65, 0.80), "shortcut_margin": (0.10, 0.20), "purity": (None, 0.99), "category_ratio": (100.0, None), "category_share": (0.001, None)}


def graded(value: Column, warn: float | None, fail: float | None, strict: bool = True) -> Column:
    """PASS, WARN or FAIL: over warn (or at it, if not strict), at or over fail."""
    out = F.lit("PASS")
    if warn is not None:
        out = F.when(value > warn if strict else value >= warn, "WARN").otherwise(out)
    return out if fail is None else F.when(value >= fail, "FAIL").otherwise(out)


def integrity_gate(rows: DataFrame, text: str, split: str, train: str, label: str, fields: list[str], category: str) -> DataFrame:
    """(check, scope, value, status) of a labelled corpus: duplicates inside each split, leakage of the other splits from train, how far single fields give the
    label away (accuracy and margin over the majority), values at PURITY's share of one label that cover a hundredth of the rows, and balance of categories."""
    hashed = rows.select(F.sha2(text, 256).alias("_h"), split, label, category, *[f for f in fields if f not in (split, label, category)])
    by_text = hashed.groupBy("_h", split).agg(F.count(F.lit(1)).alias("_n"))
    dup = by_text.groupBy(split).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).select(F.lit("duplicates").alias("check"), F.col(split).alias("scope"), ((F.col("n") - F.col("k")) / F.col("n")).alias("value"))
    seen = by_text.where(F.col(split) == train).select("_h", F.lit(True).alias("_t"))
    leak = by_text.where(F.col(split) != train).join(seen, "_h", "left").groupBy(split).agg((F.sum(F.when(F.col("_t"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("value"))
    leak = leak.select(F.lit("leakage").alias("check"), F.col(split).alias("scope"), "value")
    long = hashed.select(label, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])).alias("_x"))
    cells = long.groupBy("_x.field", "_x.v").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    sums = cells.groupBy("field").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), F.sum(F.greatest("n0", "n1")).alias("m"), F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    accuracy = sums.select(F.lit("shortcut_accuracy").alias("check"), F.col("field").alias("scope"), (F.col("m") / F.col("n")).alias("value"))
    margin = sums.select(F.lit("shortcut_margin").alias("check"), F.col("field").alias("scope"), ((F.col("m") - F.greatest("a", "b")) / F.col("n")).alias("value"))
    n = cells.join(sums.select("field", F.col("n").alias("_all")), "field")
    pure = n.where((F.col("n0") + F.col("n1")) * 100 >= F.col("_all")).groupBy("field").agg(F.max(F.greatest("n0", "n1") / (F.col("n0") + F.col("n1"))).alias("value")).select(F.lit("purity").alias("check"), F.col("field").alias("scope"), "value")
    sizes = hashed.groupBy(category).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("all"))
    ratio_, share = (sizes.select(F.lit(c).alias("check"), F.lit(category).alias("scope"), v.alias("value")) for c, v in (("category_ratio", F.col("hi") / F.col("lo")), ("category_share", F.col("lo") / F.col("all"))))
    every = tables_of([dup, leak, accuracy, margin, pure, ratio_, share])
    status = F.lit("PASS")
    for check_name, (warn, fail) in THRESHOLDS.items():
        low = check_name == "category_share"
        mine = F.when(F.col("value") < warn, "WARN").otherwise("PASS") if low else graded(F.col("value"), warn, fail, strict=check_name in ("leakage", "duplicates", "category_ratio"))
        status = F.when(F.col("check") == check_name, mine).otherwise(status)
    return every.select("check", "scope", F.round("value", 6).alias("value"), status.alias("status"))


def freeze_precheck(artifacts: DataFrame, rows: DataFrame, meta: DataFrame, expected: DataFrame, split: str, category: str, source: str, over_limit: Column, block: Column) -> DataFrame:
    """(check, scope, ok, violations, detail) before a dataset is frozen: artifacts whose verified status is ok, rows and their metadata alike in number by split, the
    expected counts (split, n), no source with over three quarters of its category, at most a hundredth of a category over the length limit, and blocks
    between 48 and 52 in a hundred of every split."""
    shape = lambda name, scope, n, detail: n.select(F.lit(name).alias("check"), F.lit(scope).alias("scope"), (F.col("violations") == 0).alias("ok"), "violations", F.lit(detail).alias("detail"))
    listed = artifacts.agg((F.count_if(F.col("status") != "ok") + (F.count(F.lit(1)) == 0).cast("int")).alias("violations"))
    counts, metas = (d.groupBy(split).agg(F.count(F.lit(1)).alias(n)) for d, n in ((rows, "_n"), (meta, "_m")))
    aligned = counts.join(metas, split, "full_outer").agg(F.count_if(~F.col("_n").eqNullSafe(F.col("_m"))).alias("violations"))
    right = counts.join(expected.select(F.col("split").alias(split), F.col("n").alias("_e")), split, "full_outer").agg(F.count_if(~F.col("_n").eqNullSafe(F.col("_e"))).alias("violations"))
    by_source = rows.groupBy(category, source).agg(F.count(F.lit(1)).alias("n"))
    capped = by_source.groupBy(category).agg((4 * F.max("n") > 3 * F.sum("n")).alias("x")).agg(F.count_if("x").alias("violations"))
    long = rows.groupBy(category).agg((100 * F.count_if(over_limit) > F.count(F.lit(1))).alias("x")).agg(F.count_if("x").alias("violations"))
    balance = rows.groupBy(split).agg(F.count_if(block).alias("b"), F.count(F.lit(1)).alias("n")).agg(F.count_if((100 * F.col("b") < 48 * F.col("n")) | (100 * F.col("b") > 52 * F.col("n"))).alias("violations"))
    return tables_of(
        [
            shape("artifact_hashes", "artifacts", listed, "artifacts that don't match their manifest, or none listed"), shape("row_meta_alignment", "splits", aligned, "splits whose rows and metadata differ in number"),
            shape("split_row_counts", "splits", right, "splits without the expected number of rows"), shape("source_file_cap", "categories", capped, "categories with over 3/4 of one source"),
            shape("over_limit", "categories", long, "categories with over 1/100 too long"), shape("class_balance", "splits", balance, "splits outside 48 to 52 in 100 blocks"),
        ]
    )
