"""Document fingerprints by locally consistent parsing.

A text's code points are the symbols of level 0. At each level runs of one symbol become one symbol; deterministic coin tossing
(Cole and Vishkin: twice the place of the lowest bit that differs from the left neighbour, plus that bit) shrinks the alphabet
until labels are below 6 and neighbours differ; a phrase begins where the label is a local maximum. A phrase's name
is a hash of its symbols, and names are the next level's symbols. Where a phrase begins depends only on a few neighbours,
so equal substrings have equal phrases inside, wherever they stand. A fingerprint keeps the least SKETCH names of each of
three levels; likeness is the estimated share of common names, over the levels.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

SKETCH = 20
#: Weight of each level's likeness: phrases of about 4, 13 and 45 characters.
LEVELS = (0.2, 0.4, 0.4)
CHARS = 1 << 20
PART_BYTES = 128 << 20
NONE = np.uint64(1 << 32)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications, three shifts)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def coin_labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different from the left neighbour's within a text. first: where texts begin."""
    label = symbols
    for _ in range(4):
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[first] = 1
        one = label.dtype.type(1)
        place = np.bitwise_count((differ & (~differ + one)) - one)
        label = (place + place + ((label >> place.astype(label.dtype)) & one).astype(np.uint8)).astype(np.uint8)
    return label


def parse(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names of phrases, the text of each). Symbols of a text are adjacent."""
    n = len(symbols)
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (symbols[1:] != symbols[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    if len(at) < n:
        runs = np.diff(np.append(at, n))
        symbols, text_of = symbols[at], text_of[at]
        long = runs > 1
    else:
        long = None
    first = np.empty(len(symbols), dtype=bool)
    first[0] = True
    first[1:] = text_of[1:] != text_of[:-1]
    if symbols.dtype != np.uint64:
        label = coin_labels(symbols, first)
        symbols = symbols.astype(np.uint64)
    else:
        label = coin_labels(symbols, first)
    values = mix(symbols + np.uint64(0x9E3779B97F4A7C15))
    if long is not None and long.any():
        values[long] = mix(values[long] + runs[long].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    begins = first.copy()
    begins[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    starts = np.flatnonzero(begins)
    inside = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    values *= _POWERS[inside & 63]
    return mix(np.add.reduceat(values, starts)), text_of[starts]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each level a matrix of each text's SKETCH least 32-bit names, ascending, filled up with NONE."""
    out = [np.full((len(texts), SKETCH), NONE, dtype=np.uint64) for _ in LEVELS]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for level in out:
        symbols, text_of = parse(symbols, text_of)
        keys = np.unique((text_of.astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32)))
        owner = (keys >> np.uint64(32)).astype(np.int64)
        start = np.searchsorted(owner, np.arange(len(texts)))
        end = np.append(start[1:], len(keys))
        at = start[:, None] + np.arange(SKETCH)
        there = at < end[:, None]
        level[there] = keys[at[there]] & np.uint64(0xFFFFFFFF)
    return out


def spelt(levels: list[np.ndarray]) -> list[str]:
    """Fingerprints as text: the levels' names in hex, parted by ':'."""
    columns = []
    for level in levels:
        used = (level != NONE).sum(axis=1)
        columns.append([bytes(row).hex()[: 8 * n] for row, n in zip(level.astype(">u4"), used)])
    return [":".join(parts) for parts in zip(*columns)]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Weighted mean over levels of the bottom-k estimate of common names' share; levels empty on both sides count as alike."""
    total = np.zeros(len(a[0]))
    for weight, x, y in zip(LEVELS, a, b):
        both = np.sort(np.concatenate([x, y], axis=1), axis=1)
        real = both != NONE
        twice = np.zeros_like(real)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        rank = np.cumsum(real & ~twice, axis=1)
        common = (twice & (rank <= SKETCH)).sum(axis=1)
        distinct = np.minimum(rank[:, -1], SKETCH)
        total += weight * np.where(distinct > 0, common / np.maximum(distinct, 1), 1.0)
    return np.clip(total, 0, 1)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _keyed(docs: DataFrame) -> DataFrame:
    """(known, doc_id, h, text): rows in the order of these columns; null ids first, null texts as empty ones, h a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("h"), "text")


def placing(bounds: list[tuple]):
    """Arrow function: the number of bounds (known, id, h, tie), sorted, at or below a key. Most keys need their id alone."""
    nulls = sum(not b[0] for b in bounds)
    ids = np.array([b[1] for b in bounds[nulls:]], dtype=np.int64)

    @F.arrow_udf("int")
    def place(known: pa.Array, doc_id: pa.Array, h: pa.Array, tie: pa.Array) -> pa.Array:
        there = np.asarray(known)
        own = np.asarray(doc_id.fill_null(0))
        out = nulls + np.searchsorted(ids, own, side="right")
        for i in np.flatnonzero(~there | (nulls + np.searchsorted(ids, own) != out)):
            out[i] = bisect_right(bounds, (bool(there[i]), int(own[i]), h[i].as_py(), tie[i].as_py()))
        return pa.array(out, pa.int32())

    return place


def in_order(docs: DataFrame, parts: int | None) -> DataFrame:
    """(_tail, doc_id, text) dealt by ranges of (doc_id, hash of the text) and sorted; each partition ends with the next range's first document (_tail = 1).

    Texts are shuffled once. Bounds come from a sample of 100 keys a partition, a million at most (as in Spark's own range partitioner); they only
    decide where ranges end. Equal rows are told apart by a tie number, so that no range need hold all of them: as they are equal, it changes no
    result which of them follows which. The driver holds the sample and each range's first key. Without `parts` there is one for PART_BYTES of text, and
    no fewer than Spark's shuffle partitions.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))
    tie = F.xxhash64(F.monotonically_increasing_id())
    keys = rows.select("known", F.coalesce("doc_id", F.lit(0)), "h", tie).sample(fraction=min(1.0, min(100 * parts, 1_000_000) / max(n, 1)), seed=7).collect()
    keys = sorted(tuple(k) for k in keys)
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    dealt = rows.withColumn("_tie", tie).withColumn("_part", placing(bounds)("known", "doc_id", "h", "_tie")).drop("_tie")
    firsts = dealt.groupBy("_part").agg(F.min(F.struct("known", "doc_id", "h")).alias("_first")).collect()
    heads = sorted((r["_part"], *r["_first"]) for r in firsts)
    before = spark.createDataFrame([(heads[i - 1][0], *head[2:]) for i, head in enumerate(heads)], "_to int, _id long, _h long")
    tails = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).groupBy("_to", "doc_id", "h").agg(F.min("text").alias("text"))
    sent = dealt.select("_part", F.lit(0).alias("_tail"), "doc_id", "h", "text").unionByName(tails.select(F.col("_to").alias("_part"), F.lit(1).alias("_tail"), "doc_id", "h", "text"))
    return sent.repartitionById(len(bounds) + 1, "_part").sortWithinPartitions("_tail", "doc_id", "h", "text").select("_tail", "doc_id", "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the next row by (doc_id, hash of the text), null ids first; after the last comes the first, so a sole row follows itself. A
    null text is the empty text, whose fingerprint is '::'. Equal texts have equal fingerprints and likeness 1. Texts
    are parsed whole; a batch holds about CHARS code points, or one longer text.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

    def run(batches):
        ids, texts, size = [], [], 0
        for tail, doc_id, text in rows(batches):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if tail:
                break
            if size > CHARS and len(ids) > 1:
                yield described(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(text)
        if len(ids) > 1:
            yield described(ids, texts)
        for _ in batches:
            pass

    def described(ids, texts):
        """All but the last, which only follows."""
        m = len(ids) - 1
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        levels = sketches(texts + changed)
        mine, following, after = ([level[at] for level in levels] for at in (slice(0, m), slice(1, m + 1), slice(m + 1, 2 * m + 1)))
        names = spelt(levels)
        columns = [
            pa.array(ids[:m], pa.int64()),
            pa.array([len(t) for t in texts[:m]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(names[:m]),
            pa.array(names[m + 1 :]),
            pa.array(likeness(mine, after)),
            pa.array(likeness(mine, following)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, parts).mapInArrow(run, schema)


def op6(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
