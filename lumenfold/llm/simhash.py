"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct 64-bit fingerprints are routed so that any two within `max_bits` meet: the bits are cut into max_bits + k blocks, and
two such fingerprints agree on k whole blocks. k grows with the number of fingerprints (`links`). A bucket (fingerprints that
agree on k blocks) that is large is cut again on its remaining bits into max_bits + 1 blocks, which the same argument allows,
so no task holds an unbounded group. In a bucket, fingerprints are
sorted by Gray rank; neighbours in that order share most bits, so upper nodes factor out the bits their members
share. A search carries the differences accumulated from the root and prunes a node's whole group when they exceed
`max_bits`. Each bucket yields a spanning forest, not its pairs; distributed components join the forests.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, release, small_batches, spare, table

BUCKET = 2048
FAN = 8
CHUNK = 1 << 15
BINS = 64
#: Bits of a text's marks, and the most blocks that fingerprints are asked to agree on at first.
MARKS, AGREE = 128, 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words. Words end at ASCII white space."""
    return views(text, shingle, seed, 1)[0]


def views(text: str | None, shingle: int, seed: int, count: int) -> list[int]:
    """count fingerprints: the first of the hashes themselves, the others of the hashes mixed anew, so that their errors are independent."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * count
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :])) or [(0, ends[-1])]
    ones = np.zeros((count, 64), dtype=np.int64)
    for at in range(0, len(spans), CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in spans[at : at + CHUNK]], dtype=np.uint64)
        for view in range(count):
            if view:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            ones[view] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(spans), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected binary order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Distinct codes in Gray order under upper nodes of FAN children. levels[k]: (pattern, mask) of the bits that all below share."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        ands, ors = self.codes, self.codes
        self.levels = [(ands, np.full(len(ands), ~np.uint64(0)))]
        while len(ands) > 1:
            at = np.arange(0, len(ands), FAN)
            ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
            self.levels.append((ands, ands | ~ors))

    def search(self, queries: np.ndarray, max_bits: int, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, code's place in Gray order, differing bits) of all within max_bits, among the first `upto` codes at least. A level of whose nodes
        little was pruned above is looked at as a whole, without lists of places; a node's shared bits hold those of the nodes above it."""
        reach = [-(-(len(self.codes) if upto is None else upto) // FAN**k) for k in range(len(self.levels))]
        pattern, mask = self.levels[-1]
        q = np.arange(len(queries))
        node = np.zeros(len(queries), dtype=np.int64)
        differ = np.bitwise_count((queries ^ pattern[0]) & mask[0])
        for k in range(len(self.levels) - 2, -1, -1):
            keep = differ <= max_bits
            pattern, mask = self.levels[k]
            if 4 * np.count_nonzero(keep) > len(queries) * reach[k + 1]:
                off = queries[:, None] ^ pattern[None, : reach[k]]
                whole = np.bitwise_count(off & mask[None, : reach[k]] if k else off)
                if k:
                    q, node, differ = np.repeat(np.arange(len(queries)), reach[k]), np.tile(np.arange(reach[k]), len(queries)), whole.ravel()
                else:
                    q, node = np.nonzero(whole <= max_bits)
                    differ = whole[q, node]
                continue
            q, node, differ = q[keep], node[keep], differ[keep]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            inside = child < reach[k]
            child = child[inside]
            q = np.repeat(q, FAN)[inside]
            differ = np.bitwise_count((queries[q] ^ pattern[child]) & mask[child])
            node = child
        keep = differ <= max_bits
        return q[keep], node[keep], differ[keep].astype(np.int64)


#: Estimated shares of common shingles, in steps: pairs of an earlier step are joined first, pairs below the last are left out.
STEPS = (0.95, 0.9, 0.85, 0.8, 0.75)


def likeness(marks: np.ndarray, first: np.ndarray, second: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Estimated share of common shingles: unlike sets agree on half of the bits of their marks (rows of two words)."""
    out = np.zeros(len(first))
    for at in range(0, len(first), chunk):
        differ = np.bitwise_count(marks[first[at : at + chunk]] ^ marks[second[at : at + chunk]]).sum(axis=1, dtype=np.int64)
        out[at : at + chunk] = np.maximum(1 - 2 * differ / MARKS, 0)
    return out


def forest(codes: np.ndarray, max_bits: int, marks: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span the components of the graph of codes within max_bits, nearest first (a minimum spanning forest). With marks
    (see shingle_marks) the graph is that of codes which also look alike by them, most alike first."""
    index = GrayIndex(codes)
    codes, n = index.codes, len(codes)
    found = []
    for at in range(0, n, block):
        q, node, differ = index.search(codes[at : at + block], max_bits, min(at + block, n))
        once = node < q + at
        found.append((q[once] + at, node[once], differ[once]))
    first, second, step = (np.concatenate(c) for c in zip(*found))
    steps = max_bits + 1
    if marks is not None:
        step, steps = np.searchsorted(-np.array(STEPS), -likeness(marks[index.order], first, second)), len(STEPS)
    label, root, edges = np.arange(n), list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(steps):
        at = np.flatnonzero(step == k)
        la, lb = label[first[at]], label[second[at]]
        _, some = np.unique(np.maximum(la, lb) * n + np.minimum(la, lb), return_index=True)
        for i in at[some[la[some] != lb[some]]].tolist():
            x, y = find(int(first[i])), find(int(second[i]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append(i)
        label = np.array([find(int(x)) for x in label]) if edges else label
    return codes[first[edges]], codes[second[edges]]


def block_masks(free: int, blocks: int) -> list[int]:
    """Cuts the set bits of free into runs of nearly equal number."""
    bits = [b for b in range(64) if free >> b & 1]
    cut = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def agreeing(max_bits: int, k: int) -> list[int]:
    """Masks of k of max_bits + k blocks: two codes within max_bits agree on one of them."""
    return [sum(c) for c in combinations(block_masks((1 << 64) - 1, max_bits + k), k)]


def links(codes: DataFrame, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): edges whose components are those of all pairs of distinct codes (column fp) within max_bits; with columns m0 and m1
    (see shingle_marks), of such pairs as also look alike by them.

    Codes meet where they agree on k blocks. Asking for one more block takes (max_bits + k + 1) / (k + 1) times the rows, cutting the share of rows that is
    in large buckets takes 1 + max_bits * share times, so k grows, up to AGREE, while that is dearer. What then is in large buckets is cut again, and again.
    """
    full = (1 << 64) - 1
    kept = ["fp", *(["m0", "m1"] if "m0" in codes.columns else [])]
    value = F.col("fp").bitwiseAND(F.col("mask"))

    def crowded(rows: DataFrame) -> tuple[DataFrame, int, int]:
        found = materialize(rows.groupBy(F.col("mask").alias("_m"), value.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket))
        many, held = found.agg(F.count(F.lit(1)), F.sum("_n")).first()
        return F.broadcast(found) if many <= 50_000 else found, many, held or 0

    n = codes.count()
    for k in range(1, AGREE + 1):
        masks = agreeing(max_bits, k)
        rows = codes.select(*kept, F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
        large, many, held = crowded(rows)
        if held * (k + 1) <= n * len(masks):
            break

    @F.arrow_udf("array<bigint>")
    def cut(mask: pa.Array) -> pa.Array:
        each, at = np.unique(mask.to_numpy(), return_inverse=True)
        cuts = [[_signed(m | c) for c in block_masks(full & ~m, max_bits + 1)] for m in each.view(np.uint64).tolist()]
        return pa.array(cuts, pa.list_(pa.int64())).take(pa.array(at))

    free = max((full & ~m).bit_count() for m in masks)
    parts = []
    while many and free > max(max_bits, (bucket - 1).bit_length()):
        where = (F.col("mask") == F.col("_m")) & (value == F.col("_v"))
        parts.append(rows.join(large, where, "left_anti").select(*kept, "mask"))
        again = materialize(rows.join(large, where, "left_semi").select(*kept, "mask"))
        rows = again.select(*kept, F.explode(cut("mask")).alias("mask"))
        free -= free // (max_bits + 1)
        large, many, _ = crowded(rows)
    release(codes.sparkSession)
    routed = rows
    for p in parts:
        routed = routed.unionByName(p)

    def columns(batch):
        mask, fp, *marks = (np.asarray(batch.column(i)) for i in range(batch.num_columns))
        return [mask, mask & fp, fp, *([np.stack(marks, axis=1).view(np.uint64)] if marks else [])]

    def run(batches):
        held = None
        for batch in _chain(batches):
            now = held if batch is None else columns(batch) if held is None else [np.concatenate(x) for x in zip(held, columns(batch))]
            if now is None or not len(now[0]):
                continue
            mask, value, fp, *marks = now
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            if batch is not None:
                held = [x[starts[-1] :] for x in now]
                starts, ends = starts[:-1], ends[:-1]
            found = [forest(fp[a:b].view(np.uint64), max_bits, *[m[a:b] for m in marks]) for a, b in zip(starts, ends) if b - a > 1]
            if found:
                src, dst = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    meeting = routed.select("mask", *kept).repartition(F.col("mask"), value).sortWithinPartitions(F.col("mask"), value)
    return meeting.mapInArrow(run, "src long, dst long")


def _chain(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id (smallest id of the class) for every row.

    Null and empty texts, and texts without words, have fingerprint 0 and link like others. Rows whose ids are null take
    part; a class of null ids alone has a null component_id. Repeated rows are one another's duplicates. An
    empty table gives none.
    """
    rows = materialize(fingerprints(docs, shingle, seed))
    codes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = materialize(links(codes, max_bits))
    of_code = materialize(_named(codes, "fp", connected_components(edges)))  # a plain table, so that the join below can be split at a hot fingerprint
    return rows.join(of_code, "fp").select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, component_id) of nodes (key, least): the least id of a node's class. Members and classes are plain tables, so that their join can be split at a
    class that holds a third of all nodes."""
    n = nodes.count()
    named = compact(classes.join(nodes, classes["node"] == nodes[key]).select("node", "root", "least"), n)
    least = compact(named.groupBy("root").agg(F.min("least").alias("component_id")), n)
    linked = named.join(least, "root").select(F.col("node").alias(key), "component_id")
    return nodes.join(linked, key, "left").select(key, F.coalesce("component_id", "least").alias("component_id"))


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """Distinct signed XXH64 of a text's n-word shingles; of the whole sequence if it is shorter."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1))} if words else set()
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)


def shingle_marks(hashes: list[int]) -> tuple[int, int]:
    """MARKS bits, in two signed words: of each of as many parts of the hash range the last bit of its least hash. A part without hashes takes another bit of the
    next part that has some (from the last on to the first). (0, 0) for no hashes."""
    if not hashes:
        return 0, 0
    x = np.sort(np.array(hashes, dtype=np.int64).view(np.uint64))
    bins, at = np.unique((x >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64), return_index=True)
    part = np.arange(MARKS)
    of = np.searchsorted(bins, part) % len(bins)
    away = (bins[of] - part) % MARKS % 56
    return tuple(np.packbits((x[at[of]] >> away.astype(np.uint64) & np.uint64(1)).astype(bool), bitorder="little").view(np.int64).tolist())


#: Tokens whose frequency is sampled: one text in SAMPLED, the FREQUENT most frequent. They only order tokens; any order gives the same classes.
SAMPLED, FREQUENT = 16, 1 << 17


#: A hash that more texts than this are estimated to hold meets in blocks of about so many.
HOT = 100_000


def rare_first(hashes: list[int], num: int, den: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[list[int], list[int]]:
    """The first |A| - ceil(num/den |A|) + 1 hashes, rarest first: sets of Jaccard num/den or more share one of them. Then how often the sample holds each. [0] for
    an empty set."""
    if not hashes:
        return [0], [0]
    h = np.array(hashes, dtype=np.int64)
    often = np.zeros(len(h), dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = np.where(frequent[at] == h, counts[at], 0)
    order = np.lexsort((h, often))[: len(h) - -(-num * len(h) // den) + 1]
    return h[order].tolist(), often[order].tolist()


def in_cells(tokens: list[int], often: list[int], row: int, hot: int) -> tuple[list[int], list[int]]:
    """Where a text meets others, and the place of the token that leads there: at the token itself; at a token of more than `hot` texts, by estimate, in those
    cells of a triangle of blocks of texts that are in its own block's line, so that any two texts share a cell and no cell holds all."""
    import xxhash

    out, places = [], []
    for p, (x, n) in enumerate(zip(tokens, often)):
        blocks = -(-n * SAMPLED // hot)
        if blocks < 2:
            out.append(x)
            places.append(p)
            continue
        own = row % blocks
        for other in range(blocks):
            out.append(xxhash.xxh64_intdigest(np.array([x, min(own, other), max(own, other)], dtype=np.int64).tobytes()) - (1 << 63))
            places.append(p)
    return out, places


def cast(hashes: list[int]) -> bytes | None:
    """How many hashes fall in each of BINS equal parts of their range, a byte each; None if a part holds over 255."""
    counts = np.bincount((np.array(hashes, dtype=np.int64).view(np.uint64) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def meeting_pairs(x: np.ndarray, row: np.ndarray, part: np.ndarray, n: np.ndarray, p: np.ndarray, num: int, den: int, casts: np.ndarray | None = None, cast_of: np.ndarray | None = None, most: int = 1 << 18):
    """Yields (greater row, lesser row) arrays: pairs of equal x and different parts (x, part: sorted) that sizes n, places p of x and, where both
    rows have one, their casts let have Jaccard num/den. A place's cast is casts[cast_of], none if that is negative. Pairs within a part are not looked at."""
    ends = lambda new: np.repeat(np.r_[np.flatnonzero(new)[1:], len(new)], np.diff(np.r_[np.flatnonzero(new), len(new)]))
    new = np.r_[True, x[1:] != x[:-1]]
    start, many = ends(new | np.r_[True, part[1:] != part[:-1]]), ends(new)
    many = many - start
    held, found = 0, []
    upto = np.cumsum(many)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        size = many[lo:hi]
        first, lo = lo, hi
        i = np.repeat(np.arange(first, hi), size)
        if not len(i):
            continue
        j = np.repeat(start[first:hi] - (np.cumsum(size) - size), size) + np.arange(len(i))
        least, largest = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        shared = np.minimum(p[i], p[j]) + 1 + np.minimum(n[i] - p[i], n[j] - p[j]) - 1
        fits = (den * least >= num * largest) & ((num + den) * shared >= num * (n[i] + n[j]))
        i, j = i[fits], j[fits]
        if casts is not None and len(i):
            a, b = cast_of[i], cast_of[j]
            known = np.flatnonzero((a >= 0) & (b >= 0))
            out = np.ones(len(i), dtype=bool)
            for some in np.array_split(known, 1 + len(known) // (1 << 16)):
                common = np.minimum(casts[a[some]], casts[b[some]]).sum(axis=1, dtype=np.int64)
                out[some] = (num + den) * common >= num * (n[i[some]] + n[j[some]])
            i, j = i[out], j[out]
        found.append(np.stack([np.maximum(row[i], row[j]), np.minimum(row[i], row[j])]))
        held += len(i)
        if held > most:
            yield np.unique(np.concatenate(found, axis=1), axis=1)
            held, found = 0, []
    if held:
        yield np.unique(np.concatenate(found, axis=1), axis=1)


def meetings(prefixes: DataFrame, num: int, den: int, rows: int = 1 << 16) -> DataFrame:
    """(a, b) of prefixes (x, row, part, size_place, cast): the pairs of meeting_pairs for each x, each once. size_place is n << 32 | p; cast may be null."""

    def run(batches):
        held, size = [], 0
        for batch in _chain(batches):
            if batch is not None:
                held.append(batch)
                size += len(batch)
                if size < rows:
                    continue
            if not size:
                continue
            now = pa.Table.from_batches(held)
            x = now.column(0).to_numpy()
            cut = size if batch is None else int(np.searchsorted(x, x[-1]))
            held, size = now.slice(cut).to_batches(), size - cut
            if not cut:
                continue
            now = now.slice(0, cut)
            x, row, part, both = (now.column(i).to_numpy() for i in range(4))
            known = now.column(4).is_valid().to_numpy()
            casts = np.frombuffer(b"".join(now.column(4).drop_null().to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            for a, b in meeting_pairs(x, row, part, both >> 32, both & 0xFFFFFFFF, num, den, casts, np.where(known, np.cumsum(known) - 1, -1)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = prefixes.select("x", "row", "part", "size_place", "cast").repartition("x").sortWithinPartitions("x", "part")
    return met.mapInArrow(run, "a long, b long").distinct()


def crowd(hashes: list[int]) -> bytes:
    """How many hashes fall in each of 2**k equal parts of their range, a byte each, about two hashes a part; empty if a part holds over 255."""
    k = max(6, (max(len(hashes), 2) // 2).bit_length())
    counts = np.bincount((np.array(hashes, dtype=np.int64).view(np.uint64) >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(a: bytes, b: bytes, n: int, m: int, num: int, den: int) -> bool:
    """False only if sets of n and m hashes with these crowds can't have Jaccard num/den: a part's lesser count bounds what they share there."""
    if not a or not b:
        return True
    x, y = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (a, b))
    if len(x) > len(y):
        x, y = y, x
    shared = int(np.minimum(x, y.reshape(len(x), -1).sum(axis=1)).sum())
    return (num + den) * shared >= num * (n + m)


#: Narrow tables are written by tasks of about so many rows: few rows make few files.
ROWS_A_FILE = 200_000


def compact(df: DataFrame, n: int) -> DataFrame:
    """df, of about n rows, as a table of few files."""
    return materialize(df.coalesce(1 + n // ROWS_A_FILE))


def similar_texts(docs: DataFrame, *, shingle: int = 2, max_bits: int = 8, seed: int = 42, fingerprints: int = 2, words: int = 5, num: int = 4, den: int = 5, hot: int = HOT) -> DataFrame:
    """doc_id, component_id for every row: classes of texts whose five-word shingles have Jaccard num/den or more, exactly those of all such pairs.

    First come the pairs that SimHash finds: any of the `fingerprints` fingerprints (of differently mixed hashes) within max_bits, spanning forests only,
    each verified on whole texts. They join most near copies, so that the exact route need not compare the members of a large class. Then a prefix
    filter on shingles, rarest first, gives every pair of different classes that can reach num/den; pairs that counts of hashes (`cast` where they meet,
    which goes along with frequent shingles only, then `crowd`) rule out are left out, and all others are verified on whole texts too. Equal texts are always one class. Null and empty texts, and texts without words, are
    alike. Texts whose ids are all null are only alike with equal ones.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"))
    small_batches(spark)
    names = [f"fp{k}" for k in range(fingerprints)]

    def sets(batches):
        for batch in batches:
            found = pa.array([shingle_hashes(t, words) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["key", "s"])

    sample = hashed.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLED)) == 0).select("th", "text").mapInArrow(sets, "key binary, s array<long>")
    tokens = sample.groupBy("key").agg(F.first("s").alias("s")).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    often = tokens.where("n > 1").orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow().sort_by("x")
    shared_often = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("x", "n")))

    def described(batches):
        frequent, counts = shared_often.value
        start = TaskContext.get().partitionId() << 33
        for batch in batches:
            whole = batch.column(1).to_pylist()
            fps = np.array([views(t, shingle, seed, fingerprints) for t in whole], dtype=np.uint64).reshape(-1, fingerprints)
            found = [shingle_hashes(t, words) for t in whole]
            columns = [pa.array(np.arange(start, start + len(whole))), batch.column(0), batch.column(2)]
            marks = np.array([shingle_marks(s) for s in found], dtype=np.int64).reshape(-1, 2)
            columns += [pa.array(np.ascontiguousarray(marks[:, k])) for k in (0, 1)]
            columns += [pa.array([of(s) for s in found], pa.binary()) for of in (crowd, cast)]
            rare = [rare_first(s, num, den, frequent, counts) for s in found]
            cells, places = zip(*[in_cells(*r, start + i, hot) for i, r in enumerate(rare)]) if rare else ((), ())
            columns += [pa.array(cells, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())), pa.array([r[1].count(0) for r in rare], pa.int64()), pa.array([len(s) for s in found], pa.int64())]
            columns += [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(fingerprints)]
            start += len(whole)
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "th", "m0", "m1", "crowd", "cast", "cells", "places", "unknown", "n", *names])

    rows = materialize(hashed.mapInArrow(described, "row long, doc_id long, th binary, m0 long, m1 long, crowd binary, cast binary, cells array<long>, places array<long>, unknown long, n long, " + ", ".join(f"{n} long" for n in names)))
    n = rows.count()
    ids = compact(rows.groupBy("th").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), n)  # each text's first row stands for it
    texts = compact(rows.select("row", *names).join(ids.select("row"), "row"), n)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        wanted = compact(ids.join(ends, "row").where("least is not null").select("row", "least", F.col("th").alias("_th")), n)
        few = F.broadcast(wanted) if wanted.count() <= 50_000 else wanted
        chosen = hashed.join(few, (F.col("doc_id") == F.col("least")) & (F.col("th") == F.col("_th"))).select("row", "text")
        whole = materialize(chosen.mapInArrow(sets, "key long, s array<long>").dropDuplicates(["key"]))
        both = pairs.join(whole.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        out = materialize(both.where(shared * den >= (F.size("sa") + F.size("sb") - shared) * num).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        discard(wanted), discard(whole)
        return out

    found, spent = [], []
    for name in names:
        heads = compact(rows.groupBy(F.col(name).alias("fp")).agg(F.min("row").alias("head"), *[F.min_by(m, "row").alias(m) for m in ("m0", "m1")]), n)
        near = materialize(links(heads, max_bits).distinct())
        release(spark)
        a, b = (heads.select(F.col("fp").alias(e), F.col("head").alias(n)) for e, n in (("src", "a"), ("dst", "b")))
        same = texts.join(heads.select(F.col("fp").alias(name), "head"), name).where("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b"))
        found += [near.join(a, "src").join(b, "dst").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), same]
        spent += [heads, near]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    candidates = compact(every.distinct(), 2 * n)
    alike = verified(candidates)
    for table_ in (*spent, candidates, texts):
        discard(table_)
    release(spark)
    classes = compact(connected_components(alike), n)
    parts = compact(ids.select("row").join(classes.select(F.col("node").alias("row"), "root"), "row", "left").select("row", F.coalesce("root", "row").alias("part")), n)
    release(spark)
    met_at = rows.select("row", "n", "cells", "places", "unknown", "cast").join(parts, "row").select("row", "part", "n", "unknown", "cast", F.explode(F.arrays_zip("cells", "places")).alias("_c"))
    prefixes = met_at.select("row", "part", "n", "unknown", "cast", F.col("_c.cells").alias("x"), F.col("_c.places").alias("_p"))
    prefixes = prefixes.withColumn("size_place", F.shiftleft("n", 32) + F.col("_p")).withColumn("cast", F.when(F.col("_p") >= F.col("unknown"), F.col("cast")))
    met = materialize(meetings(prefixes, num, den))
    release(spark)

    @F.arrow_udf("boolean")
    def fits(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_be_alike(*row, num, den) for row in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), m.to_pylist())], pa.bool_())

    a, b = (rows.select(F.col("row").alias(e), F.col("crowd").alias(f"c{e}"), F.col("n").alias(f"n{e}")) for e in ("a", "b"))
    pairs = materialize(met.join(a, "a").join(b, "b").where(fits("ca", "cb", "na", "nb")).select("a", "b"))
    discard(met)
    more = verified(pairs)
    if not more.isEmpty():
        classes = connected_components(compact(alike.unionByName(more), 2 * n))
    of_text = _named(ids.select("row", "least"), "row", classes)
    named = compact(ids.select("row", "th").join(of_text, "row").select("th", "component_id"), n)  # a plain table, so that the join below can be split at a hot text
    release(spark)
    return rows.select("doc_id", "th").join(named, "th").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without the documents whose class has a smaller id, and without second copies of the same row's id and text. Rows without an id stay."""
    gone_id, text_hash, place = (spare(docs, n) for n in ("_gone", "_text_hash", "_place"))
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    again = Window.partitionBy("doc_id", text_hash).orderBy(text_hash)
    kept = left.withColumn(text_hash, F.xxhash64("text")).withColumn(place, F.row_number().over(again))
    return kept.where((F.col(place) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def op1(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
