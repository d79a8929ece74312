"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

The index holds each item's BM25 impacts divided by the item's score for itself, so one threshold serves all items. Items lie in blocks; each
term has its largest impact anywhere, and in the blocks where it is essential: an item's rarest terms are essential until the others together
are worth at most REST. A passage whose terms' largest impacts sum to less than the threshold is dropped; so is a block where the essential terms'
block maxima, plus what its items' other terms are worth at most, do. What is left is scored exactly, so all items above the threshold are retrieved.
A retrieved item counts as leaked if enough five-word shingles of its question and of its answer are in the document, or, where
the table has no answers, of the item as a whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_worker, small_batches, table

#: Items of so many bytes are searched in one scan of the documents; more items take more scans.
GROUP_BYTES = 32 << 20
BLOCK = 16
REST = 0.25
#: Items of up to 64, 256, 1,024 ... words are indexed apart, so that a long item doesn't make the passages of short ones long.
CLASS, WIDER = 64, 4
CELLS = 1 << 22
MEMO = 400_000
SHINGLE = 5


def bare(word: str) -> str:
    return re.sub(r"[\W_]+", "", word.lower())


def words_of(text: str | None) -> list[str]:
    return [w for w in map(bare, (text or "").split()) if w]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text: its last sentence, if five words are left before it and in it, else its last third, is the answer."""
    cut = [m.end() for m in re.finditer(r"[.!?\n]+\s+", text)]
    for at in reversed(cut):
        if len(words_of(text[at:])) >= SHINGLE and len(words_of(text[:at])) >= SHINGLE:
            return text[:at], text[at:]
    parts = text.split()
    at = len(parts) - len(parts) // 3
    return " ".join(parts[:at]), " ".join(parts[at:])


def shingles(words: list, n: int = SHINGLE) -> set:
    """Distinct n-word shingles; the whole sequence if it is shorter."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    """The inverted index of items of about one length: [(id, question's words, answer's words)], with terms numbered by `terms`."""

    def __init__(self, rows: list[tuple], terms: dict[str, int], frequency: dict[str, int], total: int, mean_words: float, threshold: float, k1: float = 1.2, b: float = 0.75):
        rows = sorted(rows, key=lambda r: (len(r[1]) + len(r[2]), str(r[0])))
        self.items, self.threshold, self.wide = [r[0] for r in rows], threshold, len(terms)
        self.words = [(np.array([terms[w] for w in q], dtype=np.int32), np.array([terms[w] for w in a], dtype=np.int32)) for _, q, a in rows]
        self.stride = max(32, max((len(q) + len(a) for _, q, a in rows), default=1))
        n, blocks = len(rows), -(-len(rows) // BLOCK)
        each, essential, rest = [], [], np.zeros(blocks)
        for k, (_, q, a) in enumerate(rows):
            counts = sorted(((frequency.get(w, 1), terms[w], tf) for w, tf in Counter(q + a).items()))
            df, t, tf = (np.array(c, dtype=np.float64) for c in zip(*counts))
            impact = np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (len(q) + len(a)) / mean_words))
            impact /= impact.sum()
            left = np.maximum(1 - np.cumsum(impact), 0.0)
            needed = int(np.argmax(left <= min(REST, threshold / 2))) + 1
            rest[k // BLOCK] = max(rest[k // BLOCK], left[needed - 1])
            t = t.astype(np.int64)
            each.append((t, np.full(len(t), k), impact))
            essential.append((t[:needed], np.full(needed, k // BLOCK), impact[:needed]))
        t, k, v = (np.concatenate(c) if c else np.zeros(0) for c in (zip(*each) if each else ((), (), ())))
        keys = t.astype(np.int64) * max(n, 1) + k.astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.impacts, self.rest = keys[order], v[order], rest
        self.most = np.zeros(self.wide)
        np.maximum.at(self.most, t.astype(np.int64), v)
        t, block, v = (np.concatenate(c) if c else np.zeros(0) for c in (zip(*essential) if essential else ((), (), ())))
        cells = t.astype(np.int64) * max(blocks, 1) + block.astype(np.int64)
        order = np.argsort(cells, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(cells[order]) > 0]) if len(cells) else np.zeros(0, np.int64)
        own = cells[order][starts]
        self.cell_block, self.cell_most = own % max(blocks, 1), np.maximum.reduceat(v[order], starts) if len(starts) else np.zeros(0)
        self.cells = np.searchsorted(own // max(blocks, 1), np.arange(self.wide + 1))
        self.parts: dict[int, tuple] = {}

    def retrieve(self, passages: np.ndarray, terms: np.ndarray):
        """passages, terms: equally long, sorted by passage, each pair once. Yields (passage, item's place, score) arrays."""
        enough, n, blocks = self.threshold - 1e-9, len(self.items), len(self.rest)
        if not n or not len(passages):
            return
        firsts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        alive = np.add.reduceat(self.most[terms], firsts) >= enough
        keep = np.repeat(alive, np.diff(np.r_[firsts, len(passages)]))
        passages, terms = passages[keep], terms[keep]
        if not len(passages):
            return
        firsts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        ends = np.r_[firsts[1:], len(passages)]
        met = self.cells[terms + 1] - self.cells[terms]
        upto = np.cumsum(met)
        lo = 0
        while lo < len(firsts):
            before = upto[firsts[lo] - 1] if firsts[lo] else 0
            hi = max(lo + 1, min(int(np.searchsorted(upto[ends - 1], before + CELLS)), lo + max(1, CELLS // blocks)))
            a, z = firsts[lo], ends[min(hi, len(firsts)) - 1]
            local = np.repeat(np.arange(min(hi, len(firsts)) - lo), ends[lo:hi] - firsts[lo:hi])
            cell = _ranges(self.cells[terms[a:z]], met[a:z])
            place = np.repeat(local, met[a:z]) * blocks + self.cell_block[cell]
            bound = np.bincount(place, self.cell_most[cell], (min(hi, len(firsts)) - lo) * blocks).reshape(-1, blocks)
            p, block = np.nonzero((bound > 0) & (bound + self.rest >= enough))
            size = (ends - firsts)[lo + p]
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // CELLS)) + 1
            for some in np.split(np.arange(len(p)), cuts):
                if len(some):
                    yield from self._scored(passages, terms, firsts[lo + p[some]], size[some], block[some], n, enough)
            lo = hi

    def _scored(self, passages, terms, first, size, block, n, enough):
        pair = np.repeat(np.arange(len(first)), size)
        t, low = terms[_ranges(first, size)], np.repeat(block, size) * BLOCK
        start = np.searchsorted(self.keys, t * n + low)
        many = np.searchsorted(self.keys, t * n + np.minimum(low + BLOCK, n)) - start
        at = _ranges(start, many)
        place = np.repeat(pair, many) * BLOCK + self.keys[at] % n - np.repeat(low, many)
        scores = np.bincount(place, self.impacts[at], len(first) * BLOCK).reshape(-1, BLOCK)
        x, k = np.nonzero(scores >= enough)
        if len(x):
            yield passages[first[x]], block[x] * BLOCK + k, scores[x, k]

    def shares(self, k: int, had: _Grams, whole: bool) -> list[float]:
        """Of the question's, the answer's and, if asked, the whole item's shingles, the share that a document has."""
        if k not in self.parts:
            if len(self.parts) >= 10_000:
                self.parts.clear()
            q, a = (x.tolist() for x in self.words[k])
            self.parts[k] = tuple(shingles(x) for x in ((q, a, q + a) if whole else (q, a)))
        return [len(part & had[min(SHINGLE, len(next(iter(part))))]) / len(part) if part else 1.0 for part in self.parts[k]]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Matcher:
    """The indexes of one group of items, and the words it has seen: word as written -> term, or -1."""

    def __init__(self, items: list[tuple], frequency: dict[str, int], total: int, mean_words: float, whole: bool, threshold: float):
        rows = [(i, words_of(q), words_of(a)) for i, q, a in items]
        rows = [r for r in rows if r[1] or r[2]]
        terms = {w: t for t, w in enumerate(sorted({w for r in rows for w in r[1] + r[2]}))}
        classes: dict[int, list] = {}
        for r in rows:
            longest = CLASS
            while longest < len(r[1]) + len(r[2]):
                longest *= WIDER
            classes.setdefault(longest, []).append(r)
        self.indexes = [Index(classes[c], terms, frequency, total, mean_words, threshold) for c in sorted(classes)]
        self.memo, self.whole = _Terms(terms), whole

    def leaks(self, texts: list, overlap: float) -> list[tuple]:
        """[(row, item id, score, question overlap, answer overlap)] verified, by row and item."""
        if not self.indexes:
            return []
        ids = [np.fromiter(map(self.memo.__getitem__, w), dtype=np.int64, count=len(w)) for w in ((t or "").split() for t in texts)]
        ids = [x[x != -2] for x in ids]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        if not sizes.sum():
            return []
        whole = np.concatenate(ids)
        local = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, grams = [], {}
        for index in self.indexes:
            segments = -(-sizes // index.stride)
            segment = np.repeat(np.cumsum(segments) - segments, sizes) + local // index.stride
            known = whole >= 0
            flat, segment, inner = whole[known], segment[known], (local >= index.stride)[known]
            wide = index.wide
            pairs = np.unique(np.concatenate([segment * wide + flat, (segment[inner] - 1) * wide + flat[inner]]))
            doc_of = np.repeat(np.arange(len(ids)), segments)
            best: dict[tuple[int, int], float] = {}
            for p, k, s in index.retrieve(pairs // wide, pairs % wide):
                for key, score in zip(zip(doc_of[p].tolist(), k.tolist()), s.tolist()):
                    best[key] = max(score, best.get(key, 0.0))
            for row, k in sorted(best):
                if row not in grams:
                    grams[row] = _Grams(ids[row].tolist())
                shares = index.shares(k, grams[row], self.whole)
                if min(shares[:2]) >= overlap or shares[2:] and shares[2] >= overlap:
                    out.append((row, index.items[k], best[row, k], *shares[:2]))
        return sorted(out, key=lambda x: x[0])


class _Terms(dict):
    """-1: not in the index; -2: no letter or digit, so no word."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        plain = bare(word)
        t = self.terms.get(plain, -1) if plain else -2
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = t
        return t


class _Grams(dict):
    def __init__(self, words):
        super().__init__()
        self.words = words

    def __missing__(self, n):
        self[n] = {tuple(self.words[i : i + n]) for i in range(len(self.words) - n + 1)}
        return self[n]


def index_groups(items: DataFrame, answer: str | None, threshold: float, group_bytes: int = GROUP_BYTES):
    """Broadcasts of about group_bytes of items each, one for all items of up to that size; document frequencies and the mean length are those of all items."""
    spark = items.sparkSession
    answers = F.col(answer) if answer else F.lit(None).cast("string")
    rows = items.select("item_id", "text", answers.alias("_answer")).where("text is not null or _answer is not null")
    whole = F.concat_ws(" ", "text", "_answer")
    tokens = F.filter(F.transform(F.split(F.lower(whole), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)[\W_]+", "")), lambda w: w != "")
    worded = rows.select("item_id", "text", "_answer", tokens.alias("_words"), F.octet_length(whole).alias("_size"))
    total, words, size = worded.agg(F.count(F.lit(1)), F.sum(F.size("_words")), F.sum("_size")).first()
    groups = max(1, -(-(size or 0) // group_bytes))
    df = worded.select(F.explode(F.array_distinct("_words")).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for g in range(groups):
        part = worded.where(place == g)
        mine = [(r[0], *((r[1] or "", r[2] or "") if answer else split_item(r[1] or ""))) for r in part.select("item_id", "text", "_answer").collect()]
        own = part.select(F.explode("_words").alias("_w")).distinct()
        frequency = {r[0]: r[1] for r in df.join(own, "_w").collect()}
        yield spark.sparkContext.broadcast({"items": mine, "frequency": frequency, "total": total, "mean": max(1.0, (words or 0) / max(1, total)), "whole": not answer, "threshold": threshold})


def _matcher(x: dict) -> Matcher:
    return Matcher(x["items"], x["frequency"], x["total"], x["mean"], x["whole"], x["threshold"])


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, overlap: float = 0.8, answer: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each item that each row of docs leaks.

    threshold: share of an item's own BM25 score that a passage must reach. overlap: share of the question's, and of the answer's, distinct
    five-word shingles that the document must hold; without an answer column the halves are a split of one text, so that share of the
    whole item's shingles is enough too (the overlaps given are still those of the halves). Passages are 2 * stride words at every stride words, over the whole
    text, where stride is at least the longest item of the index (an index has items of about one length). Items without words match nothing; null and empty texts leak
    nothing; repeated items and rows give a row each. A null id is kept as null.
    """
    small_batches(docs.sparkSession, 256)
    parts = []
    for shared in index_groups(items, answer, threshold, group_bytes):

        def run(batches, shared=shared):
            matcher = per_worker(shared, _matcher)
            for batch in batches:
                found = matcher.leaks(batch.column(1).to_pylist(), overlap)
                if found:
                    rows, *columns = map(list, zip(*found))
                    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
        parts.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """docs, columns as they are, without the rows that leak an item. Only texts go to Python, only verdicts come back."""
    small_batches(docs.sparkSession, 256)
    for shared in index_groups(items, None, threshold):
        docs = docs.where(_clean(shared, overlap)("text"))
    return docs


def _clean(shared, overlap: float):
    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = per_worker(shared, _matcher)
        for texts in columns:
            keep = np.ones(len(texts), dtype=bool)
            keep[[f[0] for f in matcher.leaks(texts.to_pylist(), overlap)]] = False
            yield pa.array(keep)

    return clean


def op9(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
