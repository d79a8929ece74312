"""Best-fit packing of tokenised documents, improved by swap-based local search.

Documents are tokenised once into pieces of at most `capacity` tokens. The packing is solved on the histogram of
piece lengths, which has at most `capacity` rows however large the corpus is: bins with the same contents are one group
with a count. Best fit decreasing places every length; then local search exchanges one piece for one, two for one, one for two, or moves
pieces between underfull groups, wherever that raises the sum of squared fills, until bins empty to the least number that the tokens allow or nothing
improves. A corpus with enough short documents is packed to that least number by best fit decreasing alone, as the given tables are; the search matters
where short ones are few. Groups are turned into ranges of ranks within a length, and every piece looks up its place by its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, materialize, per_worker, small_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _k long"


#: Marks that the vocabulary keeps apart from letters before them.
MARKS = ".,;:!?#$%&*|"


def byte_letters() -> list[str]:
    """The letters in which a byte-level vocabulary spells the bytes 0 to 255: printable Latin-1 stands for itself, the rest for 256 and up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b if b in printable else 256 + rest.index(b)) for b in range(256)]


class Tokens:
    """Text -> its ids as little-endian uint32 bytes. The vocabulary's words end at white space and where letters meet
    marks, so texts can be cut at spaces and line breaks, and letters from the marks after them; what was met before
    needs no second tokenising. A run of letters is one word of the model, so it goes to the model itself."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.spell = dict(enumerate(byte_letters()))
        self.parts = Memo(self.part, 400_000)
        self.words = Memo(self.word)

    def part(self, part: str) -> bytes:
        if part.isalpha():
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.spell)
            return np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            plain = stem.lower() if stem.isascii() else self.tokenizer.normalizer.normalize_str(stem)
            if plain.isalpha():
                ids = self.parts.one(plain)
                return ids + self.parts.one(word[len(stem) :]) if len(stem) < len(word) else ids
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(self.words(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row a piece; _part and _k number the pieces of one length within the task that wrote them, from 0."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast({"spec": f.read()})  # one vocabulary file

    def run(batches):
        tokens, part, seen = per_worker(shared, lambda x: Tokens(x["spec"])), TaskContext.get().partitionId(), Counter()
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.ids(text or "") + tail
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(rows, (doc_id, piece, start, length, crc, part, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_k"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Groups of equal bins: contents (sorted descending) -> how many bins hold just these."""

    def __init__(self, capacity: int):
        self.capacity, self.of = capacity, Counter()

    def add(self, contents, n: int) -> None:
        contents = tuple(sorted(contents, reverse=True))
        if contents and n:
            self.of[contents] += n
            if not self.of[contents]:
                del self.of[contents]

    def count(self) -> int:
        return sum(self.of.values())


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> Bins:
    """Best fit decreasing on counts. A length fills whole groups of the tightest room; only the last is split, so there are
    at most a few groups for each distinct length."""
    room: dict[int, list] = {}  # free tokens -> [(contents, bins)]
    free: list[int] = []

    def put(contents, bins):
        if bins:
            r = capacity - sum(contents)
            if r not in room:
                room[r] = []
                insort(free, r)
            room[r].append((contents, bins))

    for length, n in sorted(lengths.items(), reverse=True):
        while n:
            i = bisect_left(free, length)
            r = free[i] if i < len(free) else capacity
            if i < len(free):
                contents, bins = room[r].pop()
                if not room[r]:
                    del room[r], free[i]
            else:
                contents, bins = (), n
            fits = r // length
            whole = min(bins, n // fits)
            put(contents + (length,) * fits, whole)
            n -= whole * fits
            rest = bins - whole
            if rest and n:
                last = min(n, fits)
                put(contents + (length,) * last, 1)
                n -= last
                rest -= 1
            if contents:
                put(contents, rest)
    out = Bins(capacity)
    for groups in room.values():
        for contents, bins in groups:
            out.add(contents, bins)
    return out


class Underfull:
    """Groups of bins that are not full, found by what a bin of theirs could give: one piece, or two."""

    def __init__(self, bins: Bins):
        self.capacity = bins.capacity
        self.ones: dict[int, set] = {}  # length -> groups that hold such a piece
        self.twos: dict[int, set] = {}  # sum -> (group, piece, piece)
        self.masks = {1: 0, 2: 0}  # bit v: something of v tokens can be given
        for contents in bins.of:
            self.put(contents)

    def _offers(self, contents: tuple):
        have = sorted(Counter(contents).items())
        yield from ((1, self.ones, y, contents) for y, _ in have)
        for i, (y, n) in enumerate(have):
            if n > 1:
                yield 2, self.twos, 2 * y, (contents, y, y)
            for z, _ in have[i + 1 :]:
                yield 2, self.twos, y + z, (contents, y, z)

    def put(self, contents: tuple) -> None:
        if sum(contents) < self.capacity:
            for kind, held, v, offer in self._offers(contents):
                held.setdefault(v, set()).add(offer)
                self.masks[kind] |= 1 << v

    def drop(self, contents: tuple) -> None:
        if sum(contents) < self.capacity:
            for kind, held, v, offer in self._offers(contents):
                held[v].discard(offer)
                if not held[v]:
                    del held[v]
                    self.masks[kind] &= ~(1 << v)

    def best(self, taker: tuple, bins: Bins):
        """(tokens gained, giver, leaves, comes) of the best change for a bin of group taker, or None: the change that fills it most, then the
        emptiest giver. A change counts only if it raises the sum of squared fills."""
        fill = sum(taker)
        space, best = self.capacity - fill, None
        pieces = Counter(taker)
        single = sorted(pieces)
        leaves = [(), *((x,) for x in single), *((x, y) for i, x in enumerate(single) for y in single[i:] if x < y or pieces[x] > 1)]
        for leave in leaves:
            out = sum(leave)
            for kind, held in ((1, self.ones), (2, self.twos))[: 2 if len(leave) == 1 else 1]:
                left = self.masks[kind] & ((1 << (out + space + 1)) - 1)
                while left:
                    v = left.bit_length() - 1
                    gain = v - out
                    if gain <= 0 or best and gain < best[0]:
                        break
                    for offer in held[v]:
                        giver, come = (offer, (v,)) if kind == 1 else (offer[0], offer[1:])
                        if giver == taker and bins.of[giver] < 2 or sum(giver) - fill >= gain:
                            continue
                        found = (gain, -sum(giver), -len(come) - len(leave), giver, leave, come)
                        if not best or found > best:
                            best = found
                    if best and best[0] >= gain:
                        break
                    left &= (1 << v) - 1
        return best and (best[0], *best[3:])


def local_search(bins: Bins) -> Bins:
    """Moves, and exchanges one for one, two for one and one for two, between underfull bins, the fullest takers first, each for as many bins as both groups have. Ends when
    the number of bins is the least that the tokens allow, or when no such change raises the sum of squared fills; that sum grows with every change,
    so it does end."""
    capacity = bins.capacity
    least = -(-sum(sum(c) * n for c, n in bins.of.items()) // capacity)
    under, stuck = Underfull(bins), set()
    total = bins.count()
    while total > least:
        takers = sorted((c for c in bins.of if sum(c) < capacity and c not in stuck), key=lambda c: (-sum(c), c))
        if not takers:
            break
        for taker in takers:
            if taker not in bins.of or total <= least:
                continue
            change = under.best(taker, bins)
            if not change:
                stuck.add(taker)
                continue
            _, giver, out, come = change
            n = bins.of[taker] // 2 if taker == giver else min(bins.of[taker], bins.of[giver])
            full, empty = Counter(taker), Counter(giver)
            full.subtract(out), full.update(come)
            empty.subtract(come), empty.update(out)
            before = {taker, giver}
            after = [tuple(sorted(c.elements(), reverse=True)) for c in (full, empty)]
            known = {c for c in after if c in bins.of}
            bins.add(taker, -n), bins.add(giver, -n)
            bins.add(after[0], n), bins.add(after[1], n)
            total -= n * (not after[1])
            for c in before:
                if c not in bins.of:
                    under.drop(c)
            for c in after:
                if c and c not in known and c not in before and c in bins.of:
                    under.put(c)
            stuck.clear()
    return bins


def slots(bins: Bins) -> tuple[np.ndarray, ...]:
    """Ranges of ranks within a length: (length, first rank, first sequence, pieces a bin, first offset), sorted."""
    rows, taken, sequence = [], Counter(), 0
    for contents, n in sorted(bins.of.items(), reverse=True):
        offset = 0
        for length, m in sorted(Counter(contents).items(), reverse=True):
            rows.append((length, taken[length], sequence, m, offset))
            taken[length] += n * m
            offset += length * m
        sequence += n
    return tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(docs: DataFrame, *, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for every piece of every row of docs.

    Only documents over the capacity are cut. Null and empty texts are one piece of one token. Repeated rows are
    packed each by itself. Ties in length are settled by the order in which tasks wrote pieces: any piece of
    that length fits there. An empty table gives no rows. What the driver gets is the histogram of lengths
    (at most `capacity` rows); what it broadcasts is the plan, a few groups for each distinct length.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id))
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(slots(local_search(best_fit_decreasing(lengths, capacity))))
    upto = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select("length", "_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    ranked = pieces.join(before, ["length", "_part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_k")).alias("_rank")
    )

    def place(batches):
        length_of, first, sequence, m, offset = plan.value
        wide = int(first.max()) + 1 if len(first) else 1
        starts = length_of * wide + first
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(starts, length * wide + np.minimum(rank, wide - 1), side="right") - 1
            j = rank - first[at]
            found = [pa.array(sequence[at] + j // m[at]), pa.array(offset[at] + j % m[at] * length)]
            columns = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, *found], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op10(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
