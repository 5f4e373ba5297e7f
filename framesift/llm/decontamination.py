"""Benchmark decontamination: a prefix-filtered containment join with exact windows.

Each benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one
window). Inside a window the shingles of ``SHINGLE`` words are ordered by rarity over all
documents. A document that holds the window holds its rarest shingle, so for full
containment the necessary prefix of a window is that one shingle: documents are looked
through for these only. Where one occurs, the bounds on position and length say where the
window would have to lie, and the words there are compared one by one.

The benchmark side is a stated query set: it is applied in blocks of at most
``BLOCK_WINDOWS`` windows, each of a bounded size on every executor, whatever the size of
the benchmark. Rarity is counted over all documents with the same blocks. Several blocks
give several partial results per document, merged by document.

Defined cases: null or blank texts have no words and no hits; items without words have
no window; items with equal words are all reported; items with a null id take part, and
their id is left out of the list; equal rows get equal results; further columns are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from framesift.llm.common import NON_WORDS, Powers, grams, keyed, text_bytes, words_of
from framesift.session import store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHINGLE = 3
#: Windows of one block: 13 word hashes and two numbers each, about 30 MB.
BLOCK_WINDOWS = 250_000
#: A document is contaminated from 1/20 of its words on.
HIT_SHARE = 20


class Block:
    """Windows of one block: their words' hashes, lengths and items, and their anchors."""

    def __init__(self, items: list[str], words: list[bytes]):
        self.items, rows, owners = items, {}, {}
        for item, raw in enumerate(words):
            hashes = np.frombuffer(raw, np.uint64)
            for i in range(max(1, len(hashes) - WINDOW + 1)):
                window = hashes[i : i + WINDOW].tobytes()
                number = rows.setdefault(window, len(rows))
                owners.setdefault(number, set()).add(item)
        self.length = np.array([len(w) // 8 for w in rows], np.int64)
        self.words = np.zeros((len(rows), WINDOW), np.uint64)
        for number, w in enumerate(rows):
            self.words[number, : len(w) // 8] = np.frombuffer(w, np.uint64)
        self.owners = [np.array(sorted(owners[i]), np.int64) for i in range(len(rows))]
        self.shingle_size = np.minimum(self.length, SHINGLE)

    def shingles(self) -> np.ndarray:
        """Distinct shingles of all windows, those of short items by their own size."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in self._shingles())]))

    def _shingles(self):
        """Window numbers, offset and hash of all shingles."""
        for size in np.unique(self.shingle_size).tolist():
            for offset in range(WINDOW - size + 1):
                own = np.flatnonzero((self.shingle_size == size) & (offset + size <= self.length))
                if len(own):
                    hashes = self.words[own, offset]
                    for k in range(1, size):
                        hashes = _join(hashes, self.words[own, offset + k])
                    yield own, np.full(len(own), offset), hashes

    def anchor(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle and sort the windows by it."""
        best = np.full(len(self.length), np.iinfo(np.int64).max)
        offsets, anchors = np.zeros(len(best), np.int64), np.zeros(len(best), np.uint64)
        for own, offset, hashes in self._shingles():
            seen = counts[np.searchsorted(shingles, hashes)]
            better = seen < best[own]
            best[own[better]] = seen[better]
            offsets[own[better]], anchors[own[better]] = offset[better], hashes[better]
        order = np.argsort(anchors, kind="stable")
        self.order, self.anchors, self.offsets = order, anchors[order], offsets[order]


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a run of words from that of its beginning and the next word, as in grams()."""
    pair = np.empty((2, len(left)), np.uint64)
    pair[0], pair[1] = left, right
    return grams(pair.T.ravel(), 2)[::2]


def item_words(benchmark: DataFrame, size: int) -> DataFrame:
    """item, words: the word hashes of every item that has words, in parts of at most ``size`` windows.

    Parts of a long item overlap, so that each of its windows is in one of them.
    """

    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            words, first = words_of(data, offsets, NON_WORDS, powers)
            rows, parts = [], []
            for row, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                for at in range(a, max(a + 1, b - WINDOW + 1), size):
                    rows.append(row)
                    parts.append(words[at : min(b, at + size + WINDOW - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows, pa.int32())), pa.array(parts, pa.binary())], ["item", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(run, "item string, words binary").filter(F.octet_length("words") > 0)


def blocks(benchmark: DataFrame, size: int = BLOCK_WINDOWS):
    """The benchmark in blocks of at most ``size`` windows, read one part of an item after the other."""
    items, words, windows = [], [], 0
    for row in item_words(benchmark, size).toLocalIterator():
        own = max(1, len(row["words"]) // 8 - WINDOW + 1)
        if windows and windows + own > size:
            yield Block(items, words)
            items, words, windows = [], [], 0
        items.append(row["item"])
        words.append(bytes(row["words"]))
        windows += own
    yield Block(items, words)


def count_shingles(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each of the given shingles occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def run(batches):
        known, powers = shared.value, Powers()
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            words, _ = words_of(data, offsets, NON_WORDS, powers)
            for n in sizes:
                found, _ = _lookup(known, grams(words, n))
                counts += np.bincount(found, minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["shingle", "n"])

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(shingles), np.int64)
    for row in sums.toLocalIterator():
        counts[row["shingle"]] = row["n"]
    return counts


def _lookup(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values that occur in the sorted array: their places in it and among the values."""
    if not len(known) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Most values miss; a table of 2^20 marks on their low bits leaves few to search for.
    marks = np.zeros(1 << 20, bool)
    marks[known & np.uint64(0xFFFFF)] = True
    at = np.flatnonzero(marks[values & np.uint64(0xFFFFF)])
    place = np.searchsorted(known, values[at])
    place[place == len(known)] = 0
    same = known[place] == values[at]
    return place[same], at[same]


def _hits(block: Block, sizes: list[int], words: np.ndarray, first: np.ndarray):
    """Verified occurrences: start word and number of window, for the words of a batch."""
    starts, windows = [], []
    row_of = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    row_end = first[1:][row_of] if len(words) else first
    row_start = first[:-1][row_of] if len(words) else first
    unique, begin = np.unique(block.anchors, return_index=True)
    ends = np.append(begin[1:], len(block.anchors))
    for n in sizes:
        place, at = _lookup(unique, grams(words, n))
        reps = ends[place] - begin[place]
        at = np.repeat(at, reps)
        entry = np.repeat(begin[place] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        window = block.order[entry]
        start = at - block.offsets[entry]
        fits = (block.shingle_size[window] == n) & (start >= row_start[at]) & (start + block.length[window] <= row_end[at])
        start, window = start[fits], window[fits]
        for k in range(WINDOW):
            need = k < block.length[window]
            good = ~need
            good[need] = words[start[need] + k] == block.words[window[need], k]
            start, window = start[good], window[good]
        starts.append(start)
        windows.append(window)
    return np.concatenate(starts), np.concatenate(windows)


def matches(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, key, n_words, spans, items`` of every row.

    ``spans`` are the runs of words that lie in windows, as (start, end) pairs, ``items``
    the ids of the items that have an occurring window, sorted as strings.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key bigint, n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
    results = None
    for block in blocks(benchmark, block_windows):
        sizes = np.unique(block.shingle_size).tolist() or [SHINGLE]
        shingles = block.shingles()
        block.anchor(shingles, count_shingles(docs, shingles, sizes))
        found = keyed(docs).mapInArrow(_matcher(docs.sparkSession.sparkContext.broadcast(block), sizes), schema)
        results = found if results is None else _merged(store(results, "hits"), store(found, "hits"))
    return results


def _matcher(shared, sizes):
    def run(batches):
        block, powers = shared.value, Powers()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            words, first = words_of(data, offsets, NON_WORDS, powers)
            start, window = _hits(block, sizes, words, first)
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + block.length[window], -1)
            inside = np.cumsum(covered)[:-1] > 0
            edges = np.empty(len(words) + 1, bool)
            edges[0] = edges[-1] = True
            edges[1:-1] = inside[1:] != inside[:-1]
            edges[first] = True
            cuts = np.flatnonzero(edges) if len(words) else np.zeros(1, np.int64)
            begin, end = cuts[:-1][inside[cuts[:-1]]], cuts[1:][inside[cuts[:-1]]]
            row = np.searchsorted(first, begin, side="right") - 1
            span_offsets = np.searchsorted(row, np.arange(len(first)))
            spans = pa.StructArray.from_arrays([pa.array(begin - first[row]), pa.array(end - first[row])], ["start", "end"])
            items: list[set] = [set() for _ in range(len(batch))]
            for r, w in set(zip((np.searchsorted(first, start, side="right") - 1).tolist(), window.tolist())):
                items[r].update(block.items[i] for i in block.owners[w].tolist() if block.items[i] is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(span_offsets, pa.int32()), spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["doc_id", "key", "n_words", "spans", "items"],
            )

    return run


def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Results of two blocks; both hold the same rows, equal ones with equal results."""
    other = right.dropDuplicates(["doc_id", "key"]).select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("spans").alias("more_spans"), F.col("items").alias("more_items")
    )
    both = left.join(other, left["doc_id"].eqNullSafe(F.col("d")) & (left["key"] == F.col("k")))

    def union(spans, span):
        last = F.element_at(spans, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(joined))
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["end"] >= span["start"]), grown).otherwise(F.concat(spans, F.array(span)))

    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    spans = F.aggregate(F.array_sort(F.concat("spans", "more_spans")), empty, union)
    return both.select("doc_id", "key", "n_words", spans.alias("spans"), F.array_sort(F.array_union("items", "more_items")).alias("items"))


def judged(found: DataFrame) -> DataFrame:
    """``matches`` with ``n_hit`` and ``contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    counted = found.withColumn("n_hit", hit)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
