"""Exact Jaccard self-join of word n-gram sets over prefix trees, and its components.

A document's set holds the hashes of its distinct runs of ``width`` words (``N`` unless
given). All sets share one order, frequent shingles last (classes of a fixed-size count
sketch over all documents, then the hash). Two sets of similarity ``s = numerator / 100``
(``NUMERATOR`` unless given) must share a shingle within their first
``n - ceil(s n) + 1`` in that order, so only these prefixes meet:

* The shingle space is cut into slices. A slice holds, for each set, its prefix shingles
  that fall there, as one ordered list; the lists of a slice form a trie with a list of
  nodes for each shingle.
* Sets under one node share the whole path to it. They are paired at its first shingle
  only; further shingles pair sets of different nodes. A pair is dropped when the
  remaining lengths cannot reach the overlap that both sizes require.
* First each set is paired with leaders only, ``LEADERS`` for each shingle, which joins groups
  of near copies with few pairs. Verified links give components. In the other one of ``LEADER_ROUNDS``
  rounds each set outside of a shingle's largest component is paired with ``PARTNERS`` others, in another
  random order, so also members that link with few of a large group are hardly left outside its
  component, and pairs grow with the sets, not with their square. Then whatever pairs of different components still share a shingle are all
  tested, so no link between components is lost; pairs inside a component would not change it.
* Signatures of parity bits bound from below in how many shingles two sets differ. Nodes
  pair sets only where signatures of ``SHORT_BITS`` allow the similarity.
* Pairs are verified on the full sets, after a look at signatures that grow with them. Only documents that occur in pairs are read again,
  told by a bit table of fixed size, whose false hits the join removes.

Copies with equal sets count once from the first pass on. Sets are named by 64-bit
digests; at 10^10 documents the expected number of clashes is below 3.

Defined cases: null or blank texts have an empty set, are linked with nothing and form a
component of their own; texts of fewer than ``width`` words have one shingle, the whole
sequence; a null ``doc_id`` takes part but never names a component unless alone; rows
with equal ids are told apart by text and get the component of their own text; further
columns are not looked at.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from framesift.llm.bits import bit_table, maybe
from framesift.llm.common import BLANKS, Powers, grams, keyed, mix64, text_bytes, words_of
from framesift.llm.components import components
from framesift.session import store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 4
#: Two sets link when NUMERATOR / 100 of their union is shared, if not told otherwise.
NUMERATOR = 85
SKETCH_SLOTS = 1 << 18
SLICE_SHINGLES = 200_000
LEAST_SLICES = 48
PAIRS_AT_ONCE = 200_000
#: Bits of a signature at least, and of the one that goes with every list.
SHORT_BITS = 512
#: Rounds before all other pairs are tested, the first with so many leaders of each shingle, later ones
#: with so many partners of each set; the result is the same for any numbers.
LEADER_ROUNDS = 2
LEADERS, PARTNERS = 16, 64

_ENTRY = np.dtype([("shingle", "<u8"), ("place", "<i4")])


def prefix_length(n, numerator: int = NUMERATOR):
    return n - -(-numerator * n // 100) + 1


def needed_overlap(n, m, numerator: int = NUMERATOR):
    return -(-numerator * (n + m) // (100 + numerator))


def shingle_sets(batch, powers: Powers, n: int = N):
    """The ordered distinct shingles of each row of a batch with a ``text`` column."""
    data, offsets = text_bytes(batch.column("text"))
    words, first = words_of(data, offsets, BLANKS, powers)
    runs = grams(words, n)
    for a, b in pairwise(first.tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield mix64(grams(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield words[:0]


def _signature(values: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; as many bits as shingles, rounded up to a power of two."""
    bits = max(SHORT_BITS, 1 << (len(values) - 1).bit_length()) if len(values) else SHORT_BITS
    hit = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((hit & 1).astype(bool)).tobytes()


def _short(signature: bytes) -> bytes:
    return np.bitwise_xor.reduce(np.frombuffer(signature, np.uint64).reshape(-1, SHORT_BITS // 64)).tobytes()


def least_difference(left: bytes, right: bytes) -> int:
    """In how many shingles two sets differ at least; the longer signature is folded."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _digest(values: np.ndarray) -> int:
    return int(np.int64(mix64(np.array([mix64(values).sum(dtype=np.uint64) + np.uint64(len(values))]))[0].astype(np.int64)))


def _scan(width: int):
    """A row for each document (n, set), and at the end rows of the task's sketch (slot, n)."""

    def run(batches):
        powers, sketch = Powers(), np.zeros(SKETCH_SLOTS, np.int64)
        for batch in batches:
            sizes, names, signatures, shorts = [], [], [], []
            for values in shingle_sets(batch, powers, width):
                sizes.append(len(values))
                names.append(_digest(values))
                signatures.append(_signature(values))
                shorts.append(_short(signatures[-1]))
                np.add.at(sketch, (values & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64), 1)
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), none, pa.array(signatures, pa.binary()), pa.array(shorts, pa.binary())],
                ["doc_id", "key", "set", "n", "slot", "signature", "short"],
            )
            kind = batch.column("doc_id").type
        some = np.flatnonzero(sketch)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), kind), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(sketch[some]), pa.array(some, pa.int32()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())],
                ["doc_id", "key", "set", "n", "slot", "signature", "short"],
            )

    return run


def frequency_classes(scanned: DataFrame) -> np.ndarray:
    """Class of each slot of the sketch: 0 unless well above the mean, then by powers of two."""
    sums = scanned.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(SKETCH_SLOTS, np.int64)
    for row in sums.toLocalIterator():
        counts[row["slot"]] = row["n"]
    usual = counts.mean()
    noise = 6 * np.sqrt(usual) + 8
    above = np.maximum(counts - usual, 0) / noise
    return np.where(above < 1, 0, np.log2(np.maximum(above, 1)).astype(np.int64) + 1).astype(np.uint8)


def _prefixes(shared, slices: int, width: int, numerator: int):
    """A row for each set and slice: the set's prefix shingles there and their places."""

    def run(batches):
        classes, powers, seen = shared.value, Powers(), set()
        for batch in batches:
            out_slice, out_set, out_n, out_list = [], [], [], []
            for values in shingle_sets(batch, powers, width):
                n, name = len(values), _digest(values)
                if n == 0 or name in seen:
                    continue
                seen.add(name)
                kind = classes[(values & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64)]
                order = np.argsort(kind, kind="stable")[: prefix_length(n, numerator)] if kind.any() else np.arange(prefix_length(n, numerator))
                entries = np.empty(len(order), _ENTRY)
                entries["shingle"], entries["place"] = values[order], np.arange(len(order))
                where = (mix64(values[order]) % np.uint64(slices)).astype(np.int64)
                sort = np.argsort(where, kind="stable")
                entries, where = entries[sort], where[sort]
                cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(where)]
                for a, b in pairwise(cuts):
                    out_slice.append(int(where[a]))
                    out_set.append(name)
                    out_n.append(n)
                    out_list.append(entries[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_slice, pa.int32()), pa.array(out_set, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_list, pa.binary())], ["slice", "set", "n", "list"]
            )

    return run


class Trie:
    """Prefix lists of one slice: nodes by (parent, shingle), and the nodes of each shingle.

    ``sizes, groups, shorts`` describe the records; a node keeps the records whose list runs
    through it, and the place of its shingle in each.
    """

    def __init__(self, sizes, groups, shorts, lists, numerator: int):
        self.sizes, self.groups, self.shorts, self.numerator = sizes, groups, shorts, numerator
        self.last_place = sizes - needed_overlap(sizes, sizes, numerator)
        self.children: dict[tuple[int, int], int] = {}
        self.depth, self.records, self.places = [0], [None], [None]
        self.header: dict[int, list[int]] = {}
        for record, entries in lists:
            node, depth = 0, 0
            for shingle, place in entries:
                depth += 1
                child = self.children.get((node, shingle))
                if child is None:
                    child = self.children[node, shingle] = len(self.depth)
                    self.depth.append(depth)
                    self.records.append([])
                    self.places.append([])
                    self.header.setdefault(shingle, []).append(child)
                self.records[child].append(record)
                self.places[child].append(place)
                node = child

    def meetings(self):
        """For each shared shingle: the records that meet there, their places, and their node.

        Node 0 stands for nodes of the first level, whose records meet one another too.
        """
        for nodes in self.header.values():
            if len(nodes) == 1 and (self.depth[nodes[0]] > 1 or len(self.records[nodes[0]]) == 1):
                continue  # shared already further up
            records = np.concatenate([self.records[x] for x in nodes])
            groups = self.groups[records]
            if (groups == groups[0]).all():
                continue
            yield records, np.concatenate([self.places[x] for x in nodes]), np.repeat([0 if self.depth[x] == 1 else x for x in nodes], [len(self.records[x]) for x in nodes])

    def _possible(self, a, b, place_a, place_b, node_a, node_b):
        """Which pairs could be similar, by size and by what remains after the shingle."""
        n, m = self.sizes[a], self.sizes[b]
        rest = 1 + np.minimum(n - place_a, m - place_b) - 1
        return ((node_a != node_b) | (node_a == 0)) & (self.groups[a] != self.groups[b]) & (rest >= needed_overlap(n, m, self.numerator))

    def _alike(self, a, b):
        """Which pairs the short signatures allow."""
        n, m = self.sizes[a], self.sizes[b]
        return np.bitwise_count(self.shorts[a] ^ self.shorts[b]).sum(axis=1, dtype=np.int64) <= n + m - 2 * needed_overlap(n, m, self.numerator)

    def leader_pairs(self, ranks):
        """Each record with the first ``LEADERS`` records, by ``ranks``, that could be similar to it."""
        for records, places, nodes in self.meetings():
            # Those too far in for a set of their own size lead last, as few could be similar to them.
            order = np.lexsort((ranks[records], places > self.last_place[records]))
            records, places, nodes = records[order], places[order], nodes[order]
            while len(records) > 1:
                lead = slice(0, LEADERS)
                good = self._possible(records[lead, None], records[None, :], places[lead, None], places[None, :], nodes[lead, None], nodes[None, :])
                x, y = np.nonzero(np.triu(good, 1))
                alike = self._alike(records[x], records[y])
                x, y = x[alike], y[alike]
                if len(x):
                    yield records[x], records[y]
                left = np.ones(len(records), bool)
                left[lead], left[y] = False, False
                # Records unlike these leaders may find some of their own.
                records, places, nodes = records[left], places[left], nodes[left]
                if not len(x) and len(records) > 64:
                    break

    def near_pairs(self, ranks):
        """Each record outside of a shingle's largest group with the first ``PARTNERS``, by ``ranks``, that could be similar to it."""
        for records, places, nodes in self.meetings():
            order = np.argsort(ranks[records], kind="stable")
            records, places, nodes = records[order], places[order], nodes[order]
            group = np.unique(self.groups[records], return_inverse=True)[1]
            others = np.flatnonzero(group != np.bincount(group).argmax())
            step = max(1, PAIRS_AT_ONCE // len(records))
            for i in range(0, len(others), step):
                a = others[i : i + step]
                x, y = np.nonzero(self._possible(records[a, None], records[None, :], places[a, None], places[None, :], nodes[a, None], nodes[None, :]))
                alike = self._alike(records[a[x]], records[y])
                x, y = x[alike], y[alike]
                some = np.arange(len(x)) - np.searchsorted(x, x) < PARTNERS
                if some.any():
                    yield records[a[x[some]]], records[y[some]]

    def all_pairs(self):
        """All pairs of different groups that could be similar, each shingle's in blocks."""
        for records, places, nodes in self.meetings():
            step = max(1, PAIRS_AT_ONCE // len(records))
            for i in range(0, len(records), step):
                a = slice(i, i + step)
                good = self._possible(records[a, None], records[None, :], places[a, None], places[None, :], nodes[a, None], nodes[None, :])
                x, y = np.nonzero(good)
                x += i
                later = x < y
                a, b = records[x[later]], records[y[later]]
                alike = self._alike(a, b)
                if alike.any():
                    yield a[alike], b[alike]


def _slice_of(table: pa.Table):
    """Sets of a slice, the row of each, and their entries with the owner of each; copies count once."""
    names, first = np.unique(table.column("set").to_numpy(), return_index=True)
    lists = table.column("list").take(pa.array(first)).to_pylist()
    return names, first, np.frombuffer(b"".join(lists), _ENTRY), np.repeat(np.arange(len(names)), [len(x) // _ENTRY.itemsize for x in lists])


def _cuts(owner: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else []


def _shared(table: pa.Table) -> pa.Table:
    """The lists of a slice without shingles of one set only, and without lists that become empty."""
    names, first, entries, owner = _slice_of(table)
    _, back, counts = np.unique(entries["shingle"], return_inverse=True, return_counts=True)
    shared = counts[back] > 1
    owner, entries = owner[shared], entries[shared]
    cuts = _cuts(owner)
    members = owner[cuts[:-1]] if len(owner) else owner
    return pa.table({
        "slice": table.column("slice").take(pa.array(first[members])), "set": pa.array(names[members], pa.int64()),
        "n": table.column("n").take(pa.array(first[members])), "list": pa.array([entries[x:y].tobytes() for x, y in pairwise(cuts)], pa.binary()),
    })


def _meetings(turn: int | None, numerator: int):
    """Pairs (a, b) of a slice: with the leaders (round 0) or partners (later) of round ``turn``, or all."""

    def run(table: pa.Table) -> pa.Table:
        names, first, entries, owner = _slice_of(table)
        sizes = table.column("n").to_numpy()[first].astype(np.int64)
        groups = table.column("component").to_numpy()[first]
        shorts = np.frombuffer(b"".join(table.column("short").take(pa.array(first)).to_pylist()), np.uint64).reshape(-1, SHORT_BITS // 64)
        shingles, places = np.unique(entries["shingle"], return_inverse=True)[1].tolist(), entries["place"].tolist()
        trie = Trie(sizes, groups, shorts, ((int(owner[a]), zip(shingles[a:b], places[a:b])) for a, b in pairwise(_cuts(owner))), numerator)
        found, size = [np.zeros((2, 0), np.int64)], 0
        ranks = mix64(names.astype(np.uint64) + np.uint64(turn or 0))
        for pair in trie.all_pairs() if turn is None else trie.near_pairs(ranks) if turn else trie.leader_pairs(ranks):
            found.append(np.stack(pair).astype(np.int64))
            size += found[-1].shape[1]
            if size > 10 * PAIRS_AT_ONCE:
                found, size = [np.unique(np.concatenate(found, axis=1), axis=1)], 0
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        a, b = names[a], names[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _unlike(numerator: int):
    """Pairs whose signatures allow the similarity: bits that differ are shingles that differ."""

    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            differ = np.array([least_difference(x, y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(differ <= n + m - 2 * needed_overlap(n, m, numerator)))

    return run


def _by_signature(pairs: DataFrame, owners: DataFrame, numerator: int) -> DataFrame:
    left = owners.select(F.col("set").alias("a"), "n", F.col("signature").alias("left"))
    right = owners.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("signature").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right").mapInArrow(_unlike(numerator), "a bigint, b bigint")


def _wanted_sets(shared, width: int):
    def run(batches):
        bits, powers = shared.value, Powers()
        for batch in batches:
            batch = batch.filter(pa.array(maybe(bits, batch.column("h").to_numpy())))
            names, sets = [], []
            for values in shingle_sets(batch, powers, width):
                names.append(_digest(values))
                sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "key", "set", "shingles"])

    return run


def _similar(numerator: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, width: int, numerator: int) -> DataFrame:
    """The pairs of sets that link. ``owners``: set, n, signature, doc_id, key of one document per set."""
    spark = docs.sparkSession
    pairs = store(_by_signature(pairs, owners, numerator), "pairs")
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    ids = store(owners.join(wanted, F.col("set") == F.col("s"), "left_semi"), "wanted")
    bits = spark.sparkContext.broadcast(bit_table(ids, F.xxhash64(F.lit(2), "doc_id", "key")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = keyed(docs).withColumn("h", F.xxhash64(F.lit(2), "doc_id", "key"))
    sets = read.mapInArrow(_wanted_sets(bits, width), f"doc_id {kind}, key bigint, set bigint, shingles binary")
    chosen = ids.select("set", F.col("doc_id").alias("d"), F.col("key").alias("k"))
    sets = sets.join(chosen, "set").filter(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("set", "shingles").dropDuplicates(["set"])
    sets = store(sets, "sets")
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(_similar(numerator), "a bigint, b bigint")


def _with_roots(rows: DataFrame, column: str, roots: DataFrame | None, name: str) -> DataFrame:
    """``rows`` with the component of the set in ``column``: its root, or the set itself."""
    if roots is None:
        return rows.withColumn(name, F.col(column))
    known = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(known, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", column)).drop("_node", "_root")


def _joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` after more links: only links between components, each once, are looked at."""
    between = _with_roots(_with_roots(links, "a", roots, "x"), "b", roots, "y").filter("x <> y")
    more = components(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if roots is None:
        return store(more.select("node", "root"), "roots")
    moved = _with_roots(roots, "root", more, "now").select("node", F.col("now").alias("root"))
    return store(moved.union(more.select("node", "root")), "roots")


def joined(docs: DataFrame, width: int = N, numerator: int = NUMERATOR) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, root`` of every row.

    Shingles are of ``width`` words, and sets link from a similarity of ``numerator / 100`` on.

    ``root`` names the component by a set and is null for documents without words.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = store(keyed(docs).mapInArrow(_scan(width), f"doc_id {kind}, key bigint, set bigint, n bigint, slot int, signature binary, short binary"), "scanned")
    rows = scanned.filter("slot IS NULL")
    full = rows.filter("n > 0")
    owners = store(full.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("o"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("short").alias("short")).select("set", "n", "signature", "short", "o.doc_id", "o.key"), "owners")
    shingles = owners.agg(F.sum(F.col("n") - F.ceil(F.col("n") * numerator / 100) + 1)).first()[0] or 0
    slices = max(LEAST_SLICES, int(shingles) // SLICE_SHINGLES)
    classes = spark.sparkContext.broadcast(frequency_classes(scanned))
    prefixes = keyed(docs).mapInArrow(_prefixes(classes, slices, width, numerator), "slice int, set bigint, n int, list binary")
    shared = prefixes.groupBy("slice").applyInArrow(_shared, "slice int, set bigint, n int, list binary")
    lists = store(shared.join(owners.select("set", "short"), "set"), "lists")
    roots = None
    for turn in [*range(LEADER_ROUNDS), None]:
        grouped = _with_roots(lists, "set", roots, "component")
        found = grouped.groupBy("slice").applyInArrow(_meetings(turn, numerator), "a bigint, b bigint").distinct()
        roots = _joined_roots(roots, verified(found, docs, owners, width, numerator))

    placed = rows.join(roots, (F.col("set") == F.col("node")) & (F.col("n") > 0), "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "set")))
    named = placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "r")
    return placed.join(named, (F.col("root") == F.col("r")) & (F.col("n") > 0), "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root"
    )
