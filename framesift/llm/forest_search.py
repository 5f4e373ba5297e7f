"""Nearest neighbours by inner product from a forest of random-projection trees.

Every row is indexed and every query is searched; only the trees' directions and cuts
come from a sample of bounded size.

* The forest has ``TREES`` trees of one depth. Each level of a tree has a random
  direction, orthogonal to those of the other levels, and each node cuts at the median
  of the sample rows that reach it. The sample is chosen by a hash of the row and holds
  about ``SAMPLE_ROWS`` rows, of which ``NODE_ROWS`` at least reach a leaf.
* One queue over all trees gives a query the leaf that is next likeliest to hold
  neighbours: its priority is the sum of the margins by which the query lies on the
  other side of a cut, for a query drawn towards the centre as its neighbours are.
* The queue runs until the leaves taken hold a number of rows that reaches ``RECALL``
  for ``CALIBRATION`` queries, whose true neighbours are found by comparing them with
  every row. The bound on work is thus measured on the table itself, at any size.
* Leaves next to each other form blocks. A block's rows and the queries that want some of
  its leaves meet in cells of at most about ``BLOCK_ROWS`` rows and ``CELL_QUERIES``
  queries; rows of a large leaf and queries of a busy block are dealt over several cells,
  so a vector that fills a third of the table is no single task. Cells stream: rows
  first, then the queries batch by batch.
* Within a leaf all pairs that a query wants are scored; those that reach its k-th best
  of the sample rows in its leaves (no row below that can be among the k best) are scored again in double
  precision, component after component, and the k best of a cell go on to the window
  that ranks a query's finds.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or
have another length than most take no part. Equal rows are rows of their own: each is
searched, and finds the others. Ties go to the smaller ``vec_id``, a null one last; a row
without ``vec_id`` is no query. An empty table has no result; with k rows or fewer all of
them are found. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from framesift.llm.vectors import is_finite, lists, matrix, usual_length
from framesift.session import store
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 8
#: Rows of a leaf, as long as the sample can tell leaves so small apart.
LEAF_ROWS = 128
SAMPLE_ROWS, NODE_ROWS = 16384, 16
CALIBRATION, RECALL = 128, 0.95
BLOCK_ROWS, CELL_QUERIES = 4096, 20000
SEED = 11


@dataclass(frozen=True)
class Forest:
    """Directions ``(length, trees * depth)``, cuts ``(trees, nodes)``, rows of each leaf."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray
    sizes: np.ndarray
    draw: float = 1.0
    budget: int = 0

    @property
    def trees(self) -> int:
        return len(self.cuts)

    def sides(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.normals).reshape(len(x), self.trees, self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, numbered over the whole forest."""
        side, node = self.sides(x), np.zeros((len(x), self.trees), np.int64)
        tree = np.arange(self.trees)
        for level in range(self.depth):
            node = 2 * node + 1 + (side[:, :, level] > self.cuts[tree, node])
        return node - (2**self.depth - 1) + tree * 2**self.depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Per query, tree and node: how far the drawn query lies above the node's cut."""
        level = np.repeat(np.arange(self.depth), 2 ** np.arange(self.depth))
        return self.draw * self.sides(x)[:, :, level] - self.cuts


def fit(sample: np.ndarray, n_rows: int) -> Forest:
    """Directions and cuts from the sample; the depth follows the number of rows."""
    depth = max(0, min(math.ceil(math.log2(max(n_rows, 1) / LEAF_ROWS)), int(math.log2(max(len(sample), 1) / NODE_ROWS)))) if len(sample) >= NODE_ROWS else 0
    trees, length = (TREES if depth else 1), sample.shape[1]
    rnd, parts = np.random.default_rng(SEED), []
    for first in range(0, trees * depth, length):
        parts.append(np.linalg.qr(rnd.standard_normal((length, min(length, trees * depth - first))))[0])
    normals = np.concatenate(parts, axis=1) if parts else np.zeros((length, 0))
    cuts = np.zeros((trees, 2**depth - 1))
    side = (sample @ normals).reshape(len(sample), trees, depth)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            first = np.searchsorted(node[order], np.arange(2**level, 2 ** (level + 1) + 1) - 1)
            for v in range(2**level):
                here = order[first[v] : first[v + 1]]
                if len(here):
                    cuts[t, 2**level - 1 + v] = np.median(side[here, t, level])
            node = 2 * node + 1 + (side[:, t, level] > cuts[t, node])
    return Forest(depth, normals, cuts, np.zeros(trees * 2**depth, np.int64))


def taken_leaves(margins: np.ndarray, sizes: list[int], depth: int, budget: float):
    """Leaves in the order of one queue over all trees, until they hold ``budget`` rows."""
    inner, above = 2**depth - 1, margins.tolist()
    queue = [(0.0, t, 0) for t in range(len(above))]
    held = 0
    while queue and held < budget:
        cost, t, node = heapq.heappop(queue)
        here = above[t]
        while node < inner:
            m, node = here[node], 2 * node + 1
            if m > 0:
                heapq.heappush(queue, (cost + m, t, node))
                node += 1
            else:
                heapq.heappush(queue, (cost - m, t, node + 1))
        leaf = t * (inner + 1) + node - inner
        held += sizes[leaf]
        yield leaf, held


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row of a score matrix the columns of its k largest entries, in any order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(scores, -k, axis=1)[:, -k:]


def _true_neighbours(rows: DataFrame, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """``(query, neighbour's components)`` of a few queries against every row, in blocks."""

    def best(batches):
        names, kept = ["q", "row", "score", "x"], None
        for batch in batches:
            x, row = matrix(batch.column("x")), batch.column("row").to_numpy()
            scores = queries @ x.T
            scores[own[:, None] == row[None, :]] = -np.inf
            at = _best(scores, k)
            q = np.repeat(np.arange(len(queries)), at.shape[1])
            at = at.ravel()
            found = (q, row[at], scores[q, at], x[at])
            kept = found if kept is None else tuple(np.concatenate(z) for z in zip(kept, found))
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            first = np.searchsorted(kept[0][order], np.arange(len(queries)))
            order = order[np.arange(len(order)) - first[kept[0][order]] < k]
            kept = tuple(z[order] for z in kept)
        if kept is not None and len(kept[0]):
            lengths = np.full(len(kept[0]), kept[3].shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept[0], pa.int32()), pa.array(kept[1]), pa.array(kept[2]), lists(kept[3].ravel(), lengths, pa.float64())], names
            )

    found = rows.select("row", "x").mapInArrow(best, "q int, row bigint, score double, x array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
    near = found.withColumn("place", place).filter(F.col("place") <= k).filter("score > '-Infinity'").select("q", "x").toArrow()
    near = near.combine_chunks()
    if near.num_rows == 0:
        return np.zeros(0, np.int64), np.zeros((0, queries.shape[1]))
    return near.column("q").to_numpy().astype(np.int64), matrix(near.column("x").combine_chunks())


def _calibrated(forest: Forest, queries: np.ndarray, near: tuple[np.ndarray, np.ndarray], k: int) -> Forest:
    """The forest with the pull of neighbours to the centre and the rows a search must take."""
    q, x = near
    mine, theirs = queries[q] @ forest.normals, x @ forest.normals
    weight = float((mine * mine).sum())
    draw = float((mine * theirs).sum()) / weight if weight else 1.0
    drawn = Forest(forest.depth, forest.normals, forest.cuts, forest.sizes, draw)
    sizes, leaves, needed = forest.sizes.tolist(), drawn.leaves(x), []
    order = np.argsort(q, kind="stable")
    first = np.searchsorted(q[order], np.arange(len(queries) + 1))
    for i, margins in enumerate(drawn.margins(queries)):
        mine = leaves[order[first[i] : first[i + 1]]]
        left, seen = len(mine), np.zeros(len(mine), bool)
        open_rows = {leaf: np.flatnonzero((mine == leaf).any(axis=1)) for leaf in set(mine.ravel().tolist())}
        for leaf, rows in taken_leaves(margins, sizes, forest.depth, math.inf):
            if leaf in open_rows:
                new = open_rows[leaf][~seen[open_rows[leaf]]]
                seen[new] = True
                needed += [rows] * len(new)
                left -= len(new)
                if left == 0:
                    break
    needed.sort()
    budget = needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))] if needed else 1
    # Leaves of one tree hold different rows: so many rows are k others at least.
    budget = max(budget, forest.trees * (k + 1))
    return Forest(forest.depth, forest.normals, forest.cuts, forest.sizes, draw, int(budget))


def _leaf_counts(rows: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of every leaf: a table of fixed size."""

    def count(batches):
        total = np.zeros(len(forest.sizes), np.int64)
        for batch in batches:
            total += np.bincount(forest.leaves(matrix(batch.column("x"))).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["leaf", "n"])

    counted = rows.select("x").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(len(forest.sizes), np.int64)
    for row in counted:
        sizes[row["leaf"]] = row["n"]
    return sizes


def build(rows: DataFrame, k: int) -> tuple[Forest, np.ndarray, np.ndarray]:
    """Forest over ``rows(row, id, x, is_query)``, with the sample and its row numbers."""
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(2**32)) < int(share * 2**32) + 1)
    sample = drawn.select("row", "x").limit(2 * SAMPLE_ROWS).orderBy("row").toArrow().combine_chunks()
    x, own = matrix(sample.column("x").combine_chunks()), sample.column("row").to_numpy()
    forest = fit(x, n)
    forest = Forest(forest.depth, forest.normals, forest.cuts, _leaf_counts(rows, forest))
    asked = rows.filter("is_query").select("row", "x").orderBy(F.xxhash64(F.lit(SEED + 1), "row"), "row").limit(CALIBRATION).toArrow().combine_chunks()
    if asked.num_rows:
        queries, mine = matrix(asked.column("x").combine_chunks()), asked.column("row").to_numpy()
        forest = _calibrated(forest, queries, _true_neighbours(rows, queries, mine, k), k)
    return forest, x, own


def _visits(queries: DataFrame, forest: Forest, sample: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """Each query with the leaves it takes and its k-th best of the sample rows in them."""
    sizes, places = forest.sizes.tolist(), forest.leaves(sample)

    def search(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                x, row = matrix(part.column("x")), part.column("row").to_numpy()
                scores = x @ sample.T
                scores[row[:, None] == own[None, :]] = -np.inf
                taken = [[leaf for leaf, _ in taken_leaves(m, sizes, forest.depth, forest.budget) if sizes[leaf]] for m in forest.margins(x)]
                for i, leaves in enumerate(taken):
                    met = np.zeros(len(sizes), bool)
                    met[leaves] = True
                    scores[i, ~met[places].any(axis=1)] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
                flat = np.fromiter((leaf for t in taken for leaf in t), np.int32)
                leaves = lists(flat, np.array([len(t) for t in taken]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), part.column("x"), pa.array(least), leaves], ["row", "id", "x", "least", "leaves"])

    kind = queries.schema["x"].dataType.simpleString()
    return queries.mapInArrow(search, f"row bigint, id bigint, x {kind}, least double, leaves array<int>")


@dataclass(frozen=True)
class Cells:
    """Block of each leaf, and how many parts of rows and of queries a block has."""

    block: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    chunks: np.ndarray

    @staticmethod
    def of(forest: Forest, n_queries: dict[int, int] | None = None) -> Cells:
        block, held, blocks = np.zeros(len(forest.sizes), np.int64), [], -1
        per_tree = 2**forest.depth
        for leaf, n in enumerate(forest.sizes.tolist()):
            if leaf % per_tree == 0 or held[blocks] + n > BLOCK_ROWS:
                held.append(0)
                blocks += 1
            held[blocks] += n
            block[leaf] = blocks
        parts = np.maximum(1, -(-np.array(held, np.int64) // (2 * BLOCK_ROWS)))
        chunks = np.array([max(1, -(-(n_queries or {}).get(b, 0) // CELL_QUERIES)) for b in range(len(held))], np.int64)
        first = np.concatenate([[0], np.cumsum(parts * chunks)])
        return Cells(block, first, parts, chunks)


def _spread(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A part below ``n`` for each row number, even for rows next to each other."""
    mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % n.astype(np.uint64)).astype(np.int64)


_CELL = "cell bigint, is_query boolean, row bigint, id bigint, least double, leaves array<int>, x {}"


def _dealt(take: np.ndarray, cell: np.ndarray, batch: pa.RecordBatch, is_query: bool, least, leaves) -> pa.RecordBatch:
    at = pa.array(take)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell), pa.array(np.full(len(take), is_query)), batch.column("row").take(at), batch.column("id").take(at), least, leaves, batch.column("x").take(at)],
        ["cell", "is_query", "row", "id", "least", "leaves", "x"],
    )


def _copies(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries to be repeated: which entry, and the number of the copy."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _row_cells(rows: DataFrame, forest: Forest, cells: Cells) -> DataFrame:
    def deal(batches):
        for batch in batches:
            row, leaf = batch.column("row").to_numpy(), forest.leaves(matrix(batch.column("x")))
            who, leaf = np.repeat(np.arange(len(row)), forest.trees), leaf.ravel()
            block = cells.block[leaf]
            which, chunk = _copies(cells.chunks[block])
            block = block[which]
            cell = cells.first[block] + _spread(row[who[which]], cells.parts[block]) * cells.chunks[block] + chunk
            none = pa.nulls(len(which), pa.float64())
            yield _dealt(who[which], cell, batch, False, none, lists(leaf[which].astype(np.int32), np.ones(len(which), np.int64), pa.int32()))

    return rows.select("row", "id", "x").mapInArrow(deal, _CELL.format(rows.schema["x"].dataType.simpleString()))


def _query_cells(visits: DataFrame, cells: Cells) -> DataFrame:
    def deal(batches):
        for batch in batches:
            row, wanted = batch.column("row").to_numpy(), batch.column("leaves")
            who = np.repeat(np.arange(len(row)), wanted.value_lengths().to_numpy())
            leaf = wanted.flatten().to_numpy()
            order = np.lexsort((leaf, who))
            who, leaf = who[order], leaf[order]
            block = cells.block[leaf]
            new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (block[1:] != block[:-1])]) if len(who) else np.zeros(0, np.int64)
            lengths = np.diff(np.r_[new, len(who)])
            which, part = _copies(cells.parts[block[new]])
            mine, of = who[new][which], block[new][which]
            cell = cells.first[of] + part * cells.chunks[of] + _spread(row[mine], cells.chunks[of])
            run, step = _copies(lengths[which])
            leaves = lists(leaf[new[which][run] + step].astype(np.int32), lengths[which], pa.int32())
            yield _dealt(mine, cell, batch, True, batch.column("least").take(pa.array(mine)), leaves)

    return visits.mapInArrow(deal, _CELL.format(visits.schema["x"].dataType.simpleString()))


_LAST = np.iinfo(np.int64).max


class _Members:
    """Rows of a cell, gathered before its queries come."""

    def __init__(self):
        self.batches = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def sorted(self):
        all_rows = pa.Table.from_batches(self.batches).combine_chunks()
        leaf = all_rows.column("leaves").combine_chunks().flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf = leaf[order]
        x = matrix(all_rows.column("x").combine_chunks())[order]
        ids = all_rows.column("id").fill_null(_LAST).to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        spans = dict(zip(leaf[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(leaf)].tolist())))
        return spans, all_rows.column("row").to_numpy()[order], ids, x, float(np.sqrt((x * x).sum(axis=1).max()))


def _scored(members, batch: pa.RecordBatch, k: int) -> pa.RecordBatch | None:
    """The k best rows of the leaves that each query of a batch wants in this cell."""
    spans, rows, ids, x, longest = members
    q, row = matrix(batch.column("x")), batch.column("row").to_numpy()
    wanted = batch.column("leaves")
    who, leaf = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
    # Products of matrices round in another order than the sum that counts.
    slack = 1e-15 * (4 + q.shape[1]) * np.sqrt((q * q).sum(axis=1)) * longest
    least = batch.column("least").to_numpy() - slack
    order = np.argsort(leaf, kind="stable")
    cuts = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]]) if len(leaf) else []
    near, far = [], []
    for start, end in zip(cuts, np.r_[cuts[1:], len(leaf)] if len(leaf) else []):
        span = spans.get(int(leaf[order[start]]))
        if span is None:
            continue
        mine = who[order[start:end]]
        a, b = np.nonzero(q[mine] @ x[span[0] : span[1]].T >= least[mine][:, None])
        near.append(mine[a])
        far.append(span[0] + b)
    if not near:
        return None
    near, far = np.concatenate(near), np.concatenate(far)
    other = row[near] != rows[far]
    near, far = near[other], far[other]
    if len(near) == 0:
        return None
    score = np.zeros(len(near))
    for d in range(q.shape[1]):
        score += q[near, d] * x[far, d]
    order = np.lexsort((rows[far], ids[far], -score, near))
    first = np.searchsorted(near[order], np.arange(len(q)))
    order = order[np.arange(len(order)) - first[near[order]] < k]
    near, far, found = near[order], far[order], ids[far[order]]
    return pa.RecordBatch.from_arrays(
        [pa.array(row[near]), batch.column("id").take(pa.array(near)), pa.array(rows[far]), pa.array(found, mask=found == _LAST), pa.array(score[order])],
        ["query_row", "query_id", "row", "vec_id", "score"],
    )


def _meet(cells: DataFrame, k: int) -> DataFrame:
    def score(batches):
        cell, members, ready = None, None, None
        for batch in batches:
            key, asks = batch.column("cell").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (asks[1:] != asks[:-1])])
            for start, end in zip(cuts, np.r_[cuts[1:], len(key)]):
                part = batch.slice(start, end - start)
                if key[start] != cell:
                    cell, members, ready = key[start], _Members(), None
                if not asks[start]:
                    members.add(part)
                elif members.batches:
                    ready = ready or members.sorted()
                    found = _scored(ready, part, k)
                    if found is not None:
                        yield found

    placed = cells.repartition("cell").sortWithinPartitions("cell", "is_query")
    return placed.mapInArrow(score, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double")


def numbered(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``row, id, x, is_query`` of the rows that take part, written once."""
    good = is_finite(column) & F.exists(F.col(column), lambda v: v != 0)
    rows = vectors.filter(good).select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    length = usual_length(rows, "x")
    return store(rows.filter(F.size("x") == length).withColumn("row", F.monotonically_increasing_id()), "vectors")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_row, query_id, rank, row, vec_id, score`` of the k nearest rows found for each query."""
    rows = numbered(vectors, is_query, id_column, column)
    if rows.isEmpty():
        return rows.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.lit(1).alias("rank"), "row", F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    forest, sample, own = build(rows, k)
    visits = store(_visits(rows.filter("is_query").select("row", "id", "x"), forest, sample, own, k), "visits")
    cells = Cells.of(forest)

    def wanted_blocks(batches):
        total = np.zeros(len(cells.parts), np.int64)
        for batch in batches:
            wanted = batch.column("leaves")
            who = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            pairs = np.unique(who * len(total) + cells.block[wanted.flatten().to_numpy()])
            total += np.bincount(pairs % len(total), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["block", "n"])

    busy = visits.select("leaves").mapInArrow(wanted_blocks, "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n")).collect()
    cells = Cells.of(forest, {r["block"]: r["n"] for r in busy})
    found = _meet(_row_cells(rows, forest, cells).union(_query_cells(visits, cells)), k)
    # A row found in several trees counts once; both steps use the same shuffle.
    once = found.repartition("query_row").groupBy("query_row", "row").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "row", "vec_id", "score")
