"""A Merkle manifest of a table: one append log of tree nodes, and proofs read from it.

Each group of rows (a source) has a tree over its leaves in order, ``ARITY`` children to a
node, and the groups' roots have one tree above them. The nodes of a tree are one log in
the order in which they are complete: a node follows its last child (postorder).

* The place of a node follows from its level, its number in the level and the number of
  leaves alone (``position``), as full subtrees have sizes of closed form. So builders that
  each take an aligned run of ``ARITY ** HEIGHT`` leaves write their part of the log on
  their own, and only their roots go on to the builders above, a 4096th of the rows.
* A subtree is a run of the log. Proofs of a block of leaves come from that run and from
  the few siblings above it, which are asked for by their places in the log, once for the
  block and not for each leaf.
* Rows are ranked in their group by a sort over ranges and one offset for each range, so a
  group that holds a third of the table is many tasks; no group is gathered.

Defined cases: null values are leaves' ``-``; a null id comes first in its group and a null
group before all others; rows that agree in everything have equal leaves next to each
other. A group with one leaf has that leaf as root, as has a table with one group. Texts of
any length are hashed by Spark where they are read. An empty table gives an empty log.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from framesift.session import small_side, store
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARITY, BITS = 16, 4
#: Levels that one builder makes above its run of leaves.
HEIGHT = 3
_BLOCK = BITS * HEIGHT
#: More levels than any table needs.
LEVELS = 15
_A_TO_Z, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash_of(*values: Column) -> Column:
    """SHA-256 in hex of values told apart by their lengths."""

    def framed(v: Column) -> Column:
        text = v.cast("string")
        return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def folded(text: Column) -> Column:
    return F.translate(text, _A_TO_Z, _LOWER)


# --- Places in the log -----------------------------------------------------------


def _complete(n: Column) -> Column:
    """Inner nodes that are complete once n leaves are in the log."""
    total = F.shiftright(n, BITS)
    for level in range(2, LEVELS + 1):
        total = total + F.shiftright(n, BITS * level)
    return total


def _power(level: Column) -> Column:
    """Leaves of a full subtree of so many levels."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (level * BITS).cast("int"))


def position(level: Column, index: Column, n: Column) -> Column:
    """Place in the log of a node of a tree over n leaves, from 0."""
    end = (index + 1) * _power(level)
    last = end - 1
    # The nodes at the end of the log that are complete only because no leaf follows.
    open_below = F.lit(0)
    for g in range(1, LEVELS + 1):
        open_below = open_below + F.when((F.lit(g) < level) & (n % F.lit(ARITY**g) != 0), 1).otherwise(0)
    return F.when(end <= n, last + _complete(last) + level).otherwise(n + _complete(n) + open_below)


def top_level(n: Column) -> Column:
    """The level of the root: as many as it takes until one node remains."""
    top = F.lit(0)
    for level in range(1, LEVELS + 1):
        top = F.when(n > ARITY ** (level - 1), level).otherwise(top)
    return top


# --- Builders --------------------------------------------------------------------


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


_NODE = "grp bigint, n bigint, level int, index bigint, digest string"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())


def _built(batches):
    """Nodes above each aligned run of nodes, in the order in which they are complete.

    Rows come sorted by group and index; ``top`` is the level of the root of their tree.
    """
    run, pending, made, out = None, [], [], []

    def close(last: bool) -> None:
        """Hash full runs of children from below; at the end of a block also the others."""
        grp, n, top, level, block = run
        for h in range(min(HEIGHT, top - level)):
            children = pending[h]
            if not last and len(children) < ARITY:
                return
            if children:
                digest = _hash(children)
                out.append((grp, n, level + h + 1, (block << (_BLOCK - BITS * (h + 1))) + made[h], digest))
                made[h] += 1
                pending[h + 1].append(digest)
                children.clear()

    def written() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], ["grp", "n", "level", "index", "digest"])
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("grp", "n", "top", "level", "index", "digest")]
        for grp, n, top, level, index, digest in zip(*columns):
            here = (grp, n, top, level, index >> _BLOCK)
            if here != run:
                if run:
                    close(True)
                run, pending, made = here, [[] for _ in range(HEIGHT + 1)], [0] * HEIGHT
            pending[0].append(digest)
            if len(pending[0]) == ARITY:
                close(False)
        if out:
            yield written()
    if run:
        close(True)
    if out:
        yield written()


def _above(nodes: DataFrame) -> DataFrame:
    """The next ``HEIGHT`` levels over ``nodes(grp, n, top, level, index, digest)``."""
    block = F.shiftright("index", _BLOCK)
    placed = nodes.repartition("grp", block).sortWithinPartitions("grp", "index")
    return placed.select("grp", "n", "top", "level", "index", "digest").mapInArrow(_built, _NODE)


@dataclass(frozen=True)
class Log:
    """``nodes(grp, n, level, index, pos, digest)`` of all trees; groups are numbers.

    ``lower`` holds the levels up to ``HEIGHT``, ``upper`` those above.
    """

    lower: DataFrame
    upper: DataFrame

    def nodes(self) -> DataFrame:
        return self.lower.unionByName(self.upper)

    def roots(self) -> DataFrame:
        """``grp, n, digest`` of the trees' roots."""
        top = top_level(F.col("n"))
        return self.nodes().filter(F.col("level") == top).select("grp", "n", "digest")


def append_log(leaves: DataFrame) -> Log:
    """The log over ``leaves(grp, n, index, digest)``, indices from 0 in each group."""
    def placed(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("pos", position(F.col("level"), F.col("index"), F.col("n")))

    with_top = leaves.select("grp", "n", F.lit(0).alias("level"), "index", "digest", top_level(F.col("n")).alias("top"))
    low = placed(with_top.drop("top").unionByName(_above(with_top.filter("top > 0"))))
    lower = store(low, "merkle_log")
    found, at = [], lower
    for level in range(HEIGHT, LEVELS, HEIGHT):
        last = at.filter(F.col("level") == level).withColumn("top", top_level(F.col("n"))).filter(F.col("top") > level)
        if last.isEmpty():
            break
        at = store(placed(_above(last)), "merkle_log")
        found.append(at)
    upper = found[0] if found else lower.filter(F.lit(False))
    for more in found[1:]:
        upper = upper.unionByName(more)
    return Log(lower, upper)


# --- Proofs ----------------------------------------------------------------------

_STEPS = "array<struct<at:int,sibling:bigint,own:bigint,digest:string>>"


def paths(log: Log, nodes: DataFrame, lowest: int) -> DataFrame:
    """``grp, index, steps`` of ``nodes(grp, n, level, index)``: all siblings of the nodes
    from level ``lowest`` to the root, found by their places in the log."""
    at = nodes.withColumn("top", top_level(F.col("n"))).filter(F.col("top") > F.col("level"))
    step = at.select("grp", "n", "index", "level", F.explode(F.sequence("level", F.col("top") - 1)).alias("at"))
    own = F.call_function("shiftright", F.col("index"), ((F.col("at") - F.col("level")) * BITS).cast("int"))
    width = F.call_function("shiftright", F.col("n") + _power(F.col("at")) - 1, (F.col("at") * BITS).cast("int"))
    step = step.withColumns({"own": own, "width": width}).withColumn("first", F.col("own") - F.col("own") % ARITY)
    asked = step.withColumn("sibling", F.explode(F.sequence("first", F.least(F.col("first") + ARITY - 1, F.col("width") - 1))))
    asked = asked.filter("sibling <> own").withColumn("pos", position(F.col("at"), F.col("sibling"), F.col("n")))
    kept = log.nodes().filter(F.col("level") >= lowest).select("grp", "pos", "digest")
    found = asked.select("grp", "index", "at", "own", "sibling", "pos").join(kept, ["grp", "pos"])
    return found.groupBy("grp", "index").agg(F.collect_list(F.struct("at", "sibling", "own", "digest")).alias("steps"))


def _steps(found: list[dict], first: int, last: int) -> list[tuple[bytes, bytes]]:
    """For each level the digests of the siblings before and after, empty where a run has one member."""
    out = [([], []) for _ in range(first, last)]
    for s in sorted(found, key=lambda s: (s["at"], s["sibling"])):
        out[s["at"] - first][s["sibling"] > s["own"]].append(s["digest"])
    return [("".join(a).encode(), "".join(b).encode()) for a, b in out]


def _fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in steps:
        digest = hashlib.sha256(before + digest + after).hexdigest().encode()
    return digest


def _block_proofs(key, lower: pa.Table, above: pa.Table) -> pa.Table:
    """Proof digests and folded roots of the leaves of one aligned block."""
    order = np.lexsort((lower.column("index").to_numpy(), lower.column("level").to_numpy()))
    lower = lower.take(pa.array(order))
    level, digest = lower.column("level").to_numpy(), lower.column("digest").to_pylist()
    top = above.column("top")[0].as_py()
    high = min(HEIGHT, top)
    levels = [[digest[i].encode() for i in np.flatnonzero(level == h)] for h in range(high + 1)]
    upper = _steps(above.column("steps")[0].as_py() or [], HEIGHT, top)
    upper += _steps(above.column("root_steps")[0].as_py() or [], 0, above.column("root_top")[0].as_py())

    # From the top of the block down: what lies above each node, as steps and as text.
    inner: dict[tuple[int, int], list] = {(high, 0): upper}
    text = {(high, 0): b"".join(a + b for a, b in upper)}
    for h in range(high - 1, 0, -1):
        for i in range(len(levels[h])):
            first = i - i % ARITY
            before, after = b"".join(levels[h][first:i]), b"".join(levels[h][i + 1 : first + ARITY])
            inner[h, i] = [(before, after), *inner[h + 1, i >> BITS]]
            text[h, i] = before + after + text[h + 1, i >> BITS]
    n = len(levels[0])
    changed, proofs, roots = lower.column("changed").slice(0, n).to_pylist(), [], []
    for i, leaf in enumerate(levels[0]):
        steps, rest = upper, text[high, 0]
        if high:
            first = i - i % ARITY
            before, after = b"".join(levels[0][first:i]), b"".join(levels[0][i + 1 : first + ARITY])
            steps, rest = [(before, after), *inner[1, i >> BITS]], before + after + text[1, i >> BITS]
        proofs.append(hashlib.sha256(rest).hexdigest())
        roots.append(_fold(changed[i].encode() if changed[i] else leaf, steps).decode())
    known = lower.slice(0, n).select(["grp", "id", "digest"]).rename_columns(["grp", "id", "leaf"])
    return known.append_column("proof_sha256", pa.array(proofs, pa.string())).append_column("folded_root", pa.array(roots, pa.string()))


# --- Ranks -----------------------------------------------------------------------


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``grp`` (number of the group, nulls first), ``index`` and ``n`` in it.

    Written once after sorting over ranges, as sampled bounds may differ between runs.
    """
    named = rows.withColumn("grp_name", F.col(group))
    placed = named.repartitionByRange("grp_name", *order).sortWithinPartitions("grp_name", *order)
    placed = store(placed.withColumn("seq", F.monotonically_increasing_id()).withColumn("place", F.shiftright("seq", 33)), "merkle_rows")
    runs = placed.groupBy("grp_name", "place").agg(F.min("seq").alias("first_seq"), F.count("*").alias("held"))
    within = Window.partitionBy("grp_name")
    ahead = F.coalesce(F.sum("held").over(within.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp_name", "place", (ahead - F.col("first_seq")).alias("shift"), F.sum("held").over(within).alias("n"))
    groups = numbers(runs.select("grp_name").distinct())
    runs = runs.join(groups, runs["grp_name"].eqNullSafe(groups["name"])).drop("name")
    runs = small_side(runs.select(F.col("grp_name").alias("run_name"), F.col("place").alias("run"), "shift", "n", "grp"), "merkle_runs")
    found = placed.join(runs, placed["grp_name"].eqNullSafe(runs["run_name"]) & (placed["place"] == runs["run"]))
    return found.select(*rows.columns, "grp", "n", (F.col("seq") + F.col("shift")).alias("index"))


def numbers(names: DataFrame) -> DataFrame:
    """``name, grp``: group names numbered from 0 in their order, nulls first, by ranges."""
    column = names.columns[0]
    placed = store(names.select(F.col(column).alias("name")).orderBy(F.asc_nulls_first("name")).withColumn("seq", F.monotonically_increasing_id()), "merkle_groups")
    place = F.shiftright("seq", 33)
    runs = placed.groupBy(place.alias("place")).agg(F.count("*").alias("held"), F.min("seq").alias("first_seq"))
    # One row for each range of names: as many as shuffle partitions.
    shifts, ahead = {}, 0
    for row in runs.orderBy("place").collect():
        shifts[row["place"]] = ahead - row["first_seq"]
        ahead += row["held"]
    shift = F.create_map(*[F.lit(v) for pair in shifts.items() for v in pair])[place] if shifts else F.lit(0)
    return placed.select("name", (F.col("seq") + shift).alias("grp"))


# --- The manifest ----------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """``leaves(grp, n, index, id, digest, changed)``, the log of the groups and the log over their roots."""

    leaves: DataFrame
    log: Log
    roots: DataFrame
    above: Log

    def root(self) -> str | None:
        found = self.above.roots().first()
        return found["digest"] if found else None


def manifest(leaves: DataFrame, group: str, *order: str) -> Manifest:
    """The manifest of ``leaves(id, digest, changed, ...)``, with a tree for each group in ``order``."""
    rows = store(ranked(leaves, group, *order), "merkle_leaves")
    log = append_log(rows.select("grp", "n", "index", "digest"))
    roots = store(log.roots(), "merkle_roots")
    n = F.lit(roots.count()).cast("bigint")
    tops = roots.select(F.lit(0).cast("bigint").alias("grp"), n.alias("n"), F.col("grp").alias("index"), "digest")
    return Manifest(rows, log, roots, append_log(tops))


def proofs(made: Manifest) -> DataFrame:
    """``grp, id, leaf, proof_sha256, folded_root`` of every leaf.

    A proof is the siblings' digests from the leaf to the root. The folded root starts from
    ``changed`` where that is set.
    """
    tops = made.above.lower.filter("level = 0")
    root_steps = paths(made.above, tops, 0).select(F.col("index").alias("grp"), F.col("steps").alias("root_steps"))
    sizes = tops.select(F.col("index").alias("grp"), top_level(F.col("n")).alias("root_top"))
    over = small_side(sizes.join(root_steps, "grp", "left"), "merkle_root_paths")
    # A block's number is that of its first leaf without the lower bits.
    first = made.leaves.filter(F.col("index") % ARITY**HEIGHT == 0)
    blocks = first.select("grp", "n", F.lit(HEIGHT).alias("level"), F.shiftright("index", _BLOCK).alias("index"))
    steps = paths(made.log, blocks, HEIGHT)
    above = (
        blocks.join(steps, ["grp", "index"], "left").join(over, "grp")
        .select("grp", F.col("index").alias("block"), top_level(F.col("n")).alias("top"), "steps", "root_steps", "root_top")
    )
    leaf = made.leaves.select("grp", F.shiftright("index", _BLOCK).alias("block"), F.lit(0).alias("level"), "index", "digest", "id", "changed")
    inner = made.log.lower.filter(F.col("level") > 0)
    block = F.call_function("shiftright", F.col("index"), ((HEIGHT - F.col("level")) * BITS).cast("int"))
    none = [F.lit(None).cast(leaf.schema[c].dataType).alias(c) for c in ("id", "changed")]
    lower = leaf.unionByName(inner.select("grp", block.alias("block"), "level", "index", "digest", *none))
    above = store(above, "merkle_paths")
    schema = f"grp bigint, id {leaf.schema['id'].dataType.simpleString()}, leaf string, proof_sha256 string, folded_root string"
    return lower.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_block_proofs, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``source, id, digest, changed``: leaves of documents, and the leaf of a document that
    was tampered with (A-Z of its text made small) where 5 divides the checksum of its id."""
    def leaf(text: Column) -> Column:
        return hash_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return docs.select(
        "source", F.col("doc_id").alias("id"), leaf(F.col("text")).alias("digest"),
        F.when(tampered, leaf(folded(F.col("text")))).alias("changed"),
    )


def proven(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document."""
    leaves = store(document_leaves(docs), "merkle_documents")
    made = manifest(leaves, "source", "id", "digest")
    root = made.root()
    roots = small_side(made.roots.select("grp", F.col("digest").alias("subroot")), "merkle_subroots")
    return proofs(made).join(roots, "grp").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
