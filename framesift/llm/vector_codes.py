"""Vectors as codes of four bytes: integer k-means for each quarter, pruned by adaptive bounds.

Components become integers, and all distances that decide are compared as integers, so
the codes do not depend on the machine or on how rows are dealt. Four rounds of assigning
and averaging follow; the bounds only save comparisons:

* Each part of each vector keeps its ``b`` closest codebook entries besides its own, in
  order and with lower bounds of their distances, and one outer bound below the distances
  of all other entries. A round lowers a bound by as far as its entry has moved, and the
  outer one by the farthest move.
* A part whose own entry is nearer than all its bounds keeps it. If only listed entries
  could be nearer, these are compared; if the outer bound is too low, all entries are, and
  the list is made anew.
* ``b`` follows from the last round: the length that would have served nearly all parts
  that a list could serve, and longer ones if too many parts needed all entries.

What a round needs of the whole table is one row for each entry: count and sums of its
parts, added up in the tasks first. State is written after each round and the one before
removed, so a lost executor costs no more than tasks of one round.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are
dropped, also those with another length than most. A length that four does not divide is
filled up with zeros. Components whose integer exceeds 62 bits drop the row too; large ones
are computed with Python's integers. With fewer than 256 rows the codebooks are shorter;
repeated rows and equal ids count one by one, in the order of their vectors; null ids come
last. Sums beyond 64 bits are NULL. An empty table gives no rows.
"""

from __future__ import annotations

import decimal
import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from framesift.llm.common import drop_folder
from framesift.llm.vectors import is_finite, matrix, usual_length
from framesift.session import shared_root, small_side
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST = 2**62
#: Lengths of the list of closest entries: at first, and at least and most.
FIRST_B, LEAST_B, MOST_B = 16, 4, 32
#: The share of listed parts that a list of the next round should serve.
SERVED = 0.95
#: Stands for a part that had to compare all entries.
ALL = 255
#: Relative margin by which rounding cannot turn a bound around.
MARGIN = 1e-9


def quantised(rows: DataFrame, id_column: str, label_column: str, column: str) -> DataFrame:
    """``id, label, x`` with integer components, a multiple of ``PARTS`` of them."""
    named = rows.filter(is_finite(column)).select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).alias("label"), F.col(column).alias("x"))
    length = usual_length(named, "x")
    scaled = F.transform("x", lambda v: F.floor(v.cast("double") * SCALE))
    inside = F.forall("x", lambda v: F.abs(v.cast("double") * SCALE) < float(LARGEST))
    filled = F.concat(scaled, F.array_repeat(F.lit(0).cast("bigint"), -length % PARTS))
    return named.filter((F.size("x") == length) & inside).select("id", "label", filled.alias("x"))


def _exact(x: np.ndarray, codes: np.ndarray) -> type:
    """A type in which all distances are whole numbers without rounding."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(codes).max(initial=0)))
    return np.float64 if (2 * most) ** 2 * x.shape[-1] * ENTRIES < 2**53 else object


def _ranked(distances: np.ndarray) -> np.ndarray:
    """Distance and index of each entry as one number, so that ties go to the lower index."""
    return distances * ENTRIES + np.arange(distances.shape[1])


class Part:
    """One quarter of the vectors of a batch against its codebook."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, b: int):
        self.kind = _exact(x, codes)
        self.x, self.codes, self.b = x.astype(self.kind), codes.astype(self.kind), b
        n = len(x)
        self.own, self.distance = np.zeros(n, np.int64), np.zeros(n, self.kind)
        self.near, self.low = np.zeros((n, b), np.uint8), np.full((n, b), np.inf, np.float32)
        self.outer, self.asked = np.full(n, np.inf, np.float32), np.zeros(n, np.uint8)

    def _roots(self, ranked: np.ndarray) -> np.ndarray:
        """Distances rounded down to single precision."""
        d = np.sqrt((ranked // ENTRIES).astype(np.float64)) * (1 - MARGIN)
        return np.nextafter(d.astype(np.float32), np.float32(0))

    def compare_all(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        x, c = self.x[rows], self.codes
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        ranked = _ranked(d)
        want = min(self.b + 2, ranked.shape[1])
        if self.kind is np.float64 and want < ranked.shape[1]:
            ranked = np.partition(ranked, want - 1, axis=1)[:, :want]
        ranked = np.sort(ranked, axis=1)
        index = (ranked % ENTRIES).astype(np.int64)
        self.own[rows], self.distance[rows] = index[:, 0], ranked[:, 0] // ENTRIES
        listed = min(self.b, ranked.shape[1] - 1)
        self.near[rows, :listed], self.low[rows, :listed] = index[:, 1 : listed + 1], self._roots(ranked[:, 1 : listed + 1])
        self.low[rows, listed:] = np.inf
        self.outer[rows] = self._roots(ranked[:, self.b + 1]) if ranked.shape[1] > self.b + 1 else np.inf
        self.asked[rows] = ALL

    def carry(self, own: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, moved: np.ndarray) -> None:
        """Entries of the round before, as far as the bounds allow."""
        kept = min(self.b, near.shape[1])
        low = np.nextafter((low - moved[near]).astype(np.float32), -np.float32(np.inf))
        outer = np.nextafter((outer - moved.max(initial=0.0)).astype(np.float32), -np.float32(np.inf))
        if near.shape[1] > kept:
            outer = np.minimum(outer, low[:, kept:].min(axis=1))
        self.own, self.near[:, :kept], self.low[:, :kept], self.outer = own.astype(np.int64), near[:, :kept], low[:, :kept], outer
        gap = self.x - self.codes[self.own]
        self.distance = (gap * gap).sum(axis=1)
        reach = np.sqrt(self.distance.astype(np.float64)) * (1 + MARGIN)
        self.asked = (self.low <= reach[:, None]).sum(axis=1).astype(np.uint8)
        far = self.outer <= reach
        self.compare_listed(np.flatnonzero((self.asked > 0) & ~far))
        self.compare_all(np.flatnonzero(far))

    def compare_listed(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        listed = np.isfinite(self.low[rows])
        index = np.concatenate([self.own[rows, None], self.near[rows]], axis=1).astype(np.int64)
        gap = self.codes[index] - self.x[rows, None, :]
        ranked = (gap * gap).sum(axis=2) * ENTRIES + index
        # Unused places of a list must not win.
        most = float(2**53) if self.kind is np.float64 else 2**200
        ranked[:, 1:] = np.where(listed, ranked[:, 1:], most)
        ranked = np.sort(ranked, axis=1)
        used = ranked[:, 1:] < most
        self.own[rows], self.distance[rows] = (ranked[:, 0] % ENTRIES).astype(np.int64), ranked[:, 0] // ENTRIES
        self.near[rows] = np.where(used, ranked[:, 1:] % ENTRIES, 0).astype(np.uint8)
        roots = self._roots(np.where(used, ranked[:, 1:], 0))
        self.low[rows] = np.where(used, roots, np.float32(np.inf))


def _bytes(values: np.ndarray) -> pa.Array:
    """A binary column of the rows of an array."""
    values = np.ascontiguousarray(values)
    width = values.nbytes // max(len(values), 1)
    data = values.tobytes()
    return pa.array([data[i : i + width] for i in range(0, len(data), width)] if width else [b""] * len(values), pa.binary())


def _array(column: pa.Array, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, PARTS, -1)


class Bounds:
    """What tasks of a round need: codebooks ``(part, entry, place)``, moves, list length."""

    def __init__(self, codes: np.ndarray, moved: np.ndarray | None, b: int):
        self.codes, self.moved, self.b = codes, moved, b

    def parts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, list[Part]]:
        n = batch.num_rows
        x = matrix(batch.column("x"), np.int64).reshape(n, PARTS, -1)
        made = [Part(x[:, p], self.codes[p], self.b) for p in range(PARTS)]
        if self.moved is None:
            for part in made:
                part.compare_all(np.arange(n))
        else:
            own, near = _array(batch.column("own"), np.uint8, n), _array(batch.column("near"), np.uint8, n)
            low, outer = _array(batch.column("low"), np.float32, n), _array(batch.column("outer"), np.float32, n)
            for p, part in enumerate(made):
                part.carry(own[:, p, 0], near[:, p], low[:, p], outer[:, p, 0], self.moved[p])
        return x, made


_STATE = ["own", "near", "low", "outer", "asked"]


def _assigned(state: DataFrame, bounds: Bounds) -> DataFrame:
    """State after an assignment: entries, lists, bounds, and how many entries were asked for."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, parts = bounds.parts(batch)
            stacked = [np.stack([p.own.astype(np.uint8) for p in parts], 1)] + [np.stack([getattr(p, c) for p in parts], 1) for c in _STATE[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "label", "x")] + [_bytes(s) for s in stacked], ["id", "label", "x", *_STATE])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("id", "label", "x")] + [f"{c} binary" for c in _STATE])
    return state.mapInArrow(assign, schema)


def _sums(state: DataFrame, entries: int) -> list:
    """For each part and entry the count and sums of its parts; for part -1 how many parts asked for how many entries."""

    def add(batches):
        total, counts, asked = None, np.zeros((PARTS, entries), np.int64), np.zeros(ALL + 1, np.int64)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            x = matrix(batch.column("x"), np.int64).reshape(n, PARTS, -1)
            own = _array(batch.column("own"), np.uint8, n)[:, :, 0]
            asked += np.bincount(_array(batch.column("asked"), np.uint8, n).ravel(), minlength=ALL + 1)
            # Python integers as soon as a batch could leave 64 bits; its sum is added to the rest as such.
            kind = np.int64 if int(np.abs(x).max(initial=0)) * n < 2**52 else object
            if total is None:
                total = np.zeros((PARTS, entries, x.shape[2]), object)
            for p in range(PARTS):
                here = np.zeros((entries, x.shape[2]), kind)
                np.add.at(here, own[:, p], x[:, p].astype(kind))
                total[p] += here.astype(object)
                counts[p] += np.bincount(own[:, p], minlength=entries)
        if total is None:
            return
        part, entry = np.nonzero(counts)
        used = np.flatnonzero(asked)
        with decimal.localcontext(decimal.Context(prec=60)):
            sums = [[decimal.Decimal(int(v)) for v in total[p, e]] for p, e in zip(part, entry)] + [[]] * len(used)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[part, np.full(len(used), -1)], pa.int32()), pa.array(np.r_[entry, used], pa.int32()),
                pa.array(np.r_[counts[part, entry], asked[used]]), pa.array(sums, pa.list_(pa.decimal128(38, 0))),
            ],
            ["part", "entry", "n", "sums"],
        )

    length = len(state.select("x").first()["x"]) // PARTS
    found = state.select("x", "own", "asked").mapInArrow(add, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    summed = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(length)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *summed).collect()


def next_length(asked: dict[int, int], b: int) -> int:
    """Length of the lists of the next round."""
    whole, total = asked.get(ALL, 0), sum(asked.values())
    if 2 * whole > total:
        return min(MOST_B, 2 * b)
    enough, served = LEAST_B, 0
    for n in sorted(a for a in asked if a != ALL):
        served += asked[n]
        enough = max(LEAST_B, n)
        if served >= SERVED * (total - whole):
            break
    return min(MOST_B, enough)


def _averaged(codes: np.ndarray, sums: list) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """New codebooks, how far each entry moved at most, and the lengths that lists were asked for."""
    new, asked = codes.copy(), {}
    width = codes.shape[2]
    for row in sums:
        if row["part"] < 0:
            asked[row["entry"]] = row["n"]
        else:
            new[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    gap = new.astype(object) - codes.astype(object)
    moved = np.array([[math.sqrt(int(d)) for d in part] for part in (gap * gap).sum(axis=2)]) * (1 + MARGIN)
    return new, moved, asked


def _first_codes(rows: DataFrame) -> np.ndarray:
    """The parts of the rows with the smallest ids, as many as a codebook has entries."""
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(ENTRIES).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64)
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)


def _decided(state: DataFrame, bounds: Bounds) -> DataFrame:
    """``id, label, code, error`` of the last assignment."""

    def decide(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            _, parts = bounds.parts(batch)
            own = np.stack([p.own.astype(np.uint8) for p in parts], 1)
            error = sum(p.distance.astype(object) for p in parts)
            with decimal.localcontext(decimal.Context(prec=60)):
                errors = [d if (d := decimal.Decimal(int(e))) < 10**38 else None for e in error]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([row.tobytes().hex() for row in own]), pa.array(errors, pa.decimal128(38, 0))],
                ["id", "label", "code", "error"],
            )

    return state.mapInArrow(decide, f"id bigint, label {state.schema['label'].dataType.simpleString()}, code string, error decimal(38,0)")


def coded(vectors: DataFrame, id_column: str = "vec_id", label_column: str = "label", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, error`` of every kept row, and the final codebooks."""
    spark = vectors.sparkSession
    folder = f"{shared_root(spark)}/framesift-{spark.sparkContext.applicationId}/codes-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.options(**{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    state = kept(quantised(vectors, id_column, label_column, column), "rows")
    codes, moved, b, at = _first_codes(state), None, FIRST_B, "rows"
    if codes.shape[1] == 0:
        return state.select("id", "label", F.lit("").alias("code"), F.lit(None).cast("decimal(38,0)").alias("error")), codes
    for r in range(ROUNDS):
        state = kept(_assigned(state, Bounds(codes, moved, b)), f"round{r}")
        codes, moved, asked = _averaged(codes, _sums(state, codes.shape[1]))
        drop_folder(spark, f"{folder}/{at}")
        at, b = f"round{r}", next_length(asked, b)
    return kept(_decided(state, Bounds(codes, moved, b)), "codes"), codes


def digest_of(codes: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for v in codes.ravel()).encode()).hexdigest()


def label_errors(rows: DataFrame) -> DataFrame:
    """The error of all rows of each label, null among them."""
    return rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))


def with_label_errors(rows: DataFrame) -> DataFrame:
    sums = small_side(label_errors(rows), "label_errors")
    return rows.join(sums, rows["label"].eqNullSafe(sums["same"])).drop("same")


def as_long(column: str) -> Column:
    return F.col(column).try_cast("bigint").alias(column)
