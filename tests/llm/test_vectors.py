"""Vector search against all pairs, vector codes against plain rounds, on hard rows and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from framesift.llm import forest_search, vector_codes
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, cell string, x string, id int"
WIDTH = 8


def vector(rnd, pull=0.0):
    return [float(np.float32(rnd.gauss(pull, 1))) for _ in range(WIDTH)]


def made_rows(n=900):
    rnd = random.Random(3)
    same = vector(rnd)
    rows = []
    for i in range(n):
        # A third of the rows hold one vector.
        rows.append((i, same if i % 3 == 0 else vector(rnd, i % 5), [None, 1, 2][i % 3 if i % 7 else 0]))
    rows += [(20, vector(rnd), 1), rows[40], rows[40], (None, vector(rnd), None), (None, same, 2)]
    odd = [None, [], [0.0] * WIDTH, [math.nan] + [1.0] * (WIDTH - 1), [math.inf] * WIDTH, [1.0, None] + [1.0] * (WIDTH - 2), [1.0] * (WIDTH + 1), [1.0]]
    rows += [(10_000 + 20 * i, x, 1) for i, x in enumerate(odd)]
    return [(*r, 1, "c", "x", 2) for r in rows]


def usable(x, zero):
    return x and len(x) == WIDTH and all(v is not None and math.isfinite(v) for v in x) and (zero or any(x))


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_search_finds_what_all_pairs_find(vectors, rows):
    found = forest_search.nearest(vectors, F.col("vec_id") % 20 == 0, 10).collect()
    kept = [r for r in rows if usable(r[1], False)]
    x = np.array([r[1] for r in kept], np.float64)
    asked = [i for i, r in enumerate(kept) if r[0] is not None and r[0] % 20 == 0]
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_row"], []).append(r)
    assert len(by_query) == len(asked)
    assert sorted(v[0]["query_id"] for v in by_query.values()) == sorted(kept[i][0] for i in asked)
    hits = total = 0
    best = {}
    for i in asked:
        score = x @ x[i]
        score[i] = -np.inf
        best.setdefault(kept[i][0], []).append(np.sort(score)[::-1][:10])
    for answer in by_query.values():
        answer.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in answer] == list(range(1, 11))
        assert all(r["row"] != r["query_row"] for r in answer) and len({r["row"] for r in answer}) == 10
        order = [(-r["score"], r["vec_id"] is None, r["vec_id"] or 0) for r in answer]
        assert order == sorted(order)
        scores = np.array([r["score"] for r in answer])
        wanted = min(best[answer[0]["query_id"]], key=lambda w: abs(w - scores).sum())
        assert (scores <= wanted + 1e-9).all()
        hits += (scores >= wanted[-1] - 1e-9).sum()
        total += 10
    assert hits / total >= 0.9


def test_scores_are_the_inner_products(vectors, rows):
    found = forest_search.nearest(vectors.filter("vec_id < 200"), F.col("vec_id") % 20 == 0, 5).collect()
    by_id = {}
    for r in rows:
        if usable(r[1], False):
            by_id.setdefault(r[0], []).append(r[1])
    for r in found:
        products = {sum(a * b for a, b in zip(p, q)) for p in by_id[r["query_id"]] for q in by_id[r["vec_id"]]}
        assert min(abs(r["score"] - p) for p in products) < 1e-9


def test_search_in_few_rows_and_none(spark, rows):
    few = spark.createDataFrame([r for r in rows if r[0] in (0, 1, 2, 20)], SCHEMA)
    found = forest_search.nearest(few, F.col("vec_id") % 20 == 0, 20).collect()
    assert len(found) == 3 * 4  # the rows 0 and 20 (twice) find the four others
    assert forest_search.nearest(few.filter("vec_id < 0"), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert forest_search.nearest(few.filter("vec_id = 1"), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert forest_search.nearest(few.filter("vec_id = 0"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_queue_takes_leaves_by_their_margins():
    margins = np.array([[0.5, -0.2, 0.1], [3.0, 0.4, -0.3]])
    taken = [leaf for leaf, _ in forest_search.taken_leaves(margins, [1] * 8, 2, math.inf)]
    assert sorted(taken) == list(range(8))
    # Tree 0: leaf 3 costs nothing, 2 costs 0.1, then over the root 0.5 to leaf 0, and 0.2 more to leaf 1.
    # Tree 1: leaf 6 costs nothing, 7 costs 0.3, then 3.0 and 0.4 more.
    assert taken == [3, 6, 2, 7, 0, 1, 5, 4]


def plain_codes(rows):
    """The rounds of the contract, compared entry by entry."""
    kept = sorted((r for r in rows if usable(r[1], True)), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * v) for v in r[1]]))
    x = [[math.floor(1024 * v) for v in r[1]] for r in kept]
    w = WIDTH // 4
    cut = [[v[p * w : p * w + w] for v in x] for p in range(4)]
    books = [part[:256] for part in cut]
    for r in range(5):
        near = []
        for p in range(4):
            near.append([min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(books[p])) for v in cut[p]])
            if r < 4:
                new = []
                for j, c in enumerate(books[p]):
                    mine = [v for v, (_, k) in zip(cut[p], near[p]) if k == j]
                    new.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
                books[p] = new
    return kept, ["".join(f"{near[p][i][1]:02x}" for p in range(4)) for i in range(len(kept))], [sum(near[p][i][0] for p in range(4)) for i in range(len(kept))], books


def test_codes_equal_plain_rounds(vectors, rows):
    made, books = vector_codes.coded(vectors)
    out = vector_codes.with_label_errors(made).collect()
    kept, codes, errors, wanted_books = plain_codes(rows)
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    def order(t):
        return [(v is None, v or 0) if not isinstance(v, str) else (False, v) for v in t]
    want = sorted(((r[0], r[2], c, e, by_label[r[2]]) for r, c, e in zip(kept, codes, errors)), key=order)
    got = sorted(((r["id"], r["label"], r["code"], int(r["error"]), int(r["label_error"])) for r in out), key=order)
    assert got == want
    text = ",".join(str(v) for book in wanted_books for entry in book for v in entry)
    assert vector_codes.digest_of(books) == hashlib.sha256(text.encode()).hexdigest()


def test_codes_of_large_components_few_rows_and_none(spark):
    rows = [(i, [3e14 * (i + 1), -1e-3, 7.5, float(i)], None) for i in range(6)]
    made, books = vector_codes.coded(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert books.shape == (4, 6, 1) and [int(v) for v in books[0][:2, 0]] == [math.floor(1024 * 3e14), math.floor(2048 * 3e14)]
    assert {r["code"] for r in made.collect()} == {f"{i:02x}00{0:02x}{i:02x}" for i in range(6)}
    empty, books = vector_codes.coded(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and vector_codes.with_label_errors(empty).count() == 0 and books.size == 0


def test_length_that_four_does_not_divide_is_filled_up(spark):
    made, books = vector_codes.coded(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    assert books.tolist() == [[[1024, 2048]], [[3072, 4096]], [[5120, 0]], [[0, 0]]]
    assert [(r["code"], r["error"]) for r in made.collect()] == [("00000000", 0)]


@pytest.mark.parametrize("b", [4, 8, 32])
def test_bounds_never_change_an_assignment(b):
    rnd = np.random.default_rng(5)
    x, codes = rnd.integers(-40, 40, (700, 4)), rnd.integers(-40, 40, (60, 4))
    part = vector_codes.Part(x, codes, b)
    part.compare_all(np.arange(len(x)))
    for step in range(4):
        moved_codes = codes + rnd.integers(-3 + step, 4 - step, codes.shape) * (rnd.random((60, 1)) < 0.5)
        moved = np.sqrt(((moved_codes - codes) ** 2).sum(axis=1))
        codes = moved_codes
        new = vector_codes.Part(x, codes, max(4, b - step))
        new.carry(part.own, part.near, part.low, part.outer, moved)
        d = ((x[:, None] - codes[None]) ** 2).sum(axis=2)
        assert (new.own == d.argmin(axis=1)).all() and (new.distance == d.min(axis=1)).all()
        part = new
