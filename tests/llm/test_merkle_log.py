"""The manifest against a tree built in memory, and the places of its log."""

import hashlib
import zlib

import pytest
from framesift.llm import merkle_log
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, grp string, n string, digest string, level string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way_up(levels, i):
    for level in levels[:-1]:
        first = i - i % 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def in_memory(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        def leaf(t):
            return sha(framed(v) for v in (doc_id, source, lang, n_chars, t))

        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by_source.setdefault(source, []).append((doc_id, leaf(text), leaf(low if tampered else text)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels_of([r[1] for r in by_source[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    root = top[-1][0]
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, changed) in enumerate(by_source[s]):
            siblings, fold = "", changed
            for before, after in [*way_up(trees[s], i), *way_up(top, k)]:
                siblings += "".join(before + after)
                fold = sha([*before, fold, *after])
            out.append((doc_id, leaf, trees[s][-1][0], root, sha([siblings]), fold, fold == root))
    return out


def key(row):
    return [(v is None, v if v is not None else 0) for v in row]


def checked(spark, rows, partitions=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = [tuple(r) for r in merkle_log.proven(docs).collect()]
    assert sorted(got, key=key) == sorted(in_memory(rows), key=key)
    return got


def row(i, text, source, lang="en", n=3):
    return (i, text, lang, source, n, "g", "n", "d", "l")


def test_hard_rows(spark):
    rows = [row(i, f"Text {i}", ["b", "a", "é", None][i % 4]) for i in range(70)]
    rows += [row(3, "Text 3", None)] * 3 + [row(None, "no id", "a"), row(None, None, None, None, None), row(7, "", "lone"), row(8, "-", "", "", 0)]
    rows += [row(100 + i, "A" * 50_000 + "é日本" * 900, "long") for i in range(17)] + [row(5, None, "null text"), row(-5, "Minus", "a")]
    got = checked(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_sizes_around_full_runs(spark, n):
    checked(spark, [row(i, "T", "s") for i in range(n)])


def test_groups_of_more_than_one_block_and_many_groups(spark):
    checked(spark, [row(i, f"X{i}", "big") for i in range(4096 + 257)] + [row(i, "Y", f"s{i}") for i in range(300)], 7)


def test_empty_table(spark):
    assert merkle_log.proven(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 256, 300, 4096, 4097, 5000])
def test_the_log_is_in_the_order_of_completion(spark, n):
    leaves = spark.range(n).select(F.lit(0).cast("bigint").alias("grp"), F.lit(n).cast("bigint").alias("n"), F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = merkle_log.append_log(leaves).nodes().orderBy("pos").collect()
    assert [r["pos"] for r in nodes] == list(range(len(nodes)))
    # A node comes right after the last of its children, and children are in order.
    pending = {}
    for r in nodes:
        if r["level"]:
            children = pending.pop(r["level"] - 1)
            assert r["digest"] == sha(children) and len(children) <= 16
        pending.setdefault(r["level"], []).append(r["digest"])
    assert [len(v) for v in pending.values()] == [1]
