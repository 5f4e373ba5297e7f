"""Every operator against brute force on one table of hard cases, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from framesift.llm import (
    decontamination, jaccard_join, language_model, line_dedup, mixing, quality_rules, substring_dedup, token_files, tokens, toxicity,
)
from framesift.llm.components import components
from tokenizers import Tokenizer

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, `row` int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(rnd, n):
    return " ".join(rnd.choice(["alpha", "Beta", "gamma", "delta", "über", "x", "of", "the", "日本"]) + str(rnd.randint(0, 30)) for _ in range(n))


def texts():
    rnd = random.Random(7)
    base, passage = words(rnd, 80), words(rnd, 70)
    near = base.split()
    near[40] = "changed"
    return [
        base, base, " ".join(near), passage + "\n" + words(rnd, 40), words(rnd, 30) + "\n" + passage, None, "", " \n\t", "one", "one two three", "One two  three",
        "a\x00b c", words(rnd, 3000), "z" * 3000, "ab " * 400, "<|endoftext|> it's  \n here", words(rnd, 15) + " loser idiot", "line of five words here\nline of five words here\nLINE  of five words here",
    ]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, ["en", None, "de"][i % 3], [None, "b", "a", "b"][i % 4], len(t or ""), i, "k", 1) for i, t in enumerate(texts())]
    return [*made, made[3], (None, "text without id but words enough", "en", "b", 1, 1, "k", 1), (0, "another text of the first id", "en", "a", 1, 1, "k", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_jaccard_components(docs, rows, nothing):
    sets = []
    for doc_id, text, *_ in rows:
        w = BLANK_WORDS.findall(lower(text))
        sets.append((doc_id, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    names = defaultdict(list)
    for (doc_id, _), r in zip(sets, root):
        names[r].append(doc_id)
    want = Counter((d, len(s), min((x for x in names[r] if x is not None), default=None)) for (d, s), r in zip(sets, root))
    assert got(jaccard_join.joined(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_join.joined(nothing).count() == 0


def test_large_group_of_loose_copies_needs_few_pairs(spark, monkeypatch):
    """A member that links with few of its group still joins it before all pairs are tested."""
    rnd, n = random.Random(5), 300
    base, made = [f"w{i}" for i in range(100)], []
    for i in range(n):
        w = list(base)
        for at in rnd.sample(range(2, 98), 2 if i % 3 else 3):
            w[at] = f"x{i}.{at}"
        made.append(w)
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(97)) for w in made]
    root = list(range(n))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    tested, verified = [], jaccard_join.verified

    def counted(pairs, *others):
        tested.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id bigint, text string").repartition(3)
    assert got(jaccard_join.joined(docs), "doc_id", "component_id") == Counter(enumerate(root))
    assert sum(tested) < 40 * n, tested


def test_sets_outside_of_a_large_component_get_several_partners():
    n, outside = 200, 20
    entry, names = np.zeros(1, jaccard_join._ENTRY).tobytes(), np.arange(1, n + 1)
    table = pa.table({
        "slice": np.zeros(n, np.int32), "set": names, "n": np.full(n, 100, np.int32), "list": [entry] * n,
        "short": [bytes(jaccard_join.SHORT_BITS // 8)] * n, "component": np.where(names <= outside, names, 1000),
    })
    pairs = jaccard_join._meetings(1, 85)(table)
    met = Counter(pairs["a"].to_pylist() + pairs["b"].to_pylist())
    assert min(met[s] for s in range(1, outside + 1)) >= 16
    assert pairs.num_rows <= 64 * outside


def test_signatures_never_overstate():
    rnd = np.random.default_rng(3)
    for n, m in ((5, 6), (300, 280), (5000, 300)):
        pool = np.unique(rnd.integers(0, 2**63, 6000, dtype=np.uint64))
        x, y = (np.sort(rnd.choice(pool, k, replace=False)) for k in (n, m))
        assert jaccard_join.least_difference(jaccard_join._signature(x), jaccard_join._signature(y)) <= len(np.setxor1d(x, y))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    found = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_needless_links_go(spark, monkeypatch):
    from framesift.llm import components as module

    links = [(i, j) for i in range(0, 60, 3) for j in range(i + 3, 60, 3)] + [(7, 7), (1, 4), (4, 1)]
    df = spark.createDataFrame(links, "a bigint, b bigint").coalesce(1)
    assert df.mapInArrow(module._forest, "a bigint, b bigint").count() == 20
    monkeypatch.setattr(module, "FOREST_NODES", 2)
    assert dict(components(df.repartition(3)).collect()) == {**{i: 0 for i in range(3, 60, 3)}, 4: 1}


def test_decontamination(spark, docs, rows, nothing):
    items = [(1, rows[0][1]), (2, "one two"), (3, None), (4, "..."), (None, "one two three"), (5, rows[3][1].split("\n")[0])]
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORDS.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    want = Counter()
    for doc_id, text, *_ in rows:
        w, hit, found = ITEM_WORDS.findall(lower(text)), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= owners
        want[doc_id, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (decontamination.BLOCK_WINDOWS, 20):
        df = decontamination.judged(decontamination.matches(docs, benchmark, size))
        assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()) == want
    assert {len(b.length) <= 20 for b in decontamination.blocks(benchmark, 20)} == {True}
    assert decontamination.matches(nothing, benchmark).count() == 0
    assert not any(r.n_hit for r in decontamination.judged(decontamination.matches(docs, benchmark.limit(0))).collect())


def test_substring_dedup(docs, rows, nothing):
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    want = Counter()
    for doc_id, t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[doc_id, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)] += 1
    found = substring_dedup.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == want
    assert substring_dedup.without_repeats(nothing).count() == 0


def test_substring_dedup_of_random_overlaps(spark):
    """Shared parts of all lengths around the limit, also across the pieces of a long text."""
    rnd = random.Random(2)
    pool = "".join(rnd.choice("abcd") for _ in range(1200))
    made = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randint(1, 4) if i else 2500):
            at, n = rnd.randrange(900), rnd.randint(150, 300)
            parts += ["".join(rnd.choice("efgh") for _ in range(rnd.randint(0, 60))), pool[at : at + n]]
        made.append((i, "".join(parts)))
    test_substring_dedup(spark.createDataFrame(made, "doc_id bigint, text string"), made, spark.createDataFrame([], "doc_id bigint, text string"))


@pytest.mark.parametrize("full", range(5))
def test_substring_dedup_with_full_bit_tables(spark, nothing, monkeypatch, full):
    """A table whose bits are all set holds nothing back, also at the ends of repeats and beside edits."""
    made_tables, bit_table = [], substring_dedup.bit_table

    def filled(names, key):
        made_tables.append(bit_table(names, key))
        return np.full_like(made_tables[-1], -1) if len(made_tables) == full + 1 else made_tables[-1]

    monkeypatch.setattr(substring_dedup, "bit_table", filled)
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    base = letters(1200)
    made = [(0, base), (1, base[:500] + "X" + base[501:]), (2, base[:700] + "X" + base[701:])]
    made += [(i, letters(150) + base[150 * i - 450 : 150 * i - 50] + letters(150)) for i in range(3, 8)]
    test_substring_dedup(spark.createDataFrame(made, "doc_id bigint, text string"), made, nothing.select("doc_id", "text"))
    assert len(made_tables) >= 5


def test_token_prefixes(docs, rows, nothing):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    counter = tokens.PrefixCounter(file)
    for text in ["it's  here", "we'll\n\nsee <|endoftext|>!", "<|endo", "日本 語 \x85x", "a\x1c b"]:
        steps = counter.text_steps(text)
        assert tokens.prefix_counts(steps).tolist() == [len(library.encode(text[:k], add_special_tokens=False)) for k in range(1, len(text) + 1)]
        assert tokens.longest_within(steps, 10**6) == len(text) and tokens.longest_within(steps, 0) == 0
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t, *_ in rows)
    assert got(tokens.token_prefixes(docs, file), "doc_id", "n_bytes", "n_tokens") == want
    assert tokens.token_prefixes(nothing, file).count() == 0


def test_every_prefix_counts_as_the_library_has_it():
    """Words with and without marks, letters of many scripts, contractions, blanks; nodes forgotten on the way."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    library, counter, rnd = Tokenizer.from_file(file), tokens.PrefixCounter(file), random.Random(3)
    parts = "word Élève straße naïve ǅungla ɐbc 日本 it's they'll don't x.y 3.14 !? , ... 😀 é ﬁ ʼn Ʌ ȿa ß, ñ. l'été 're ª º, µ. ² aʰ,".split() + ["  ", "\n", "\t "]
    for n in range(300):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", " ", ", ", ". "]) for _ in range(rnd.randint(0, 8)))
        if n % 50 == 0:
            counter._forget()
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert tokens.prefix_counts(counter.text_steps(text)).tolist() == want


def test_token_files(spark, docs, rows, nothing):
    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)

    def written(df):
        path = token_files.new_path(spark)
        token_files.write_tokens(df, file, path)
        return token_files.read_tokens(spark, path)

    files = written(docs)
    found = token_files.token_digests(files).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows if r[0] is not None)) + [None]
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert "ids" not in token_files.token_starts(files)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert token_files.token_digests(written(nothing)).count() == 0


def test_mixing(docs, rows, nothing):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    per_source = defaultdict(list)
    for r in found:
        assert r["size"] == len(BLANK_WORDS.findall(r["row"]["text"] or "")) and 0 <= r.taken <= 2 * r["size"]
        per_source[r["row"]["source"]].append(r)
    for own in per_source.values():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert sum(r.taken for r in own) == int(own[0].target) <= 2 * own[0].source_size
    whole = sum(r["size"] for r in found)
    assert abs(sum(own[0].target for own in per_source.values()) - 1.5 * whole) < 1e-6 * whole
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(BLANK_WORDS.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in found)
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0


def plain_passages(rows, min_words=line_dedup.MIN_WORDS, min_characters=line_dedup.MIN_CHARACTERS):
    """Unit counts, removed places and text of each (doc_id, text), by walking through all units."""
    cut, seen, result = {}, {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        units, last = [], None
        for m in BLANK_WORDS.finditer(text):
            if last is None or last[0][-1] in ".!?,;:" or "\n" in text[last.end() : m.start()]:
                units.append([])
            units[-1].append(m)
            last = m
        cut[doc, text] = units
        for i, u in enumerate(units):
            seen.setdefault(" ".join(lower(m[0]) for m in u), (doc, text, i))
    for (doc, text), units in cut.items():
        later = [seen[" ".join(lower(m[0]) for m in u)] != (doc, text, i) for i, u in enumerate(units)]
        spans, i = [], 0
        while i < len(units):
            j = i
            while j < len(units) and later[j]:
                j += 1
            run = [m[0] for u in units[i:j] for m in u]
            if j > i and (len(run) >= min_words or sum(map(len, run)) >= min_characters):
                spans.append((i, j - i, units[i][0].start(), units[j][0].start() if j < len(units) else len(text)))
            i = max(j, i + 1)
        kept, at = [], 0
        for _, _, start, end in spans:
            kept.append(text[at:start])
            at = end
        result[doc, text] = len(units), spans, "".join(kept) + text[at:]
    return result


def test_line_dedup(spark, docs, rows, nothing):
    rnd = random.Random(21)
    clauses = [words(rnd, rnd.randint(1, 9)) + rnd.choice([",", ".", "?", ";", "", "\n", " \t"]) for _ in range(40)]
    made = [" ".join(rnd.choice(clauses) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    made += ["日本語の文章です。" * 50, "前置き\n" + "日本語の文章です。" * 50 + "\n後書き", "a, b. c", " \n lead " + made[0] + "  \n", "x\r\ny", "3.14 is, e.g., no end", "," * 5 + " , ,"]
    many = spark.createDataFrame([(100 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    for df, pairs in ((many.repartition(3), [(100 + i, t) for i, t in enumerate(made)]), (docs, [(r[0], r[1] or "") for r in rows if r[0] != 0])):
        for limits in ((line_dedup.MIN_WORDS, line_dedup.MIN_CHARACTERS), (3, 20)):
            want, found = plain_passages(pairs, *limits), line_dedup.without_later_passages(df.filter("doc_id IS NULL OR doc_id <> 0"), *limits).collect()
            source = Counter((d, t) for d, t in pairs)
            assert Counter((r.doc_id, r.n_units, tuple(tuple(s) for s in r.removed), r["text"]) for r in found) == Counter(
                {k: v for k, v in sum((Counter({(d, want[d, t][0], tuple(want[d, t][1]), want[d, t][2]): n}) for (d, t), n in source.items()), Counter()).items()}
            )
    found = {r.doc_id: r for r in line_dedup.without_later_passages(docs).collect()}
    assert found[1]["text"] == "" and [tuple(s) for s in found[1].removed] == [(0, 1, 0, len(texts()[1]))] and found[5].n_units == 0
    assert line_dedup.without_later_passages(nothing).count() == 0


def test_toxicity(spark, nothing, labels):
    assert toxicity.fold("L0sеr! 2024 café") == " loser 2024 cafe "
    rnd = random.Random(5)
    made = [(i, words(rnd, 40) + (" you fo0lish clod" if i % 4 == 0 else " a foolish mistake" if i % 4 == 1 else ""), "x", 1.0) for i in range(300)]
    many = spark.createDataFrame([*made, (999, None, "x", 1.0), (None, "", "x", 1.0)], "doc_id bigint, text string, score string, predicted double")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    found = toxicity.scored(many, toxicity.learn(many, marks)).collect()
    assert all(r.predicted == int(r.doc_id is not None and r.doc_id < 300 and r.doc_id % 4 == 0) for r in found)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in found)
    spared = toxicity.Lexicon({" clod ": 5.0}, (" sweet clod ",), (0.0, 1.0, 0.0))
    assert spared.found(" a sweet clod ") == [] and spared.found(" a clod ") == [(2, 5.0)]
    assert toxicity.scored(nothing, toxicity.learn(nothing, labels)).count() == 0
    assert {r.score for r in toxicity.scored(many, toxicity.learn(many, marks.limit(0))).collect()} == {0.0}


def test_lexicon_finds_what_a_walk_over_all_starts_finds():
    rnd = random.Random(8)
    terms = {" clod": 4.0, " foolish ": 5.0, " bad": 3.5, " badger ": 6.0, " o": 3.0}
    exceptions = (" old clod ", " bad luck ", " sweet badger ")
    lexicon = toxicity.Lexicon(terms, exceptions, (-4.0, 1.0, 0.5))
    for _ in range(300):
        folded = toxicity.fold(" ".join(rnd.choice(["clod", "clods", "Foolish", "foolishly", "b@d", "badger", "old", "luck", "sweet", "0ld", "cl0d", "x", "9"]) for _ in range(rnd.randint(0, 12))))
        want = {}
        for start in range(len(folded)):
            inside = any(folded.startswith(e, at) and at <= start < at + len(e) - 1 for e in exceptions for at in range(len(folded)))
            weights = [w for t, w in terms.items() if folded.startswith(t, start)]
            if weights and not inside:
                want[start] = max(weights)
        assert lexicon.found(folded) == sorted(want.items())


def test_spans_are_whole_in_long_texts(spark):
    """Places far beyond 16 bits, and spans as large as they get, next to one another."""
    rnd = random.Random(11)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    head = "".join(rnd.choice("abcdefgh ") for _ in range(200_000))
    docs = spark.createDataFrame([(1, head + passage), (2, passage), (2, passage), (3, "short")], "doc_id bigint, text string")
    rows = substring_dedup.without_repeats(docs).select("doc_id", "n_removed", "n_spans", "kept").collect()
    assert Counter((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in rows) == Counter(
        [(1, 5000, 1, head), (2, 5000, 1, ""), (2, 5000, 1, ""), (3, 0, 0, "short")]
    )
    # What is shuffled of a span is one number.
    plan = substring_dedup.without_repeats(docs)._jdf.queryExecution().analyzed().toString()
    assert "array<bigint>" in plan and "array<struct<start" not in plan


def test_language_model(docs, rows, nothing, labels):
    df = language_model.classified(docs, labels)
    found = df.collect()
    assert len(found) == len(rows)
    assert all((r.perplexity is None) == (r.n_bytes == 0) and not (r.n_bytes == 0 and r.kept) for r in found)
    assert language_model.classified(nothing, labels).count() == 0
    counts = docs.sparkSession.createDataFrame([(5, 3), (45, 1), (1605, 2)], "code bigint, n bigint")
    p = language_model.probabilities(counts).toPandas()
    sums = p.groupby(p["code"] // language_model.SYMBOLS)["p"].sum()
    assert len(p) == language_model.SYMBOLS**language_model.ORDER and np.allclose(sums, 1)


def test_language_model_counts_words(docs, rows, labels, monkeypatch):
    """Perplexities, thresholds and kept rows against a plain modified Kneser-Ney model of words."""
    monkeypatch.setattr(language_model, "HELD_OUT", 3)

    def tokens(text):
        return ["<s>", *BLANK_WORDS.findall(lower(text)), "</s>"]

    trusted = {i for i in range(40) if i % 2}
    three, two, one = Counter(), Counter(), Counter()
    held_out = {d for d in trusted if zlib.crc32(str(d).encode()) % 3 == 0}
    trained = [tokens(t) for d, t, *_ in rows if d in trusted - held_out and t]
    for t in trained:
        three.update(zip(t, t[1:], t[2:]))
        two["<s>", t[1]] += 1
    two.update((b, c) for _, b, c in three)
    one.update(c for _, c in two)

    def model(counts, below):
        def shorter(g):
            return below(g[1:] or g)

        n1, n2, n3, n4 = (max(1, sum(n == k for n in counts.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        total, given = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            given[g[:-1]] += d[min(n, 3) - 1]

        def p(g):
            if g[:-1] not in total:
                return shorter(g)
            n = counts[g]
            return ((n - d[min(n, 3) - 1]) if n else 0) / total[g[:-1]] + given[g[:-1]] / total[g[:-1]] * shorter(g)

        return p

    costs = language_model.spelling(language_model.trusted_texts(docs, labels))

    def spelled(g):
        data = np.frombuffer(b"" if g[0] == "</s>" else g[0].encode(), np.uint8)
        data = np.append(data, np.uint8(32))
        return np.exp(-costs[language_model._codes(data, np.array([0, len(data)]))].sum() / language_model.UNIT)

    short = model(two, model(Counter({(c,): n for c, n in one.items()}), spelled))
    p = model(three, short)

    def perplexity(text):
        t = tokens(text)
        logs = [np.log(short((t[0], t[1]))), *(np.log(p(g)) for g in zip(t, t[1:], t[2:]))]
        return -sum(logs) / len(logs)

    want = Counter((d, round(float(perplexity(t)), 5) if t else None) for d, t, *_ in rows)
    found = language_model.classified(docs, labels).collect()
    assert Counter((r.doc_id, None if r.perplexity is None else round(float(np.log(r.perplexity)), 5)) for r in found) == want
    limits = defaultdict(float)
    for r in found:
        if r.doc_id in held_out and r.perplexity is not None:
            limits[r.lang] = max(limits[r.lang], r.perplexity)
    assert limits
    for r in found:
        assert r.threshold == limits.get(r.lang)
        assert r.kept == (r.perplexity is not None and (r.threshold is None or r.perplexity <= r.threshold))


def test_language_model_tells_words_apart(spark, monkeypatch):
    """Words of the same classes of bytes, and n-grams that are weighed by the join alone."""
    texts = ["日本 語文 字典 " * 20, "日本 語文 字典", "語日 本文 典字", "字典 日本 語文"]
    docs = spark.createDataFrame([(i, t, "ja") for i, t in enumerate(texts)] + [(1, texts[1], "ja")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = {}
    for common in (1 << 10, 0):
        monkeypatch.setattr(language_model, "COMMON", common)
        found[common] = Counter((r.doc_id, r.perplexity) for r in language_model.classified(docs, labels).collect())
    assert found[0] == found[1 << 10]
    p = dict(found[0].keys())
    assert p[1] < p[3] < p[2] and found[0][1, p[1]] == 2


def test_quality_rules(docs, rows, nothing, labels, spark):
    want = Counter()
    for doc_id, text, *_ in rows:
        w, places = BLANK_WORDS.findall(text or ""), defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        repeated = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if BLANK_WORDS.search(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        want[doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed] += 1
    df = quality_rules.judged(docs, labels)
    assert got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not df.filter("base_failed AND kept").count()
    assert quality_rules.judged(nothing, labels).count() == 0
    from math import comb
    from pyspark.sql import functions as F

    for k, n in ((0, 500), (3, 700), (20, 1000)):
        tail = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01)).first()[0]
        assert tail == pytest.approx(sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_pipeline_stages(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i == 16)) for i in range(18)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows[12][1][:400])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    unique = stages["ngram_jaccard_join"](spark, kept, folder)
    ids = [r.doc_id for r in unique.collect()]
    assert unique.columns == docs.columns and 1 not in ids and 2 not in ids and {0, 5, 6, 7, 12} <= set(ids) and ids.count(3) == 1
    clean = stages["benchmark_decontamination"](spark, unique, folder)
    assert 12 in {r.doc_id for r in clean.collect()} or clean.count() == unique.count() - 1
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids"]


def test_pipeline_takes_near_copies_by_five_words(spark, tmp_path):
    """Copies of five-word similarity 0.8 and more go, also below 0.85; less similar ones stay."""
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(900)]
    changed, other = list(base), list(base)
    for i in range(19):
        changed[20 + 45 * i] = f"c{i}"
    for i in range(24):
        other[20 + 36 * i] = f"o{i}"
    made = [base, base[:738], changed, other]

    def similarity(a, b, n):
        x, y = ({tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    assert 0.8 < similarity(base, made[1], 5) < 0.85 and similarity(base, made[1], 4) < 0.85
    assert 0.8 < similarity(base, changed, 5) < similarity(base, changed, 4) < 0.85
    assert max(similarity(x, other, 5) for x in made[:3]) < 0.8
    df = spark.createDataFrame([(i, " ".join(t), "en", "a", 1, 1, "k", 1) for i, t in enumerate(made)], SCHEMA).repartition(2)
    found = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in found.collect()) == [0, 3]
    assert len({r.component_id for r in jaccard_join.joined(df).collect()}) == 4


def test_pipeline_keeps_wordless_rows_and_one_row_of_a_document(spark, tmp_path):
    """Equal rows without words all stay; of rows with equal id and text the first by their other columns does."""
    blank = [(1, None, "en", "a", 0, 1, "k", 1), (1, None, "en", "a", 0, 1, "k", 1), (None, " \n\t", "en", "a", 3, 1, "k", 1), (None, " \n\t", "en", "a", 3, 1, "k", 1)]
    same = [(2, "some words", "en", "b", 10, 1, "k", 1), (2, "some words", "en", "a", 11, 1, "k", 1), (2, "some words", "en", "a", 10, 1, "k", 1), (2, "some words", "en", "a", 10, 1, "k", 1)]
    others = [(3, "some words", "en", "a", 1, 1, "k", 1), (None, "\x00", None, None, 1, 1, None, 1), (None, "\x00", None, "a", 1, 1, None, 1)]
    df = spark.createDataFrame([*blank, *same, *others], SCHEMA).repartition(3)
    found = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, df, str(tmp_path))
    assert got(found, *found.columns) == Counter([*blank, same[2], others[1]])


def test_digest_of_items():
    assert decontamination.items_digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()


def test_spans_of_many_equal_rows_count_once(spark):
    text = words(random.Random(9), 120)
    rows = spark.createDataFrame([(5, text)] * 300 + [(6, text), (7, "alone")], "doc_id bigint, text string").repartition(5)
    found = substring_dedup.without_repeats(rows)
    result = found.groupBy("doc_id", "n_removed", "n_spans").count().orderBy("doc_id").collect()
    n = len(text.encode())
    assert [tuple(r) for r in result] == [(5, n, 1, 300), (6, n, 1, 1), (7, 0, 0, 1)]


def test_kept_words_are_bounded(spark, tmp_path):
    """With few kept words, tokens are the same and an encoder holds no more than two such lots and a batch."""
    file = public_tokenizers.path("word_bpe_49k.json")
    texts = [words(random.Random(i), 200) for i in range(8)]
    few, many = token_files.WordEncoder(file, 50), token_files.WordEncoder(file)
    for t in texts:
        assert few.encode([t]) == many.encode([t])
        assert len(few) <= 50 + 400
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    token_files.write_tokens(df, file, f"{tmp_path}/few", cache_words=10)
    token_files.write_tokens(df, file, f"{tmp_path}/many")
    found = [sorted(token_files.token_digests(token_files.read_tokens(spark, f"{tmp_path}/{x}")).collect()) for x in ("few", "many")]
    assert found[0] == found[1]
