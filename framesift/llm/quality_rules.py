"""Quality rules with risk-controlled thresholds (native).

Every document gets counts of words, characters, symbols, repeated lines and repeated
eight-word windows. Rules compare ratios of these with cutoffs. The cutoffs come from
labelled documents: of all cutoffs of a rule, the strictest one is taken of which an
exact binomial test shows, in each stratum, that it rejects less than ``ALPHA`` of the
good documents. The tests of all strata, rules and cutoffs share ``DELTA`` evenly
(Bonferroni), so all guarantees hold together with probability 1 - ``DELTA``.

Windows are hashed inside the row by pairwise combination (1, 2, 4, 8 words). Only
documents in which a window repeats are unrolled, to find which words are covered.

Defined cases: null and blank texts have no words, fail the base rules and are not kept;
a stratum without labels, or with too few for any proof, has no cutoff and rejects
nothing beyond the base rules; a null language is a stratum; rows that agree in id and
text count alike. Labels without a document, or several labels of one document, are
fine: a document is good if any of its labels says so.
"""

from __future__ import annotations

from framesift.llm.common import text_key, text_of
from framesift.session import store
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Allowed share of good documents that one rule rejects in a stratum, and the chance that any guarantee fails.
ALPHA = 0.01
DELTA = 0.05
#: Candidate cutoffs of each rule, as ratios; a document is rejected above the cutoff.
CUTOFFS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
RULES = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "joints": "n_joints / n_words",
}


def _pairs(hashes: Column, width: int) -> Column:
    """Hashes of runs of ``2 * width`` words from those of ``width`` words; shorter arrays give none."""
    n = F.size(hashes) - width
    left, right = F.slice(hashes, F.lit(1), F.greatest(n, F.lit(0))), F.slice(hashes, F.lit(width + 1), F.greatest(n, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts of every row: doc_id, key, stratum, the base columns and those of the rules."""
    text = text_of()
    read = docs.select("doc_id", text_key().alias("key"), F.col(stratum).alias("stratum"), text.alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    read = read.withColumns({"lines": lines, "h1": F.transform("words", lambda w: F.xxhash64(w))})
    read = read.withColumn("h8", _pairs(_pairs(_pairs(F.col("h1"), 1), 2), 4))
    counted = read.select(
        "doc_id", "key", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        # Words that follow an equal word.
        F.size(F.filter(F.zip_with(F.slice("h1", F.lit(1), F.greatest(F.size("h1") - 1, F.lit(0))), F.slice("h1", F.lit(2), F.greatest(F.size("h1") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_joints"),
        F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.col("h8")).alias("windows"),
    )
    return store(counted, "measures")


def repeat_words(counted: DataFrame) -> DataFrame:
    """Words inside windows that occur twice or more, for documents that have such windows."""
    unrolled = counted.filter("windows IS NOT NULL").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.posexplode("windows").alias("pos", "gram"))
    twice = unrolled.groupBy("doc_id", "key", "gram").agg(F.collect_list("pos").alias("at")).filter(F.size("at") > 1)
    starts = twice.select("doc_id", "key", F.explode("at").alias("pos"))
    before = F.lag("pos").over(Window.partitionBy("doc_id", "key").orderBy("pos"))
    covered = starts.select("doc_id", "key", F.least(F.lit(WINDOW), F.coalesce(F.col("pos") - before, F.lit(WINDOW))).alias("words"))
    return covered.groupBy("doc_id", "key").agg(F.sum("words").cast("long").alias("n_repeat_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(at most k of n) exactly, summed in logarithms."""
    odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    first = n.cast("double") * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(state, i):
        term = state["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + odds
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda s: F.exp(s["total"]))


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({f"r_{name}": F.coalesce(F.expr(f"try_divide({' , '.join(f'cast({x} as double)' for x in rule.split(' / '))})"), F.lit(0.0)) for name, rule in RULES.items()})


def chosen_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, one cutoff per rule (null: none proven). One row per stratum that has labels."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("labelled")).distinct()
    held = measured.filter("NOT base_failed").join(good, F.col("doc_id") == F.col("labelled"))
    cells = [F.count_if(F.col(f"r_{rule}") > c).alias(f"{rule}_{i}") for rule in RULES for i, c in enumerate(CUTOFFS)]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *cells)
    tests = F.count("*").over(Window.partitionBy()) * (len(RULES) * len(CUTOFFS))

    def proven(k):
        # Sums are needed only where at most the allowed share was rejected.
        return F.when(k <= F.floor(F.col("n") * alpha), binomial_tail(k, F.col("n"), alpha) <= F.col("each")).otherwise(F.lit(False))

    level = counts.withColumn("each", F.lit(delta) / tests)
    return level.select("stratum", *(
        F.coalesce(*(F.when(proven(F.col(f"{rule}_{i}")), F.lit(c)) for i, c in enumerate(CUTOFFS))).alias(f"c_{rule}") for rule in RULES
    ))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every row's counts, ratios, its stratum's cutoffs, ``base_failed`` and ``kept``."""
    counted = measures(docs)
    repeats = repeat_words(counted).withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = counted.drop("windows").join(repeats, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    joined = joined.withColumn("n_repeat_words", F.coalesce("n_repeat_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = store(ratios(joined.withColumn("base_failed", failed)), "measured")
    cutoffs = chosen_cutoffs(measured, labels, alpha, delta).withColumnRenamed("stratum", "s")
    rows = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("s")), "left").drop("s")
    passed = ~F.col("base_failed")
    for rule in RULES:
        passed = passed & ~F.coalesce(F.col(f"r_{rule}") > F.col(f"c_{rule}"), F.lit(False))
    return rows.withColumn("kept", passed)
