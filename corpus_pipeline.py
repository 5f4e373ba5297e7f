"""Training-data pipeline over ``documents``: reject, deduplicate, decontaminate, mix, tokenise.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given. All but the
last return the columns of ``docs``; rows with a null text or id pass through the stages by
the rules of their operators.
"""

from __future__ import annotations

import public_tokenizers
from framesift.llm import decontamination, jaccard_join, mixing, token_files, toxicity
from framesift.llm.common import table, text_key, text_of
from framesift.session import store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Near copies share at least so many hundredths of their runs of so many words.
SHINGLE_WORDS, SIMILAR_HUNDREDTHS = 5, 80
#: Words whose ids a worker keeps, fewer than alone: workers also hold what earlier stages left.
CACHE_WORDS = 100_000


def _rows_of(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are (``left_semi``) or are not (``left_anti``) among ``decided``."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key().alias("key"))
    found = decided.select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    kept = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["key"] == found["k"]), how)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not predict to be toxic."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies; rows without words all stay.

    Of rows that agree in id and text, the one with the least other columns, in their order, stays. Near copies are those of five-word similarity 0.8, where ``op3_jaccard_join`` takes four words and 0.85.
    """
    rows = jaccard_join.joined(docs, SHINGLE_WORDS, SIMILAR_HUNDREDTHS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.key")
    worded = text_of().rlike(r"[^\x20\x09-\x0D]")
    kept = _rows_of(docs.filter(worded), first, "left_semi")
    rest = F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), "text")
    one = kept.select("doc_id", text_key().alias("key"), rest.alias("rest")).groupBy("doc_id", "key").agg(F.min("rest").alias("rest"))
    one = one.select(*("doc_id" if c == "doc_id" else F.col("rest").getField(c).alias(c) for c in docs.columns))
    return docs.filter(~worded).union(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontamination.judged(decontamination.matches(docs, table(spark, sf_dir, "benchmark")))
    return _rows_of(docs, found.filter("contaminated").select("doc_id", "key"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the token files written."""
    path = token_files.new_path(spark)
    token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path, cache_words=CACHE_WORDS)
    return token_files.token_rows(token_files.read_tokens(spark, path))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Learned lexicon, near-copy groups and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
