"""Token ids as Parquet lists, in id order, with selective reads of tokens and metadata.

Documents are range-partitioned by ``doc_id`` and sorted, encoded, and written as one
row each: metadata columns beside a list column of ids. Ids are dictionary-encoded (a
vocabulary has few distinct values), positions delta-encoded; row groups are kept small
and carry page indexes, so a reader of metadata never touches ids, and a reader of some
documents opens only their pages.

Where a document starts in the whole sequence is a distributed prefix sum over the files'
metadata: inside each written partition, then over one row per partition.

Encoding is by words between blanks, which the tokenizer never joins. Each worker keeps the
ids of the words it has seen, up to two generations of ``CACHE_WORDS``, or as many as given, and those of one batch;
forgetting costs time and changes nothing. If the file states the rules in ``WORD_RULES``, texts of
Latin letters and ASCII signs alone are lower-cased and split into the pieces of these rules here,
as are the Latin words of other texts, and new pieces go to the merge model directly; all other
words, and all texts under other files, take the whole tokenizer.

Defined cases: null texts are empty and consist of the end id alone; null ids sort last;
equal ids are ordered by their text's hash, and equal rows each get their own place in
an arbitrary order; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from framesift.llm.common import keyed
from framesift.llm.tokens import byte_letters
from framesift.session import shared_root
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END_ID = 1
CACHE_WORDS = 350_000
#: The normaliser and the splitting under which Latin words are split here.
WORD_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed", "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Signs of ASCII, and the letters of Latin-1 and Latin Extended-A whose lower case is one
#: composed letter.
LATIN_TEXT = re.compile("[ \\n\\t!-~À-ÖØ-öø-įı-ſ]*")
LATIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")
ROW_GROUP_BYTES = 16 * 2**20
PAGE_BYTES = 256 * 2**10
WRITING = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "compression": "zstd",
}


class WordEncoder(dict):
    """Ids of whole texts, from the ids of their words or pieces, which are the entries."""

    def __init__(self, file: str, cache_words: int | None = None):
        super().__init__()
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        rules = json.loads(self.tokenizer.to_str())
        self.by_pieces = all(rules[k] == v for k, v in WORD_RULES.items())
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        # Signs that all of them begin with; a text without these needs no search.
        self.special_start = re.match(r"[\W\d_]*", os.path.commonprefix(added))[0]
        self.letters = dict(enumerate(byte_letters()))
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > (self.cache_words or CACHE_WORDS):
            self.older = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, self._parts(t))) for t in texts]

    def _parts(self, text: str) -> list[str]:
        if self._latin(text):
            return LATIN_PIECE.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def _latin(self, text: str) -> bool:
        """Whether the rules can be followed here: no special token, no sign outside of ``LATIN_TEXT``."""
        if not self.by_pieces or self.special_start in text and self.special.search(text):
            return False
        if text.isascii() and text.replace("\n", " ").replace("\t", " ").isprintable():
            return True
        return LATIN_TEXT.fullmatch(text) is not None

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if self.by_pieces and word.isascii() and word.isalpha() and word.islower():
                ids = self._merged(word)
            elif not self._latin(word):
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            elif (pieces := LATIN_PIECE.findall(word.lower())) != [word]:
                return b"".join(map(self.__getitem__, pieces))
            else:
                ids = self._merged(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        self[word] = ids
        return ids

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()


@cache
def encoder_of(file: str, cache_words: int) -> WordEncoder:
    """One per worker process, so that the words it has seen serve later tasks too."""
    return WordEncoder(file, cache_words)


def _encode(file: str, end_id: int, cache_words: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(file, cache_words)
        for batch in batches:
            rows = [b + end for b in encoder.encode(batch.column("text").to_pylist())]
            starts = np.cumsum([0, *(len(b) // 4 for b in rows)])
            values = pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(starts), pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)],
                ["doc_id", "key", "n_tokens", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, file: str, path: str, end_id: int = END_ID, cache_words: int | None = None) -> None:
    """Write ``doc_id, key, part, pos, n_tokens, ids`` below ``path`` in ascending id order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    ordered = keyed(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(_encode(file, end_id, cache_words or CACHE_WORDS), f"doc_id {kind}, key bigint, n_tokens bigint, ids array<int>")
    counted = encoded.select(
        "doc_id", "key", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"), "n_tokens", "ids",
    )
    counted.write.options(**WRITING).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows(part, pos, n_tokens, ...)`` of all documents with ``start``."""
    before = Window.unboundedPreceding, -1
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    first = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(*before)), F.lit(0))
    return rows.withColumn("inside", inside).join(first, F.col("part") == F.col("p")).withColumn("start", F.col("inside") + F.col("first"))


def token_starts(files: DataFrame) -> DataFrame:
    """``part, pos, start``: ids of all documents before each; reads metadata columns only."""
    return _with_starts(files.select("part", "pos", "n_tokens"), files).select("part", "pos", "start")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        starts = ids.offsets.to_numpy()
        raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("pos"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
        )


def token_digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""
    kind = files.schema["doc_id"].dataType.simpleString()
    sums = files.select("doc_id", "part", "pos", "n_tokens", "ids").mapInArrow(_checksums, f"doc_id {kind}, part int, pos bigint, n_tokens bigint, ids_crc32 bigint")
    return _with_starts(sums, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_rows(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document."""
    return files.join(token_starts(files), ["part", "pos"]).select("doc_id", "start", "n_tokens", "ids")


def new_path(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tokens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
