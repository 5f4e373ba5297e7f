"""Removal of passages that occur earlier, by global grouping of line and clause digests.

A unit is a line, or a part of one that ends in a word with a mark of ``MARKS`` at its end.
It is normalised (A-Z lower-cased, runs of blanks as one, ends trimmed) and hashed. All
units take part, however short. Over all documents their digests are grouped; the
occurrence that ranks first, by document and place, stays. Later occurrences go where a run
of them, unit after unit, is a passage: ``MIN_WORDS`` words, or ``MIN_CHARACTERS``
characters other than blanks, which is for scripts without blanks and long addresses. So
single stock lines and short phrases that many texts share stay, and passages that begin
or end inside a line are found but for the clause that is cut. What goes keeps its place in
the original text: first unit, number of units, first and last character, where the blanks
up to the next unit go with it. The text that stays is the original without these places.

Digests are grouped by one minimum, which is a partial aggregate, so a unit in a third of
all documents is one row from each task. The first places, a row for each digest, then go
to the document they lie in; units of a document that are not among them are later ones. No
rows are joined by digest. Digests have 64 bits; a clash makes a unit count as a repeat,
and changes a text only beside a whole run of repeats.

Defined cases: texts without words have no units and stay as they are; null texts are
empty; rows with equal id and text are one document and lose the same passages; a null id
ranks last; a unit that recurs in its own document is a later one there; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from framesift.llm.common import BLANKS, Powers, keyed, mix64, range_hash, running_hash, text_bytes
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 40
MIN_CHARACTERS = 300
MARKS = b".!?,;:"
_CLOSES = np.isin(np.arange(256), list(MARKS))


class Units:
    """Units of the texts of an Arrow column, all rows one after the other.

    ``first`` is the first unit of each row, with one entry more than rows; ``starts`` are
    first bytes, ``words`` and ``characters`` sums over all units before, with one more entry.
    """

    def __init__(self, column: pa.Array, powers: Powers):
        self.data, self.offsets = data, offsets = text_bytes(column)
        folded = BLANKS[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (folded != 0) | (data == 0)
        edge = inside[1:] != inside[:-1]
        # Rows that touch are told apart where both have a word there.
        edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
        cuts = np.flatnonzero(edge)
        is_word = inside[cuts[:-1] + 1] if len(cuts) else np.zeros(0, bool)
        starts, ends = cuts[:-1][is_word], cuts[1:][is_word]
        row = np.searchsorted(offsets, starts, "right") - 1
        opens = np.ones(len(starts), bool)
        line_ends = np.concatenate([[0], np.cumsum(data == 10)])
        opens[1:] = (row[1:] != row[:-1]) | _CLOSES[data[ends[:-1] - 1]] | (line_ends[starts[1:]] != line_ends[ends[:-1]])
        at = np.flatnonzero(opens)
        self.starts = starts[at]
        self.first = np.searchsorted(self.starts, offsets)
        self.words = np.append(at, len(starts))
        self.points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        lengths = np.concatenate([[0], np.cumsum(self.points[ends] - self.points[starts])])
        self.characters = lengths[self.words]
        if len(starts):
            up, down = powers.of(max(len(data), len(starts)) + 1)
            hashes = range_hash(running_hash(folded, powers), starts, ends, powers)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
            sizes = np.diff(self.words).astype(np.uint64)
            self.digests = mix64((sums[self.words[1:]] - sums[at]) * down[at] + sizes)
        else:
            self.digests = np.zeros(0, np.uint64)


def _digests(batches):
    powers = Powers()
    for batch in batches:
        units = Units(batch.column("text"), powers)
        counts = np.diff(units.first)
        row = pa.array(np.repeat(np.arange(len(counts)), counts))
        number = np.arange(len(units.starts)) - np.repeat(units.first[:-1], counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(number, pa.int32()), pa.array(units.digests.view(np.int64))], ["doc_id", "key", "unit", "digest"]
        )


def units(docs: DataFrame) -> DataFrame:
    """``doc_id, key, unit, digest`` of all units."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(_digests, f"doc_id {kind}, key bigint, unit int, digest bigint")


def first_units(docs: DataFrame) -> DataFrame:
    """``d, k, firsts``: the units of each document that occur nowhere earlier."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "unit")
    first = units(docs).groupBy("digest").agg(F.min(place).alias("p"))
    return first.groupBy(F.col("p.doc_id").alias("d"), F.col("p.key").alias("k")).agg(F.collect_list("p.unit").alias("firsts"))


def _without_passages(min_words: int, min_characters: int):
    def run(batches):
        powers = Powers()
        for batch in batches:
            units, firsts = Units(batch.column("text"), powers), batch.column("firsts")
            sizes = firsts.value_lengths().to_numpy()
            later = np.ones(len(units.starts) + 1, bool)
            later[np.repeat(units.first[:-1], sizes) + firsts.flatten().to_numpy()] = False
            later[-1] = False
            row = np.append(np.repeat(np.arange(len(batch)), np.diff(units.first)), -1)
            before = np.concatenate([[False], later[:-1] & (row[1:] == row[:-1])])
            begins = np.flatnonzero(later & ~before)
            ends = np.flatnonzero(np.append(later[:-1] & ~(later[1:] & (row[1:] == row[:-1])), False)) + 1
            long = (units.words[ends] - units.words[begins] >= min_words) | (units.characters[ends] - units.characters[begins] >= min_characters)
            begins, ends = begins[long], ends[long]
            rows, offsets = row[begins], units.offsets
            start = units.starts[begins]
            end = np.minimum(np.append(units.starts, len(units.data))[ends], offsets[rows + 1])
            change = np.zeros(len(units.data) + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, end, -1)
            stays = np.cumsum(change[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(stays)])[offsets]
            base = units.points[offsets[rows]]
            spans = pa.StructArray.from_arrays(
                [pa.array(begins - units.first[rows], pa.int32()), pa.array(ends - begins, pa.int32()), pa.array(units.points[start] - base), pa.array(units.points[end] - base)],
                ["unit", "units", "start", "end"],
            )
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(batch) + 1)), pa.int32()), spans)
            text = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(units.data[stays].tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(units.first)), removed, text], ["doc_id", "key", "n_units", "removed", "text"]
            )

    return run


def without_later_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_characters: int = MIN_CHARACTERS) -> DataFrame:
    """``doc_id, key, n_units, removed, text`` of every row; text without its later passages."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, firsts = keyed(docs), first_units(docs)
    both = texts.join(firsts, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["key"] == F.col("k")), "left")
    rows = both.select("doc_id", "key", "text", F.coalesce("firsts", F.array().cast("array<int>")).alias("firsts"))
    return rows.mapInArrow(
        _without_passages(min_words, min_characters), f"doc_id {kind}, key bigint, n_units bigint, removed array<struct<unit: int, units: int, start: bigint, end: bigint>>, text string"
    )
