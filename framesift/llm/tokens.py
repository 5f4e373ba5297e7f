"""Token counts of every prefix, by dynamic programming over byte-pair tokens.

For each prefix of a piece of text exactly one token can be the last of its encoding:
the token ``t`` for which the last token of the prefix before it and ``t`` stay two
tokens when encoded together. So the counts of all prefixes follow one from the other
(``count[i] = count[i - len(t)] + 1``) and no prefix is encoded again. Pieces are what
the tokenizer's pattern splits off. A text that ends inside a run of blanks, or inside
a contraction, is split otherwise there than the whole text; its count is taken so.

A document's prefix counts are stored as 16-bit steps, one per character: the count at
any cut, the longest prefix within a budget and the total are sums of steps.

Chunks repeat and share beginnings, so each worker keeps what it has computed: steps of up
to ``CACHE_CHUNKS`` chunks of a kind, and a tree of byte prefixes of pieces of up to
``TREE_NODES`` nodes, each with the count and the last token of its prefix. Forgetting costs time and
changes nothing. A step that does not fit 16 bits ends the task with an overflow error
instead of a wrong count.

Defined cases: null texts are empty and have 0 tokens; a special string inside a text is
one special token at its end, and ordinary text before that; equal rows give equal rows;
further columns are not looked at.
"""

from __future__ import annotations

from array import array
from functools import cache
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from framesift.llm.common import keyed
from pyspark.sql import DataFrame

CACHE_CHUNKS = 250_000
TREE_NODES = 1_000_000
#: Prefixes of longer pieces are not kept.
SHORT_PIECE = 64
LIMIT = 512
#: The split pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = {"'re", "'ve", "'ll"}
#: Marks that are a piece, and a token, of their own after a word; and the end of the Latin letters.
MARKS = frozenset(".,;:!?")
LATIN_END = "\u0250"
ONE = array("h", [1]).tobytes()

BLANK = frozenset(chr(i) for i in range(0x3001) if regex.match(r"\p{White_Space}", chr(i)))
_PIECE = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
# A single space between two other characters always starts a piece.
_CHUNK = regex.compile(r"(?<=\P{White_Space})(?= \P{White_Space})")
_ODD_BLANKS = regex.compile(r" \p{White_Space}|\p{White_Space} ")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _one_word(part: str) -> bool:
    """Whether a part is letters only, and so a single piece, with a blank before it or not."""
    return part.isalpha() and max(part) < LATIN_END


class PrefixCounter:
    """Steps of token counts, character by character, for texts of one vocabulary."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.vocabulary = {t: t for t in self.tokenizer.get_vocab(with_added_tokens=False)}
        self.longest = max(map(len, self.vocabulary))
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special_strings = special
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.letters = dict(enumerate(byte_letters()))
        self.pairs: dict[tuple[str, str], bool] = {}
        self._forget()
        self.pieces: dict[str, list[int]] = {}
        self.first: list[dict[str, bytes]] = [{}, {}]
        self.later: list[dict[str, bytes]] = [{}, {}]

    def stays(self, left: str, right: str) -> bool:
        """Whether two tokens in a row (or one alone) are the encoding of their text."""
        key = left, right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_CHUNKS:
                self.pairs.clear()
            encoded = [t.value for t in self.tokenizer.model.tokenize(left + right)]
            known = self.pairs[key] = encoded == ([left, right] if left else [right])
        return known

    def _forget(self):
        """The tree of prefixes with its root only: edges by node and byte, counts and last tokens by node."""
        self.edges: dict[int, int] = {}
        self.counts, self.lasts = [0], [""]

    def _grow(self, letters: str, path: list[int]) -> int:
        """A node for the prefix that ends after ``letters``, whose shorter prefixes are ``path``."""
        i, counts, lasts = len(path), self.counts, self.lasts
        # Only one start fits, so the likeliest are tried first: the last token grows by
        # this letter, or the letter is a token of its own.
        for start in (i - 1 - len(lasts[path[-1]]), i - 1, *range(i - 2, max(0, i - self.longest) - 1, -1)):
            token = self.vocabulary.get(letters[start:i])
            if token and self.stays(lasts[path[start]], token):
                counts.append(counts[path[start]] + 1)
                lasts.append(token)
                return len(counts) - 1
        raise ValueError(f"no token ends {letters[:i]!r}")

    def piece_counts(self, piece: str) -> list[int]:
        """Token count of each prefix, by characters, of one piece of the pattern."""
        if len(self.counts) > TREE_NODES:
            self._forget()
        data, edges, node = piece.encode(), self.edges, 0
        path, letters = [0], None
        for byte in data:
            key = node << 8 | byte
            node = edges.get(key)
            if node is None:
                if letters is None:
                    letters = data.decode("latin-1").translate(self.letters)
                node = self._grow(letters, path)
                if len(path) <= SHORT_PIECE:
                    edges[key] = node
            path.append(node)
        counts = self.counts
        if len(data) == len(piece):
            found = [counts[x] for x in path[1:]]
        else:
            # A character ends where no further byte of it follows.
            found = [counts[x] for x, following in zip(path[1:], data[1:] + b" ") if following & 0xC0 != 0x80]
        if piece in LONG_CONTRACTIONS:
            found[1] = found[0] + 1  # the quote and the letter are pieces of their own
        return found

    def chunk_steps(self, chunk: str) -> bytes:
        """Steps of a chunk that no piece crosses the ends of."""
        if _one_word(chunk[1:] if chunk[:1] == " " else chunk):
            own = self.piece_counts(chunk)
            return array("h", map(sub, own, [0, *own])).tobytes()
        counts, done, before_run, run = [0], 0, 0, 0
        for match in _PIECE.finditer(chunk):
            piece, start = match[0], match.start()
            own = self.pieces.get(piece)
            if own is None:
                own = self.piece_counts(piece)
                if len(self.pieces) >= CACHE_CHUNKS:
                    self.pieces = {}
                self.pieces[piece] = own
            if start == 0 or chunk[start - 1] not in BLANK:
                run, before_run = start, done
            lead = 0
            if piece[0] in BLANK:
                while lead < len(piece) and piece[lead] in BLANK:
                    lead += 1
                if run < start or lead > 1:
                    counts += [before_run + c for c in self.piece_counts(chunk[run : start + lead])[start - run :]]
                else:
                    counts.append(done + own[0])
            counts += [done + c for c in own[lead:]] if done or lead else own
            done += own[-1]
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def _known(self, caches: list[dict[str, bytes]], part: str, lead: str) -> bytes:
        """Steps of a chunk; chunks not met since the cache was last full are forgotten."""
        steps = caches[0].get(part)
        if steps is None:
            steps = caches[1].get(part)
            if steps is None:
                if part[-1:] in MARKS and _one_word(part[:-1]):
                    steps = self._known(caches, part[:-1], lead) + ONE
                else:
                    steps = self.chunk_steps(lead + part)
            if len(caches[0]) >= CACHE_CHUNKS:
                caches[:] = [{}, caches[0]]
            caches[0][part] = steps
        return steps

    def plain_steps(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_BLANKS.search(text):
            return b"".join(self._known(self.first, c, "") for c in _CHUNK.split(text))
        head, *rest = text.split(" ")
        steps = list(map(self.later[0].get, rest))
        if None in steps:
            steps = [self._known(self.later, part, " ") if s is None else s for part, s in zip(rest, steps)]
        return self._known(self.first, head, "") + b"".join(steps)

    def text_steps(self, text: str) -> bytes:
        if not any(s in text for s in self.special_strings):
            return self.plain_steps(text)
        out, at = [], 0
        for match in self.special.finditer(text):
            segment = match.start() - at
            steps = np.frombuffer(self.plain_steps(text[at : match.end() - 1]), "<i2")
            closing = steps[:segment].sum(dtype=np.int64) + 1 - steps.sum(dtype=np.int64)
            out += [steps.tobytes(), np.array([closing], "<i2").tobytes()]
            at = match.end()
        return b"".join([*out, self.plain_steps(text[at:])])


@cache
def counter_of(file: str) -> PrefixCounter:
    """One per worker process, so that what it has seen serves later tasks too."""
    return PrefixCounter(file)


def steps_of(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<i2").astype(np.int64)


def prefix_counts(stored: bytes) -> np.ndarray:
    """Exact token count of every prefix of a document, one entry per character."""
    return np.cumsum(steps_of(stored))


def longest_within(stored: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(prefix_counts(stored) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefixes(docs: DataFrame, file: str) -> DataFrame:
    """``doc_id, key, n_bytes, n_tokens, steps`` of every row; ``file`` exists on all executors."""

    def count(batches):
        counter = counter_of(file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            steps = [counter.text_steps(t) for t in texts]
            tokens = [int(np.frombuffer(s, "<i2").sum(dtype=np.int64)) for s in steps]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(steps, pa.binary())],
                ["doc_id", "key", "n_bytes", "n_tokens", "steps"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(count, f"doc_id {kind}, key bigint, n_bytes bigint, n_tokens bigint, steps binary")
