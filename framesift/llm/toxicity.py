"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, takes accents off, maps look-alike letters of other alphabets and
digits inside words to the letters they stand for, and turns all else into single blanks.
Terms are word beginnings or whole words; their weights are log odds learned from labelled
documents. Phrases in which a term is seen in clean documents only are exceptions: a term
inside one does not count. The weights found, as a sum and by length, are turned into a
score by a logistic fit.

Labels are read only of documents whose crc32(doc_id as text) mod 3 is not 1, and of these
at most ``TRAINING_ROWS``, those with the smallest hashes. So the sample, its terms, of which
none is left out, and the fit are of bounded size, and all texts are scored whole.

Defined cases: null texts are empty; texts without terms get the score of no finding; a
null id counts as the empty string; a document with several labels is toxic if one says
so; labels without document are unused; without toxic labels every score is 0; further
columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from framesift.llm.common import text_of
from framesift.session import store
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 20_000
#: Toxic training documents that a term must be in, and its least log odds.
MIN_DOCS = 5
MIN_WEIGHT = 3.0
BEGINNINGS = range(4, 9)
#: Clean training documents that a phrase must be in to be an exception.
EXCEPTION_DOCS = 3
DECISION = 0.7
FOLDS = 3
HELD_OUT = 1

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухікмнтвјѕԁһԛԝαβεικνορτυχγηωµıłøđßæœ",
    "aeopcyxikmhtbjsdhqwabeiknoptuxynwuilodbao",
)
#: Digits and signs that stand for letters inside words.
STANDS_FOR = str.maketrans("0134578@$", "oieastbas")
_INSIDE_WORD = re.compile(r"(?<=[^\W\d_])[0134578@$]+(?=[^\W_]|[0134578@$]*[^\W\d_])|(?<![\w@$])[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?![\w@$])")
_NO_WORD = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with single blanks between, before and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(LOOKALIKES)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = _INSIDE_WORD.sub(lambda m: m[0].translate(STANDS_FOR), text)
    return f" {_NO_WORD.sub(' ', text).strip()} "


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


class Lexicon:
    """Terms with weights, exception phrases and the coefficients of the score."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = (), coefficients=(0.0, 0.0, 0.0)):
        self.terms, self.exceptions, self.coefficients = terms, exceptions, coefficients
        self._automaton = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.coefficients

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), 0.0))
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (len(term), weight))
            self._automaton.make_automaton()
        return self._automaton

    def found(self, folded: str) -> list[tuple[int, float]]:
        """Start and weight of each word found, by its weightiest term, without exceptions."""
        if not self.terms:
            return []
        words, spared = {}, []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight:
                words[start] = max(weight, words.get(start, 0.0))
            else:
                spared.append((start, end))
        if spared:
            words = {s: w for s, w in words.items() if not any(a <= s < b for a, b in spared)}
        return sorted(words.items())

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, w in self.found(folded))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str) -> float:
        if not self.terms:
            return 0.0
        x, y = self.features(text)
        a, b, c = self.coefficients
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``text, toxic`` of the training sample, the same in every run."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != HELD_OUT))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = sample.select(F.col("doc_id").alias("labelled"), "toxic")
    # Bounded by the sample: at most TRAINING_ROWS rows of two numbers.
    chosen = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    return store(chosen.select("text", "toxic"), "toxicity_training")


def _parts(batches):
    """The distinct word beginnings and words of each document."""
    for batch in batches:
        parts, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(fold(text).split())
            own = {f" {w} " for w in words if len(w) >= BEGINNINGS[0]} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}
            parts += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(toxic, pa.int32())], ["part", "toxic"])


def _phrases(lexicon: Lexicon):
    """The two words around and with each term found, once per document."""

    def run(batches):
        for batch in batches:
            phrases, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, own = fold(text), set()
                for start, _ in lexicon.found(folded):
                    end = folded.index(" ", start + 1)
                    if start:
                        own.add(folded[folded.rindex(" ", 0, start) : end + 1])
                    if end + 1 < len(folded):
                        own.add(folded[start : folded.index(" ", end + 1) + 1])
                phrases += own
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(toxic, pa.int32())], ["part", "toxic"])

    return run


def _features(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            values = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            numbers = [pa.array([v[i] for v in values], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*numbers, batch.column("toxic").cast(pa.int32())], ["x", "y", "toxic"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic coefficients by Newton steps, with a weak pull to zero."""
    design, beta = np.stack([np.ones_like(x), x, y], axis=1), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3), design.T @ (label - p) - 0.1 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled documents; ``exceptions`` are further phrases that never count."""
    training = training_rows(docs, labels, rows)
    spared = tuple(fold(e) for e in exceptions)
    sizes = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Lexicon({})
    counts = training.mapInArrow(_parts, "part string, toxic int").groupBy("part").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    best = counts.withColumn("weight", weight).filter((F.col("bad") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT))
    terms = {r["part"]: r["weight"] for r in best.collect()}
    # A term that goes on from another one finds no further words.
    terms = {t: w for t, w in terms.items() if not any(t[:n] in terms for n in range(2, len(t)))}
    lexicon = Lexicon(terms, spared)
    phrases = training.mapInArrow(_phrases(lexicon), "part string, toxic int").groupBy("part").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    harmless = phrases.filter((F.col("bad") == 0) & (F.col("good") >= EXCEPTION_DOCS)).orderBy("part")
    lexicon = Lexicon(terms, spared + tuple(r["part"] for r in harmless.collect()))
    fitted = training.mapInArrow(_features(lexicon), "x double, y double, toxic int").toPandas()
    return Lexicon(terms, lexicon.exceptions, _fit(fitted["x"].to_numpy(), fitted["y"].to_numpy(), fitted["toxic"].to_numpy(float)))


def _scores(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            scores = pa.array([lexicon.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), text_of().alias("text"))
    rows = texts.mapInArrow(_scores(lexicon), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not predicted to be toxic.

    Rows pass through Python whole, so that Spark need not queue them beside their texts.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([lexicon.score(t or "") < DECISION for t in texts.to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
