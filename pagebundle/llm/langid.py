"""Language identification: known words first, character n-grams for the rest.

A model holds, for known words and for character n-grams of orders 1 to ``max_order``, the
log frequency in each language. A text is scored word by word. A known word adds its log
frequencies. An unseen word backs off: its n-grams of the longest order of which any is
known add the mean of their log frequencies, else shorter ones are tried. The
largest sum (with the log share of the language in training) wins; ``score`` is its
softmax share.

The classifier is fitted on a bounded sample: about ``max_training_rows`` labelled rows,
chosen by a hash of the id, and keeps the ``max_words`` most frequent words and
``max_grams`` n-grams. These parameters bound the model, which is broadcast. Prediction
covers every row and every word of it.

Defined cases: a null text, one without letters, or an empty training set gives ``und``
with score 0. Rows without language or text teach nothing. Equal sums go to the language
that sorts first. Repeated rows are scored alike. Other columns are left alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import crc_bucket, short_batches, stage

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


@dataclass(frozen=True)
class LanguageConfig:
    max_training_rows: int = 30_000
    max_words: int = 60_000
    max_grams: int = 120_000
    max_order: int = 5
    smoothing: float = 0.5


@dataclass
class LanguageModel:
    """Log frequencies: one row of ``scores`` per word or n-gram, one column per language."""

    languages: list[str] = field(default_factory=list)
    prior: np.ndarray | None = None
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    max_order: int = 5

    def unseen(self, word: str) -> np.ndarray:
        padded = f"^{word}$"
        for order in range(min(self.max_order, len(padded)), 0, -1):
            rows = [
                row
                for i in range(len(padded) - order + 1)
                if (row := self.grams.get(padded[i : i + order])) is not None
            ]
            if rows:
                return self.scores[rows].mean(axis=0)
        return np.zeros(len(self.languages))


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _grams(word: str, max_order: int) -> Iterator[str]:
    padded = f"^{word}$"
    for order in range(1, max_order + 1):
        for i in range(len(padded) - order + 1):
            yield padded[i : i + order]


def _counted(pairs: Counter) -> pd.DataFrame:
    return pd.DataFrame(
        [(lang, term, n) for (lang, term), n in pairs.items()], columns=["lang", "term", "n"]
    )


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"]):
            counts.update((lang, w) for w in words_of(text))
        yield _counted(counts)


def learn_languages(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """Fits a model on the labelled rows of ``docs`` (doc_id, text, lang)."""
    short_batches(docs.sparkSession)
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    rows = labelled.count()
    if rows > config.max_training_rows:
        share = int(config.max_training_rows / rows * (1 << 30))
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    shares = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages, order = sorted(shares), config.max_order
    if not languages:
        return LanguageModel()
    schema = "lang string, term string, n long"
    words = stage(
        labelled.mapInPandas(_word_counts, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")), "language-words"
    )

    def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word in zip(batch["lang"], batch["term"]):
                counts.update((lang, g) for g in _grams(word, order))
            yield _counted(counts)

    def most_frequent(counts: DataFrame, limit: int) -> tuple[list[str], np.ndarray]:
        """Up to ``limit`` terms and their counts, a column per language."""
        per_language = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages]
        top = (
            counts.groupBy("term").agg(F.sum("n").alias("total"), F.array(*per_language).alias("counts"))
            .orderBy(F.desc("total"), "term").limit(limit).select("term", "counts").toArrow()
        )
        flat = top["counts"].combine_chunks().flatten().to_numpy()
        return top["term"].to_pylist(), flat.reshape(-1, len(languages))

    known = most_frequent(words, config.max_words)
    # Each word counts once: unseen words are like rare ones, not like frequent ones.
    grams = words.mapInPandas(gram_counts, schema).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return _model(shares, known, most_frequent(grams, config.max_grams), config)


def _model(shares: dict[str, int], known, frequent, config: LanguageConfig) -> LanguageModel:
    """``known`` and ``frequent``: terms with a row of counts each."""
    languages = sorted(shares)

    def log_shares(counts: np.ndarray) -> np.ndarray:
        counts = counts + config.smoothing
        return np.log(counts / counts.sum(axis=0)).astype(np.float32)

    blocks = [log_shares(known[1])]
    words = {term: i for i, term in enumerate(known[0])}
    lengths, grams, at = np.array([len(t) for t in frequent[0]]), {}, len(words)
    for order in range(1, config.max_order + 1):
        rows = np.flatnonzero(lengths == order)
        if len(rows):
            blocks.append(log_shares(frequent[1][rows]))
            grams |= {frequent[0][row]: at + i for i, row in enumerate(rows.tolist())}
            at += len(rows)
    total = sum(shares.values())
    prior = np.log(np.array([shares[lang] / total for lang in languages]))
    return LanguageModel(languages, prior, words, grams, np.vstack(blocks), config.max_order)


class _Scorer:
    """Sums the log frequencies of whole texts; remembers the scores of words it has met."""

    def __init__(self, model: LanguageModel, max_remembered: int = 400_000) -> None:
        self.model, self.max_remembered = model, max_remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))

    def _numbers(self, words: list[str]) -> np.ndarray:
        number, model = self.number, self.model
        if len(number) > self.max_remembered:
            self._forget()
            number = self.number
        for word in words:
            if word not in number:
                i = number[word] = len(number)
                if i == len(self.table):
                    self.table = np.vstack((self.table, np.zeros_like(self.table)))
                known = model.words.get(word)
                self.table[i] = model.unseen(word) if known is None else model.scores[known]
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        sums = self.model.prior + self.table_rows(words)
        best = int(np.argmax(sums))
        return self.model.languages[best], float(1 / np.exp(sums - sums[best]).sum())

    def table_rows(self, words: list[str]) -> np.ndarray:
        numbers = self._numbers(words)
        return self.table[numbers].sum(axis=0)


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def language_of(spark, model: LanguageModel):
    """A column function: text to (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf(_PREDICTED)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(LanguageModel(**shared.value))
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=_PREDICTED.names)

    return predicted


def language_digest(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = learn_languages(docs.where(~held_out), config)
    predicted = language_of(docs.sparkSession, model)
    return docs.select("doc_id", held_out.alias("held_out"), predicted("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
