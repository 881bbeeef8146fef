"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, compatibility forms, look-alike letters of other scripts and digits
or signs that stand for letters become one plain letter each; l, i, 1 and | become the
same one. Everything that is no letter becomes one space. Lexicon entries are whole
words or word beginnings (stems with open endings); an automaton finds all of them in
one pass over the text, and each word counts its longest entry.

The lexicon is learned from labelled documents. A term's support is the number of
toxic documents with it, but at most the number of distinct contexts (the words around
it) it has there, so that copies of one document count once; against it stands the number of clean documents with the term.
Terms whose log odds are high beyond chance (lower confidence limit) enter, weighted by
their log odds; a longer entry that says no more than a shorter one is dropped. Phrases
of two words in which an entry is mostly met in clean documents become exceptions: such
a hit does not count. The weights found in a text, and their sum per word, feed a
logistic regression whose probability is the score.

Bounds: the classifier is fitted on about ``max_training_rows`` labelled rows, chosen by
a hash of the id, with at most ``max_candidates`` candidate terms and ``max_terms``
entries. Scoring covers every row and its whole text.

Defined cases: null and empty texts, and texts without hits, get the score of no hits.
Without any usable label every score is 0. If labels repeat an id, one toxic label makes
it toxic; null labels teach nothing. Repeated rows are scored alike. Other columns stay.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import crc_bucket, short_batches, stage

#: Look-alikes of Latin letters, and digits and signs read as letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v",
    "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ɑ": "a",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "|": "i", "l": "i",
}
_FOLD = str.maketrans(_LOOKALIKES)
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
STEM_LENGTHS = (4, 5, 6, 7)


@dataclass(frozen=True)
class ToxicityConfig:
    max_training_rows: int = 60_000
    max_candidates: int = 50_000
    max_terms: int = 5_000
    min_contexts: int = 5
    #: the lower confidence limit of the log odds that an entry needs
    min_log_odds: float = 1.5


@dataclass
class ToxicityModel:
    """Folded entries (" stem" or " word ") with weights, exception phrases, logistic weights."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    logistic: list[float] | None = None


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one space before the first and after the last."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {_NO_LETTERS.sub(' ', text.translate(_FOLD)).strip()} "


def terms_of(word: str) -> Iterator[str]:
    yield f" {word} "
    for n in STEM_LENGTHS:
        if n < len(word):
            yield f" {word[:n]}"


def _toxic_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, context) of toxic texts."""
    for batch in batches:
        found = set()
        for text in batch["text"]:
            words = fold(text).split()
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                context = hash_of(f"{before} {word} {after}")
                found.update((term, context) for term in terms_of(word))
        yield pd.DataFrame(list(found), columns=["term", "context"])


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class Matcher:
    """The automaton over one model."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (len(entry.rstrip()), len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(phrase, (0, len(phrase), 0.0))
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, tuple[int, float]]:
        """Word start to (matched length, weight) of its longest entry, without exceptions."""
        best: dict[int, tuple[int, float]] = {}
        excepted: list[tuple[int, int]] = []
        if self.ready:
            for end, (length, full, weight) in self.automaton.iter(folded):
                start = end - full + 1
                if not length:
                    excepted.append((start, end))
                elif start not in best or full > best[start][0]:
                    best[start] = (full, weight)
        for start, end in excepted:
            for word in [w for w in best if start <= w < end]:
                del best[word]
        return best

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + weights found), log(1 + 100 * weights found per word)."""
        folded = fold(text)
        total = sum(w for _, w in self.hits(folded).values())
        words = max(folded.count(" ") - 1, 1)
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str | None) -> float:
        logistic = self.model.logistic
        if logistic is None:
            return 0.0
        a, b = self.features(text)
        z = logistic[0] + logistic[1] * a + logistic[2] * b
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Two non-negative weights and an intercept by Newton steps on a bounded sample."""
    design = np.column_stack((np.ones(len(x)), x))
    used = [0, 1, 2]
    while True:
        w = np.zeros(3)
        d = design[:, used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(d @ w[used], -30, 30)))
            gradient = d.T @ (y - p) - ridge * w[used]
            hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(used))
            step = np.linalg.solve(hessian, gradient)
            w[used] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        negative = [i for i in used[1:] if w[i] < 0]
        if not negative:
            return w.tolist()
        used.remove(min(negative, key=lambda i: w[i]))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()
) -> ToxicityModel:
    """Fits a model on labelled documents: docs (doc_id, text), labels (doc_id, toxic)."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    short_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") >= 1).alias("toxic"))
    rows = known.count()
    if rows > config.max_training_rows:
        share = int(config.max_training_rows / rows * (1 << 30))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # One row per sampled label: bounded by the sample size.
    known = F.broadcast(known.withColumnRenamed("doc_id", "_label_id"))
    sample = stage(
        docs.join(known, docs["doc_id"] == F.col("_label_id")).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")),
        "toxicity-sample",
    )
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return ToxicityModel()

    support = (
        sample.where("toxic").select("text")
        .mapInPandas(_toxic_terms, "term string, context long")
        .distinct()
        .groupBy("term").agg(F.count("*").alias("contexts"))
        .where(F.col("contexts") >= config.min_contexts)
        .orderBy(F.desc("contexts"), "term")
        .limit(config.max_candidates)
    )
    candidates = {r["term"]: r["contexts"] for r in support.collect()}
    shared = spark.sparkContext.broadcast(set(candidates))

    def documents_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for batch in batches:
            counts: Counter = Counter()
            for text, is_toxic in zip(batch["text"], batch["toxic"]):
                words = set(fold(text).split())
                counts.update((t, bool(is_toxic)) for t in {t for w in words for t in terms_of(w)} & wanted)
            yield pd.DataFrame([(t, x, n) for (t, x), n in counts.items()], columns=["term", "toxic", "n"])

    found = (
        sample.select("toxic", "text").mapInPandas(documents_with, "term string, toxic boolean, n long")
        .groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect()
    )
    in_clean = {r["term"]: r["n"] for r in found if not r["toxic"]}
    # Copies of one document share their contexts: they support a term once.
    candidates = {r["term"]: min(r["n"], candidates[r["term"]]) for r in found if r["toxic"]}
    weights = choose_entries(candidates, in_clean, toxic, clean, config)
    model = ToxicityModel(weights)
    model.exceptions = _learn_exceptions(sample, model)
    matcher_state = vars(model)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(ToxicityModel(**matcher_state))
        for batch in batches:
            x = [matcher.features(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "a": [i for i, _ in x], "b": [i for _, i in x]})

    # Bounded by the sample size; equal feature rows are counted together.
    points = (
        sample.select("toxic", "text").mapInPandas(featured, "toxic boolean, a double, b double").toPandas()
    )
    model.logistic = _fit_logistic(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy(dtype=float))
    return model


def choose_entries(
    candidates: dict[str, int], in_clean: dict[str, int], toxic: int, clean: int, config: ToxicityConfig
) -> dict[str, float]:
    """Significant terms with their log odds; a longer one only where it says more."""
    chosen: dict[str, float] = {}
    scored = []
    for term, contexts in candidates.items():
        a, b = contexts + 0.5, in_clean.get(term, 0) + 0.5
        odds = math.log(a / (toxic - a + 1)) - math.log(b / (clean - b + 1))
        limit = odds - 1.96 * math.sqrt(1 / a + 1 / b)
        if limit >= config.min_log_odds:
            scored.append((len(term.rstrip()), term, odds))
    for length, term, odds in sorted(scored):
        shorter = [chosen.get(term[:n]) for n in range(2, length + 1)]
        if all(s is None or odds > s + 1 for s in shorter):
            chosen[term] = odds
    best = sorted(chosen, key=lambda t: (-candidates[t] * chosen[t], t))[: config.max_terms]
    return {t: chosen[t] for t in best}


def _learn_exceptions(sample: DataFrame, model: ToxicityModel, min_clean: int = 3, max_share: float = 0.2, most: int = 10_000) -> list[str]:
    """Two-word phrases around entries that are mostly met in clean documents."""
    state = vars(model)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(ToxicityModel(**state))
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                folded, found = fold(text), set()
                for start in matcher.hits(folded):
                    stop = folded.find(" ", start + 1)
                    before, after = folded.rfind(" ", 0, start), folded.find(" ", stop + 1)
                    if before >= 0:
                        found.add(folded[before : stop + 1])
                    if after >= 0:
                        found.add(folded[start : after + 1])
                counts.update((p, bool(toxic)) for p in found)
            yield pd.DataFrame([(p, t, n) for (p, t), n in counts.items()], columns=["phrase", "toxic", "n"])

    found = (
        sample.select("toxic", "text").mapInPandas(phrases, "phrase string, toxic boolean, n long")
        .groupBy("phrase")
        .agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("n"))
        .where((F.col("n") - F.col("bad") >= min_clean) & (F.col("bad") <= max_share * F.col("n")))
        .orderBy(F.desc("n"), "phrase")
        .limit(most)
    )
    return [r["phrase"] for r in found.collect()]


def toxicity_of(spark, model: ToxicityModel):
    """A column function: text to the score."""
    shared = spark.sparkContext.broadcast(vars(model))

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(ToxicityModel(**shared.value))
        for texts in batches:
            yield pd.Series([matcher.score(t) for t in texts], dtype="float64")

    return scores


def toxicity_digest(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = learn_toxicity(docs.where(~held_out), labels.where(~held_out), config)
    score = toxicity_of(docs.sparkSession, model)
    return docs.select("doc_id", held_out.alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )
