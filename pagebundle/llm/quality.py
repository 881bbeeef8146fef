"""Quality rules whose cutoffs are certified on labelled holdouts.

Each document gets counts over its whole text (``TEXT_STATS``). From these come the
metrics in ``METRICS``; a metric above its cutoff rejects the document. Cutoffs are
learned per stratum (language) from labelled rows, split by a hash of the id:

* the tuning third proposes a ladder of rule sets, each as strict as the one before or
  stricter: per metric the best cutoff (a quantile of the metric, by the margin of bad over
  good rejections) among those that reject no good tuning document, added metric by metric,
  the best first; then all metrics with growing shares of good documents allowed;
* the other two thirds certify them. A rule set holds if the exact binomial test rejects
  "its false rejections of good documents reach ``max_false_rejection``", that is if
  P(Bin(n, alpha) <= k) <= level, with n good holdout documents of which any rule of the
  set would reject k. This is the same as an exact upper confidence bound below alpha.

Rule sets are tested from the mildest on and testing stops at the first failure
(fixed-sequence testing, no correction needed inside a sequence); the level is
``delta / strata`` (Bonferroni). A set is judged as a whole, so alpha is not split over
its metrics: the rules of a stratum reject at most ``max_false_rejection`` of its good
documents, for all strata at once with confidence ``1 - delta``. Among certified sets the
one with the best margin of bad over good rejections on the tuning rows is taken, ties to
the milder set. A stratum with too few labelled documents certifies nothing and rejects
nothing beyond the base rules: without false rejections n must reach
log(delta / strata) / log(1 - alpha), that is 144 for four strata.

Defined cases: a null or empty text has no words, all counts are zero and the base rule
fails it. A null language is a stratum of its own. Repeated rows are judged one by one
and alike. If labels repeat an id, one bad label makes it bad; null labels and ids
without document are ignored. Empty labels certify nothing. Other columns are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagebundle.llm.common import WORDS, crc_bucket, fresh, short_batches, stage

_COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper_words", "n_bangs",
)
TEXT_STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in _COUNTS])

#: Higher is worse; the sign turns a lower bound into an upper one.
METRICS = (
    "symbols_per_word", "repeat_share", "dup_line_share", "upper_share",
    "bangs_per_word", "long_words", "short_words",
)


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_false_rejection: float = 0.03
    delta: float = 0.05
    #: candidate cutoffs per metric and stratum
    grid: int = 40


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of ``TEXT_STATS`` for one whole text."""
    if not text:
        return (0,) * len(_COUNTS)
    words = WORDS.findall(text)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
            lines += 1
        elif WORDS.search(line):
            seen.add(line)
            lines += 1
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        covered = -1  # last word position already counted
        for i, window in enumerate(windows):
            if window in often:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, "#*$%&|<>")),
        dups,
        repeated,
        lines,
        sum(map(str.isupper, words)),
        text.count("!"),
    )


@F.pandas_udf(TEXT_STATS)
def text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=list(_COUNTS), dtype="int64")


def base_failed(stats: Column, config: QualityConfig = QualityConfig()) -> Column:
    return (stats["n_words"] < config.min_words) | (
        100 * stats["n_repeat_words"] > config.max_repeat_percent * stats["n_words"]
    )


def metrics(stats: Column) -> Column:
    """An array of doubles in the order of ``METRICS``."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    lines = F.greatest(stats["n_lines"], F.lit(1)).cast("double")
    mean = stats["word_chars"] / words
    return F.array(
        stats["n_symbols"] / words,
        stats["n_repeat_words"] / words,
        stats["n_dup_lines"] / lines,
        stats["n_upper_words"] / words,
        stats["n_bangs"] / words,
        mean,
        -mean,
    )


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 1.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, i = 0.0, k
    while i >= 0 and term > 0:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
        if term < total * 1e-17 and i < n * p:
            break
    return min(1.0, total)


def choose_cutoff(
    cutoffs: list[float], good_tune: list[int], bad_tune: list[int], good_hold: list[int],
    n_good_tune: int, n_bad_tune: int, n_good_hold: int, alpha: float, level: float,
) -> float | None:
    """The certified cutoff of one sequence; the lists count rows above each cutoff."""
    best: tuple[float, float] | None = None
    for i in sorted(range(len(cutoffs)), key=lambda j: -cutoffs[j]):
        if n_good_hold == 0 or binomial_tail(n_good_hold, good_hold[i], alpha) > level:
            break
        margin = bad_tune[i] / max(n_bad_tune, 1) - good_tune[i] / max(n_good_tune, 1)
        if margin > 0 and (best is None or margin > best[0]):
            best = (margin, cutoffs[i])
    return None if best is None else best[1]


#: Shares of good tuning documents that one metric of a rule set may reject.
_ALLOWED = (0.0, 0.0025, 0.005, 0.01, 0.015, 0.02, 0.03)


def propose_ladder(grids: list[list[float]], good: list[list[int]], bad: list[list[int]], n_good: int, n_bad: int) -> list[list[float]]:
    """Rule sets from mild to strict: a cutoff per metric, infinite where there is no rule.

    ``good[m][i]`` and ``bad[m][i]`` count the tuning rows above cutoff ``grids[m][i]``.
    """

    def best(m: int, allowed: float) -> tuple[float, float]:
        """Margin and cutoff. More allowed rejections add lower cutoffs only, so sets are nested."""
        found = (0.0, math.inf)
        for i in sorted(range(len(grids[m])), key=lambda j: -grids[m][j]):
            if good[m][i] <= allowed * n_good:
                margin = bad[m][i] / max(n_bad, 1) - good[m][i] / max(n_good, 1)
                found = max(found, (margin, grids[m][i]), key=lambda x: x[0])
        return found

    first = [best(m, _ALLOWED[0]) for m in range(len(grids))]
    ladder, now = [], [math.inf] * len(grids)
    for m in sorted(range(len(grids)), key=lambda j: -first[j][0]):
        now[m] = first[m][1]
        ladder.append(list(now))
    ladder += [[best(m, allowed)[1] for m in range(len(grids))] for allowed in _ALLOWED[1:]]
    return [s for i, s in enumerate(ladder) if min(s) < math.inf and (i == 0 or s != ladder[i - 1])]


def learn_cutoffs(labelled: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per stratum: ``cutoffs`` array<double> in the order of METRICS (null: no rule).

    ``labelled``: stratum string, metrics array<double>, good boolean, tuning boolean, one
    row per labelled document; read several times, so pass a table. All counting is
    aggregated in Spark; only strata * metrics * grid rows meet the test.
    """
    steps = [i / config.grid for i in range(config.grid + 1)]

    def candidates(i: int) -> Column:
        value = F.col("metrics")[i]
        both = [F.percentile_approx(F.when(g, value), steps, 10_000) for g in (F.col("good"), ~F.col("good"))]
        none = F.array().cast("array<double>")
        return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(q, none) for q in both])))

    grids = stage(
        labelled.where("tuning")
        .groupBy("stratum")
        .agg(F.array(*[candidates(i) for i in range(len(METRICS))]).alias("grids")),
        "quality-grids",
    )
    strata = max(grids.count(), 1)
    per_value = labelled.where("tuning").join(grids, "stratum").select(
        "stratum", "good", F.posexplode(F.arrays_zip("metrics", "grids")).alias("metric", "m")
    )
    counts = per_value.groupBy(
        "stratum", "metric", "good", F.size(F.filter("m.grids", lambda c: c < F.col("m.metrics"))).alias("above")
    ).agg(F.count("*").alias("n"))

    @F.pandas_udf("array<array<double>>")
    def proposed(grids: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_proposed([list(g) for g in gs], c) for gs, c in zip(grids, counts)], dtype="object")

    ladders = (
        counts.groupBy("stratum")
        .agg(F.collect_list(F.struct("metric", "good", "above", "n")).alias("counts"))
        .join(grids, "stratum")
        .select("stratum", proposed("grids", "counts").alias("ladder"))
    )
    ladders = stage(ladders, "quality-ladders")

    def spares(rules: Column) -> Column:
        return ~F.exists(F.zip_with("metrics", rules, lambda value, cutoff: value > cutoff), lambda over: over)

    # Sets are nested: those that spare a row are the first ones.
    spared = (
        labelled.join(ladders, "stratum")
        .groupBy("stratum", "good", "tuning", F.size(F.filter("ladder", spares)).alias("spared"))
        .agg(F.count("*").alias("n"))
        .groupBy("stratum")
        .agg(F.collect_list(F.struct("good", "tuning", "spared", "n")).alias("counts"))
    )
    alpha, level = config.max_false_rejection, config.delta / strata

    @F.pandas_udf(T.IntegerType())
    def chosen(size: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_chosen(int(n), c, alpha, level) for n, c in zip(size, counts)], dtype="int32")

    no_rule = F.lit(None).cast("double")
    return (
        spared.join(ladders, "stratum")
        .select("stratum", "ladder", chosen(F.size("ladder"), F.col("counts")).alias("at"))
        .select(
            "stratum",
            F.when(
                F.col("at") >= 0,
                F.transform(F.get("ladder", F.col("at")), lambda c: F.when(c < float("inf"), c)),
            ).otherwise(F.array(*[no_rule] * len(METRICS))).alias("cutoffs"),
        )
    )


def _proposed(grids: list[list[float]], counts) -> list[list[float]]:
    """Turns counts per bucket (how many candidates lie below the value) into counts above each."""
    over = {g: [[0] * (len(grid) + 1) for grid in grids] for g in (True, False)}
    for c in counts:
        over[bool(c["good"])][c["metric"]][c["above"]] += c["n"]
    above = {g: [[sum(v[i + 1 :]) for i in range(len(v) - 1)] for v in over[g]] for g in over}
    return propose_ladder(grids, above[True], above[False], sum(over[True][0]), sum(over[False][0]))


def _chosen(sets: int, counts, alpha: float, level: float) -> int:
    """The certified rule set of a ladder, -1 if there is none; counts say how many sets spare a row."""
    over = {(g, t): [0] * (sets + 1) for g in (True, False) for t in (True, False)}
    for c in counts:
        over[bool(c["good"]), bool(c["tuning"])][c["spared"]] += c["n"]
    total = {key: sum(v) for key, v in over.items()}
    rejected = {key: [sum(v[: i + 1]) for i in range(sets)] for key, v in over.items()}
    # Milder sets have the higher strictness rank, as the higher of two cutoffs has.
    best = choose_cutoff(
        [-i for i in range(sets)], rejected[True, True], rejected[False, True], rejected[True, False],
        total[True, True], total[False, True], total[True, False], alpha, level,
    )
    return -1 if best is None else int(-best)


def labelled_metrics(docs: DataFrame, stats: str, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The learning table: labelled documents with their metrics, staged without texts."""
    quality = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg((F.min("quality") >= 1).alias("good"))
    )
    judged = docs.where(~base_failed(F.col(stats))).select(
        F.col("doc_id").alias("_label_id"), _stratum(stratum).alias("stratum"), metrics(F.col(stats)).alias("metrics")
    )
    return stage(
        judged.join(quality, "_label_id").select(
            "stratum", "metrics", "good", (crc_bucket(F.col("_label_id"), 3) == 0).alias("tuning")
        ),
        "quality-labelled",
    )


def _stratum(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def judge(
    docs: DataFrame, stats: str, cutoffs: DataFrame, stratum: str = "lang", base: str = "base_failed", verdict: str = "kept"
) -> DataFrame:
    """``docs`` with the columns ``base`` and ``verdict``; ``stats`` names the TEXT_STATS column."""
    key, found = fresh(docs, "_stratum"), fresh(docs, "_cutoffs")
    rules = stage(cutoffs.select(F.col("stratum").alias(key), F.col("cutoffs").alias(found)), "quality-cutoffs")
    rejected = F.exists(
        F.zip_with(metrics(F.col(stats)), F.col(found), lambda value, cutoff: value > cutoff),
        lambda over: F.coalesce(over, F.lit(False)),
    )
    failed = base_failed(F.col(stats))
    return (
        docs.withColumn(key, _stratum(stratum))
        .join(rules, key, "left")
        .withColumn(base, failed)
        .withColumn(verdict, ~failed & ~F.coalesce(rejected, F.lit(False)))
        .drop(key, found)
    )


def _counted(docs: DataFrame) -> DataFrame:
    """A table of the counts without texts: (doc_id, lang, s)."""
    short_batches(docs.sparkSession)
    return stage(docs.select("doc_id", "lang", text_stats("text").alias("s")), "quality-stats")


def quality_digest(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id with the counts and the verdict, one row per row of ``docs``."""
    stats = _counted(docs)
    judged = judge(stats, "s", learn_cutoffs(labelled_metrics(stats, "s", labels), config))
    return judged.select("doc_id", *[f"s.{c}" for c in _COUNTS[:5]], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    The texts are counted twice, once to learn and once to judge, so that none of them
    has to be shuffled or staged.
    """
    stats = fresh(docs, "_stats")
    cutoffs = learn_cutoffs(labelled_metrics(_counted(docs), "s", labels), config)
    base, verdict = fresh(docs, "base_failed"), fresh(docs, "kept")
    judged = judge(docs.withColumn(stats, text_stats("text")), stats, cutoffs, base=base, verdict=verdict)
    return judged.where(F.col(verdict)).select(*[F.col(f"`{c}`") for c in docs.columns])
