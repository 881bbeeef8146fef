"""The provided tables seen as page bundles, recogniser output, replies and job events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle.sources.dictionary import PATTERN_SCHEMA
from pagebundle.sources.pages import explode_pages

TRIAL_TYPES = ("", "Alpha", "Beta", "Gamma")
# idx, type, header, phrases, exclusions, weight, active
TRIAL_PATTERNS = (
    (0, "Alpha", "THING", ["that", "with"], ["zzz"], 1.0, True),
    (1, "Alpha", "THTION", ["from"], [], 1.2, True),
    (2, "Beta", "WHICH", ["this", "ther"], [], 1.0, True),
    (3, "Beta", "THEN", ["erin"], [], 0.8, True),
    (4, "Gamma", "THEA", ["tion", "ther", "that", "with", "from", "this", "erat"], ["thnt"],
     1.0, True),
    (5, "Omega", "THE", ["the"], [], 1.0, False),
    (6, "Void", "—", ["that"], [], 1.0, True),
    (7, "Alpha", "HERE1", ["Éa", "that", "that"], [], 0.9, True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread an input that is stored in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trial_dictionary(spark: SparkSession) -> DataFrame:
    names = [field.split()[0] for field in PATTERN_SCHEMA.split(", ")]
    rows = [dict(zip(names, ("trial", *p))) for p in TRIAL_PATTERNS]
    # through Arrow: a local relation, read without starting a job
    return spark.createDataFrame(pa.Table.from_pylist(rows), PATTERN_SCHEMA)


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").alias("bundle_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a bundle, every line a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return explode_pages(balanced(docs), "doc_id", "text", "\n")


def blanked(pages: DataFrame) -> DataFrame:
    """Scans without a text layer here and there (their text is the recogniser's job)."""
    lost = (F.col("bundle_id") * 7 + F.col("page_number")) % 5 == 0
    return pages.withColumn("text", F.when(lost, "").otherwise(F.col("text")))


def gray_histogram(pages: DataFrame) -> DataFrame:
    """Pixel counts per gray level: about half of the pages carry hardly any ink; pages
    whose number is a multiple of 11 could not be measured."""
    b, p = F.col("bundle_id"), F.col("page_number")
    dark = F.when((b + p) % 2 == 0, (p % 3) * 50).otherwise(900 + p)
    levels = F.array(
        *[
            F.struct(F.lit(level).alias("level"), pixels.cast("long").alias("pixels"))
            for level, pixels in ((40, dark), (200, p % 7), (230, F.lit(500)), (255, F.lit(99000)))
        ]
    )
    return pages.where(p % 11 != 0).select("bundle_id", "page_number", F.inline(levels))


def recogniser_output(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Text read from pages without a text layer; every third attempt failed."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    b, p = F.col("bundle_id"), F.col("page_number")
    return (
        pages.where("text = ''").select("bundle_id", "page_number", ((b + p) % n).alias("item_id"))
        .join(items.withColumnRenamed("text", "item_text"), "item_id")
        .select(
            "bundle_id", "page_number",
            F.when((b + p) % 3 == 0, "").otherwise(F.col("item_text")).alias("ocr_text"),
        )
    )


def responses(pages: DataFrame) -> DataFrame:
    """One model reply per page and possible current type; some malformed or mistyped."""
    types = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.lit(name).alias("current_type"))
            for i, name in enumerate(TRIAL_TYPES)
        ]
    )
    keyed = pages.select("bundle_id", "page_number", F.inline(types))
    b, p = F.col("bundle_id"), F.col("page_number")
    n = (b * 13 + p * 5 + F.col("t") * 7) % 120
    quoted = F.concat(F.lit('"'), F.col("proposed"), F.lit('"'))
    body = F.concat(
        F.lit('```json {"isFirstPage": '),
        F.when((b + p + F.col("t")) % 3 == 0, "false").otherwise("true"),
        F.lit(', "documentType": '), F.coalesce(quoted, F.lit("null")),
        F.lit(', "isKnownType": '), F.when(F.col("n") % 4 == 0, "true").otherwise("false"),
        F.lit(', "confidence": '),
        F.when(p % 2 == 0, (F.col("n") / 100).cast("string"))
        .otherwise(F.col("n").cast("string")),
        F.lit(', "reasonCodes": ["layout", "n'), F.col("n").cast("string"),
        F.lit('"], "suggestedNewPatterns": ["s1", "s2", "s3", "s4"]} ```'),
    )
    proposed = (
        F.when(F.col("n") % 6 == 0, None).when(F.col("n") % 6 == 1, "Alpha")
        .when(F.col("n") % 6 == 2, "Beta").when(F.col("n") % 6 == 3, "Gamma")
        .when(F.col("n") % 6 == 4, "Delta").otherwise(F.col("current_type"))
    )
    kind = F.col("n") % 17
    content = (
        F.when(kind == 0, "no answer")
        .when(kind == 3, F.concat(body, F.lit(" i jeszcze {x}")))
        .when(kind == 5, F.replace(body, F.lit('"'), F.lit("'")))
        .when(kind == 7, F.replace(body, F.lit('["layout"'), F.lit("[7")))
        .when(kind == 9, F.replace(body, F.lit('["s1", "s2", "s3", "s4"]'), F.lit("null")))
        .when(
            kind == 11,
            F.regexp_replace(body, r'"confidence": ([0-9.]+)', '"confidence": "$1"'),
        )
        .otherwise(body)
    )
    return (
        keyed.withColumn("n", n).withColumn("proposed", proposed)
        .withColumn("content", content)
        .select("bundle_id", "page_number", "current_type", "content")
    )


def job_events(spark: SparkSession, sf_dir: str, signup: str = "submit") -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("element_id"),
        F.when(kind == "signup", signup).when(kind == "view", "running")
        .when(kind == "purchase", "done").when(kind == "error", "failed")
        .otherwise("busy").alias("kind"),
        F.col("props").alias("error"),
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("page_count"))


def page_requests(counts: DataFrame) -> DataFrame:
    """One page-range request per bundle: plain, overlapping, reversed, out of bounds,
    garbage, padded, blank and with numbers of any length."""
    b, n = F.col("bundle_id"), F.col("page_count")
    text = lambda c: c.cast("string")
    spec = (
        F.when(b % 9 == 0, F.concat(F.lit("1-"), text(F.greatest(F.lit(1), F.floor(n / 2)))))
        .when(b % 9 == 1, F.concat(text(n), F.lit(", 1 ,,1-1")))
        .when(b % 9 == 2, F.concat(F.lit("1-"), text(n)))
        .when(b % 18 == 12, "99999999999999999999-9999999999999999")
        .when(b % 18 == 13, "1,00099999999999999999999999999999999999999999")
        .when(b % 9 == 3, "5-2")
        .when(b % 9 == 4, "2-x")
        .when(b % 9 == 5, F.concat(F.lit("1-"), text(n + 1_000_000)))
        .when(b % 9 == 6, "  ")
        .when(b % 9 == 7, F.concat(F.lit("+1,"), text(F.floor((n + 1) / 2)), F.lit("-"), text(n)))
        .otherwise("1,y,3-1")
    )
    return counts.select(
        F.concat(F.lit("r"), text(b)).alias("request_id"), "bundle_id", "page_count",
        spec.alias("spec"),
    )


def merge_members(counts: DataFrame) -> DataFrame:
    """Neighbouring bundles 2k+1 and 2k, in that order, form output k."""
    b = F.col("bundle_id")
    return counts.select(
        F.floor(b / 2).cast("long").alias("output_id"),
        F.when(b % 2 == 1, 1).otherwise(2).alias("member_order"),
        "bundle_id",
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attachment_id"),
        F.col("o_custkey").alias("element_id"),
        F.concat(F.lit("scan "), F.col("o_orderkey").cast("string")).alias("file_name"),
        F.when(pdf & (F.col("o_orderkey") % 2 == 0), ".PDF").when(pdf, "pdf")
        .otherwise("txt").alias("extension"),
    )


def raw_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of a tabular dictionary, with the untidiness such rows have."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("row_no"),
        F.when(k % 10 == 3, None).otherwise(F.concat(F.lit(" "), F.col("p_type")))
        .alias("DocumentType"),
        F.when(k % 7 == 2, "  ").otherwise(F.concat(F.col("p_name"), F.lit(" ")))
        .alias("Header"),
        F.when(k % 5 == 4, None)
        .otherwise(F.concat(F.col("p_brand"), F.lit("; ;"), F.col("p_name"), F.lit(" ;")))
        .alias("Phrases"),
        F.when(k % 3 == 0, F.col("p_brand")).otherwise("").alias("ExcludedPhrases"),
        F.when(k % 4 == 1, None).otherwise(F.col("p_size") / 10.0).alias("Weight"),
    )


def pattern_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON payloads; some malformed or without a required field."""
    k, q = F.col("p_partkey"), F.lit('"')
    name, kind = F.col("p_name"), F.col("p_type")
    full = F.concat(
        F.lit('[{"documentType": '), q, kind, q, F.lit(', "header": '), q, name, q,
        F.lit(', "phrases": ["a", "b"], "weight": '), F.col("p_size").cast("string"),
        F.lit('}, {"documentType": '), q, kind, q, F.lit(', "header": "x"}]'),
    )
    no_header = F.concat(F.lit('[{"documentType": '), q, kind, q, F.lit("}]"))
    payload = (
        F.when(k % 30 == 0, F.concat(full, F.lit(" x")))
        .when(k % 30 == 5, F.replace(full, q, F.lit("'")))
        .when(k % 30 == 6, F.replace(full, F.lit('["a", "b"]'), F.lit('"a"')))
        .when(k % 30 == 11, F.replace(full, F.lit('"phrases": ["a", "b"]'), F.lit('"phrases": null')))
        .when(k % 30 == 12, F.replace(full, F.lit('"header": "x"'), F.lit('"header": 7')))
        .when(k % 6 == 1, no_header).when(k % 6 == 2, "[{")
        .when(k % 6 == 3, "[]").when(k % 6 == 4, '{"header": "x"}').otherwise(full)
    )
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("payload_id"), payload.alias("payload")
    )
