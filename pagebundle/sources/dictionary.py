"""Pattern dictionaries: tabular, relational and JSON sources, and their preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagebundle import fixed
from pagebundle.functions import json as js
from pagebundle.functions import text
from pagebundle.functions.bind import bind
from pagebundle.staging import stage

PATTERN_SCHEMA = (
    "dict_id string, pattern_idx int, document_type string, header string, "
    "phrases array<string>, excluded_phrases array<string>, weight double, "
    "active boolean"
)
_PREPARED_STRUCT = (
    "struct<pattern_idx:int,document_type:string,header:string,header_fold:string,"
    "phrases:array<struct<text:string,norm:string>>,excluded:array<string>,"
    "weight:double>"
)
_PAYLOAD_FIELDS = ("documentType", "header", "phrases", "excludedPhrases", "weight")


def split_phrase_list(col: Column) -> Column:
    items = F.transform(F.split(col, ";"), text.strip)
    return F.coalesce(
        F.filter(items, lambda s: s != ""), F.array().cast("array<string>")
    )


def read_dictionary(
    rows: DataFrame, order_by: str, dict_id: Column | None = None
) -> DataFrame:
    """Tabular dictionary -> patterns; ``order_by`` is the explicit row order (an int)."""
    missing = [c for c in fixed.DICTIONARY_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(
            f"missing required columns: {', '.join(missing)}. "
            f"Expected columns: {', '.join(fixed.DICTIONARY_COLUMNS)}."
        )
    header = text.strip(F.col("Header"))
    return rows.where(header != "").select(
        (dict_id if dict_id is not None else F.lit("default")).alias("dict_id"),
        F.col(order_by).cast("int").alias("pattern_idx"),
        F.coalesce(text.strip(F.col("DocumentType")), F.lit("")).alias("document_type"),
        header.alias("header"),
        split_phrase_list(F.col("Phrases")).alias("phrases"),
        split_phrase_list(F.col("ExcludedPhrases")).alias("excluded_phrases"),
        F.coalesce(F.col("Weight").cast("double"), F.lit(1.0)).alias("weight"),
        F.lit(True).alias("active"),
    )


def dictionary_join(types: DataFrame, rows: DataFrame, type_form: str) -> DataFrame:
    """Detail rows of the live document types of one form.

    types: type_id, type_name, form, deleted, active; rows: type_id, ..., active.
    """
    live = types.where(
        (F.col("form") == type_form) & ~F.col("deleted") & F.col("active")
    ).select("type_id", "type_name")
    return rows.where("active").drop("active").join(live, "type_id", "inner")


def _payload_item(item: Column) -> Column:
    """The fields of one item; null where a field is missing or of the wrong kind."""

    def read(r: Column) -> Column:
        weight = r["weight"]
        return F.struct(
            js.as_text(r["documentType"]).alias("documentType"),
            js.as_text(r["header"]).alias("header"),
            js.as_texts(r["phrases"]).alias("phrases"),
            js.as_texts(r["excludedPhrases"]).alias("excludedPhrases"),
            F.when(weight["value"].isNull(), F.lit(1.0)).otherwise(js.as_number(weight)).alias("weight"),
        )

    return bind(js.fields(item, _PAYLOAD_FIELDS), read)


def parse_patterns(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payload_id, payload) -> (patterns, rejected payloads with an error).

    A payload is one unit: anything but one JSON array, or one item with a field missing
    or of the wrong kind, rejects all of it.
    """

    def read(whole: Column) -> Column:
        listed = whole["kind"].startswith("ARRAY")
        items = F.when(listed, F.try_variant_get(whole["value"], "$", "array<variant>"))
        return F.transform(items, _payload_item)

    items = bind(js.parse_one(F.col("payload")), lambda whole: bind(js.inspected(whole), read))
    # Generated, not projected: no condition on the items makes Spark parse a payload again.
    parsed = payloads.select("*", F.explode(F.array(items)).alias("items"))

    def acceptable(item: Column) -> Column:
        return F.forall(
            F.array(*[item[name].isNotNull() for name in _PAYLOAD_FIELDS]), lambda present: present
        )

    valid = F.coalesce(F.col("items").isNotNull() & F.forall("items", acceptable), F.lit(False))
    checked = parsed.withColumn("valid", valid)
    patterns = (
        checked.where("valid")
        .select("payload_id", F.posexplode("items").alias("pattern_idx", "item"))
        .select(
            F.col("payload_id").alias("dict_id"),
            "pattern_idx",
            F.col("item.documentType").alias("document_type"),
            F.col("item.header").alias("header"),
            F.col("item.phrases").alias("phrases"),
            F.col("item.excludedPhrases").alias("excluded_phrases"),
            F.col("item.weight").alias("weight"),
            F.lit(True).alias("active"),
        )
    )
    rejected = checked.where("not valid").select(
        "payload_id", F.lit(fixed.PATTERNS_ERROR).alias("error")
    )
    return patterns, rejected


def empty_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PATTERN_SCHEMA)


def active_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where("active")


def known_types(patterns: DataFrame) -> DataFrame:
    """Distinct active types per dictionary (headerless patterns count too)."""
    return active_patterns(patterns).select("dict_id", "document_type").distinct()


def with_known_types(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` + known_types, the sorted active types of their dictionary.

    Rows without dict_id use all types given. The types are one row per dictionary and
    join by its id, whatever their number.
    """
    single = "dict_id" not in rows.columns
    if single:
        rows, patterns = (d.withColumn("dict_id", F.lit("default")) for d in (rows, patterns))
    # Written first: its size tells Spark how to join it without moving the rows.
    types = stage(
        known_types(patterns).groupBy("dict_id").agg(
            F.sort_array(F.collect_list("document_type")).alias("known_types")
        ),
        "known_types",
    )
    joined = rows.join(types, "dict_id", "left").withColumn(
        "known_types", F.coalesce("known_types", F.array().cast("array<string>"))
    )
    return joined.drop("dict_id") if single else joined


def normalized_patterns(patterns: DataFrame) -> DataFrame:
    """Active patterns with every matching form computed once; headerless ones drop."""
    norm_all = lambda col: F.transform(col, text.normalize_text)
    header_fold = text.fold_ocr_digits(text.normalize_text(F.col("header")))
    return (
        active_patterns(patterns)
        .withColumn("header_fold", header_fold)
        .where("header_fold <> ''")
        .select(
            "dict_id",
            "pattern_idx",
            "document_type",
            "header",
            "header_fold",
            F.arrays_zip(
                F.col("phrases").alias("text"), norm_all("phrases").alias("norm")
            ).cast("array<struct<text:string,norm:string>>").alias("phrases"),
            norm_all("excluded_phrases").alias("excluded"),
            "weight",
        )
    )


def prepared_item() -> Column:
    return F.struct(
        "pattern_idx", "document_type", "header", "header_fold", "phrases",
        "excluded", "weight",
    )


def _in_order() -> Column:
    return F.array_sort(F.collect_list(prepared_item())).alias("patterns")


def whole_dictionary(patterns: DataFrame) -> DataFrame:
    """dict_id, patterns (dictionary order); only for dictionaries of checked size."""
    return normalized_patterns(patterns).groupBy("dict_id").agg(_in_order())


def chunked_dictionary(patterns: DataFrame, rows_per_chunk: int) -> DataFrame:
    """dict_id, chunk, patterns: bounded arrays in dictionary order."""
    return (
        normalized_patterns(patterns)
        .withColumn("chunk", F.floor(F.col("pattern_idx") / rows_per_chunk))
        .groupBy("dict_id", "chunk")
        .agg(_in_order())
    )


def within_embedding_bounds(patterns: DataFrame, max_rows: int, max_chars: int) -> bool:
    """Size check before a dictionary is embedded in a plan or broadcast."""
    chars = F.length("header") + F.length(F.concat_ws("", "phrases", "excluded_phrases"))
    sizes = patterns.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")
    ).first()
    return sizes["n"] <= max_rows and sizes["chars"] <= max_chars
