"""Strict reading of JSON texts: syntax as a standard parser wants it, values by their kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagebundle.functions.bind import bind


def parse_one(text: Column) -> Column:
    """The text as a variant; null unless it is exactly one JSON value.

    As the element of an array the value must end where the text ends: anything after
    it, or a second value, is an error or a second element.
    """

    def only(wrapped: Column) -> Column:
        alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
        return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))

    return bind(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), only)


def kind(value: Column) -> Column:
    """BOOLEAN, NUMBER, STRING, VOID (a JSON null), ARRAY<...> or OBJECT<...>; null if absent."""

    def named(name: Column) -> Column:
        number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
        return F.when(number, "NUMBER").otherwise(name)

    return bind(F.schema_of_variant(value), named)


def inspected(value: Column) -> Column:
    """A variant with its kind: what the readers below take (bind it, so that both are found once)."""
    return F.struct(value.alias("value"), kind(value).alias("kind"))


def fields(value: Column, names: tuple[str, ...]) -> Column:
    """The named fields of an object, inspected; all of them absent for any other value."""
    schema = ", ".join(f"{name}: variant" for name in names)
    return bind(
        F.try_variant_get(value, "$", f"struct<{schema}>"),
        lambda found: F.struct(*[inspected(found[name]).alias(name) for name in names]),
    )


def as_text(item: Column) -> Column:
    return F.when(item["kind"] == "STRING", F.try_variant_get(item["value"], "$", "string"))


def as_number(item: Column) -> Column:
    """Numbers, flags as 1 and 0, and texts that hold a number."""
    value = item["value"]
    of_text = F.trim(F.try_variant_get(value, "$", "string")).try_cast("double")
    return (
        F.when(item["kind"] == "NUMBER", F.try_variant_get(value, "$", "double"))
        .when(item["kind"] == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(item["kind"] == "STRING", of_text)
    )


def as_texts(item: Column) -> Column:
    """An array of texts, empty where the field is absent; null for anything else."""
    value = item["value"]
    none = F.array().cast("array<string>")
    items = F.try_variant_get(value, "$", "array<variant>")
    all_texts = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.when(value.isNull(), none).when(
        item["kind"].startswith("ARRAY") & all_texts, F.try_variant_get(value, "$", "array<string>")
    )


def is_blank(item: Column) -> Column:
    """Absent, null, false, zero, or an empty text, list or object."""
    value, name = item["value"], item["kind"]
    return (
        value.isNull()
        | name.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
        & F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) <= 0, F.lit(True))
        | F.coalesce(as_text(item) == "", F.lit(False))
        | F.coalesce(name.isin("NUMBER", "BOOLEAN") & (as_number(item) == 0), F.lit(False))
    )
