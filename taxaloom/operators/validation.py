"""Validation of nested records against a closed schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """A property of a class: its type (string, integer, float, boolean or a tuple of allowed values), and what it must have."""

    kind: str | tuple[str, ...] = "string"
    required: bool = False
    many: bool = False


TYPE_NAMES = {"integer": ("BIGINT",), "float": ("DOUBLE", "BIGINT", "DECIMAL"), "boolean": ("BOOLEAN",), "string": ("STRING",)}


def _problem(severity: str, message: Column, path: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), message.alias("message"), path.alias("path"))


def _slot_problems(record: Column, name: str, slot: Slot) -> list[Column]:
    path = F.lit(f"/{name}")
    value = F.try_variant_get(record, f"$.{name}", "variant")
    kind = F.schema_of_variant(value)
    present = value.isNotNull() & (kind != "VOID")
    out = []
    if slot.required:
        out.append(F.when(~F.coalesce(present, F.lit(False)), _problem("ERROR", F.lit(f"'{name}' is a required property"), F.lit("/"))))
    if slot.many:
        out.append(F.when(present & ~F.startswith(kind, F.lit("ARRAY")), _problem("ERROR", F.lit(f"{name}: not a list"), path)))
        items = F.try_variant_get(record, f"$.{name}", "array<string>")
        if isinstance(slot.kind, tuple):
            wrong = F.filter(items, lambda x: ~x.isin(*slot.kind))
            out.append(F.when(F.size(wrong) > 0, _problem("ERROR", F.concat(F.lit(f"{name}: not among the allowed values: "), F.array_join(wrong, "; ")), path)))
        return out
    if isinstance(slot.kind, tuple):
        text = F.try_variant_get(record, f"$.{name}", "string")
        out.append(F.when(present & ~F.coalesce(text.isin(*slot.kind), F.lit(False)), _problem("ERROR", F.concat(F.lit(f"{name}: not among the allowed values: "), F.coalesce(text, kind)), path)))
    else:
        fits = F.lit(False)
        for t in TYPE_NAMES[slot.kind]:
            fits = fits | F.startswith(kind, F.lit(t))
        out.append(F.when(present & ~fits, _problem("ERROR", F.concat(F.lit(f"{name}: not of type {slot.kind}: "), kind), path)))
    return out


def problems(record: Column, schema: dict[str, Slot]) -> Column:
    """What is wrong with a JSON object (a string column), as array<struct<severity, message, path>>."""
    parsed = F.try_parse_json(record)
    keys = F.json_object_keys(record)
    unknown = F.filter(keys, lambda k: ~k.isin(*schema))
    extra = F.when(F.size(unknown) > 0, _problem("ERROR", F.concat(F.lit("additional properties are not allowed: "), F.array_join(F.array_sort(unknown), ", ")), F.lit("/")))
    found = [p for name, slot in schema.items() for p in _slot_problems(parsed, name, slot)]
    whole = F.filter(F.array(extra, *found), lambda x: x.isNotNull())
    return F.when(keys.isNull(), F.array(_problem("FATAL", F.lit("not an object"), F.lit("/")))).otherwise(whole)


def validate(rows: DataFrame, schema: dict[str, Slot], column: str = "record") -> DataFrame:
    """The rows with problems and valid."""
    return rows.withColumn("problems", problems(F.col(column), schema)).withColumn("valid", F.size("problems") == 0)


def exit_code(checked: DataFrame) -> int:
    """0: all valid, 1: some are not, 2: some are no records or there are none."""
    n, bad, fatal = checked.agg(F.count("*"), F.count_if(~F.col("valid")), F.count_if(F.exists("problems", lambda p: p["severity"] == "FATAL"))).first()
    return 2 if not n or fatal else 1 if bad else 0
