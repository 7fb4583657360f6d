"""Schemas of classes compiled to one expression that finds every problem of a nested record, each with its path."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import let

PROBLEM = "array<struct<severity:string,message:string,instantiates:string,path:string>>"
#: Kinds of values that a type takes; other types are strings.
NUMBERS = ("bigint", "decimal", "double", "float")
TYPES = {"integer": ("bigint",), "float": NUMBERS, "double": NUMBERS, "decimal": NUMBERS, "boolean": ("boolean",)}
PATTERNS = {"date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "datetime": "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}"}


class SchemaError(ValueError):
    """A schema, or a class asked for, that cannot be used: not a problem of a record."""


@dataclass(frozen=True)
class Slot:
    name: str
    range: str
    required: bool = False
    many: bool = False
    inlined: bool = False
    pattern: str | None = None
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Schema:
    """Classes with all their slots, inherited ones included, and enumerations with their values."""

    classes: dict[str, tuple[Slot, ...]]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def slots(self, name: str) -> tuple[Slot, ...]:
        if name not in self.classes:
            raise SchemaError(f"no class {name}")
        return self.classes[name]


def _listed(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def parse(spec: dict[str, Any]) -> Schema:
    """A schema from its parts: classes (is_a, mixins, slots, slot_usage, attributes), slots, enums, default_range.

    A class has the slots of the class it is one of, of its mixins, and its own, in this
    order; what slot_usage says of a slot goes before the slot's definition, and what a
    class says before what its ancestors say.
    """
    classes, slots, enums = (spec.get(k) or {} for k in ("classes", "slots", "enums"))

    def lineage(name: str, path: tuple[str, ...] = ()) -> list[str]:
        if name not in classes:
            raise SchemaError(f"no class {name}")
        if name in path:
            raise SchemaError(f"class {name} inherits from itself")
        of = classes[name] or {}
        above = [*_listed(of.get("is_a")), *_listed(of.get("mixins"))]
        return list(dict.fromkeys([n for a in above for n in lineage(a, (*path, name))] + [name]))

    def identified(name: str) -> bool:
        return any(definition(name, s).get("identifier") for s in names(name))

    def names(name: str) -> list[str]:
        return list(dict.fromkeys(s for c in lineage(name) for s in [*_listed((classes[c] or {}).get("slots")), *((classes[c] or {}).get("attributes") or {})]))

    def definition(name: str, slot: str) -> dict[str, Any]:
        out = dict(slots.get(slot) or {})
        for c in lineage(name):
            out |= ((classes[c] or {}).get("attributes") or {}).get(slot) or {}
        for c in lineage(name):
            out |= ((classes[c] or {}).get("slot_usage") or {}).get(slot) or {}
        return out

    def made(name: str, slot: str) -> Slot:
        d = definition(name, slot)
        kind = d.get("range") or spec.get("default_range") or "string"
        inlined = kind in classes and bool(d.get("inlined") or d.get("inlined_as_list") or not identified(kind))
        required = bool(d.get("required") or d.get("identifier"))
        return Slot(slot, kind, required, bool(d.get("multivalued")), inlined, d.get("pattern"), d.get("minimum_value"), d.get("maximum_value"))

    values = {name: tuple(map(str, (e or {}).get("permissible_values") or ())) for name, e in enums.items()}
    return Schema({name: tuple(made(name, s) for s in names(name)) for name in classes}, values)


@lru_cache(maxsize=8)
def load(path: str) -> Schema:
    """The schema in a YAML or JSON file; the last few stay in memory."""
    if not Path(path).is_file():
        raise SchemaError(f"no schema at {path}")
    text = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        return parse(json.loads(text))
    import yaml

    return parse(yaml.safe_load(text))


def _kind(value: Column) -> Column:
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _shown(value: Column) -> Column:
    """A value as it may stand in a message."""
    return F.coalesce(F.substring(F.try_variant_get(value, "$", "string"), 1, 80), _kind(value))


def _problem(of: str, message: Column | str, path: Column, severity: str = "ERROR") -> Column:
    return F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(of).alias("instantiates"), F.when(path == "", "/").otherwise(path).alias("path"))


def _one(problem: Column, when: Column) -> Column:
    return F.when(when, F.array(problem)).otherwise(F.array().cast(PROBLEM))


def _scalar(schema: Schema, of: str, slot: Slot, x: Column, path: Column) -> Column:
    if slot.range in schema.enums:
        fits = (_kind(x) == "string") & F.coalesce(F.try_variant_get(x, "$", "string").isin(*schema.enums[slot.range]), F.lit(False))
        return _one(_problem(of, F.concat(F.lit("'"), _shown(x), F.lit(f"' is not one of {slot.range}")), path), ~fits)
    fits = _kind(x).isin(*TYPES.get(slot.range, ("string",)))
    kind = slot.range if slot.range in TYPES else "string"
    found = [_one(_problem(of, F.concat(F.lit("'"), _shown(x), F.lit(f"' is not of type {kind}")), path), ~fits)]
    text, number = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
    for pattern in filter(None, (slot.pattern, PATTERNS.get(slot.range))):
        found.append(_one(_problem(of, F.concat(F.lit("'"), _shown(x), F.lit(f"' does not match {pattern}")), path), fits & ~text.rlike(pattern)))
    for bound, wrong, word in ((slot.least, number < F.lit(slot.least), "less"), (slot.most, number > F.lit(slot.most), "more")):
        if bound is not None:
            found.append(_one(_problem(of, F.concat(F.lit("'"), _shown(x), F.lit(f"' is {word} than {bound:g}")), path), fits & wrong))
    return F.concat(*found)


def _value(schema: Schema, of: str, slot: Slot, x: Column, path: Column, within: tuple[str, ...]) -> Column:
    return _object(schema, slot.range, x, path, within) if slot.inlined else _scalar(schema, of, slot, x, path)


def _object(schema: Schema, of: str, record: Column, path: Column, within: tuple[str, ...] = ()) -> Column:
    if of in within:
        raise SchemaError(f"class {of} nests in itself")
    slots, inner = schema.slots(of), (*within, of)

    def checked(slot: Slot) -> Column:
        here = F.concat(path, F.lit(f"/{slot.name}"))

        def present(x: Column) -> Column:
            if not slot.many:
                return _value(schema, of, slot, x, here, inner)
            members = lambda xs: F.flatten(F.transform(xs, lambda y, i: _value(schema, of, slot, y, F.concat(here, F.lit("/"), i.cast("string")), inner)))
            return let(F.try_variant_get(x, "$", "array<variant>"), lambda xs: F.when(xs.isNull(), F.array(_problem(of, F.concat(F.lit("'"), _shown(x), F.lit("' is no list")), here))).otherwise(members(xs)))

        absent = F.array(_problem(of, f"'{slot.name}' is required", path)) if slot.required else F.array().cast(PROBLEM)
        value = F.try_variant_get(record, f"$['{slot.name}']", "variant")
        return let(value, lambda x: F.when(x.isNull() | F.is_variant_null(x), absent).otherwise(present(x)))

    def keys(xs: Column) -> Column:
        unknown = F.array_sort(F.array_except(F.map_keys(xs), F.array(*[F.lit(s.name) for s in slots])))
        extra = let(unknown, lambda u: _one(_problem(of, F.concat(F.lit("properties that the class does not have: "), F.array_join(u, ", ")), path), F.size(u) > 0))
        return F.concat(extra, *map(checked, slots))

    no_object = F.array(_problem(of, F.concat(F.lit("'"), _shown(record), F.lit("' is no object")), path))
    return let(F.try_variant_get(record, "$", "map<string,variant>"), lambda xs: F.when(xs.isNull(), no_object).otherwise(keys(xs)))


def problems(record: Column, schema: Schema, target: str) -> Column:
    """All problems of a JSON object (a string column) as an instance of a class: severity, message, instantiates, path.

    One expression, whatever the nesting; a value's path is that of a JSON pointer. What
    is no object is FATAL. Null stands for an absent value.
    """
    schema.slots(target)
    fatal = F.array(_problem(target, "no object", F.lit(""), "FATAL"))
    whole = lambda v: F.when(F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), _object(schema, target, v, F.lit(""))).otherwise(fatal)
    return let(F.try_parse_json(record), whole)


def validate(rows: DataFrame, schema: Schema, target: str, column: str = "record") -> DataFrame:
    """The rows with problems and valid (see validation.exit_code)."""
    return rows.withColumn("problems", problems(F.col(column), schema, target)).withColumn("valid", F.size("problems") == 0)
