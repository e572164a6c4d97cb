"""Contracts on rows: a JSON schema becomes one column expression, which gives the path and the reason of each fault of a JSON text.

Known: $ref into the schema itself (not to what contains it), type, enum, const, required, properties, additionalProperties, items, minItems, maxItems,
minLength, maxLength, pattern, minimum, maximum, anyOf, oneOf, allOf, not. Other words say nothing. The text is parsed once, as a variant; a value,
its type, fields and items are worked out once and then named (`_with`), since an expression that is used twice is otherwise worked out twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import buckets

C = F.col
FAULTS = "array<struct<path:string,reason:string>>"
#: How the types of a schema begin in the description of a variant.
TYPES = {"object": r"^OBJECT<", "array": r"^ARRAY<", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "null": r"^VOID$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL\(|DOUBLE|FLOAT)"}


def _pointed(root: dict, ref: str) -> dict:
    if not ref.startswith("#"):
        raise ValueError(f"only references into the schema itself are known, not {ref!r}")
    found: Any = root
    for step in filter(None, ref[1:].split("/")):
        found = found[step.replace("~1", "/").replace("~0", "~")]
    return found


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """What `then` makes of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def _as(self, value: Column, kind: str) -> Column:
        return F.try_variant_get(value, "$", kind)

    def _when(self, wrong: Column, path: Column, reason: str) -> Column:
        return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))).otherwise(F.array().cast(FAULTS))

    def faults(self, schema: Any, value: Column, path: Column, within: tuple[str, ...] = ()) -> Column:
        """The faults of a value that is there."""
        if schema is True or schema == {}:
            return F.array().cast(FAULTS)
        if schema is False:
            return self._when(F.lit(True), path, "not allowed")
        known = F.struct(
            value.alias("value"), F.schema_of_variant(value).alias("kind"), self._as(value, "map<string,variant>").alias("fields"), self._as(value, "array<variant>").alias("items")
        )
        return _with(known, lambda x: self._faults(schema, x["value"], x["kind"], x["fields"], x["items"], path, within))

    def _faults(self, schema: dict, value: Column, kind: Column, fields: Column, items: Column, path: Column, within: tuple[str, ...]) -> Column:
        found = []
        if (ref := schema.get("$ref")) is not None:
            if ref in within:
                raise ValueError(f"{ref} contains itself")
            found.append(self.faults(_pointed(self.root, ref), value, path, (*within, ref)))
        is_ = lambda name: kind.rlike(TYPES[name])
        if (types := schema.get("type")) is not None:
            types = [types] if isinstance(types, str) else types
            found.append(self._when(~reduce(lambda a, b: a | b, map(is_, types)), path, f"not of type {' or '.join(types)}"))
        for word, options in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if options is not None:
                texts = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in options]
                found.append(self._when(~F.to_json(value).isin(*texts), path, f"{word} differs"))
        text, number = self._as(value, "string"), self._as(value, "double")
        tests = [
            ("pattern", "string", lambda x: ~text.rlike(x)), ("minLength", "string", lambda x: F.length(text) < x), ("maxLength", "string", lambda x: F.length(text) > x),
            ("minimum", "number", lambda x: number < x), ("maximum", "number", lambda x: number > x),
            ("minItems", "array", lambda x: F.size(items) < x), ("maxItems", "array", lambda x: F.size(items) > x),
        ]
        found += [self._when(is_(of) & wrong(schema[word]), path, word) for word, of, wrong in tests if word in schema]
        on_object = lambda faults: F.when(is_("object"), faults).otherwise(F.array().cast(FAULTS))
        at = lambda name: F.concat(path, F.lit(f".{name}"))
        for name in schema.get("required", ()):
            found.append(on_object(self._when(~F.map_contains_key(fields, name), at(name), "required")))
        properties = schema.get("properties", {})
        for name, inner in properties.items():
            own = self.faults(inner, F.try_element_at(fields, F.lit(name)), at(name), within)
            found.append(on_object(F.when(F.map_contains_key(fields, name), own).otherwise(F.array().cast(FAULTS))))
        if schema.get("additionalProperties", True) is not True:
            more = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*properties) if properties else F.lit(True))
            each = F.transform(more, lambda e: self.faults(schema["additionalProperties"], e["value"], F.concat(path, F.lit("."), e["key"]), within))
            found.append(on_object(F.flatten(each)))
        if "items" in schema:
            each = F.transform(items, lambda x, i: self.faults(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), within))
            found.append(F.when(is_("array"), F.flatten(each)).otherwise(F.array().cast(FAULTS)))
        fits = lambda inner: F.size(self.faults(inner, value, path, within)) == 0
        for word, wrong in (("anyOf", lambda n: n == 0), ("oneOf", lambda n: n != 1)):
            if word in schema:
                n = reduce(lambda a, b: a + b, [fits(x).cast("int") for x in schema[word]])
                found.append(self._when(wrong(n), path, word))
        found += [self.faults(x, value, path, within) for x in schema.get("allOf", ())]
        if "not" in schema:
            found.append(self._when(fits(schema["not"]), path, "not"))
        return F.flatten(F.array(*found)) if found else F.array().cast(FAULTS)


def faults(schema: dict, text: Column) -> Column:
    """The faults of a JSON text as an array of path ($ is the whole) and reason; a text that is no JSON has one."""
    value = F.try_parse_json(text)
    bad = F.array(F.struct(F.lit("$").alias("path"), F.lit("no JSON").alias("reason")))
    return _with(value, lambda v: F.when(v.isNull(), bad).otherwise(_Compiler(schema).faults(schema, v, F.lit("$"))))


def checked(rows: DataFrame, schema: dict, text: str = "json") -> DataFrame:
    """The rows' other columns, path and reason: a row for each fault. The rows are dealt out first, as one small file holds many."""
    others = [c for c in rows.columns if c != text]
    return rows.repartition(buckets(rows.sparkSession)).select(*others, F.explode(faults(schema, C(text))).alias("fault")).select(*others, "fault.path", "fault.reason")
