"""JSON and XML: kinds, paths with filters, changes, tables of rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_kind(s: Column) -> Column:
    """object, array, scalar, or null if the text isn't JSON."""
    kind = F.schema_of_variant(F.try_parse_json(s))
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(F.startswith(kind, F.lit("OBJECT")), "object").when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("scalar")


def json_unique_keys(s: Column) -> Column:
    """Whether no key of a flat object occurs twice."""
    keys = F.regexp_extract_all(s, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    return F.size(keys) == F.size(F.array_distinct(keys))


def json_set(s: Column, key: str, value: Column, create: bool = True) -> Column:
    """jsonb_set on a top-level key of an object: value is JSON text."""
    m = F.from_json(s, "map<string,string>")
    has = F.map_contains_key(m, key)
    shown = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["key"].alias("v")))
    each = lambda e: F.concat(F.to_json(F.array(e["k"])).substr(F.lit(2), F.length(F.to_json(F.array(e["k"]))) - 2), F.lit(":"), F.when(e["k"] == key, value).otherwise(raw(s, e["k"])))
    out = F.concat(F.lit("{"), F.array_join(F.transform(shown, each), ","), F.when(~has & F.lit(create), F.concat(F.when(F.size(m) > 0, ",").otherwise(""), F.lit(f'"{key}":'), value)).otherwise(""), F.lit("}"))
    return F.when(s.isNotNull(), out)


def raw(s: Column, key: Column) -> Column:
    """The JSON text of a top-level key: strings keep their quotes."""
    v = F.variant_get(F.parse_json(s), "$", "map<string,variant>")
    return F.to_json(F.element_at(v, key))


def json_path_filter(s: Column, array: str, field: str, op: str, value: str, out: str) -> Column:
    """`$.array[*] ? (@.field op value).out` as texts."""
    items = F.variant_get(F.parse_json(s), f"$.{array}", "array<variant>")
    number = lambda x, f: F.try_variant_get(x, f"$.{f}", "double")
    test = {"==": lambda a: a == float(value), ">": lambda a: a > float(value), "<": lambda a: a < float(value), ">=": lambda a: a >= float(value), "<=": lambda a: a <= float(value)}[op]
    kept = F.filter(items, lambda x: test(number(x, field)))
    return F.transform(kept, lambda x: F.try_variant_get(x, f"$.{out}", "string"))


def json_pretty(s: Column, depth: int = 1) -> Column:
    """A flat object with a line a key."""
    body = F.regexp_replace(F.regexp_replace(s, r"^\{\s*|\s*\}$", ""), r',\s*(?=")', ",\n" + "    " * depth)
    return F.concat(F.lit("{\n" + "    " * depth), F.regexp_replace(body, r'("(?:[^"\\]|\\.)*")\s*:\s*', "$1: "), F.lit("\n}"))


def xpath_rows(xml: Column, row: str, fields: dict[str, str]) -> Column:
    """XMLTABLE: a struct for each row node, by its place among them; fields are paths below it."""
    n = F.call_function("xpath_int", xml, F.lit(f"count({row})"))
    values = {name: F.call_function("xpath", xml, F.lit(f"{row}/{path}" + ("" if re.search(r"text\(\)$|@\w+$", path) else "/text()"))) for name, path in fields.items()}
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("ord"), *[F.get(v, i - 1).alias(name) for name, v in values.items()]))
