"""Variant functions with dotted paths and Arrow type names over Spark's own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrow type names that a typed extraction may ask for.
TYPES = {
    "Utf8": "string", "LargeUtf8": "string", "Utf8View": "string", "Boolean": "boolean", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "Float32": "float", "Float64": "double", "Date32": "date", "Binary": "binary",
}
_DECIMAL = re.compile(r"Decimal(?:128|256)\((\d+), ?(\d+)\)")
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def spark_type(name: str) -> str:
    """The Spark type of an Arrow type name; an unknown name is an error."""
    if m := _DECIMAL.fullmatch(name):
        if int(m[1]) > 38:
            raise ValueError(f"{name} has more digits than a Spark decimal")
        return f"decimal({m[1]},{m[2]})"
    if name.startswith("Timestamp("):
        return "timestamp_ntz" if "None" in name or "," not in name else "timestamp"
    if name not in TYPES:
        raise ValueError(f"not an Arrow type: {name}")
    return TYPES[name]


def json_path(path: str) -> str:
    """``a.b[0]`` as ``$['a']['b'][0]``; a path that already starts with ``$`` stays."""
    if path.startswith("$"):
        return path
    steps = _STEP.findall(path)
    if not steps or "".join(a or f"[{b}]" for a, b in steps) != re.sub(r"\.", "", path):
        raise ValueError(f"not a path: {path!r}")
    return "$" + "".join(f"['{a}']" if a else f"[{b}]" for a, b in steps)


def variant_get(value: Column, path: str, type_name: str | None = None) -> Column:
    """The value at *path*: a variant, or of the Arrow type *type_name*.

    Null where the path is missing or the value doesn't convert.
    """
    return F.try_variant_get(value, json_path(path), spark_type(type_name) if type_name else "variant")


def variant_to_json(value: Column) -> Column:
    """JSON text of a variant; null for null."""
    return F.to_json(value)


def variant_pretty(value: Column) -> Column:
    """Schema and JSON text of a variant, to look at."""
    return F.concat(F.schema_of_variant(value), F.lit(" "), F.to_json(value))
