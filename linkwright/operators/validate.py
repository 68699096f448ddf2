"""JSON-Schema subset compiled to columns: type, required, properties, items, pattern, minimum, maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.operators.project import column_name

# The rules of the default output.
DEFAULT_SCHEMA = {
    "type": "object", "required": ["candidate_id"],
    "properties": {
        "candidate_id": {"type": "string"}, "phones": {"type": "array", "items": {"type": "string", "pattern": r"^\+?[1-9]\d{1,14}$"}},
        "location": {"type": ["object", "string", "null"], "properties": {"country": {"type": ["string", "null"], "pattern": "^[A-Z]{2}$"}}},
        "overall_confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "skills": {"type": "array", "items": {"type": "object", "required": ["name", "confidence", "sources"], "properties": {"confidence": {"type": "number", "minimum": 0, "maximum": 1}}}},
    },
}
TYPES = {"string": T.StringType, "number": T.NumericType, "integer": T.IntegralType, "boolean": T.BooleanType, "array": T.ArrayType, "object": T.StructType}


def problems(value: Column, kind: T.DataType, schema: dict, path: str) -> Column:
    """array<string> of messages of a non-null value; a null value is judged by its parent's `required`."""
    wanted = schema.get("type")
    names = [wanted] if isinstance(wanted, str) else list(wanted or [])
    none = F.array().cast("array<string>")
    if names and not any(isinstance(kind, TYPES[n]) for n in names if n != "null"):
        return F.when(value.isNotNull(), F.array(F.lit(f"{path}: not of type {'/'.join(names)}"))).otherwise(none)
    tests: list[Column] = []
    if "pattern" in schema:
        tests.append(F.when(value.isNotNull() & ~value.rlike(schema["pattern"]), F.lit(f"{path}: does not match the pattern")))
    if "minimum" in schema:
        tests.append(F.when(value < schema["minimum"], F.lit(f"{path}: below the minimum")))
    if "maximum" in schema:
        tests.append(F.when(value > schema["maximum"], F.lit(f"{path}: above the maximum")))
    parts: list[Column] = [F.filter(F.array(*tests), lambda e: e.isNotNull())] if tests else []
    if isinstance(kind, T.StructType):
        missing = [F.when(value[n].isNull() if n in kind.names else F.lit(True), F.lit(f"{path}: {n} is required")) for n in schema.get("required", [])]
        if missing:
            parts.append(F.when(value.isNotNull(), F.filter(F.array(*missing), lambda e: e.isNotNull())).otherwise(none))
        parts += [problems(value[n], kind[n].dataType, s, f"{path}.{n}") for n, s in schema.get("properties", {}).items() if n in kind.names]
    if isinstance(kind, T.ArrayType) and "items" in schema:
        parts.append(F.coalesce(F.flatten(F.transform(value, lambda x: problems(x, kind.elementType, schema["items"], f"{path}[]"))), none))
    return F.concat(*parts) if parts else none


def validated(rows: DataFrame, schema: dict = DEFAULT_SCHEMA) -> DataFrame:
    """rows with errors (array<string>) and valid."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.withColumn("errors", problems(whole, rows.schema, schema, "$")).withColumn("valid", F.size("errors") == 0)


def schema_of(config: dict, compat: bool = False) -> dict:
    """The schema of a configured projection's rows; with `compat` types say nothing and only `required` binds."""
    kinds = {"string": {"type": ["string", "null"]}, "string[]": {"type": ["array", "null"], "items": {"type": "string"}}}
    fields = config.get("fields", [])
    properties = {} if compat else {column_name(f["path"]): kinds.get(f.get("type", ""), {}) for f in fields}
    return {"type": "object", "required": [column_name(f["path"]) for f in fields if f.get("required")], "properties": properties}


def run_verdict(rows: DataFrame) -> DataFrame:
    """One row: whether every row of a validated run is valid, and how many aren't."""
    return rows.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
