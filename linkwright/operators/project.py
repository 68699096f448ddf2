"""Configured projections: paths compiled to columns at plan time."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.functions import columns as C

NORMALIZERS: dict[str, Callable[[Column], Column]] = {"E164": lambda c: C.phone(c), "canonical": C.skill, "email": C.email, "name": C.name, "date": C.year_month}
NORMALIZERS |= {"phone": NORMALIZERS["E164"], "skill": C.skill, "country": lambda c: C.country(c, C.iso_countries(SparkSession.active()))}


def column_name(path: str) -> str:
    return path.replace(".", "_").replace("[]", "").replace("[", "_").replace("]", "")


def compiled(path: str, schema: T.StructType) -> tuple[Column, T.DataType | None]:
    """The column of a path such as a.b, a[0], a[] or a[].b, with its type; null where the path leads nowhere."""
    steps = re.findall(r"[^.\[\]]+|\[\d*\]", path)
    if not steps:
        return F.struct(*[F.col(f"`{n}`") for n in schema.names]), schema

    def walk(col: Column | None, kind: T.DataType, rest: list[str]) -> tuple[Column, T.DataType | None]:
        if not rest:
            return col, kind
        head, tail = rest[0], rest[1:]
        if head == "[]":
            if not isinstance(kind, T.ArrayType):
                return F.lit(None), None
            inner = walk(F.lit(None), kind.elementType, tail)[1]
            if inner is None:
                return F.lit(None), None
            return F.transform(col, lambda x: walk(x, kind.elementType, tail)[0]), T.ArrayType(inner)
        if head.startswith("["):
            return walk(F.get(col, F.lit(int(head[1:-1]))), kind.elementType, tail) if isinstance(kind, T.ArrayType) else (F.lit(None), None)
        if not isinstance(kind, T.StructType) or head not in kind.names:
            return F.lit(None), None
        return walk(F.col(f"`{head}`") if col is None else col[head], kind[head].dataType, tail)

    return walk(None, schema, steps)


def project(entities: DataFrame, config: dict) -> DataFrame:
    """One column a configured field; on_missing says what a missing required one is: null, omit or error.

    With omit a row becomes a JSON text that lacks the keys of missing required
    fields; other fields are null there.  An unknown normaliser leaves values as they are, with a warning.
    """
    policy = config.get("on_missing", "null")
    out: list[Column] = []
    required: set[str] = set()
    for field in config["fields"]:
        path = field.get("from") or field["path"]
        col, kind = compiled(path, entities.schema)
        listed = isinstance(kind, T.ArrayType)
        wanted = field.get("normalize")
        rule = NORMALIZERS.get(wanted) or NORMALIZERS.get(str(wanted).lower())
        if wanted and not rule:
            warnings.warn(f"unknown normaliser {wanted}", stacklevel=2)
        if rule and kind is not None:
            col = F.transform(col, rule) if listed else rule(col)
        if listed:
            col = F.when(F.size(col) > 0, col)  # an empty list counts as missing
        if field.get("required") and policy == "error":
            col = F.when(col.isNull(), F.raise_error(F.lit(f"missing required field {field['path']}"))).otherwise(col)
        name = column_name(field["path"])
        out.append(col.alias(name))
        if field.get("required"):
            required.add(name)
        for flag, suffix in (("include_confidence", "confidence"), ("include_provenance", "sources")):
            if config.get(flag):
                beside = compiled(path.replace(".value", f".{suffix}"), entities.schema)[0]
                out.append(beside.alias(f"{name}_{suffix}"))
    rows = entities.select(*out)
    if policy != "omit":
        return rows
    key = lambda c: F.to_json(F.struct(F.col(f"`{c}`")), {"ignoreNullFields": str(c in required).lower()})
    inside = F.filter(F.array(*[F.substr(key(c), F.lit(2), F.length(key(c)) - 2) for c in rows.columns]), lambda k: k != "")
    return rows.select(F.concat(F.lit("{"), F.array_join(inside, ","), F.lit("}")).alias("json"))


def default_projection(entities: DataFrame) -> DataFrame:
    """Values only, skills with confidence and sources, and a flat provenance list."""
    from_list = lambda f: F.transform(f, lambda x: x["value"])
    prov = lambda f: F.transform(F.coalesce(F.col(f"{f}.sources"), F.array().cast("array<string>")), lambda s: F.struct(F.lit(f).alias("field"), s.alias("source")))
    provs = lambda f: F.flatten(F.transform(f, lambda x: F.transform(x["sources"], lambda s: F.struct(F.lit(f).alias("field"), s.alias("source")))))
    return entities.select(
        "candidate_id", F.col("full_name.value").alias("full_name"), from_list("emails").alias("emails"), from_list("phones").alias("phones"), F.col("location.value").alias("location"), "github", "experience",
        F.transform("skills", lambda s: F.struct(s["value"].alias("name"), s["confidence"].alias("confidence"), s["sources"].alias("sources"))).alias("skills"), "overall_confidence",
        F.concat(prov("full_name"), provs("emails"), provs("phones"), prov("location")).alias("provenance"))
