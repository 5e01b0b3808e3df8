"""Schemas of labelled nodes and edges, and their validation as one projected error column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlake import errors

TYPES = {"integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType())}


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    required: bool = False
    indexed: bool = False
    default: object = None


@dataclass(frozen=True)
class Schema:
    """A label and its declared properties."""

    name: str
    properties: tuple[Property, ...] = ()

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, TYPES[p.type], not p.required) for p in self.properties])


@dataclass
class Registry:
    """Schemas by label; a later registration replaces an earlier one."""

    schemas: dict[str, Schema] = field(default_factory=dict)

    def register(self, schema: Schema) -> Registry:
        self.schemas[schema.name] = schema
        return self

    def get(self, name: str) -> Schema:
        if name not in self.schemas:
            raise errors.UnknownSchema(name)
        return self.schemas[name]


def _type_of(json: Column, name: str) -> Column:
    """Type name of a property of a VARIANT object."""
    return F.regexp_replace(F.lower(F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant"))), r"\(.*", "")


_FITS = {"integer": ("bigint",), "float": ("double", "decimal", "float"), "string": ("string",), "boolean": ("boolean",), "vector": ("array<bigint>", "array<decimal", "array<double>", "array<float>", "array<variant>", "array<void>")}


def error_column(schema: Schema, props: str) -> Column:
    """The first broken rule of a JSON object in column ``props``, or null: required properties, then unknown names, then types.

    A declared property that is present as JSON null has the wrong type.
    """
    v = F.try_parse_json(F.col(props))
    keys = F.coalesce(F.json_object_keys(F.col(props)), F.array().cast("array<string>"))
    rules = [F.when(v.isNull(), F.lit("TypeMismatch"))]
    for p in schema.properties:
        if p.required:
            rules.append(F.when(~F.array_contains(keys, p.name), F.lit(f"MissingRequiredProperty:{p.name}")))
    for p in schema.properties:
        kind = _type_of(v, p.name)
        fits = kind.isin(*_FITS[p.type]) if p.type != "vector" else kind.startswith("array<")
        rules.append(F.when(F.array_contains(keys, p.name) & ~F.coalesce(fits, F.lit(False)), F.lit(f"TypeMismatch:{p.name}")))
    extra = F.array_except(keys, F.array(*[F.lit(p.name) for p in schema.properties]).cast("array<string>"))
    rules.append(F.when(F.size(extra) > 0, F.concat(F.lit("UnknownProperty:"), F.array_min(extra))))
    return F.coalesce(*rules)


def validate(df: DataFrame, registry: Registry, label: str = "label", props: str = "properties") -> DataFrame:
    """``df`` with a column ``error``: null for valid rows."""
    out = F.lit(None).cast("string")
    for s in registry.schemas.values():
        out = F.when(F.col(label) == s.name, error_column(s, props)).otherwise(out)
    known = F.col(label).isin(*registry.schemas) if registry.schemas else F.lit(False)
    return df.withColumn("error", F.when(~F.coalesce(known, F.lit(False)), F.lit("UnknownSchema")).otherwise(out))


def require_valid(df: DataFrame, registry: Registry, label: str = "label", props: str = "properties") -> DataFrame:
    """``df`` if all of its rows are valid; otherwise the error of a first one is raised."""
    bad = validate(df, registry, label, props).where("error IS NOT NULL").select("error").limit(1).collect()
    if bad:
        name, _, detail = bad[0].error.partition(":")
        raise getattr(errors, name)(detail or name)
    return df


def migrate(df: DataFrame, old: Schema, new: Schema) -> DataFrame:
    """Typed rows of ``old`` as rows of ``new``: added properties get their default, dropped ones go, others are cast; rows that then lack a required value are left out."""
    have = {p.name for p in old.properties}
    others = [c for c in df.columns if c not in have]
    cols = [F.col(p.name).try_cast(TYPES[p.type]).alias(p.name) if p.name in have else F.lit(p.default).cast(TYPES[p.type]).alias(p.name) for p in new.properties]
    out = df.select(*others, *cols)
    for p in new.properties:
        if p.required:
            out = out.where(F.col(p.name).isNotNull())
    return out


def create(rows: DataFrame, registry: Registry, after: int = 0, order: str = "properties") -> DataFrame:
    """Validated typed rows with ids that go on from ``after``, in the order of a column; the number of rows of each partition decides where its ids begin."""
    good = require_valid(rows, registry).withColumn("_cell", F.substring(F.col(order).cast("string"), 1, 6)).withColumn("_one", F.lit(1))
    from graphlake.operators.prefix import running_total

    return running_total(good, [], "_cell", [F.col(order)], "_one", "_at").withColumn("id", F.col("_at") + 1 + after).drop("_at", "_cell", "_one")


def check_dimension(dim: int, most: int = 4096) -> int:
    if not 0 < dim <= most:
        raise ValueError(f"a dimension lies between 1 and {most}")
    return dim


def check_rate(rate: float) -> float:
    if not 0.0 <= rate <= 1.0:
        raise ValueError("a rate lies between 0 and 1")
    return rate
