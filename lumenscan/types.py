"""Attribute types, their Spark types, and the rules for names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from lumenscan.functions.names import RESERVED_PREFIX, clean_name

PK = "ap_id"
DISTANCE = "ap_distance"
SOURCE = "ap_source"
PARTITION = "ap_partition"

VECTOR = T.ArrayType(T.FloatType())
SPARSE = T.StructType([T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType())), T.StructField("length", T.IntegerType())])
GEO = T.StructType([T.StructField("geometry_desc", T.StringType())])

SPARK_TYPES: dict[str, T.DataType] = {
    "auto": T.LongType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "boolean": T.BooleanType(),
    "vector": VECTOR,
    "sparsevector": SPARSE,
    "geometry": GEO,
    "geography": GEO,
}

#: Storage engines and the attribute types each can hold; the first that fits is used.
ENGINE_TYPES: dict[str, frozenset[str]] = {
    "parquet": frozenset(SPARK_TYPES),
    "orc": frozenset(SPARK_TYPES),
    "json": frozenset(SPARK_TYPES),
    "avro": frozenset(SPARK_TYPES),
    "cassandra": frozenset({"auto", "integer", "long", "float", "double", "string", "text", "boolean", "vector"}),
    "hbase": frozenset({"auto", "integer", "long", "float", "double", "string", "text", "boolean"}),
    "jdbc": frozenset({"auto", "integer", "long", "float", "double", "string", "text", "boolean"}),
}


class EngineError(ValueError):
    """Something asked of the engine that it must refuse."""


@dataclass(frozen=True)
class Attribute:
    """One attribute of an entity; params as `unique` or `indexed` are kept with it."""

    name: str
    kind: str
    engine: str = "parquet"
    params: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.kind not in SPARK_TYPES:
            raise EngineError(f"unknown attribute type {self.kind!r}")
        object.__setattr__(self, "name", clean_name(self.name))

    @property
    def spark(self) -> T.DataType:
        return SPARK_TYPES[self.kind]


def check_attributes(attributes: list[Attribute]) -> None:
    names = [a.name for a in attributes]
    if not names:
        raise EngineError("an entity needs attributes")
    if any(not n for n in names):
        raise EngineError("empty attribute name")
    if any(n.startswith(RESERVED_PREFIX) for n in names):
        raise EngineError(f"names that begin with {RESERVED_PREFIX} are reserved")
    if len(set(names)) < len(names):
        raise EngineError("attribute names are not unique")
    for a in attributes:
        if a.engine not in ENGINE_TYPES or a.kind not in ENGINE_TYPES[a.engine]:
            raise EngineError(f"engine {a.engine!r} does not hold {a.kind!r}")


def kind_of(t: T.DataType) -> str:
    """The attribute type of a Spark type: wrapped types first, then plain ones."""
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return "vector"
    if isinstance(t, T.StructType):
        names = t.fieldNames()
        if names == SPARSE.fieldNames():
            return "sparsevector"
        if names == GEO.fieldNames():
            return "geometry"
    for kind in ("integer", "long", "float", "double", "string", "boolean"):
        if type(SPARK_TYPES[kind]) is type(t):
            return kind
    raise EngineError(f"no attribute type for {t.simpleString()}")


def available_types() -> list[str]:
    return list(SPARK_TYPES)
