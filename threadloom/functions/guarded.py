"""JSON read by its own types: a value of another type than is asked for is null, never coerced, and takes nothing with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What schema_of_variant calls a value that a type takes.
KINDS = {T.StringType: "STRING", T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.BooleanType: "BOOLEAN"}


def guarded(value: Column, kind: T.DataType | str) -> Column:
    """A variant as a value of a type: structs and arrays of texts, whole numbers, truth values and variants."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.VariantType):
        return value
    found = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        fields = [guarded(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(F.startswith(found, F.lit("OBJECT")), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.when(F.startswith(found, F.lit("ARRAY")), F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: guarded(x, kind.elementType)))
    return F.when(found == KINDS[type(kind)], F.try_variant_get(value, "$", kind.simpleString()))


def parsed(text: Column, kind: T.DataType | str) -> Column:
    """A JSON text as a value of a type; null if it is no JSON or of another kind."""
    return guarded(F.try_parse_json(text), kind)
