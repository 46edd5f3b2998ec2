"""Schemas of the relations that sources give and rules return."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FILES = _struct(path=S, content=S)
ENTRIES = _struct(path=S, is_dir=B, basename=S, extension=S)
TOKENS = _struct(
    path=S, idx=I, line=I, code=S, content=S, scope_opener=I, scope_closer=I, conditions=T.ArrayType(I), parent_idx=I, name=S, modifiers=T.ArrayType(S), in_parens=B, owner_idx=I
)
UNITS = _struct(path=S, tokens=T.ArrayType(T.StructType([f for f in TOKENS if f.name != "path"])))
EDGES = _struct(depender=S, dependent=S, dep_type=S, file=S, line=I, depender_layer=S, dependent_layers=T.ArrayType(S))
VIOLATIONS = _struct(path=S, line=I, idx=I, rule=S, code=S, message=S, fixable=B)
EXPECTED = _struct(file=S, kind=S, line=I, n=I)
