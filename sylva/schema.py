"""Row types of the code graph and the identity of its nodes."""

from __future__ import annotations

from pyspark.sql import types as T

DIRECTORY, FILE, CLASS, METHOD, FIELD = "directory", "file", "class", "method", "field"
# The id prefix of each node type.
ID_PREFIX = {"directory": "D", "file": "F", "class": "C", "method": "M", "field": "V", "struct": "S"}
CHILD, DEPENDS, FUZZY = "is_child_of", "depends_on", "depends_on_fuzzy"
STALE = "[STALE] "

CALL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("arity", T.IntegerType()),
        T.StructField("receiver", T.StringType()),
        T.StructField("is_creation", T.BooleanType()),
    ]
)


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "a": T.ArrayType(T.StringType()), "c": T.ArrayType(CALL)}
    return [T.StructField(x.split(":")[0], kinds[x.split(":")[1]]) for x in spec.split()]


#: What a parser gives: no ids yet, parents by uid.
PARSED = T.StructType(
    _fields(
        "uid:s name:s type:s path:s parent_uid:s signature:s body:s diff_hash:s start_line:i end_line:i "
        "imports:a inherits:a enum_constants:a field_type:s arity:i package:s dependency_names:c error:s"
    )
)
STRUCTS = T.StructType(
    _fields(
        "id:s uid:s name:s type:s path:s parent_id:s parent_uid:s description:s signature:s body:s diff_hash:s start_line:i end_line:i "
        "imports:a inherits:a enum_constants:a field_type:s arity:i package:s dependency_names:c"
    )
)
EDGES = T.StructType(_fields("source_id:s target_id:s edge_type:s"))
VECTORS = T.StructType([T.StructField("struct_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
LOCK = T.StructType([*_fields("uid:s diff_hash:s description:s"), T.StructField("vector", T.ArrayType(T.FloatType()))])
CHANGES = T.StructType([*_fields("path:s change:s"), T.StructField("seq", T.LongType())])
#: Versions of the lockfile and of the store; another one is not read.
FORMAT_VERSION, STORE_VERSION = 2, 3
