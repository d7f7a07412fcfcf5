"""Column functions of the engine: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ID_PREFIX, STALE


def prefix_of(kind: Column | str) -> Column:
    """The id prefix of a node type; unknown types are plain structs."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(ID_PREFIX["struct"])
    for name, letter in ID_PREFIX.items():
        out = F.when(kind == name, letter).otherwise(out)
    return out


def struct_id(uid: Column | str, kind: Column | str) -> Column:
    """Prefix, dash, first ten hex digits of the uid's MD5."""
    return F.concat(prefix_of(kind), F.lit("-"), F.substring(F.md5(uid), 1, 10))


def is_id(text: Column | str) -> Column:
    """Whether a reference is an id rather than a uid."""
    return (F.col(text) if isinstance(text, str) else text).rlike("^[SCMVFD]-")


def short_uid(uid: Column | str) -> Column:
    """The uid without its file part."""
    return F.regexp_replace(uid, "^[^#]*#", "#")


def truncate(text: Column | str, width: int = 50) -> Column:
    """White space collapsed, then cut to width with an ellipsis."""
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column | str) -> Column:
    """The language a path's extension routes to, null where none does."""
    ext = extension(path)
    return F.when(ext == ".py", "python").when(ext == ".java", "java").when(ext.isin(".html", ".htm"), "html")


def in_subtree(column: Column | str, path: str) -> Column:
    """Whether a path is ``path`` or below it; "." holds everything. Both parts reach the Parquet scan."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lit(True) if path == "." else (column == path) | column.startswith(path + "/")


def without_stale(description: Column | str) -> Column:
    description = F.col(description) if isinstance(description, str) else description
    return F.when(description.startswith(STALE), F.substring(description, len(STALE) + 1, 1 << 30)).otherwise(description)


def described(description: Column | str) -> Column:
    """Whether there is a description that is not stale."""
    description = F.col(description) if isinstance(description, str) else description
    return F.coalesce((description != "") & ~description.startswith(STALE), F.lit(False))


def embed_text(uid: Column | str, description: Column | str, body: Column | str, signature: Column | str, name: Column | str) -> Column:
    """What stands for a struct in an embedding: uid and description, else body, signature or name."""
    said = F.nullif(description, F.lit(""))
    return F.coalesce(F.when(said.isNotNull(), F.concat(uid, F.lit(": "), said)), F.nullif(body, F.lit("")), F.nullif(signature, F.lit("")), name)


def line_count(body: Column | str) -> Column:
    """Lines of a text; a final newline does not open another one."""
    n = F.size(F.split(body, "\n"))
    return F.when(F.substring(body, -1, 1) == "\n", F.greatest(n - 1, F.lit(1))).otherwise(n)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two float arrays in double precision."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normalise(v: Column, floor: float = 1e-9) -> Column:
    v = v.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(floor))
    return F.transform(v, lambda x: x / norm)


def mean_pool(tokens: Column, mask: Column, floor: float = 1e-9) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1, element by element."""
    total = F.greatest(F.aggregate(mask.cast("array<double>"), F.lit(0.0), lambda s, x: s + x), F.lit(floor))
    weighed = F.zip_with(tokens, mask.cast("array<double>"), lambda v, m: F.transform(v.cast("array<double>"), lambda x: x * m))
    summed = F.aggregate(F.slice(weighed, 2, F.greatest(F.size(weighed) - 1, F.lit(0))), F.element_at(weighed, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / total)
