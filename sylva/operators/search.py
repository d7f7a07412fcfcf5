"""Vector search and the embeddings behind it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import l2_distance

DIM, OVER_FETCH = 384, 10


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "struct_id", vector_col: str = "vector") -> DataFrame:
    """The k vectors nearest to the query by Euclidean distance (ties: id): each partition keeps its k, then one merge."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(l2_distance(F.col(vector_col), q), 6).alias("distance")).orderBy("distance", id_col).limit(k)


def search(structs: DataFrame, vectors: DataFrame, query: list[float], type_filter: str | None = None, top_k: int = 5, prefilter: bool = False) -> DataFrame:
    """``id, uid, type, distance`` of the structs nearest to the query.

    With a type filter (part of the type's name, in any case) ten times as many are fetched and then filtered, so fewer
    than ``top_k`` may be left; ``prefilter`` filters before the search instead and fills up.
    """
    wanted = F.lower("type").contains(type_filter.lower()) if type_filter else F.lit(True)
    named = structs.select("id", "uid", "type")
    if prefilter and type_filter:
        vectors = vectors.join(named.where(wanted), F.col("struct_id") == F.col("id"), "left_semi")
    hits = nearest(vectors, query, top_k * OVER_FETCH if type_filter and not prefilter else top_k)
    joined = hits.join(named, F.col("struct_id") == F.col("id")).where(wanted)
    return joined.select("id", "uid", "type", "distance").orderBy("distance", "id").limit(top_k)


class HashingEmbedder:
    """Deterministic vectors without a model: signed hashes of words and letter triples, at unit length."""

    dim = DIM

    def embed(self, texts) -> list[list[float]]:
        return [self._one(t or "") for t in texts]

    def _one(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        low = f" {text.lower()} "
        grams = [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]
        for g in grams:
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v


def embed(rows: DataFrame, embedder=None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``struct_id, vector`` of every row, in Arrow batches; the embedder travels to the executors once per task."""
    embedder = embedder or HashingEmbedder()

    def work(frames):
        for f in frames:
            yield pd.DataFrame({"struct_id": f[id_col], "vector": embedder.embed(f[text_col])})

    return rows.select(id_col, text_col).mapInPandas(work, "struct_id string, vector array<float>")
