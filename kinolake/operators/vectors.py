"""Vector tables: embed and upsert, exact and approximate top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolake.functions.vectors import cosine
from kinolake.operators.tables import upsert
from kinolake.session import cut_lineage


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], np.ndarray], out: str = "embedding", batch: int = 32) -> DataFrame:
    """Adds the provider's vector of a text; null texts get none."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        result: list = [None] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None]
        for a in range(0, len(known), batch):
            part = known[a : a + batch]
            for i, v in zip(part, provider([texts.iloc[i] for i in part])):
                result[i] = np.asarray(v, np.float32)
        return pd.Series(result, dtype=object)

    # a provider's call is made once, also where the vector is filtered on
    return rows.withColumn(out, vectors.asNondeterministic()(F.col(text)))


def embed_and_upsert(table: DataFrame, rows: DataFrame, text: str, provider, key: str = "id", meta: tuple[str, ...] = ()) -> DataFrame:
    """Rows reduced to key and ``meta``, embedded, and put into the table."""
    fresh = embed(rows.select(key, *meta, text), text, provider).select(key, *meta, "embedding")
    return upsert(table, fresh, key)


class VectorTable:
    """A stored table of vectors with the fields that go with them: rows are embedded and put in, questions find the nearest.

    ``embed`` takes texts; where vectors come from elsewhere (frames, sound) they are put in
    as they are.
    """

    def __init__(self, store, name: str, embed: Callable[[list[str]], np.ndarray], key: str = "id", meta: tuple[str, ...] = (), threshold: float | None = None):
        self.store, self.name, self.embed, self.key, self.meta, self.threshold = store, name, embed, key, meta, threshold

    def put(self, rows: DataFrame, text: str) -> None:
        """Rows by key with their text embedded; null texts have no vector and are left out."""
        fresh = embed(rows.select(self.key, *self.meta, text).dropDuplicates([self.key]), text, self.embed)
        self.put_vectors(fresh)

    def put_vectors(self, rows: DataFrame) -> None:
        self.store.upsert(self.name, rows.select(self.key, *self.meta, "embedding").filter("embedding IS NOT NULL"), self.key)

    def nearest(self, questions: list[str], k: int, threshold: float | None = None) -> DataFrame:
        """``query_id, <key>, <meta>, similarity, rank`` for each question, numbered in order; no rows where nothing is stored."""
        spark = self.store.spark
        stored = self.store.read(self.name)
        asked = [(i, [float(x) for x in v]) for i, v in enumerate(self.embed(questions))] if questions else []
        queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
        if stored is None:
            return spark.createDataFrame([], "query_id int, id string, similarity double, rank int")
        least = self.threshold if threshold is None else threshold
        hits = top_k(queries, stored, k, least, vector_id=self.key).withColumnRenamed("id", self.key)
        return hits.join(stored.select(self.key, *self.meta), self.key).select("query_id", self.key, *self.meta, "similarity", "rank")


def _best_rows(s: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest of each row, equal ones by smaller name; ``names`` is one row for all or a row each."""
    n = min(k, s.shape[1])
    names = np.broadcast_to(names, s.shape)
    at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), (len(s), n)).copy()
    edge = np.take_along_axis(s, at, 1).min(1)
    for row in np.flatnonzero((s >= edge[:, None]).sum(1) > n):  # ties at the edge: the smaller names
        some = np.flatnonzero(s[row] >= edge[row])
        at[row] = some[np.lexsort((names[row, some], -s[row, some]))][:n]
    return np.take_along_axis(s, at, 1), np.take_along_axis(names, at, 1)


class _Nearest:
    """The ``k`` best rows of a set of queries so far; both sides are compared in blocks of bounded size."""

    def __init__(self, queries: np.ndarray, k: int, rows: int = 1024, columns: int = 4096):
        norm = np.sqrt((queries * queries).sum(1))
        self.queries, self.k, self.rows, self.columns = queries / np.where(norm == 0, 1, norm)[:, None], k, rows, columns
        self.best: list = [None] * -(-len(queries) // rows)

    def add(self, names: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x * x).sum(1))
        x = x / np.where(norm == 0, 1, norm)[:, None]
        for b in range(0, len(x), self.columns):
            for i in range(len(self.best)):
                s = self.queries[i * self.rows : (i + 1) * self.rows] @ x[b : b + self.columns].T
                found = _best_rows(s, names[b : b + self.columns], self.k)
                if self.best[i] is not None:
                    old = self.best[i]
                    found = _best_rows(np.concatenate([old[0], found[0]], 1), np.concatenate([old[1], found[1]], 1), self.k)
                self.best[i] = found


def top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding", max_queries: int = 100_000) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``k`` most similar rows of each query, at least ``threshold``.

    Cosine in double precision, 0 for vectors without length; equal similarity: smaller
    id. Null vectors, vectors with NaN, and lengths other than the query's take no part.

    The queries are a stated, bounded set: they are sent to every task in one matrix
    (``max_queries`` is checked), each task keeps its own ``k`` best for each query, and
    only those are shuffled. Vectors are never moved; queries and vectors are multiplied
    in blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.filter(F.col(query_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(query_id).alias("q"), F.col(embedding).cast("array<double>").alias("e")).limit(max_queries + 1).collect()
    if len(asked) > max_queries:
        raise ValueError(f"more than {max_queries} queries; split them into blocks")
    id_type, query_type = vectors.schema[vector_id].dataType, queries.schema[query_id].dataType
    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, similarity double"
    arrow = pa.schema([("query_id", to_arrow_type(query_type)), ("id", to_arrow_type(id_type)), ("similarity", pa.float64())])
    by_dim: dict[int, tuple[list, np.ndarray]] = {}
    for dim in sorted({len(r.e) for r in asked if r.e}):
        rows = [r for r in asked if len(r.e) == dim and all(v is not None and v == v for v in r.e)]
        if rows:
            by_dim[dim] = ([r.q for r in rows], np.array([r.e for r in rows], np.float64))
    shared = vectors.sparkSession.sparkContext.broadcast(by_dim)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: _Nearest(q, k) for dim, (_, q) in shared.value.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object and pa.types.is_string(arrow.field("id").type) else ids
            sizes = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for dim, nearest in best.items():
                at = np.flatnonzero(sizes == dim)
                if len(at):
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                    fine = ~np.isnan(x).any(1)
                    nearest.add(ids[at][fine], x[fine])
        for dim, nearest in best.items():
            names, start = shared.value[dim][0], 0
            for block in nearest.best:
                if block is None:
                    continue
                s, found = block
                kept = np.ones(s.shape, bool) if threshold is None else s >= threshold
                row, at = np.nonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array([names[start + r] for r in row], arrow.field(0).type), pa.array(found[row, at].tolist(), arrow.field(1).type), pa.array(s[row, at])], schema=arrow)
                start += len(s)

    found = vectors.filter(F.col(vector_id).isNotNull()).select(vector_id, F.col(embedding).cast("array<double>")).mapInArrow(local, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class ApproximateIndex:
    """Random projections of unit vectors into buckets, several tables of them, saved with the projected vectors.

    A search looks at the rows that share a bucket with a query. Queries for which fewer
    than ``k`` rows do are searched exactly, so that every query gets ``k`` rows where
    there are so many. Recall depends on ``tables`` and ``width``; the tests measure it.
    """

    def __init__(self, dim: int, width: float, tables: int, rows: DataFrame | None = None):
        self.dim, self.width, self.tables, self.rows = dim, width, tables, rows

    def _hashed(self, df: DataFrame, name: str, embedding: str, out: str) -> DataFrame:
        """``out, embedding, _k``: usable vectors with their bucket in every table; two projections make a bucket."""
        dim, width, tables = self.dim, self.width, self.tables

        @F.pandas_udf("array<long>")
        def buckets(vectors: pd.Series) -> pd.Series:
            rng = np.random.default_rng(1)
            lines, shift = rng.normal(size=(2 * tables, dim)), rng.random(2 * tables)
            found: list = [None] * len(vectors)
            use = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
            if use:
                x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in use])
                norm = np.sqrt((x * x).sum(1))
                fine = np.isfinite(norm) & (norm > 0)
                cell = np.floor((x[fine] / norm[fine, None]) @ lines.T / width + shift).astype(np.int64)
                keys = (np.arange(tables) << 32) + ((cell[:, ::2] & 0xFFFF) << 16) + (cell[:, 1::2] & 0xFFFF)
                for i, key in zip(np.flatnonzero(fine), keys):
                    found[use[i]] = key
            return pd.Series(found, dtype=object)

        e = F.col(embedding).cast("array<double>")
        rows = df.filter(F.col(name).isNotNull()).select(F.col(name).alias(out), e.alias("embedding"), buckets(e).alias("_h"))
        return rows.filter(F.col("_h").isNotNull())

    @classmethod
    def fit(cls, vectors: DataFrame, dim: int, width: float = 1.5, tables: int = 16, vector_id: str = "id", embedding: str = "embedding") -> ApproximateIndex:
        """Vectors that are null, of another length, without length or with NaN take no part."""
        index = cls(dim, width, tables)
        index.rows = index._hashed(vectors, vector_id, embedding, "id")
        return index

    def save(self, folder: str) -> None:
        told = self.rows.sparkSession.createDataFrame([(self.dim, self.width, self.tables)], "dim int, width double, tables int")
        told.coalesce(1).write.mode("overwrite").json(f"{folder}/model")
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")

    @classmethod
    def load(cls, spark, folder: str) -> ApproximateIndex:
        told = spark.read.schema("dim int, width double, tables int").json(f"{folder}/model").first()
        return cls(told.dim, told.width, told.tables, spark.read.parquet(f"{folder}/rows"))

    def top_k(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """``query_id, id, similarity, rank``; equal similarity: smaller id. Only keys meet by shuffle; a row is compared once with a query."""
        asked = self._hashed(queries, query_id, embedding, "query_id")
        met = asked.select("query_id", F.explode("_h").alias("_k")).join(self.rows.select("id", F.explode("_h").alias("_k")), "_k").select("query_id", "id").distinct()
        scored = met.join(asked.select("query_id", F.col("embedding").alias("_q")), "query_id").join(self.rows.select("id", "embedding"), "id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        near = cut_lineage(scored.select("query_id", "id", cosine(F.col("_q"), F.col("embedding")).alias("similarity")).withColumn("rank", rank).filter(F.col("rank") <= k))
        enough = near.filter(F.col("rank") == k).select("query_id")
        few = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("embedding")).join(enough, "query_id", "left_anti")
        return near.join(enough, "query_id", "left_semi").unionByName(top_k(few, self.rows.select("id", "embedding"), k))


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, dim: int, width: float = 1.5, tables: int = 16, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding") -> DataFrame:
    """Top-k by an index that is made for this search alone; see ``ApproximateIndex``."""
    return ApproximateIndex.fit(vectors, dim, width, tables, vector_id, embedding).top_k(queries, k, query_id, embedding)
