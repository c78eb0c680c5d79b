"""A collection of dense vectors: upsert, delete, exact top-k, of one query or of many at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.functions.scalar import cosine_distance
from graphlens.session import exists, remove, stage


def latest(changes: DataFrame) -> DataFrame:
    """Live vectors of a change table: the last row of each id, unless it is a deletion."""
    last = changes.groupBy("id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "id"]), "seq").alias("r"))
    return last.select("id", "r.*").filter(~F.coalesce("deleted", F.lit(False))).drop("deleted")


class Collection:
    """Vectors of one dimension kept below ``path`` as a log of changes: rows of ``schema.VECTORS``, the last of an id counts."""

    def __init__(self, spark, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension

    def _changes(self) -> DataFrame:
        return self.spark.read.schema(schema.VECTORS).parquet(self.path) if exists(self.spark, f"{self.path}/_SUCCESS") else self.spark.createDataFrame([], schema.VECTORS)

    def _put(self, rows: DataFrame) -> None:
        at = self._changes().agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first().top + 1
        rows.withColumn("seq", F.col("seq") + F.lit(at)).select("id", "embedding", "metadata", "document", "seq", "deleted").write.mode("append").parquet(self.path)

    def upsert(self, vectors: DataFrame) -> None:
        """Put (id, embedding, metadata, document[, seq]) in; any vector of another dimension refuses all of them."""
        if not check_dimension(vectors.filter("id IS NOT NULL"), self.dimension).isEmpty():
            raise ValueError(f"vectors must have {self.dimension} numbers")
        rows = vectors if "seq" in vectors.columns else vectors.withColumn("seq", F.lit(0).cast("bigint"))
        self._put(rows.filter("id IS NOT NULL").withColumn("deleted", F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        null = lambda kind: F.lit(None).cast(kind)
        self._put(ids.select("id").distinct().select("id", null("array<float>").alias("embedding"), null("map<string,string>").alias("metadata"), null("string").alias("document"), F.lit(0).cast("bigint").alias("seq"), F.lit(True).alias("deleted")))

    def clear(self) -> None:
        remove(self.spark, self.path)

    def live(self) -> DataFrame:
        return latest(self._changes())

    def get(self, ids: DataFrame) -> DataFrame:
        return self.live().join(ids.select("id").distinct(), "id", "left_semi")


def check_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of another dimension than the collection's: none may be written."""
    return vectors.filter(F.size("embedding") != dimension)


def _where(vectors: DataFrame, where: dict[str, str] | None) -> DataFrame:
    for key, value in (where or {}).items():
        vectors = vectors.filter(F.element_at("metadata", key).eqNullSafe(F.lit(value)))
    return vectors


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: dict[str, str] | None = None) -> DataFrame:
    """(id, score[, metadata, document]): the k nearest by cosine distance, ascending, ties by id. A scan with a top-k, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    kept = [c for c in ("metadata", "document") if c in vectors.columns]
    return _where(vectors, where).select("id", cosine_distance(F.col("embedding"), q).alias("score"), *kept).orderBy("score", "id").limit(k)


def delete_by_file(vectors: DataFrame, file_path: str) -> DataFrame:
    return vectors.filter(~F.element_at("metadata", F.lit("file_path")).eqNullSafe(F.lit(file_path)))


def many_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, id, score, place): the k nearest of each of many queries, exact, ties by id.

    Queries go in blocks of ``block``, and each block meets all vectors: a task
    multiplies matrices and keeps what may be among the k nearest in its own
    rows. Only those are scored and ranked. The work is queries times vectors.
    """
    parts = [_near(vectors, rows, k) for rows in _blocks(queries.select("id", "embedding"), block)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id string, id string, score double, place int")
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    scored = candidates.distinct().join(vectors.select("id", "embedding"), "id").join(q, "query_id").select("query_id", "id", cosine_distance(F.col("embedding"), F.col("q")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return stage(scored, "scored").withColumn("place", place).filter(F.col("place") <= k)


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of ``size``; the driver holds one list and one partition at a time."""
    at = rows.toLocalIterator()
    while block := list(islice(at, size)):
        yield block


def _near(vectors: DataFrame, queries: list, k: int) -> DataFrame:
    """(query_id, id): what may be among the k nearest of each query, of every task's rows. Written, so that the block can go."""
    import numpy as np

    def unit(m):
        long = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(long > 0, long, 1)

    names = [r.id for r in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((names, unit(np.array([r.embedding for r in queries], dtype=np.float64))))

    def near(batches):
        import pyarrow as pa

        names, q = shared.value
        best = np.full((len(names), k), np.inf)
        which, ids, far = np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        for batch in batches:
            own, rows = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            for a in range(0, len(own), 512):
                d = 1 - q @ unit(np.array(rows[a : a + 512], dtype=np.float64)).T
                best = np.partition(np.concatenate([best, d], axis=1), k - 1, axis=1)[:, :k]
                # rounding may not decide: what is as near as the k-th, or nearly so, stays
                least = best.max(axis=1) + 1e-9
                i, j = np.nonzero(d <= least[:, None])
                kept = far <= least[which]
                which, ids, far = np.concatenate([which[kept], i]), np.concatenate([ids[kept], own[a : a + 512][j]]), np.concatenate([far[kept], d[i, j]])
        for a in range(0, len(which), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in which[a : a + 10_000]], pa.string()), pa.array(ids[a : a + 10_000], pa.string())], names=["query_id", "id"])

    return stage(vectors.select("id", "embedding").mapInArrow(near, "query_id string, id string"), "near")


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(group, centroid): element-wise mean, by position, so no group is gathered."""
    parts = vectors.select(group, F.posexplode("embedding").alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("centroid"))


def routed(vectors: DataFrame, query: list[float], group: str, least: float = 0.65, k: int = 10) -> DataFrame:
    """(id, score): top-k inside the group whose centroid is most like the query, or over all if none reaches ``least``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = centroids(vectors, group).withColumn("like", 1 - cosine_distance(F.col("centroid"), q)).orderBy(F.desc("like"), group).limit(1).collect()
    if best and best[0].like >= least:
        vectors = vectors.filter(F.col(group) == best[0][group])
    return top_k(vectors, query, k)
