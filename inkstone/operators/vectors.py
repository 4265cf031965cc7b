"""Dense vectors: nearest neighbours of a query set, cosine k-means, principal components, word embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_han
from ..models.lexicon import DEFAULT
from ..session import written
from . import weights

#: Vectors in one block of rows or queries; matrices that the driver adds up at most.
BLOCK, FEW_SUMS = 2_048, 64


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def packed(df: DataFrame, id: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(ids, units): rows as blocks of vectors of length 1, in the partitions they are in. Null vectors take no part, nor do those with null values."""
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null and not exists(vec, x -> x is null)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, block) for i in range(0, whole.num_rows, block)):
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type)), pa.array([_unit(_matrix(b.column(1))).tobytes()], pa.binary())], ["ids", "units"])

    return rows.mapInArrow(run, f"ids array<{kind}>, units binary")


def nearest(df: DataFrame, queries: DataFrame, id: str, vec: str, k: int = 10) -> DataFrame:
    """(query, neighbour, similarity): the k vectors most similar to each query by cosine, itself left out, ties in order of ids.

    An exact search of a stated query set: blocks of queries meet blocks of vectors, each meeting is one matrix product of
    which k rows per query are kept.
    """
    kind = df.schema[id].dataType.simpleString()
    rows, asked = packed(df, id, vec), packed(queries, id, vec)
    met = rows.crossJoin(asked.select(F.col("ids").alias("query_ids"), F.col("units").alias("query_units")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids = (np.array(batch.column(c)[i].as_py()) for c in (0, 2))
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1) for c, n in ((1, ids), (3, query_ids)))
                s = q @ x.T
                s[query_ids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s.round(12)), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                col = order.ravel()
                ok = np.isfinite(s[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row[ok]]), pa.array(ids[col[ok]]), pa.array(s[row[ok], col[ok]])], ["query", "neighbour", "similarity"])

    found = met.mapInArrow(run, f"query {kind}, neighbour {kind}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("similarity", 12).desc(), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _assign_rounds(units: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the vectors nearest to each centre."""
    spark = units.sparkSession
    shared = spark.sparkContext.broadcast(_unit(centres))
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, counts = np.zeros((len(c), dim)), np.zeros(len(c), np.int64)
        for b in batches:
            x = _matrix(b.column(0))
            best = (_unit(x) @ c.T).argmax(1)
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(counts)], ["cluster", "sums", "n"])

    parts = units.select("vec").mapInArrow(run, "cluster int, sums array<double>, n long")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums")).collect()
    sums, counts = np.zeros_like(centres), np.zeros(len(centres))
    for r in rows:
        sums[r.cluster], counts[r.cluster] = r.sums, r.n
    shared.unpersist()
    return sums, counts


def assign(df: DataFrame, id: str, vec: str, centres: np.ndarray) -> DataFrame:
    """(id, cluster, similarity) of the most similar centre of each vector, the first among equals."""
    kind = df.schema[id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(_unit(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _unit(_matrix(b.column(1))) @ shared.value.T if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.argmax(1).astype(np.int32)), pa.array(s.max(1))], ["id", "cluster", "similarity"])

    return df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null").mapInArrow(run, f"id {kind}, cluster int, similarity double")


def kmeans(df: DataFrame, id: str, vec: str, k: int = 5, rounds: int = 50, seed: int = 0, centres: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, similarity), centres) of k-means by cosine; a cluster left empty keeps its centre.

    The first centres are the k vectors with the least hash of their id, unless given. k vectors or fewer are a cluster each.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null")
    if centres is None:
        first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()
        if not first:
            return assign(df, id, vec, np.zeros((1, 1))), np.zeros((0, 0))
        centres = np.array([r.vec for r in first])
    for _ in range(rounds):
        sums, counts = _assign_rounds(rows, centres)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts[:, None], 1), centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return assign(df, id, vec, centres), centres


def principal_components(df: DataFrame, id: str, vec: str, k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((id, point), variances): centred vectors on the k directions of greatest variance, whose largest entry is positive.

    Sums and products are added up per task, then in two steps of groups of tasks; no more than FEW_SUMS matrices of dim x dim
    numbers reach the driver. Fewer than two vectors give zeros.
    """
    rows = df.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter("vec is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, None, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                n += len(x)
                total = x.sum(0) if total is None else total + x.sum(0)
                outer = x.T @ x if outer is None else outer + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()]), pa.array([outer.tobytes()])], ["n", "total", "outer"])

    def added(part: pa.Table) -> pa.Table:
        matrices = [sum(np.frombuffer(x.as_buffer()) for x in part[c]) for c in ("total", "outer")]
        return pa.table({"n": pa.array([sum(part["n"].to_pylist())], pa.int64()), **{c: pa.array([m.tobytes()], pa.binary()) for c, m in zip(("total", "outer"), matrices)}})

    schema = "n long, total binary, outer binary"
    parts = rows.select("vec").mapInArrow(moments, schema)
    for slots in (FEW_SUMS * FEW_SUMS, FEW_SUMS):
        parts = parts.groupBy(F.pmod(F.xxhash64("total", "n"), F.lit(slots)).alias("slot")).applyInArrow(added, schema)
    n, total, outer = 0, 0.0, 0.0
    for r in parts.toLocalIterator():
        n, total, outer = n + r.n, total + np.frombuffer(r.total), outer + np.frombuffer(r.outer)
    if n < 2:
        return rows.select("id", F.array(*[F.lit(0.0)] * k).alias("point")), np.zeros(k)
    mean = total / n
    cov = outer.reshape(len(mean), -1) - n * np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = (_matrix(b.column(1)) - mean) @ axes if b.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(points), pa.list_(pa.float64()))], ["id", "point"])

    return rows.mapInArrow(project, f"id {kind}, point array<double>"), values[::-1][:k]


def truncated_svd(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(U, S, V) of the k greatest singular values of at least 1e-9; the largest entry of each left vector is positive."""
    u, s, vt = np.linalg.svd(matrix)
    keep = int((s[: min(k, len(s))] >= 1e-9).sum())
    u, s, vt = u[:, :keep], s[:keep], vt[:keep]
    sign = np.where(u[np.abs(u).argmax(0), np.arange(keep)] < 0, -1.0, 1.0) if keep else np.ones(0)
    return u * sign, s, (vt * sign[:, None]).T


def embedding_words(words: Column | str, stop: frozenset[str] = DEFAULT.stop_words, chinese_only: bool = True) -> Column:
    """The words that embeddings are trained on: no stop words and, by default, only those with a Chinese character."""
    stops = F.array(*map(F.lit, sorted(stop)))
    return F.filter(words, lambda w: w.isNotNull() & ~F.array_contains(stops, w) & (has_han(w) if chinese_only else F.length(w) > 0))


def train_embeddings(docs: DataFrame, id: str, words: str, vocab_size: int = 300, dim: int = 30, window: int = 5, min_count: int = 1, chinese_only: bool = True) -> tuple[DataFrame, np.ndarray]:
    """((word, vector, count, rank), singular values): PPMI of co-occurrence counts, reduced by SVD to U * S.

    Counting is distributed; the matrix has at most vocab_size squared entries, which is what reaches the driver. No word, or
    no pair, gives an empty model.
    """
    spark = docs.sparkSession
    used = docs.select(F.col(id).alias("id"), embedding_words(words, chinese_only=chinese_only).alias("w"))
    vocab = written(weights.vocabulary(used, "id", "w", vocab_size, min_count), "vocabulary")
    cells = weights.ppmi(weights.cooccurrence(used, "w", window, True, vocab)).collect()
    names = vocab.orderBy("rank").collect()
    schema = "word string, vector array<double>, count long, rank int"
    if not names or not cells:
        return spark.createDataFrame([], schema), np.zeros(0)
    at = {r.term: i for i, r in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for c in cells:
        m[at[c.src], at[c.dst]] = c.ppmi
    u, s, _ = truncated_svd(m, dim)
    return spark.createDataFrame([(r.term, (u[i] * s).tolist(), r["count"], r.rank) for i, r in enumerate(names)], schema), s


def word_similarity(model: DataFrame, a: str, b: str) -> float:
    """Cosine of two words' vectors; 0 if the model does not know one of them."""
    found = {r.word: np.array(r.vector) for r in model.filter(F.col("word").isin(a, b)).collect()}
    if a not in found or b not in found:
        return 0.0
    return float(_unit(found[a][None])[0] @ _unit(found[b][None])[0])


def model_stats(model: DataFrame, singular_values: np.ndarray) -> dict:
    """Words, dimensions, and the first ten singular values."""
    return {"vocab_size": model.count(), "dim": len(singular_values), "singular_values": [round(float(v), 4) for v in singular_values[:10]]}


def save_model(model: DataFrame, singular_values: np.ndarray, path: str) -> None:
    """Vectors and singular values as Parquet under `path`."""
    model.write.mode("overwrite").parquet(f"{path}/vectors")
    model.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(singular_values)], "i int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/singular")


def load_model(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    values = spark.read.parquet(f"{path}/singular").orderBy("i").collect()
    return spark.read.parquet(f"{path}/vectors"), np.array([r.value for r in values])
