"""The most similar vectors of every vector, from balanced posting lists.

A bounded sample is split into small balanced clusters; their centroids, linked to their nearest fellows, are a graph in
memory that finds the lists of any vector. A vector is kept in the list of its nearest centroid and, near a boundary, in
further ones (replicas); as a query it looks into all lists whose centroid is not much farther than the nearest. A list is
searched exactly, lists longer than a limit in pieces, so nothing is left out of a list that is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Vectors that a list should hold, lists at most, sampled vectors for the fit at most, members of a piece of a list.
LIST_SIZE, MAX_LISTS, SAMPLE, PIECE = 200, 16_384, 100_000, 4_096
#: Distance to a list's centroid, over that to the nearest, up to which a vector is kept in the list, and looks into it; and how many.
KEEP_RATIO, KEEP_LISTS, PROBE_RATIO, PROBE_LISTS = 1.10, 4, 1.5, 24
#: The same for neighbours of at least CLOSE similarity, which share their nearest lists.
CLOSE, CLOSE_RATIO, CLOSE_LISTS = 0.8, 1.25, 10
#: Lists that a query looks into at least, and at most when it has found fewer than k vectors.
LEAST_LISTS, MORE_LISTS = 2, 80


def newest_vectors(models: DataFrame) -> DataFrame:
    """(word, unit) from the newest row of each model id: unit vectors as bytes of float32.

    Vectors that are null, of another length than `dim`, all zero, or with null or not finite values take no part. Of a word
    in several models, the newest one counts.
    """
    newest = models.filter("id is not null").groupBy("id").agg(F.max_by(F.struct("vectors", "dim", F.col("trained_at").alias("at")), F.struct(F.coalesce("trained_at", F.lit(float("-inf"))), F.coalesce("dim", F.lit(-1)))).alias("m"))
    rows = newest.select("m.at", "m.dim", F.explode("m.vectors").alias("word", "v")).filter("v is not null and size(v) = dim and dim > 0")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ats, vectors = [], [], []
            for w, at, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.abs(x).max()
                if np.isfinite(size) and size > 0:
                    x = x / size
                    words.append(w)
                    ats.append(at)
                    vectors.append((x / np.sqrt(x @ x)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ats, pa.float64()), pa.array(vectors, pa.binary())], ["word", "at", "unit"])

    units = rows.select("word", "at", "v").mapInArrow(unit, "word string, at double, unit binary")
    return units.groupBy("word").agg(F.max_by("unit", F.struct(F.coalesce("at", F.lit(float("-inf"))), "unit")).alias("unit"))


def balanced_centroids(x: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of clusters of at most `leaf` of the given unit vectors, by splitting again and again."""
    rng = np.random.default_rng(seed)
    done: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        part = x[at]
        if len(at) <= leaf:
            done.append(part.mean(0))
            continue
        k = int(min(16, max(2, np.ceil(len(at) / leaf))))
        centres = part[rng.choice(len(at), k, replace=False)]
        for _ in range(8):
            best = (part @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, best, part)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        best = (part @ centres.T).argmax(1)
        sizes = np.bincount(best, minlength=k)
        if sizes.max() == len(at):
            done.append(part.mean(0))  # alike: no split helps
            continue
        todo.extend(at[best == j] for j in np.flatnonzero(sizes))
    out = np.array(done, np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class CentroidGraph:
    """Centroids with links to their nearest fellows; searched from a few pivots by following links, many queries at once."""

    def __init__(self, centroids: np.ndarray, links: int = 24, seed: int = 7):
        self.c = np.ascontiguousarray(centroids, np.float32)
        n = len(self.c)
        links = min(links, n - 1)
        self.links = np.zeros((n, max(links, 0)), np.int32)
        for i in range(0, n, 1024):
            s = self.c[i : i + 1024] @ self.c.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            if links:
                near = np.argpartition(-s, links - 1, axis=1)[:, :links]
                order = np.argsort(-np.take_along_axis(s, near, 1), axis=1)
                self.links[i : i + 1024] = np.take_along_axis(near, order, 1)
        if links:
            self.links = np.concatenate([self.links, self._back_links(min(links, 12))], axis=1)
        rng = np.random.default_rng(seed)
        self.pivots = np.sort(rng.choice(n, min(n, max(8, int(12 * np.sqrt(n)))), replace=False)).astype(np.int32)

    def _back_links(self, width: int) -> np.ndarray:
        """From each centroid to some for which it is among the nearest: without these, one that is nobody's neighbour is not found."""
        n = len(self.links)
        back = np.repeat(self.links[:, :1], width, axis=1)
        used = np.zeros(n, np.int64)
        linked = [set(row) for row in self.links.tolist()]
        for rank in range(min(6, self.links.shape[1])):
            for i, j in enumerate(self.links[:, rank].tolist()):
                if used[j] < width and i not in linked[j]:
                    back[j, used[j]] = i
                    used[j] += 1
                    linked[j].add(i)
        return back

    def search(self, q: np.ndarray, r: int, beam: int = 16, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the about r nearest centroids of each query, best first; id -1 for none."""
        n = len(self.c)
        if n <= 4 * max(r, beam) or not self.links.shape[1]:  # the first step meets nearly all of them
            s = q @ self.c.T
            order = np.argsort(-s, axis=1, kind="stable")[:, : min(r, n)]
            return order.astype(np.int32), np.take_along_axis(s, order, 1)
        width = max(r, beam)
        s = q @ self.c[self.pivots].T
        top = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
        ids, sims = self.pivots[top], np.take_along_axis(s, top, 1)
        for _ in range(rounds):
            order = np.argsort(-sims, axis=1)[:, :beam]
            front = np.take_along_axis(ids, order, 1)
            near = self.links[np.maximum(front, 0)].reshape(len(q), -1)
            cand = np.sort(np.concatenate([ids, near], axis=1), axis=1)
            fresh = np.ones(cand.shape, bool)
            fresh[:, 1:] = cand[:, 1:] != cand[:, :-1]
            fresh &= cand >= 0
            s = np.einsum("bd,bnd->bn", q, self.c[np.maximum(cand, 0)])
            s[~fresh] = -3
            top = np.argpartition(-s, width - 1, axis=1)[:, :width]
            new_ids, new_sims = np.take_along_axis(cand, top, 1), np.take_along_axis(s, top, 1)
            new_ids[new_sims < -2] = -1
            same = np.array_equal(np.sort(new_ids, 1), np.sort(ids, 1))
            ids, sims = new_ids, new_sims
            if same:
                break
        order = np.argsort(-sims, axis=1)[:, :r]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def chosen_lists(sims: np.ndarray, ids: np.ndarray, ratio: float, most: int, least: int = 1) -> np.ndarray:
    """Which of the lists found (best first) are within `ratio` of the nearest centroid's distance; at least and most so many."""
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
    keep = dist <= ratio * dist[:, :1] + 1e-6 if np.isfinite(ratio) else np.ones(dist.shape, bool)
    keep[:, :least] = True
    keep[:, most:] = False
    return keep & (ids >= 0)


def similar_vectors(vectors: DataFrame, k: int = 10, min_similarity: float | None = None, list_size: int = LIST_SIZE, sample: int = SAMPLE, probe_ratio: float | None = None, probe_lists: int | None = None, keep_ratio: float = KEEP_RATIO, keep_lists: int = KEEP_LISTS, piece: int = PIECE) -> DataFrame:
    """(word, neighbour, similarity) of the k most similar other words of every word, by cosine, ties in order of words.

    vectors: (word, unit) as of newest_vectors, one row per word. Words with equal vectors are searched as one. With
    min_similarity, only neighbours of at least that similarity are kept, from the first step on.
    """
    spark = vectors.sparkSession
    close = min_similarity is not None and min_similarity >= CLOSE
    probe_ratio = probe_ratio or (CLOSE_RATIO if close else PROBE_RATIO)
    probe_lists = probe_lists or (CLOSE_LISTS if close else PROBE_LISTS)
    words = written(vectors.select("word", "unit", F.unhex(F.md5("unit")).alias("key")), "vectors-words")
    rank = F.row_number().over(W.partitionBy("key").orderBy("word"))
    reps = written(words.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("key").agg(F.min("unit").alias("unit"), F.sort_array(F.collect_list("word")).alias("words")), "vectors-keys")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "word string, neighbour string, similarity double")
    picked = reps.select("unit") if n <= sample else reps.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * sample / n)).select("unit")
    fit = np.array([np.frombuffer(r.unit, np.float32) for r in picked.toLocalIterator()])
    lists = min(MAX_LISTS, max(1, n // list_size))
    graph = CentroidGraph(balanced_centroids(fit, max(2, int(np.ceil(len(fit) / lists)))))
    model = spark.sparkContext.broadcast(graph)

    def route(batches: Iterator[pa.RecordBatch], wider: bool = False) -> Iterator[pa.RecordBatch]:
        g = model.value
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                q = np.array([np.frombuffer(x, np.float32) for x in batch.column(1).to_pylist()])
                ids, sims = g.search(q, MORE_LISTS if wider else max(probe_lists, keep_lists))
                probes = chosen_lists(sims, ids, np.inf if wider else probe_ratio, MORE_LISTS if wider else probe_lists, LEAST_LISTS)
                member = chosen_lists(sims, ids, keep_ratio, 0 if wider else keep_lists)
                row, col = np.nonzero(probes | member)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), pa.array(member[row, col]), pa.array(probes[row, col]), *(batch.column(i).take(at) for i in range(3))], ["list", "member", "query", "key", "unit", "words"])

    schema = "list int, member boolean, query boolean, key binary, unit binary, words array<string>"
    routed = written(reps.select("key", "unit", "words").mapInArrow(route, schema), "vectors-lists")
    # lists with more members or queries than a piece holds: a row per list at most, of which there are no more than MAX_LISTS
    sizes = routed.groupBy("list").agg(F.count_if("member").alias("m"), F.count_if("query").alias("q"))
    pieces = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(size))).cast("int")
    long = written(sizes.filter((F.col("m") > piece) | (F.col("q") > 2 * piece)).select("list", F.struct(pieces("m", piece).alias("m"), pieces("q", 2 * piece).alias("q")).alias("p")), "vectors-long")
    some_long = long.limit(1).count() > 0

    def in_pieces(rows: DataFrame) -> DataFrame:
        """Every member of a list meets every query in one piece: members are dealt out by hash and repeated for each part of
        the queries, queries are dealt out likewise and repeated for each part of the members."""
        if not some_long:
            return rows.withColumn("piece", F.lit(0))
        rows = rows.join(F.broadcast(long), "list", "left").withColumn("p", F.coalesce("p", F.struct(F.lit(1).alias("m"), F.lit(1).alias("q"))))
        own_m, own_q = (F.pmod(F.xxhash64("key", F.lit(seed)), F.col(f"p.{c}")).cast("int") for seed, c in ((1, "m"), (2, "q")))
        place = lambda m, q: F.struct((m * F.col("p.q") + q).alias("piece"), (F.col("member") & (m == own_m)).alias("member"), (F.col("query") & (q == own_q)).alias("query"))
        none = F.array().cast("array<struct<piece:int,member:boolean,query:boolean>>")
        as_member = F.when(F.col("member"), F.transform(F.sequence(F.lit(0), F.col("p.q") - 1), lambda q: place(own_m, q))).otherwise(none)
        as_query = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("p.m") - 1), lambda m: place(m, own_q))).otherwise(none)
        return rows.select("list", "key", "unit", "words", F.explode(F.array_union(as_member, as_query)).alias("x")).select("list", "key", "unit", "words", "x.*")

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        unit = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float32).reshape(part.num_rows, -1)
        members = np.flatnonzero(part["member"].to_numpy())
        queries = np.flatnonzero(part["query"].to_numpy())
        keys, words = part["key"], part["words"]
        out_q, out_m, out_s = [], [], []
        base = unit[members]
        for i in range(0, len(queries) if len(members) else 0, 1024):
            at = queries[i : i + 1024]
            s = unit[at] @ base.T
            s[at[:, None] == members[None, :]] = -2
            if min_similarity is not None:
                row, col = np.nonzero(s >= min_similarity - 1e-5)
            else:
                col = np.argpartition(-s, min(k + 1, s.shape[1]) - 1, axis=1)[:, : k + 1]  # one may be the query itself, in a row of its own
                row = np.repeat(np.arange(len(at)), col.shape[1])
                col = col.ravel()
                ok = s[row, col] > -2
                row, col = row[ok], col[ok]
            exact = np.einsum("nd,nd->n", unit[at[row]].astype(np.float64), base[col].astype(np.float64))
            norm = np.einsum("nd,nd->n", unit[at[row]].astype(np.float64), unit[at[row]].astype(np.float64)) * np.einsum("nd,nd->n", base[col].astype(np.float64), base[col].astype(np.float64))
            exact = exact / np.sqrt(norm)
            ok = exact >= min_similarity if min_similarity is not None else np.ones(len(exact), bool)
            row, col, exact = row[ok], col[ok], exact[ok]
            if min_similarity is not None and len(row):  # at most k of a query leave the task
                order = np.lexsort((-exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                # equal to the k-th stays, the order of words decides later
                kth = np.minimum(first + k - 1, np.append(first[1:], len(row)) - 1)
                ok = (place < k) | (exact >= np.repeat(exact[kth], np.diff(np.append(first, len(row)))) - 1e-12)
                row, col, exact = row[ok], col[ok], exact[ok]
            out_q.append(at[row])
            out_m.append(members[col])
            out_s.append(exact)
        q, m, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_m, np.int64), (out_s, np.float64)))
        return pa.table({"key": keys.take(pa.array(q)), "other": keys.take(pa.array(m)), "words": words.take(pa.array(m)), "similarity": pa.array(s)})

    def searched(rows: DataFrame) -> DataFrame:
        """(key, other, similarity, words), once for every pair, whichever lists it comes from."""
        hits = in_pieces(rows).groupBy("list", "piece").applyInArrow(search, "key binary, other binary, words array<string>, similarity double").filter("key <> other")
        return hits.groupBy("key", "other").agg(F.max("similarity").alias("similarity"), F.min("words").alias("words"))

    pairs = searched(routed)
    if min_similarity is None and n > 1:
        # queries whose lists held too few vectors look into many more; with lists of the usual size there is hardly one
        pairs = written(pairs, "vectors-pairs")
        enough = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, n - 1)).select("key")
        short = written(reps.join(enough, "key", "left_anti"), "vectors-short")
        if short.limit(1).count():
            asked = short.select("key", "unit", "words").mapInArrow(lambda batches: route(batches, True), schema).filter("query")
            again = searched(routed.filter("member").withColumn("query", F.lit(False)).unionByName(asked.withColumn("member", F.lit(False))))
            pairs = pairs.join(short.select("key"), "key", "left_anti").unionByName(again)
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), F.col("words")[0]))
    near = pairs.withColumn("rank", best).filter(F.col("rank") <= k).select("key", "similarity", F.explode("words").alias("neighbour"))
    own = reps.filter(F.size("words") > 1).select("key", F.lit(1.0).alias("similarity"), F.explode("words").alias("neighbour"))
    ordered = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    listed = near.unionByName(own).withColumn("rank", ordered).filter(F.col("rank") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x.neighbour != F.col("word")), 1, k)
    return words.select("key", "word").join(listed, "key").select("word", F.explode(others).alias("x")).select("word", "x.neighbour", (-F.col("x.s")).alias("similarity"))
