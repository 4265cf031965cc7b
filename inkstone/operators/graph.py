"""PageRank: of many small graphs at once in numpy, and of one large graph as a loop of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6


def summed_edges(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated edges added up, by source and, within one, in order of their first occurrence."""
    _, first, which = np.unique(src * n + dst, return_index=True, return_inverse=True)
    total = np.bincount(which, weight, len(first))
    order = np.lexsort((first, src[first]))
    return src[first][order], dst[first][order], total[order]


def exact_sums(n: int, group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums by group, carrying along what each addition rounds off."""
    total, lost = np.zeros(n), np.zeros(n)
    order = np.argsort(group, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    # the i-th value of every group at once
    by_place = np.argsort(place, kind="stable")
    for step in np.split(order[by_place], np.flatnonzero(np.diff(place[by_place])) + 1):
        g, v = group[step], value[step]
        new = total[g] + v
        lost[g] += np.where(np.abs(total[g]) >= np.abs(v), (total[g] - new) + v, (v - new) + total[g])
        total[g] = new
    return total + lost


def pagerank_of(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Scores of the nodes 0 .. n-1 of a weighted graph; nodes without outgoing weight give theirs to all.

    Scores are added up in the order of the edges, so that equal graphs have equal scores to the last bit.
    """
    if not n:
        return np.zeros(0)
    out = exact_sums(n, src, weight)
    share = weight / out[src] if len(src) else weight
    score = np.full(n, 1.0 / n)
    to = np.concatenate([np.arange(n), dst])
    for _ in range(rounds):
        base = (1 - damping) / n + damping * score[out == 0].sum() / n
        new = np.bincount(to, np.concatenate([np.full(n, base), damping * score[src] * share]), n)
        done = np.abs(new - score).sum() < tolerance
        score = new
        if done:
            break
    return score


def pagerank(edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE, cut_every: int = 10) -> DataFrame:
    """(node, score) of one graph of (src, dst, weight) edges, of any size.

    Edges are written once with their share of the source's weight; a round is a join and a sum by target, which combines
    before the shuffle and whose partitioning the next round's join uses. Several rounds are one plan, in which every round's
    scores are read once; they are written every `cut_every` rounds, which cuts the lineage, and then compared with those of the
    round before. Graphs with nodes without outgoing weight are written after every round, as the whole of these nodes' scores
    goes to all, but compared as seldom.
    """
    spark = edges.sparkSession
    sums = edges.groupBy("src").agg(F.sum("weight").alias("s")).filter("s > 0")
    shares = written(edges.join(sums, "src").select("src", "dst", (F.col("weight") / F.col("s")).alias("share")), "rank-edges")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = written(ends.join(sums.select(F.col("src").alias("node"), F.lit(True).alias("gives")), "node", "left").select("node", F.coalesce("gives", F.lit(False)).alias("gives")), "rank-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.count_if(~F.col("gives")).alias("sinks")).first()
    n = size.n
    if not n:
        return spark.createDataFrame([], edges.select(F.col("src").alias("node"), F.lit(0.0).alias("score")).schema)

    def after(score: DataFrame, lost: float) -> DataFrame:
        got = shares.join(score.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        return nodes.join(got, "node", "left").select("node", "gives", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))

    score, done = nodes.withColumn("score", F.lit(1.0 / n)), 0
    while done < rounds:
        step = min(cut_every, rounds - done)
        for i in range(step):
            before = score
            lost = before.filter(~F.col("gives")).agg(F.sum("score")).first()[0] if size.sinks else 0.0
            score = after(before, lost)
            # the last two rounds' scores are written, to be compared
            if size.sinks or i + 2 >= step:
                score = written(score, "rank-scores")
        done += step
        moved = score.join(before.select("node", F.col("score").alias("old")), "node").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        if moved < tolerance:
            break
    return score.select("node", "score")
