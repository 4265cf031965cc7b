"""How characteristic a term is of its record: a parsimonious language model beside the plain TF-IDF score.

Each record's terms get their share of the record's own model by expectation-maximisation against the background
probabilities of the whole collection. Background statistics reach the records by a join: those of terms with many
postings are broadcast (of terms with at least a 1/HOT of all postings there can be no more than HOT), the rest is joined
by term, where no key has more than a 1/HOT of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.hot import HOT, join_with_hot
from ..session import written


def _em(count: np.ndarray, background: np.ndarray, record: np.ndarray, starts: np.ndarray, own: float, rounds: int, tolerance: float) -> np.ndarray:
    """P(term | record) of flat postings sorted by record; starts: where each record begins."""
    p = count / np.add.reduceat(count, starts)[record]
    moving = np.ones(len(starts), bool)  # each record stops for itself, whatever others are in its batch
    for _ in range(rounds):
        e = count * (own * p) / ((1 - own) * background + own * p)
        q = e / np.add.reduceat(e, starts)[record]
        moved = np.maximum.reduceat(np.abs(q - p), starts)
        p = np.where(moving[record], q, p)
        moving &= moved >= tolerance
        if not moving.any():
            break
    return p


def distinctive_terms(records: DataFrame, own: float = 0.1, rounds: int = 50, tolerance: float = 1e-6, min_records: int = 2) -> DataFrame:
    """(id, term, occurrences, score, weight, top) of every distinct term of (id, terms) records.

    weight: P(term | record) of the parsimonious model, converged. score: (occurrences / terms of the record) * (ln((N+1) /
    (df+1)) + 1). top: the score is the record's highest among terms in at least `min_records` records (several terms with
    exactly the same score are all top). Records without terms give nothing; a null id is a record like others.
    """
    one = records.filter(F.size("terms") > 0).select("id", F.size("terms").alias("n"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    postings = written(one.groupBy("id", "n", "term").agg(F.count("*").alias("c")), "postings")
    totals = postings.agg(F.count_if(F.col("term") == "").alias("records"), F.count("*").alias("rows"), F.sum(F.when(F.col("term") != "", F.col("c"))).alias("words")).first()
    n_records, n_words = totals.records, totals.words or 1
    postings = postings.filter("term <> ''")
    stats = written(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("cf")), "term-stats")
    joined = join_with_hot(postings, stats, "term", F.col("df") >= max(1.0, totals.rows / HOT))
    per_record = joined.groupBy("id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("term", "c", "df", "cf"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                lists = batch.column(2)
                flat = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy())
                record = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                term, c, df, cf = (flat.field(i) for i in range(4))
                c, df, cf = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (c, df, cf))
                n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[record]
                score = (c / n) * (np.log((n_records + 1) / (df + 1)) + 1)
                weight = _em(c, cf / n_words, record, starts, own, rounds, tolerance)
                shared = np.where(df >= min_records, score, -np.inf)
                top = (shared == np.maximum.reduceat(shared, starts)[record]) & np.isfinite(shared)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record)), term, pa.array(c.astype(np.int64)), pa.array(score), pa.array(weight), pa.array(top)], ["id", "term", "occurrences", "score", "weight", "top"])

    id_type = records.schema["id"].dataType.simpleString()
    return per_record.select("id", "n", "t").mapInArrow(run, f"id {id_type}, term string, occurrences long, score double, weight double, top boolean")
