"""Counts of hidden Markov models by aggregation, and models made of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models.hmm import Hmm
from ..models.kernels import column_function


def hmm_counts(sequences: DataFrame, observations: str, states: str) -> DataFrame:
    """(kind, a, b, count) of sequences with parallel arrays: 'start' (state), 'trans' (state, next) and 'emit' (observation, state).

    Arrays of unequal length count up to the shorter one's end; pairs with a null count nowhere.
    """
    n = F.least(F.size(observations), F.size(states))
    s = sequences.select(F.slice(observations, F.lit(1), F.greatest(n, F.lit(0))).alias("o"), F.slice(states, F.lit(1), F.greatest(n, F.lit(0))).alias("s")).filter("o is not null and s is not null and size(s) > 0")
    start = F.array(F.struct(F.lit("start").alias("kind"), F.get("s", F.lit(0)).alias("a"), F.lit("").alias("b")))
    emit = F.zip_with("o", "s", lambda o, t: F.struct(F.lit("emit").alias("kind"), o.alias("a"), t.alias("b")))
    trans = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s")), lambda p, q: F.struct(F.lit("trans").alias("kind"), p.alias("a"), q.alias("b")))
    rows = s.select(F.explode(F.concat(start, emit, trans)).alias("x")).select("x.*").filter("a is not null and b is not null")
    return rows.groupBy("kind", "a", "b").agg(F.count("*").alias("count"))


def hmm_from_counts(counts: DataFrame, states: list[str], add_k: float = 0.01, observations: int | None = None) -> Hmm:
    """The model of counts, whose emissions the driver holds: those of at most `observations` different ones, the most frequent.

    None takes all, for closed sets of observations such as tags or characters. Others are then unseen, as what never occurred.
    """
    model = Hmm(states, add_k)
    k = len(states)
    start, trans, emit = np.full(k, add_k), np.full((k, k), add_k), {}
    emitted = counts.filter("kind = 'emit'")
    if observations is not None:
        often = emitted.groupBy("a").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "a").limit(observations)
        emitted = emitted.join(F.broadcast(often.select("a")), "a").select("kind", "a", "b", "count")
    for r in counts.filter("kind <> 'emit'").unionByName(emitted).orderBy("kind", "a", "b").collect():
        if r.kind == "start" and r.a in model.at:
            start[model.at[r.a]] += r["count"]
        elif r.kind == "trans" and r.a in model.at and r.b in model.at:
            trans[model.at[r.a], model.at[r.b]] += r["count"]
        elif r.kind == "emit" and r.b in model.at:
            emit.setdefault(r.a, np.full(k, add_k))[model.at[r.b]] += r["count"]
    return model.set_counts(start, trans, emit)


def decoded(sequences: DataFrame, observations: str, model: Hmm) -> DataFrame:
    """The rows with `states`: the likeliest states of their array of observations; null arrays have none."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    find = column_function(lambda k, o, *_: shared.value.viterbi(o), T.ArrayType(T.StringType()))
    return sequences.withColumn("states", find(observations))
