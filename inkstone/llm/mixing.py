"""Mixing sources to target shares by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and including it, in shuffled order and pass
after pass, divided by the source's share. Taken in order of these times, any prefix of the mix has the target shares but
for one document per source, until a source has given all that its repeats allow; the mix is the prefix that fits the budget. Running sums are built from the sums of fixed hash
(or time) ranges, so that no source, however large, is summed up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.prefix import running_sum
from ..session import spread, written
from .tokenizer import count_tokens

#: Ranges into which each source, and the virtual time, are divided for running sums, at least and at most.
LEAST_RANGES, MOST_RANGES = 64, 65_536


def source_name(c: Column | str) -> Column:
    return F.lower(strip(c))


def token_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = "/opt/tokenizers") -> DataFrame:
    """(doc_id, source, n_tokens), source names without case and padding; written, as later steps read it several times."""
    docs = spread(documents.select(F.col(key).alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("text")), "doc_id")
    return written(count_tokens(docs, "text", "n_tokens", folder=folder), "mix-sizes")


def _end_of_time(sources: list[tuple[float, float]], budget: float) -> float:
    """The virtual time at which sources of (weight, tokens they can give) have given `budget` tokens together."""
    time = given = 0.0
    left = sorted((most / weight, weight, most) for weight, most in sources)
    while left:
        rate = sum(w for _, w, _ in left)
        end, weight, most = left[0]
        if given + rate * (end - time) >= budget:
            return time + (budget - given) / rate
        given += rate * (end - time)
        time = end
        left.pop(0)
    return time


def mix_sources(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, ranges: int | None = None) -> DataFrame:
    """(doc_id, source, pass, n_tokens, finish) of every use of a document in the mix.

    sizes: (doc_id, source, n_tokens); targets: (source, target_share, max_repeats), one row per source (of rows with one
    name the shares add up and the smallest max_repeats counts). Documents without tokens, without a source or of a source
    without target take no part; sources without tokens leave their share to the others in proportion.

    budget: tokens of the mix; by default the largest amount at which every source still reaches its share within its repeats.
    With a larger one, sources that have given all they may stop, the others go on until the budget is met or all have stopped;
    mix_shares tells the shares that come of it. ranges: hash and time ranges for running sums, by default one for every
    20,000 documents.
    """
    goal = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    used = sizes.filter("n_tokens > 0 and doc_id is not null").join(F.broadcast(goal), "source")
    have = used.groupBy("source", "share", "repeats").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.max("n_tokens").alias("longest")).orderBy("source").collect()  # a row per target source
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, sum(r.n for r in have) // 20_000))
    whole = sum(r.share for r in have)
    total = min((r.tokens * r.repeats * whole / r.share for r in have), default=0.0) if budget is None else float(budget)
    # a source lags behind by less than a document, so by then the budget is met for certain
    end = _end_of_time([(r.share / whole, float(r.tokens * r.repeats)) for r in have], total + sum(r.longest for r in have))
    weights = F.broadcast(sizes.sparkSession.createDataFrame([(r.source, r.share / whole, r.tokens) for r in have], "source string, weight double, source_tokens long"))

    # shuffled by a digest of the id, of which leading bits are the range, so the order does not depend on the number of ranges
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(seed)))
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int")
    shuffled = used.select("doc_id", "source", "n_tokens", "repeats", digest.alias("h")).withColumn("bucket", bucket)
    summed = running_sum(shuffled, ["source"], "bucket", ["h", "doc_id"], "n_tokens", "upto").join(weights, "source")
    # only passes that end in time
    last = F.least(F.col("repeats").cast("long"), F.floor((F.lit(end * (1 + 1e-9)) * F.col("weight") - F.col("upto")) / F.col("source_tokens")) + 1)
    passes = summed.withColumn("last", last).filter("last >= 1").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))))
    timed = passes.withColumn("finish", ((F.col("pass") - 1) * F.col("source_tokens") + F.col("upto")) / F.col("weight"))
    slot = F.least(F.lit(ranges - 1), (F.col("finish") / F.lit(max(1e-9, end)) * ranges).cast("int"))
    ordered = running_sum(timed.select("doc_id", "source", "pass", "n_tokens", "finish", slot.alias("slot")), [], "slot", ["finish", "source", "doc_id", "pass"], "n_tokens", "upto")
    return ordered.filter(F.col("upto") <= F.lit(int(total * (1 + 1e-12)))).select("doc_id", "source", "pass", "n_tokens", "finish")


def mix_shares(mix: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: target share, documents and tokens there are, uses and tokens in the mix, the share they are of it."""
    goal = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    there = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    taken = mix.groupBy("source").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("mix_tokens"), F.max("pass").alias("most_repeats"))
    whole = mix.agg(F.sum("n_tokens").alias("whole"))
    joined = goal.join(there, "source", "left").join(taken, "source", "left").crossJoin(F.broadcast(whole))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "uses", "mix_tokens", "most_repeats")]
    share = F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share")
    return joined.select("source", "target_share", "max_repeats", *zero, share)
