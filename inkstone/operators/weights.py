"""Counts and weights of terms: frequencies, TF-IDF, vocabulary, co-occurrence, PPMI, new words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import GRAM_BREAKS, has_han
from ..session import written
from .hot import HOT, join_with_hot


def term_counts(docs: DataFrame, id: str, words: str) -> DataFrame:
    """(id, term, count, length, tf) of each distinct term of a document. Empty and null arrays give nothing."""
    one = docs.select(F.col(id).alias("id"), F.size(words).alias("length"), F.explode(words).alias("term")).filter("term is not null")
    return one.groupBy("id", "length", "term").agg(F.count("*").alias("count")).withColumn("tf", F.col("count") / F.col("length"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(docs: DataFrame, id: str, words: str) -> DataFrame:
    """(id, term, count, length, tf, df, weight): tf * (ln((n+1)/(df+1)) + 1), n counting documents without terms as well.

    Terms with more than 1/10,000 of all postings, of which there can be no more than 10,000, are joined by broadcast, so that
    no shuffle key has a large share of the rows.
    """
    # a null term in each document counts the documents in the same pass
    marked = F.concat(F.coalesce(F.filter(words, lambda w: w.isNotNull()), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    one = docs.select(F.col(id).alias("id"), F.coalesce(F.size(words), F.lit(0)).alias("length"), F.explode(marked).alias("term"))
    all_counts = written(one.groupBy("id", "length", "term").agg(F.count("*").alias("count")), "term-counts")
    totals = all_counts.agg(F.count("term").alias("postings"), F.sum(F.when(F.col("term").isNull(), F.col("count"))).alias("n")).first()
    n, postings = totals.n or 0, totals.postings
    counts = all_counts.filter("term is not null").withColumn("tf", F.col("count") / F.col("length"))
    df = written(document_frequency(counts), "document-frequency")
    joined = join_with_hot(counts, df, "term", F.col("df") >= max(1.0, postings / HOT))
    return joined.withColumn("weight", F.col("tf") * (F.ln((F.lit(n) + 1) / (F.col("df") + 1)) + 1))


def top_terms(weighted: DataFrame, k: int, by: str = "weight") -> DataFrame:
    """The k heaviest terms of each document with their rank; equal weights (to 9 places) in order of terms."""
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.round(by, 9).desc(), "term"))
    return weighted.withColumn("rank", rank).filter(F.col("rank") <= k)


def vocabulary(docs: DataFrame, id: str, words: str, size: int = 300, min_count: int = 1) -> DataFrame:
    """(term, count, rank) of the most frequent terms; equally frequent ones in order of their first place (id, position)."""
    one = docs.select(F.col(id).alias("id"), F.posexplode(words).alias("pos", "term")).filter("term is not null")
    counted = one.groupBy("term").agg(F.count("*").alias("count"), F.min(F.struct("id", "pos")).alias("first"))
    top = counted.orderBy(F.desc("count"), "first").limit(size)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "first"))).filter(F.col("count") >= min_count).select("term", "count", "rank")


def neighbours(words: Column | str, window: int) -> Column:
    """Array of (a, b, decay) for all pairs at distance 1 .. window-1 within an array: no shuffle, no self-join."""
    words = F.col(words) if isinstance(words, str) else words
    n = F.size(words)

    def at(distance: int) -> Column:
        places = F.when(n > distance, F.sequence(F.lit(0), n - distance - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + distance).alias("b"), F.lit(1.0 / distance).alias("decay")))

    return F.concat(*(at(d) for d in range(1, window)))


def cooccurrence(docs: DataFrame, words: str, window: int = 4, equal_words: bool = False, keep: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """(src, dst, weight), symmetric sums of 1/distance over all documents, or per document with `by`.

    Pairs of equal words count only with `equal_words` (then twice, once for each direction). keep: a frame of few terms
    (a vocabulary, whose size is its parameter) to which both words must belong.
    """
    key = [F.col(by).alias("id")] if by else []
    group = ["id"] if by else []
    pairs = docs.select(*key, F.explode(neighbours(words, window)).alias("p")).select(*group, "p.*").filter("a is not null and b is not null")
    if not equal_words:
        pairs = pairs.filter("a <> b")
    if keep is not None:
        terms = F.broadcast(keep.select("term"))
        pairs = pairs.join(terms.withColumnRenamed("term", "a"), "a").join(terms.withColumnRenamed("term", "b"), "b")
    once = pairs.groupBy(*group, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("decay").alias("weight"))
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst", (F.col("weight") * 2).alias("weight")))).otherwise(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    return once.select(*group, F.explode(both).alias("e")).select(*group, "e.*")


def ppmi(edges: DataFrame) -> DataFrame:
    """(src, dst, ppmi): max(ln(c * total / (row sum * row sum + 1e-9)), 0) of a symmetric count table."""
    edges = written(edges.select("src", "dst", "weight"), "cooccurrence")
    whole = edges.agg(F.sum("weight").alias("total"), F.count("*").alias("edges")).first()
    sums = written(edges.groupBy("src").agg(F.sum("weight").alias("s"), F.count("*").alias("n")), "row-sums")
    often = F.col("n") >= max(1.0, whole.edges / HOT)
    joined = join_with_hot(edges, sums.withColumnRenamed("s", "rs"), "src", often).drop("n")
    joined = join_with_hot(joined, sums.select(F.col("src").alias("dst"), F.col("s").alias("cs"), "n"), "dst", often)
    value = F.ln(F.col("weight") * F.lit(whole.total) / (F.col("rs") * F.col("cs") + 1e-9))
    return joined.filter("weight > 0").select("src", "dst", F.greatest(value, F.lit(0.0)).alias("ppmi"))


def scaled_by_max(df: DataFrame, by: str, value: str) -> DataFrame:
    """The value over the group's greatest; groups whose greatest is not positive have no rows."""
    top = F.max(value).over(W.partitionBy(by))
    return df.withColumn("_top", top).filter("_top > 0").withColumn(value, F.col(value) / F.col("_top")).drop("_top")


def grams(texts: DataFrame, text: str, max_len: int) -> DataFrame:
    """(gram, n, left, right): every run of 1 .. max_len characters of the texts without punctuation, and its neighbours."""
    # texts are taken apart into characters once: a run is then a slice, wherever it stands
    bare = texts.select(F.split(F.regexp_replace(F.col(text), GRAM_BREAKS, ""), "").alias("c")).filter("c[0] <> ''")
    size = F.size("c")
    run_of = lambda n: lambda i: F.struct(F.array_join(F.slice("c", i + 1, n), "").alias("gram"), F.lit(n).alias("n"), F.when(i > 0, F.get("c", i - 1)).alias("left"), F.get("c", i + n).alias("right"))
    runs = [F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), run_of(n))) for n in range(1, max_len + 1)]
    return bare.select(F.explode(F.concat(*(F.coalesce(r, F.slice(runs[0], 1, 0)) for r in runs))).alias("g")).select("g.*")


def _entropy(sides: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(gram, h_*): entropy in bits of the characters on each side, null without any; all sides in one pass."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("ch")) for c in columns)))
    counted = sides.select("gram", "c", each.alias("s")).filter("s.ch is not null").groupBy("gram", "s").agg(F.sum("c").alias("c"))
    # sum of c*log2(c) and of c give the entropy in one pass: log2(n) - sum(c*log2(c))/n
    of = lambda side: F.when(F.col("s.side") == side, F.col("c"))
    return counted.groupBy("gram").agg(*((F.log2(F.sum(of(c))) - F.sum(of(c) * F.log2(of(c))) / F.sum(of(c))).alias(f"h_{c}") for c in columns))


def new_words(texts: DataFrame, text: str, min_freq: int = 5, max_len: int = 4, min_mi: float = 6.0, top: int | None = 200, chinese_only: bool = True) -> DataFrame:
    """(word, freq, mi, score): runs of 2 .. max_len characters that stick together and stand in varied surroundings.

    mi = log2(P(word) / product of P(character)), all over the number of characters; score = mi + min(entropy of left and
    right neighbours), rounded to 4 places. One pass over the texts: each run comes with its neighbours, so none is searched
    for again. The characters' counts, of which there are no more than code points, are broadcast.
    """
    counted = written(grams(texts, text, max_len).groupBy("gram", "n", "left", "right").agg(F.count("*").alias("c")), "gram-counts")
    freq = counted.groupBy("gram", "n").agg(F.sum("c").alias("freq"))
    chars = freq.filter("n = 1").select(F.col("gram").alias("ch"), F.col("freq").alias("cf"))
    total = F.broadcast(chars.agg(F.sum("cf").alias("total")))
    words = freq.filter((F.col("n") >= 2) & (F.col("freq") >= min_freq))
    if chinese_only:
        words = words.filter(has_han("gram"))
    split = words.select("gram", "n", "freq", F.explode(F.split("gram", "")).alias("ch")).filter("ch <> ''").join(F.broadcast(chars), "ch").crossJoin(total)
    mi = split.groupBy("gram", "n", "freq", "total").agg(F.sum(F.log2(F.col("cf") / F.col("total"))).alias("apart")).select("gram", "freq", (F.log2(F.col("freq") / F.col("total")) - F.col("apart")).alias("mi")).filter(F.round("mi", 9) >= min_mi)
    mi = written(mi, "gram-words")
    sides = counted.join(mi.select("gram"), "gram", "left_semi")
    scored = mi.join(_entropy(sides, ("left", "right")), "gram", "left")
    score = F.round(F.col("mi") + F.least(F.coalesce("h_left", F.lit(0.0)), F.coalesce("h_right", F.lit(0.0))), 4)
    out = scored.select(F.col("gram").alias("word"), "freq", F.round("mi", 4).alias("mi"), score.alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "word").limit(top)
