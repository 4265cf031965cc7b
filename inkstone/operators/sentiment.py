"""Sentiment: lexicon scores with degree adverbs and negation, and a multinomial naive Bayes classifier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import constant_map
from ..models.lexicon import DEFAULT, Lexicon
from ..models.segment import Segmenter

THRESHOLD = 0.15


def _in(c: Column, words) -> Column:
    return c.isin(*sorted(words))


def polarity(score: Column) -> Column:
    return F.when(score >= THRESHOLD, "positive").when(score <= -THRESHOLD, "negative").otherwise("neutral")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexicon_score(words: Column | str, lexicon: Lexicon = DEFAULT) -> Column:
    """struct<raw_score, score, polarity, positive_words, negative_words> of an array of words: no shuffle, no join.

    A positive word counts 1, a negative one -1, times the leftmost degree adverb among the two words before it, with the
    sign turned if one of these two is a negation. score = tanh(raw / sqrt(number of words)). Null arrays count as empty.
    """
    degrees = constant_map(lexicon.degree, "map<string,double>")
    w = F.coalesce(F.col(words) if isinstance(words, str) else words, F.array().cast("array<string>"))

    def one(x: Column, i: Column) -> Column:
        before = [F.get(w, i - 2), F.get(w, i - 1)]
        sign = F.when(F.coalesce(_in(before[0], lexicon.negation), F.lit(False)) | F.coalesce(_in(before[1], lexicon.negation), F.lit(False)), -1.0).otherwise(1.0)
        degree = F.coalesce(*(F.try_element_at(degrees, b) for b in before), F.lit(1.0))
        return F.when(_in(x, lexicon.positive), sign * degree).when(_in(x, lexicon.negative), -sign * degree).otherwise(0.0)

    raw = F.aggregate(F.transform(w, one), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    value = lambda r: F.tanh(r / F.sqrt(F.greatest(F.size(w), F.lit(1)).cast("double")))
    return _let(raw, lambda r: F.struct(
        F.round(value(r), 4).alias("score"), F.round(r, 4).alias("raw_score"), polarity(value(r)).alias("polarity"),
        F.filter(w, lambda x: _in(x, lexicon.positive)).alias("positive_words"), F.filter(w, lambda x: _in(x, lexicon.negative) & ~_in(x, lexicon.positive)).alias("negative_words"),
    ))


def sentiment_by_windows(tokens: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The scores of lexicon_score from (id, pos, word) rows, by joins with the word lists and windows over positions."""
    spark = tokens.sparkSession
    value = {**dict.fromkeys(lexicon.negative, -1.0), **dict.fromkeys(lexicon.positive, 1.0)}
    known = set(value) | set(lexicon.degree) | set(lexicon.negation)
    rows = [(x, value.get(x), lexicon.degree.get(x), x in lexicon.negation) for x in sorted(known)]
    table = F.broadcast(spark.createDataFrame(rows, "word string, value double, degree double, negation boolean"))
    at = W.partitionBy("id").orderBy("pos")
    joined = tokens.join(table, "word", "left")
    sign = F.when(F.max(F.coalesce("negation", F.lit(False))).over(at.rowsBetween(-2, -1)), -1.0).otherwise(1.0)
    degree = F.coalesce(F.lag("degree", 2).over(at), F.lag("degree", 1).over(at), F.lit(1.0))
    each = joined.select("id", F.coalesce(F.col("value") * sign * degree, F.lit(0.0)).alias("v"))
    total = each.groupBy("id").agg(F.sum("v").alias("raw"), F.count("*").alias("n"))
    score = F.tanh(F.col("raw") / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    return total.select("id", F.round("raw", 4).alias("raw_score"), F.round(score, 4).alias("score"), polarity(score).alias("polarity"))


class NaiveBayes:
    """A fitted model as tables: (label, prior) and (label, word, logp); priors are not smoothed, words have Laplace's alpha."""

    def __init__(self, priors: DataFrame, words: DataFrame):
        self.priors, self.words = priors, words

    @classmethod
    def fit(cls, docs: DataFrame, words: str, label: str, alpha: float = 1.0) -> "NaiveBayes":
        """From documents with an array of words and a label; without label they do not count, without words they do for the prior."""
        one = docs.select(F.col(label).alias("label"), F.col(words).alias("w")).filter("label is not null")
        n = F.broadcast(one.agg(F.count("*").alias("n")))
        priors = one.groupBy("label").agg(F.count("*").alias("c")).crossJoin(n).select("label", F.ln(F.col("c") / F.col("n")).alias("prior"))
        counts = one.select("label", F.explode("w").alias("word")).filter("word is not null").groupBy("label", "word").agg(F.count("*").alias("c"))
        vocab = counts.select("word").distinct()
        size = F.broadcast(vocab.agg(F.count("*").alias("v")))
        totals = priors.select("label").join(counts.groupBy("label").agg(F.sum("c").alias("t")), "label", "left")
        # labels are few: every word gets a row for each of them
        grid = vocab.crossJoin(F.broadcast(totals)).crossJoin(size).join(counts, ["label", "word"], "left")
        logp = F.ln((F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("t", F.lit(0)) + alpha * F.col("v")))
        return cls(priors, grid.select("label", "word", logp.alias("logp")))

    def posterior(self, docs: DataFrame, id: str, words: str) -> DataFrame:
        """(id, label, p) of every label for every document; words the model does not know count for nothing."""
        ids = docs.select(F.col(id).alias("id")).distinct()
        seen = docs.select(F.col(id).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("c"))
        sums = seen.join(self.words, "word").groupBy("id", "label").agg(F.sum(F.col("c") * F.col("logp")).alias("s"))
        score = ids.crossJoin(F.broadcast(self.priors)).join(sums, ["id", "label"], "left").select("id", "label", (F.col("prior") + F.coalesce("s", F.lit(0.0))).alias("s"))
        per = W.partitionBy("id")
        shifted = score.withColumn("e", F.exp(F.col("s") - F.max("s").over(per)))
        return shifted.select("id", "label", (F.col("e") / F.sum("e").over(per)).alias("p"))

    def predict(self, docs: DataFrame, id: str, words: str) -> DataFrame:
        """(id, label, p) of the likeliest label, the first by name among equals."""
        return self.posterior(docs, id, words).groupBy("id").agg(F.max_by(F.struct("label", "p"), F.struct("p", F.lit(0))).alias("b"), F.max("p").alias("top")).select("id", "b.label", "b.p")


def nb_tables(documents: list[tuple[list[str], str]], alpha: float = 1.0) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The same model for a handful of documents, as dictionaries: (label -> log prior, word -> label -> log probability)."""
    labels = sorted({x for _, x in documents})
    vocab = {w for ws, _ in documents for w in ws}
    counts = {x: {} for x in labels}
    for ws, x in documents:
        for w in ws:
            counts[x][w] = counts[x].get(w, 0) + 1
    prior = {x: math.log(sum(1 for _, y in documents if y == x) / len(documents)) for x in labels}
    size = {x: sum(counts[x].values()) + alpha * len(vocab) for x in labels}
    return prior, {w: {x: math.log((counts[x].get(w, 0) + alpha) / size[x]) for x in labels} for w in vocab}


def labelled_model(lexicon: Lexicon = DEFAULT) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The small model of the labelled sentences."""
    cut = Segmenter(lexicon).cut
    return nb_tables([(cut(text), label) for text, label in lexicon.labelled])


def bayes_score(words: Column | str, model: tuple[dict, dict]) -> Column:
    """struct<label, probabilities, confidence> of an array of words by a small model, whose tables are literals of the plan."""
    prior, logp = model
    labels = list(prior)
    table = constant_map({w: [p[k] for k in labels] for w, p in logp.items()}, "map<string,array<double>>")
    w = F.coalesce(F.col(words) if isinstance(words, str) else words, F.array().cast("array<string>"))
    start = F.array(*(F.lit(prior[k]) for k in labels))
    sums = F.aggregate(w, start, lambda s, x: F.coalesce(F.zip_with(s, F.try_element_at(table, x), lambda p, q: p + q), s))
    shifted = _let(sums, lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))
    p = _let(shifted, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))
    names = F.array(*map(F.lit, labels))
    return _let(p, lambda x: F.struct(
        F.get(names, F.array_position(x, F.array_max(x)).cast("int") - 1).alias("label"),
        F.map_from_arrays(names, F.transform(x, lambda v: F.round(v, 4))).alias("probabilities"), F.round(F.array_max(x), 4).alias("confidence"),
    ))
