"""The sequential analyses as Arrow-batched column functions, with one set of models per Python worker and lexicon."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.dependency import heads_of
from ..operators.graph import pagerank_of, summed_edges
from . import constituency
from .entities import EntityFinder
from .lexicon import DEFAULT, Lexicon
from .segment import Segmenter
from .tagger import Tagger
from .translate import Translator

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def rows(fields: str) -> T.StructType:
    """A struct type of 'name:type' fields; types need no session this way, so workers can import this module."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split(":") for f in fields.split())])


WORDS = T.ArrayType(T.StringType())
ENTITIES = T.ArrayType(rows("start:int end:int text:string type:string"))
TREE = T.ArrayType(rows("node:int parent:int place:int label:string word:string start:int end:int"))
HEADS = T.StructType([T.StructField("heads", T.ArrayType(T.IntegerType())), T.StructField("relations", WORDS)])
KEYWORDS = T.StructType([T.StructField("keywords", T.ArrayType(rows("word:string score:double freq:double"))), T.StructField("method", T.StringType())])
SUMMARY = T.StructType([T.StructField("summary", T.StringType()), T.StructField("sentences", T.ArrayType(rows("index:int text:string score:double selected:boolean"))), T.StructField("top_indices", T.ArrayType(T.IntegerType()))])

# Sentence ends, similarity from which sentences are linked, and weight of a sentence's place.
_SENTENCES = re.compile(r"[。！？!?；;\n]+|(?<=[.!?])\s+")
LEAST_SIMILARITY, PLACE_WEIGHT, WINDOW = 0.01, 0.05, 4
_HAN = re.compile("[一-鿿]")


class Kernels:
    """Models of one lexicon, each made when it is first used. A subclass with other models can be given to every operator."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    @cached_property
    def segmenter(self) -> Segmenter:
        return Segmenter(self.lexicon)

    @cached_property
    def tagger(self) -> Tagger:
        return Tagger(self.lexicon)

    @cached_property
    def finder(self) -> EntityFinder:
        return EntityFinder(self.lexicon, self.segmenter)

    @cached_property
    def translator(self) -> Translator:
        return Translator(self.lexicon, self.segmenter)

    @cached_property
    def grammar(self) -> constituency.Grammar:
        return constituency.Grammar(self.lexicon.grammar, self.lexicon.preference)

    def content_words(self, words: list[str]) -> list[str]:
        stop = self.lexicon.stop_words
        return [w for w in words if w not in stop and (len(w) > 1 or _HAN.search(w)) and w.strip()]

    def keywords(self, words: list[str], tags: list[str], top_k: int | None = 10, method: str = "hybrid") -> dict:
        """Term frequency and centrality in the co-occurrence graph, each over its greatest, averaged for hybrid.

        An unknown method is hybrid; top_k None gives all. Equal scores keep the order of first occurrence. Without candidates: no keywords, no method.
        """
        allowed, stop = set(self.lexicon.key_tags), set(self.lexicon.key_stop)
        chosen = self.content_words([w for w, t in zip(words, tags) if t in allowed and w is not None and w not in stop])
        if not chosen:
            return {"keywords": [], "method": None}
        names = list(dict.fromkeys(chosen))
        number = {w: i for i, w in enumerate(names)}
        at = np.array([number[w] for w in chosen])
        count = np.bincount(at)
        # pairs from left to right, nearer ones first, each in both directions
        i, d = (x.ravel() for x in np.meshgrid(np.arange(len(at)), np.arange(1, WINDOW), indexing="ij"))
        i, d = i[i + d < len(at)], d[i + d < len(at)]
        i, d = i[at[i] != at[i + d]], d[at[i] != at[i + d]]
        a, b = np.stack([at[i], at[i + d]], 1).ravel(), np.stack([at[i + d], at[i]], 1).ravel()
        rank = pagerank_of(len(names), *summed_edges(len(names), a, b, np.repeat(1.0 / d, 2)))
        often, central = count / count.max(), rank / rank.max()
        score = {"tfidf": often, "textrank": central}.get(method, 0.5 * often + 0.5 * central)
        best = np.argsort(-score, kind="stable")[:top_k]
        return {"keywords": [{"word": names[i], "score": round(float(score[i]), 4), "freq": float(count[i])} for i in best], "method": method}

    def summary(self, text: str, ratio: float = 0.3, max_sentences: int | None = None, place_weight: float = 1.0) -> dict:
        """The most central sentences, in their order; centrality from TF-IDF cosines, with a bonus for early places.

        One shape for all: no sentence gives an empty summary, a single one is its own summary with score 1.
        """
        parts = [p for p in (x.strip() for x in _SENTENCES.split(text or "")) if p]
        if len(parts) < 2:
            return {"summary": parts[0] if parts else "", "sentences": [{"index": 0, "text": p, "score": 1.0, "selected": True} for p in parts], "top_indices": list(range(len(parts)))}
        n = len(parts)
        docs = [self.content_words(self.segmenter.cut(p)) for p in parts]
        posted: dict[str, dict[int, int]] = {}
        for i, d in enumerate(docs):
            for w in d:
                posted.setdefault(w, {}).setdefault(i, 0)
                posted[w][i] += 1
        rows: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in range(n)]
        norm = np.zeros(n)
        for where in posted.values():
            ids = np.fromiter(where, int, len(where))
            weights = np.array([c / len(docs[i]) for i, c in where.items()]) * (math.log((n + 1) / (len(where) + 1)) + 1)
            norm[ids] += weights**2
            for i, w in zip(ids, weights):
                rows[i].append((ids, weights, w))
        norm = np.sqrt(norm)
        src, dst, weight = [], [], []
        for i in range(n):
            if not rows[i]:
                continue
            dot = np.zeros(n)
            for ids, weights, w in rows[i]:
                dot[ids] += weights * w
            near = np.flatnonzero(dot)
            near = near[near != i]
            similar = dot[near] / (norm[near] * norm[i])
            keep = similar > LEAST_SIMILARITY
            src.append(np.full(int(keep.sum()), i))
            dst.append(near[keep])
            weight.append(similar[keep])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        score = pagerank_of(n, join(src, int), join(dst, int), join(weight, float)) + PLACE_WEIGHT * place_weight * np.exp(-np.arange(n) / n * 2)
        k = min(n, max(1, int(n * ratio)) if max_sentences is None else max_sentences)
        chosen = sorted(int(i) for i in np.argsort(-score, kind="stable")[:k])
        return {"summary": "".join(parts[i] + "。" for i in chosen), "sentences": [{"index": i, "text": p, "score": round(float(score[i]), 4), "selected": i in set(chosen)} for i, p in enumerate(parts)], "top_indices": chosen}


_made: dict[tuple[str, str], Kernels] = {}


def kernels(lexicon: Lexicon, models: type[Kernels] = Kernels) -> Kernels:
    key = lexicon.fingerprint, models.__qualname__
    if key not in _made:
        _made[key] = models(lexicon)
    return _made[key]


def column_function(kernel: Callable, kind: T.DataType, lexicon: Lexicon = DEFAULT, safe: bool = False, models: type[Kernels] = Kernels) -> Callable[..., Column]:
    """A column function of kernel(kernels, *values); null first values give null.

    safe: the column is struct<value, error>, so that one row's exception is that row's error and nothing else.
    """
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())]) if safe else kind

    def one(k: Kernels, values: tuple):
        if values[0] is None:
            return {"value": None, "error": None} if safe else None
        if not safe:
            return kernel(k, *values)
        try:
            return {"value": kernel(k, *values), "error": None}
        except Exception as x:
            return {"value": None, "error": f"{type(x).__name__}: {x}"}

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        k, arrow = kernels(lexicon, models), to_arrow_type(result)
        for columns in batches:
            yield pa.array([one(k, v) for v in zip(*(c.to_pylist() for c in columns))], arrow)

    # Spark decides by the annotations what a function is given
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, result)
    # a second column makes Spark hand over tuples in every case
    return lambda *columns: udf(*columns, *([F.lit(0)] if len(columns) == 1 else []))


def segment(text, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, t, *_: k.segmenter.cut(t), WORDS, lexicon, safe)(text)


def pos_tags(words, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, w, *_: k.tagger.tag(w), WORDS, lexicon, safe)(words)


def entities(text, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, t, *_: k.finder.find(t), ENTITIES, lexicon, safe)(text)


def phrase_tree(words, tags, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, w, t: k.grammar.parse(w, t), TREE, lexicon, safe)(words, tags)


def dependency_arrays(words, tags, safe: bool = False) -> Column:
    return column_function(lambda k, w, t: dict(zip(("heads", "relations"), heads_of(t))), HEADS, DEFAULT, safe)(words, tags)


def to_english(text, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, t, *_: k.translator.to_english(t), T.StringType(), lexicon, safe)(text)


def keywords(words, tags, top_k: int | None = 10, method: str = "hybrid", lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, w, t: k.keywords(w, t, top_k, method), KEYWORDS, lexicon, safe)(words, tags)


def summary(text, ratio: float = 0.3, max_sentences: int | None = None, place_weight: float = 1.0, lexicon: Lexicon = DEFAULT, safe: bool = False) -> Column:
    return column_function(lambda k, t, *_: k.summary(t, ratio, max_sentences, place_weight), SUMMARY, lexicon, safe)(text)
