"""The analyses as functions of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..models.constituency import as_json
from ..models.kernels import kernels
from ..models.lexicon import DEFAULT, Lexicon
from ..operators.dependency import heads_of


def register_functions(spark: SparkSession, lexicon: Lexicon = DEFAULT) -> None:
    """cut(text), tag(words), to_english(text), heads(tags), phrase_tree(words, tags), and the table function entities(text)."""

    def register(name: str, kind: str, function) -> None:
        spark.udf.register(name, F.udf(function, kind, useArrow=True))

    register("cut", "array<string>", lambda t: None if t is None else kernels(lexicon).segmenter.cut(t))
    register("tag", "array<string>", lambda w: None if w is None else kernels(lexicon).tagger.tag(list(w)))
    register("to_english", "string", lambda t: None if t is None else kernels(lexicon).translator.to_english(t))
    register("heads", "array<int>", lambda t: None if t is None else heads_of(list(t))[0])
    register("phrase_tree", "string", lambda w, t: None if w is None or t is None else as_json(kernels(lexicon).grammar.parse(list(w), list(t))))

    @F.udtf(returnType="start int, end int, text string, type string")
    class Entities:
        def eval(self, text: str):
            yield from kernels(lexicon).finder.find(text)

    spark.udtf.register("entities", Entities)
