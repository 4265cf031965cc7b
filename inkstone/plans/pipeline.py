"""Pipelines of analysis stages, compiled to one DataFrame plan.

A stage adds columns. Stages are put in order by what they need: explicit dependencies, and the producers of their input
columns. Every row carries a map of the errors its stages met; a failed stage leaves its column null for that row only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models import kernels as K
from ..models.lexicon import DEFAULT, Lexicon
from ..operators.dependency import heads_of
from ..operators.sentiment import bayes_score, labelled_model, lexicon_score
from ..operators.translate import to_chinese

ERRORS = "errors"


class PipelineError(ValueError):
    pass


@dataclass(frozen=True)
class Stage:
    """name, what it makes of a frame, and the columns it reads and adds."""

    name: str
    run: Callable[[DataFrame, dict], DataFrame]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    deps: tuple[str, ...] = ()
    #: Several stages that can run in one pass: takes (stage name, params) pairs and whether words are wanted later.
    together: Callable[[DataFrame, list[tuple[str, dict]], bool], DataFrame] | None = None

    def describe(self) -> dict:
        return {"name": self.name, "inputs": list(self.inputs), "outputs": list(self.outputs or (self.name,)), "params": dict(self.params)}


def source_text(df: DataFrame) -> Column:
    """The cleaned text, or the text itself where there is none or it is blank."""
    return F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.col("text")) if "clean_text" in df.columns else F.col("text")


def with_errors(df: DataFrame) -> DataFrame:
    return df if ERRORS in df.columns else df.withColumn(ERRORS, F.create_map().cast("map<string,string>"))


# -- stages of one document, which run together in one Arrow function --------------------------------------------------


class Document:
    """One document on its way through the stages of a function: its texts, and its words and tags once somebody asked."""

    def __init__(self, k: K.Kernels, text: str, clean_text: str | None, words: list[str] | None):
        self.k, self.text, self.clean_text = k, text, clean_text
        self._words, self._tags = words, None

    @property
    def source(self) -> str:
        return self.clean_text or self.text

    @property
    def words(self) -> list[str]:
        if self._words is None:
            self._words = self.k.segmenter.cut(self.source)
        return self._words

    @property
    def tags(self) -> list[str]:
        if self._tags is None:
            self._tags = self.k.tagger.tag(self.words)
        return self._tags


def _clean(d: Document, p: dict) -> str:
    text = " ".join(d.text.split())
    if p.get("remove_stopwords", True):
        stop = d.k.lexicon.stop_words
        text = " ".join(w for w in d.k.segmenter.cut(text) if w not in stop)
    d.clean_text = text
    return text


def _segment(d: Document, p: dict) -> list[str]:
    return d.words


def _pos(d: Document, p: dict) -> list[tuple[str, str]]:
    return list(zip(d.words, d.tags))


def _ner(d: Document, p: dict) -> list[tuple]:
    # the words of a document are those of its source text, which entities by form are looked for in
    return d.k.finder.find(d.source, d.words)


def _keywords(d: Document, p: dict) -> dict:
    return d.k.keywords(d.words, d.tags, p.get("top_k", 10), p.get("method", "hybrid"))


def _summary(d: Document, p: dict) -> dict:
    return d.k.summary(d.source, p.get("ratio", 0.3), p.get("max_sentences"), p.get("position_weight", 1.0))


def _to_english(d: Document, p: dict) -> tuple:
    return d.source, d.k.translator.to_english(d.source, d.words), "zh->en", "dictionary"


def _parse(d: Document, p: dict) -> dict:
    heads, relations = heads_of(d.tags)
    return {"dependency": (d.words, d.tags, heads, relations), "constituency": d.k.grammar.parse(d.words, d.tags)}


_PAIRS = T.ArrayType(K.rows("word:string tag:string"))
_TRANSLATION = K.rows("source:string translation:string direction:string engine:string")
_PARSE = T.StructType([T.StructField("dependency", T.StructType([T.StructField("words", K.WORDS), T.StructField("tags", K.WORDS), *K.HEADS.fields])), T.StructField("constituency", K.TREE)])
#: (stage, column) -> what makes it of a document, and its type.
OF_DOCUMENT = {
    "clean": ("clean_text", _clean, T.StringType()),
    "segment": ("words", _segment, K.WORDS),
    "pos": ("pos", _pos, _PAIRS),
    "ner": ("ner", _ner, K.ENTITIES),
    "keywords": ("keywords", _keywords, K.KEYWORDS),
    "summary": ("summary", _summary, K.SUMMARY),
    "translate": ("translation", _to_english, _TRANSLATION),
    "parse": ("parse", _parse, _PARSE),
}


def run_together(df: DataFrame, chosen: list[tuple[str, dict]], lexicon: Lexicon, models: type[K.Kernels] = K.Kernels, words: bool = False) -> DataFrame:
    """The outputs of several stages from one pass over the documents, which are cut and tagged once for all of them.

    words: also add the words as `_words`, for a later stage. A stage's exception becomes the row's error under its name.
    """
    df = with_errors(df)
    steps = [(name, *OF_DOCUMENT[name][:2], p) for name, p in chosen]
    made = {OF_DOCUMENT[name][0]: OF_DOCUMENT[name][2] for name, _ in chosen}
    kind = T.StructType([*(T.StructField(c, t) for c, t in made.items()), *([T.StructField("_words", K.WORDS)] if words else []), T.StructField(ERRORS, T.MapType(T.StringType(), T.StringType()))])

    def run(k: K.Kernels, text: str, clean_text: str | None, given: list[str] | None) -> dict:
        d = Document(k, text, clean_text, given)
        out: dict = {}
        errors: dict[str, str] = {}
        for name, column, make, p in steps:
            try:
                out[column] = make(d, p)
            except Exception as x:
                errors[name] = f"{type(x).__name__}: {x}"
        if words:
            try:
                out["_words"] = d.words
            except Exception as x:
                errors["words"] = f"{type(x).__name__}: {x}"
        return {**out, ERRORS: list(errors.items())}

    known = [F.col(c) if c in df.columns and c not in made else F.lit(None).cast(t) for c, t in (("clean_text", "string"), ("words", "array<string>"))]
    df = df.withColumn("_made", K.column_function(run, kind, lexicon, models=models)("text", *known))
    failed = F.when(F.size(f"_made.{ERRORS}") > 0, F.map_concat(ERRORS, f"_made.{ERRORS}")).otherwise(F.col(ERRORS))
    return df.withColumns({**{c: F.col(f"_made.{c}") for c in kind.fieldNames() if c != ERRORS}, ERRORS: failed}).drop("_made")


# -- stages that are expressions ---------------------------------------------------------------------------------------


def with_result(df: DataFrame, stage: str, out: str, result: Column) -> DataFrame:
    """Take a struct<value, error> column apart; the error goes to the row's error map."""
    df = df.withColumn("_result", result)
    failed = F.when(F.col("_result.error").isNotNull(), F.map_concat(ERRORS, F.create_map(F.lit(stage), F.col("_result.error")))).otherwise(F.col(ERRORS))
    return df.withColumns({out: F.col("_result.value"), ERRORS: failed}).drop("_result")


def _sentiment(df: DataFrame, p: dict, lexicon: Lexicon, models: type[K.Kernels]) -> DataFrame:
    words = next((c for c in ("words", "_words") if c in df.columns), None)
    if words is None:
        df, words = run_together(df, [], lexicon, models, words=True), "_words"
    df = df.withColumns({"_lex": lexicon_score(words, lexicon), "_bayes": bayes_score(words, labelled_model(lexicon))})
    both = F.struct("_lex.*", F.struct("_bayes.label", "_bayes.probabilities").alias("classifier"), "_bayes.confidence")
    return df.withColumn("sentiment", F.when(F.col(words).isNotNull(), both)).drop("_lex", "_bayes")


def _to_chinese(df: DataFrame, p: dict, lexicon: Lexicon, models: type[K.Kernels]) -> DataFrame:
    text = source_text(df)
    made = F.struct(text.alias("source"), to_chinese(text, lexicon).alias("translation"), F.lit("en->zh").alias("direction"), F.lit("dictionary").alias("engine"))
    return df.withColumn("translation", F.when(text.isNotNull(), made))


def _of_document(stage: str, p: dict) -> bool:
    """Whether a stage with these parameters works on one document at a time."""
    if stage == "translate":
        return p.get("direction", "zh2en").lower() in ("zh2en", "zh-en", "zh")
    return stage in OF_DOCUMENT


_BOTH = ("text", "clean_text")
#: Name, columns it reads, column it adds, parameters.
BUILT_IN = (
    ("clean", ("text",), "clean_text", {"remove_stopwords": True}),
    ("segment", _BOTH, "words", {}),
    ("pos", _BOTH, "pos", {}),
    ("ner", _BOTH, "ner", {}),
    ("sentiment", _BOTH, "sentiment", {}),
    ("keywords", _BOTH, "keywords", {"top_k": 10}),
    ("summary", _BOTH, "summary", {"ratio": 0.3}),
    ("translate", _BOTH, "translation", {"direction": "zh2en"}),
    ("parse", _BOTH, "parse", {}),
)


@dataclass(frozen=True)
class Pipeline:
    """Stages in an order in which each comes after those it needs; building one refuses unknown dependencies and cycles."""

    stages: tuple[Stage, ...]
    needs: dict[str, frozenset[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, stages: list[Stage]) -> "Pipeline":
        by_name = {s.name: s for s in stages}
        if not by_name:
            raise PipelineError("a pipeline has at least one stage")
        maker = {out: s.name for s in by_name.values() for out in (s.outputs or (s.name,))}
        needs = {}
        for s in by_name.values():
            unknown = [d for d in s.deps if d not in by_name]
            if unknown:
                raise PipelineError(f"{s.name} depends on stages that are not there: {', '.join(unknown)}")
            needs[s.name] = {*s.deps, *(maker[i] for i in s.inputs if i in maker and maker[i] != s.name)}
        order: list[Stage] = []
        fixed = {n: frozenset(d) for n, d in needs.items()}
        while needs:
            ready = [n for n, d in needs.items() if not d]
            if not ready:
                raise PipelineError(f"stages depend on one another: {', '.join(sorted(needs))}")
            for n in ready:
                order.append(by_name[n])
                del needs[n]
            for d in needs.values():
                d.difference_update(ready)
        return cls(tuple(order), fixed)

    def describe(self) -> list[dict]:
        return [s.describe() for s in self.stages]

    def _groups(self) -> list[list[Stage]]:
        """Stages in groups to be run one after the other, those that can run in one pass in as few groups as needs allow."""
        left, done, groups = list(self.stages), set(), []
        while left:
            group: list[Stage] = []
            for s in left:
                inside = {x.name for x in group}
                if s.together and _of_document(s.name, s.params) and self.needs.get(s.name, frozenset()) <= done | inside:
                    group.append(s)
            # stages that cannot run together come one at a time
            group = group or [left[0]]
            done |= {s.name for s in group}
            left = [s for s in left if s.name not in done]
            groups.append(group)
        return groups

    def run(self, docs: DataFrame) -> DataFrame:
        """The frame with every stage's outputs and the errors map; lazily, as one plan. `text` is the column to analyse."""
        df = with_errors(docs)
        groups = self._groups()
        for i, group in enumerate(groups):
            if group[0].together and _of_document(group[0].name, group[0].params):
                later = any(s.name == "sentiment" for g in groups[i + 1 :] for s in g) and "segment" not in {s.name for s in group}
                df = group[0].together(df, [(s.name, s.params) for s in group], later and "words" not in df.columns)
            else:
                df = group[0].run(df, group[0].params)
        return df.drop("_words")

    def run_batch(self, docs: DataFrame) -> DataFrame:
        """(id, ok, error, output): a row per document, whose failed stages, if any, are named in error."""
        done = self.run(docs)
        outs = [o for s in self.stages for o in (s.outputs or (s.name,)) if o in done.columns]
        kept = [c for c in docs.columns if c not in outs and c != ERRORS]
        error = F.array_join(F.transform(F.array_sort(F.map_entries(ERRORS)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "; ")
        return done.select(*kept, (F.size(ERRORS) == 0).alias("ok"), F.nullif(error, F.lit("")).alias("error"), F.struct(*dict.fromkeys(outs)).alias("output"))


class PipelineEngine:
    """Stages by name, and pipelines made of configurations {name, stages: [{name, params, deps}]}."""

    def __init__(self, lexicon: Lexicon = DEFAULT, models: type[K.Kernels] = K.Kernels):
        self.stages: dict[str, Stage] = {}

        def together(df: DataFrame, chosen: list[tuple[str, dict]], words: bool = False) -> DataFrame:
            return run_together(df, chosen, lexicon, models, words)

        for name, inputs, output, params in BUILT_IN:
            def run(df: DataFrame, p: dict, name: str = name) -> DataFrame:
                if _of_document(name, p):
                    return together(df, [(name, p)])
                return {"sentiment": _sentiment, "translate": _to_chinese}[name](df, p, lexicon, models)

            self.register(Stage(name, run, inputs, (output,), params, together=together))

    def register(self, stage: Stage) -> None:
        self.stages[stage.name] = stage

    def register_rows(self, name: str, function: Callable[[dict, dict], object], result: str | T.DataType, inputs: tuple[str, ...] = ("text",), params: dict | None = None) -> None:
        """A stage of a function of one row's inputs and the parameters; its exceptions are the row's errors."""
        kind = T._parse_datatype_string(result) if isinstance(result, str) else result

        def run(df: DataFrame, p: dict) -> DataFrame:
            read = [c for c in inputs if c in df.columns]
            present = F.lit(True)
            apply = K.column_function(lambda k, there, *values: function(dict(zip(read, values)), p), kind, DEFAULT, safe=True)
            return with_result(df, name, name, apply(present, *read))

        self.register(Stage(name, run, inputs, (name,), params or {}))

    def list_stages(self) -> list[dict]:
        return [s.describe() for s in self.stages.values()]

    def build(self, config: dict) -> Pipeline:
        """Given parameters replace a stage's defaults; of stages named twice, the later one counts."""
        chosen: dict[str, Stage] = {}
        for c in config.get("stages") or []:
            if c.get("name") not in self.stages:
                raise PipelineError(f"no such stage: {c.get('name')}")
            stage = self.stages[c["name"]]
            chosen[stage.name] = replace(stage, params=dict(c.get("params") or stage.params), deps=tuple(c.get("deps") or ()))
        return Pipeline.of(list(chosen.values()))


def run_counts(results: DataFrame) -> DataFrame:
    """(doc_count, succeeded, failed) of run_batch rows."""
    return results.agg(F.count("*").alias("doc_count"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def cleaned(words: Column | str, stop: list[str]) -> Column:
    """struct<cleaned, tokens, original_tokens, removed> of the words of a text."""
    words = F.col(words) if isinstance(words, str) else words
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
    return F.struct(F.array_join(kept, " ").alias("cleaned"), kept.alias("tokens"), words.alias("original_tokens"), (F.size(words) - F.size(kept)).alias("removed"))
