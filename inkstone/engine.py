"""One object for all of it: a corpus, analyses whose results are kept, models, pipelines and queries of what was kept."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import constituency
from .models import lexicon as L
from .models.entities import annotate
from .models.kernels import kernels
from .operators import vectors
from .operators.dependency import heads_of
from .operators.sentiment import bayes_score, labelled_model, lexicon_score
from .operators.translate import to_chinese
from .plans.pipeline import PipelineEngine, run_counts
from .sources.store import Registry, Store
from .sources.uploads import decode

#: Tasks that hold no results.
NO_RESULTS = ("corpus", "pipeline_config", "annotation")


class Engine:
    """Analyses of single texts run in this process; those of a corpus are plans over its table.

    `root` is a folder that all executors share. Of two sources of a text, a text given counts before the corpus document named.
    """

    def __init__(self, spark: SparkSession, root: str, lexicon: L.Lexicon = L.DEFAULT):
        self.spark, self.root, self.lexicon = spark, root, lexicon
        self.stores = Registry(spark, f"{root}/tasks")
        self.pipelines = PipelineEngine(lexicon)
        self._k = kernels(lexicon)

    # -- state and names -----------------------------------------------------------------------------------------------

    def status(self) -> dict:
        return {"tasks": [self.stores.store(t).stats() for t in self.stores.tasks()], "stages": len(self.pipelines.stages), "dictionary": len(self.lexicon.dictionary)}

    def meta(self) -> dict:
        """Names of tags, relations, phrases, entity types and polarities."""
        return {"tags": L.TAG_NAMES, "relations": L.RELATION_NAMES, "phrases": L.PHRASE_NAMES, "entities": L.ENTITY_NAMES, "polarities": L.POLARITY_NAMES}

    # -- corpus --------------------------------------------------------------------------------------------------------

    @property
    def corpus(self) -> Store:
        return self.stores.store("corpus")

    def add_document(self, text: str, name: str | None = None) -> str:
        if not (text or "").strip():
            raise ValueError("a document has text")
        now = time.time()
        return self.corpus.insert({"name": name or f"语料_{int(now)}", "text": text, "created_at": now})

    def upload(self, data: bytes, name: str | None = None) -> dict:
        """Add a file's text; its length is that before white space around it is dropped."""
        text, encoding = decode(data)
        if text is None:
            raise ValueError("the file's encoding is not known")
        return {"id": self.add_document(text.strip(), name), "length": len(text), "encoding": encoding}

    def documents(self) -> DataFrame:
        """(id, name, length, created_at, preview), newest first."""
        text = F.get_json_object("body", "$.text")
        rows = self.corpus.all().select("id", F.coalesce(F.get_json_object("body", "$.name"), F.lit("未命名")).alias("name"), F.length(text).alias("length"), F.get_json_object("body", "$.created_at").cast("double").alias("created_at"), F.substring(text, 1, 80).alias("preview"))
        return rows.orderBy(F.desc("created_at"), F.desc("id"))

    def texts(self, ids: Sequence[str] | None = None) -> DataFrame:
        """(id, text) of all documents, or of those named, as often as and in the order (`place`) in which they are named."""
        rows = self.corpus.all().select("id", F.get_json_object("body", "$.text").alias("text"))
        if ids is None:
            return rows
        named = self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "place int, id string")
        return rows.join(F.broadcast(named), "id").select("place", "id", "text").orderBy("place")

    def clean(self, id: str, remove_stop_words: bool = True) -> dict:
        text = " ".join(self._text(None, id).split())
        words = self._k.segmenter.cut(text)
        kept = [w for w in words if not remove_stop_words or w not in self.lexicon.stop_words]
        return {"text": text, "cleaned": " ".join(kept), "tokens": kept, "original_tokens": words, "removed_stopwords": len(words) - len(kept)}

    def _text(self, text: str | None, corpus_id: str | None) -> str:
        if text:
            return text
        found = self.corpus.get(corpus_id) if corpus_id else None
        if not found:
            raise ValueError("neither a text nor a known document")
        return found["text"]

    # -- analyses of one text, kept as results -------------------------------------------------------------------------

    def analyse(self, task: str, text: str | None = None, corpus_id: str | None = None, keep: bool = True, **params) -> dict:
        """The result of segment, pos, parse, ner, sentiment, summary, translate or keywords for one text."""
        made = {"segment": self._segment, "pos": self._pos, "parse": self._parse, "ner": self._ner, "sentiment": self._sentiment, "summary": self._k.summary, "translate": self._translate, "keywords": self._keywords}
        if task not in made:
            raise ValueError(f"no such analysis: {task}")
        source = self._text(text, corpus_id)
        result = made[task](source, **params)
        if keep:
            self.stores.store(task).insert({"text": source, "result": result, "created_at": time.time()} | ({"corpus_id": corpus_id} if corpus_id else {}))
        return result

    def _segment(self, text: str) -> dict:
        words = self._k.segmenter.cut(text)
        return {"words": words, "count": len(words)}

    def _tagged(self, text: str) -> tuple[list[str], list[str]]:
        words = self._k.segmenter.cut(text)
        return words, self._k.tagger.tag(words)

    def _pos(self, text: str) -> dict:
        return {"pos": [list(x) for x in zip(*self._tagged(text))]}

    def _parse(self, text: str) -> dict:
        words, tags = self._tagged(text)
        heads, relations = heads_of(tags)
        tree = json.loads(constituency.as_json(self._k.grammar.parse(words, tags)))
        return {"dependency": {"words": words, "tags": tags, "heads": heads, "relations": relations}, "constituency": {"words": words, "tags": tags, "tree": tree}}

    def _ner(self, text: str) -> dict:
        found = self._k.finder.find(text)
        return {"entities": [dict(zip(("start", "end", "text", "type"), e)) for e in found], "annotated": annotate(text, found)}

    def _sentiment(self, text: str) -> dict:
        words = self.spark.createDataFrame([(self._k.segmenter.cut(text),)], "w array<string>")
        r = words.select(lexicon_score("w", self.lexicon).alias("s"), bayes_score("w", labelled_model(self.lexicon)).alias("b")).first().asDict(True)
        return r["s"] | {"classifier": {k: r["b"][k] for k in ("label", "probabilities")}, "confidence": r["b"]["confidence"]}

    def _translate(self, text: str, direction: str = "zh2en") -> dict:
        zh = direction.lower() in ("zh2en", "zh-en", "zh")
        to = self._k.translator.to_english(text) if zh else self.spark.createDataFrame([(text,)], "t string").select(to_chinese("t", self.lexicon).alias("x")).first().x
        return {"source": text, "translation": to, "direction": "zh->en" if zh else "en->zh", "engine": "dictionary"}

    def _keywords(self, text: str, top_k: int = 10, method: str = "hybrid") -> dict:
        return self._k.keywords(*self._tagged(text), top_k, method)

    def annotate(self, text: str, entities: Sequence[dict], note: str = "") -> str:
        """Keep entities marked by hand."""
        return self.stores.store("annotation").insert({"text": text, "entities": list(entities), "note": note, "created_at": time.time()})

    def annotations(self) -> DataFrame:
        return self.stores.store("annotation").all()

    # -- embeddings ----------------------------------------------------------------------------------------------------

    def _model_path(self) -> str:
        return f"{self.root}/models/embeddings"

    def train_embeddings(self, ids: Sequence[str] | None = None, vocab_size: int = 200, dim: int = 20, window: int = 5, min_count: int = 1) -> dict:
        """Train on the corpus, or documents of it, and save the model."""
        from .models.kernels import segment

        docs = self.texts(ids).select("id", segment("text", self.lexicon).alias("words"))
        model, values = vectors.train_embeddings(docs, "id", "words", vocab_size, dim, window, min_count)
        vectors.save_model(model, values, self._model_path())
        return vectors.model_stats(*self.embeddings())

    def embeddings(self):
        return vectors.load_model(self.spark, self._model_path())

    def word_map(self, clusters: int = 5) -> DataFrame:
        """(word, point, cluster): words on their two principal components, in clusters."""
        model, _ = self.embeddings()
        points, _ = vectors.principal_components(model, "word", "vector", 2)
        labels, _ = vectors.kmeans(model, "word", "vector", clusters)
        return points.join(labels.select("id", "cluster"), "id").withColumnRenamed("id", "word")

    def neighbours(self, word: str, k: int = 10) -> DataFrame:
        """The k nearest words; none for a word that the model does not know."""
        model, _ = self.embeddings()
        return vectors.nearest(model, model.filter(F.col("word") == word), "word", "vector", k).orderBy("rank").select(F.col("neighbour").alias("word"), F.round("similarity", 4).alias("similarity"))

    # -- pipelines -----------------------------------------------------------------------------------------------------

    def save_pipeline(self, config: dict) -> str:
        self.pipelines.build(config)
        return self.stores.store("pipeline_config").insert({"name": config.get("name"), "config": config, "created_at": time.time()})

    def preview(self, config: dict, text: str) -> dict:
        docs = self.spark.createDataFrame([(0, text)], "doc_index int, text string")
        return self.pipelines.build(config).run_batch(docs).first().asDict(True)

    def run_pipeline(self, pipeline: str, ids: Sequence[str] | None = None) -> dict:
        """Run a saved pipeline over the corpus, or documents of it; results are a table of their own, the run a record that names it."""
        saved = self.stores.store("pipeline_config").get(pipeline)
        if not saved:
            raise ValueError(f"no such pipeline: {pipeline}")
        run, started = uuid.uuid4().hex[:12], time.time()
        path = f"{self.root}/runs/{run}"
        self.pipelines.build(saved["config"]).run_batch(self.texts(ids)).write.parquet(path)
        counts = run_counts(self.spark.read.parquet(path)).first()
        record = {"run_id": run, "pipeline_id": pipeline, "batch": True, "doc_count": counts.doc_count, "succeeded": counts.succeeded, "failed": counts.failed, "started": started, "finished": time.time(), "results": path}
        self.stores.store("pipeline_run").insert(record)
        return record

    def run(self, run_id: str) -> tuple[dict, DataFrame] | None:
        """A run's record and its results."""
        rows = self.stores.store("pipeline_run").query([("run_id", "eq", run_id)], limit=1).collect()
        record = json.loads(rows[0].body) if rows else None
        return record and (record, self.spark.read.parquet(record["results"]))

    # -- results -------------------------------------------------------------------------------------------------------

    def result_tasks(self) -> list[dict]:
        return [self.stores.store(t).stats() for t in self.stores.tasks() if t not in NO_RESULTS]

    def results(self, task: str, entity_type: str | None = None, corpus_id: str | None = None, order_by: str | None = None, order: str = "desc", offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page of a task's results, by corpus document, and for ner by the type of some entity in them."""
        where = [("corpus_id", "eq", corpus_id)] if corpus_id else []
        some = F.from_json(F.get_json_object("body", "$.result.entities"), "array<struct<type: string>>")
        of_type = lambda df: df if entity_type is None else df.filter(F.coalesce(F.exists(some, lambda e: e.type == entity_type), F.lit(False)))
        return self.stores.store(task).query(where, order_by, order, offset, limit, keep=of_type)

