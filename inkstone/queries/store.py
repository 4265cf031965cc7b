"""Queries of the document store over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import scratch_path, table
from ..sources import store
from ..sources.uploads import decode_files
from . import model_sql as M
from .text import _strip

#: Corpus documents that engine_texts asks for.
ASKED = ("corpus_5", "corpus_2", "nowhere", "corpus_5", "corpus_1")
TASKS = ("corpus", "segment", "keywords", "ner", "parse", "translation", "pipeline_run")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def store_filter_sort_page(spark: SparkSession, d: str) -> DataFrame:
    where = [("props.k", "gte", 20), ("event_type", "in", ["click", "view", "purchase"]), ("user_id", "ne", 8)]
    return store.query(_events(spark, d), where, "value", "desc", 50, 500, "event_id").select("event_id", "user_id", "event_type", "value")


CONDITIONS = {
    "is_eq": ("event_type", "eq", "click"), "is_ne": ("event_type", "ne", "click"), "is_in": ("event_type", "in", ["click", None]), "is_not_in": ("event_type", "not_in", ["click", "view"]),
    "has": ("event_type", "contains", "ic"), "starts": ("event_type", "startswith", "cl"), "is_gt": ("value", "gt", 10), "is_gte": ("props.k", "gte", 50), "is_lt": ("value", "lt", 10.5), "is_lte": ("props.k", "lte", 50),
    "no_field": ("props.missing", "eq", None), "other_type": ("event_type", "gt", 5), "within": ("event_type", "in", "click view"),
}


def store_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Every operator on every event, nested JSON fields, missing fields and wrong types included."""
    e = _events(spark, d)
    return e.select("event_id", *(store.predicate(e, *c).alias(n) for n, c in CONDITIONS.items()))


def store_live_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of each corpus document, without those whose newest state is a tombstone."""
    c = table(spark, d, "corpus").select("id", "name", "text", "_created", "_deleted")
    gone = F.coalesce("_deleted", F.lit(False))
    order = F.struct(F.coalesce("_created", F.lit(float("-inf"))), gone, F.coalesce("text", F.lit("")))
    return store.newest_live(c, "id", order, gone).select("id", F.length("text").alias("length"), "_created")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct ids and shards of 100 of each task."""
    parts = [table(spark, d, t).groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("ids")).select(F.lit(t).alias("task"), "total", "ids", F.ceil(F.col("ids") / 100).cast("long").alias("shards")) for t in TASKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_listing(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(table(spark, d, "corpus").dropDuplicates(["id", "text", "created_at", "_deleted", "name"]))


def resolved_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each segment request's own text, or that of its corpus document."""
    requests = table(spark, d, "segment").select("id", "text", "corpus_id").dropDuplicates(["id"])
    return store.texts_of(requests, table(spark, d, "corpus")).select("id", F.length("resolved").alias("length"), F.md5("resolved").alias("digest"))


def results_with_type(spark: SparkSession, d: str) -> DataFrame:
    """The ner results in which some entity has a type, as a filter on the nested array."""
    once = table(spark, d, "ner").dropDuplicates(["id"])
    return once.filter(F.exists("result.entities", lambda e: F.upper(e.type) == "PERSON")).select("id", F.size("result.entities").alias("entities"), "created_at")


def result_tasks(spark: SparkSession, d: str) -> DataFrame:
    """All result rows by task and corpus document, without the corpus itself."""
    names = [t for t in TASKS if t not in ("corpus", "pipeline_run")]
    parts = [table(spark, d, t).select(F.lit(t).alias("task"), "id", "corpus_id") for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("task", "corpus_id").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id"))


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the results of each batch run say succeeded and failed, beside the counts stored with it."""
    once = table(spark, d, "pipeline_run").dropDuplicates(["id"]).filter("results is not null")
    ok = F.size(F.filter("results", lambda r: F.coalesce(r.ok, F.lit(False))))
    return once.select("id", F.size("results").alias("docs"), ok.alias("ok"), (F.size("results") - ok).alias("not_ok"), F.col("succeeded").alias("stored_ok"), F.col("failed").alias("stored_not_ok"))


def upload_decode(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploaded bytes, in turn of UTF-8, GB18030 and UTF-16, decoded again."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            data = [t.encode(("utf-8", "gb18030", "utf-16")[i % 3]) for i, t in zip(ids, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(map(str, ids)), pa.array(data, pa.binary())], ["path", "content"])

    found = decode_files(docs.mapInArrow(encode, "path string, content binary"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "length", F.md5("text").alias("digest"), F.when(F.col("path").cast("long") % 3 == 2, F.col("encoding")).alias("encoding"))


def _translations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translation").filter("id is not null").groupBy("id").agg(F.max("text").alias("text"), F.max("corpus_id").alias("corpus_id"))


def store_natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Events as records of a store, by a number within a nested field: 9 before 10, a page of those of one type."""
    s = store.Store(spark, scratch_path(spark, "store"), "events")
    s.insert_frame(_events(spark, d).orderBy("event_id").select("event_id", "event_type", "value", F.struct(F.from_json("props", "k double").k.alias("k")).alias("props")))
    page = s.query([("event_type", "eq", "view")], "props.k", "desc", 20, 400)
    return page.select(F.get_json_object("body", "$.event_id").cast("long").alias("event_id"), F.get_json_object("body", "$.props.k").cast("double").alias("k"))


def store_shards(spark: SparkSession, d: str) -> DataFrame:
    """Translation records put into a store, two deleted, exported to shards of 100 and read back with their places."""
    path = scratch_path(spark, "store")
    s = store.Store(spark, f"{path}/tasks", "translation", 100)
    s.insert_frame(_translations(spark, d).orderBy("id"))
    for id in ("translate_3", "translate_4"):
        s.delete(id)
    s.merge(f"{path}/shards")
    return store.read_json_shards(spark, f"{path}/shards", "id string, text string").select("shard", F.col("seq").cast("int").alias("place"), "id", F.length("text").alias("length"))


def store_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks of a registry: what it says of them, and of their compaction, with a deleted and a fetched record each."""
    r = store.Registry(spark, scratch_path(spark, "registry"), 50)
    for name in ("keywords", "ner"):
        rows = table(spark, d, name).filter("id is not null").groupBy("id").agg(F.max("text").alias("text"))
        r.store(name).insert_frame(rows)
        added = r.store(name).insert({"text": name})
        r.store(name).delete(rows.agg(F.min("id")).first()[0])
        assert r.store(name).get(added)["text"] == name
    stats = [r.store(t).stats() for t in r.tasks()]
    packed = {c["task"]: c for c in r.compact_all()}
    return spark.createDataFrame([(x["task"], x["shard_size"], x["total"], x["shard_count"], packed[x["task"]]["after_shards"], packed[x["task"]]["records"]) for x in stats], "task string, shard_size int, total int, shards int, after_shards int, records int")


def engine_results(spark: SparkSession, d: str) -> DataFrame:
    """The subjects' descriptions (a fixed table of a few rows) cut, tagged and looked through for entities by the engine, and its results read back."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    for r in table(spark, d, "subjects").orderBy("subject").collect():
        if r.description:
            for task in ("segment", "pos", "ner"):
                engine.analyse(task, text=r.description, corpus_id=r.subject)
    out = engine.results("segment", order_by="text").select(F.lit("segment").alias("task"), F.get_json_object("body", "$.corpus_id").alias("corpus_id"), F.get_json_object("body", "$.result.count").cast("int").alias("n"))
    tags = F.from_json(F.get_json_object("body", "$.result.pos"), "array<array<string>>")
    return out.unionByName(engine.results("pos").select(F.lit("pos").alias("task"), F.get_json_object("body", "$.corpus_id").alias("corpus_id"), F.size(tags).alias("n")))


def engine_documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus put into an engine: its listing."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    rows = table(spark, d, "corpus").filter("text is not null and id is not null").groupBy("id").agg(F.max_by(F.struct("name", "text", "created_at"), F.struct("text", "created_at")).alias("r")).select("id", "r.*")
    engine.corpus.insert_frame(rows)
    return engine.documents()


def engine_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of corpus documents named in an order of their own, one of them twice and one unknown."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    rows = table(spark, d, "corpus").filter("text is not null and id is not null").groupBy("id").agg(F.max("text").alias("text"))
    engine.corpus.insert_frame(rows)
    return engine.texts([*ASKED]).select("place", "id", F.length("text").alias("length"))


def engine_uploads(spark: SparkSession, d: str) -> DataFrame:
    """The subjects' descriptions (a fixed table of a few rows) uploaded as bytes of several encodings: their texts and lengths."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    rows = table(spark, d, "subjects").filter("description is not null and trim(description) <> ''").orderBy("subject").collect()
    sent = {engine.upload(f" {r.description}\n".encode(("utf-8", "gb18030", "utf-16")[i % 3]), r.subject)["id"]: i for i, r in enumerate(rows)}
    assert len(sent) == len(rows)
    return engine.documents().select("name", "length", "preview")


def engine_entity_results(spark: SparkSession, d: str) -> DataFrame:
    """Stored ner results in an engine: a page of those with some person, in order of their time."""
    engine = Engine(spark, scratch_path(spark, "engine"))
    rows = table(spark, d, "ner").filter("id is not null and created_at is not null").groupBy("id").agg(F.max_by(F.struct("text", "result", "created_at"), F.struct("created_at", "_created")).alias("r"))
    engine.stores.store("ner").insert_frame(rows.orderBy("id").select("id", "r.*"))
    found = engine.results("ner", entity_type="PERSON", order_by="created_at", order="desc", offset=5, limit=150)
    return found.select("id", F.get_json_object("body", "$.created_at").cast("double").alias("created_at"))


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Translation records put into a store, two of them deleted, compacted, and read back in order."""
    s = store.Store(spark, scratch_path(spark, "store"), "translation", 10_000)
    s.insert_frame(_translations(spark, d))
    for id in ("translate_1", "translate_2"):
        s.delete(id)
    s.compact()
    return s.query([("text", "ne", None)]).select("id", F.length(F.get_json_object("body", "$.text")).alias("length"))


QUERIES = {f.__name__: f for f in (store_filter_sort_page, store_predicates, store_live_after_delete, store_stats, corpus_listing, resolved_texts, results_with_type, result_tasks, run_outcomes, upload_decode, store_roundtrip, store_natural_order, store_shards, store_tasks, engine_results, engine_documents, engine_texts, engine_uploads, engine_entity_results)}

ORACLES = {
    "store_filter_sort_page": """
        SELECT event_id, user_id, event_type, value FROM events
        WHERE TRY_CAST(props ->> '$.k' AS DOUBLE) >= 20 AND event_type IN ('click', 'view', 'purchase') AND user_id IS DISTINCT FROM 8
        ORDER BY value DESC NULLS LAST, event_id LIMIT 500 OFFSET 50""",
    "store_predicates": """
        SELECT event_id, event_type IS NOT DISTINCT FROM 'click' AS is_eq, event_type IS DISTINCT FROM 'click' AS is_ne, coalesce(event_type = 'click', true) AS is_in,
            coalesce(event_type NOT IN ('click', 'view'), true) AS is_not_in, coalesce(contains(event_type, 'ic'), false) AS has, coalesce(starts_with(event_type, 'cl'), false) AS starts,
            coalesce(value > 10, false) AS is_gt, coalesce(CAST(props ->> '$.k' AS DOUBLE) >= 50, false) AS is_gte, coalesce(value < 10.5, false) AS is_lt, coalesce(CAST(props ->> '$.k' AS DOUBLE) <= 50, false) AS is_lte,
            (props ->> '$.missing') IS NULL AS no_field, false AS other_type, coalesce(contains('click view', event_type), false) AS within
        FROM events""",
    "store_live_after_delete": """
        WITH r AS (SELECT id, text, _created, coalesce(_deleted, false) AS gone, row_number() OVER (PARTITION BY id ORDER BY _created DESC NULLS LAST, coalesce(_deleted, false) DESC, coalesce(text, '') DESC) AS n FROM corpus)
        SELECT id, length(text)::INT AS length, _created FROM r WHERE n = 1 AND NOT gone""",
    "store_stats": " UNION ALL ".join(f"SELECT '{t}' AS task, count(*) AS total, count(DISTINCT coalesce(id, '~')) AS ids, ceil(count(DISTINCT coalesce(id, '~')) / 100)::BIGINT AS shards FROM {t}" for t in TASKS),
    "corpus_listing": """
        SELECT DISTINCT id, coalesce(name, '未命名') AS name, length(text)::INT AS length, created_at, substring(text, 1, 80) AS preview FROM corpus WHERE NOT coalesce(_deleted, false) AND text IS NOT NULL""",
    "resolved_texts": """
        WITH q AS (SELECT id, any_value(text) AS text, any_value(corpus_id) AS corpus_id FROM segment GROUP BY id),
        c AS (SELECT id, max(text) AS text FROM corpus WHERE NOT coalesce(_deleted, false) GROUP BY id)
        SELECT q.id, length(coalesce(nullif(q.text, ''), c.text))::INT AS length, md5(coalesce(nullif(q.text, ''), c.text)) AS digest FROM q LEFT JOIN c ON q.corpus_id = c.id""",
    "results_with_type": """
        WITH o AS (SELECT id, any_value(result.entities) AS e, any_value(created_at) AS created_at FROM ner GROUP BY id)
        SELECT id, len(e)::INT AS entities, created_at FROM o WHERE len(list_filter(e, lambda x: upper(x.type) = 'PERSON')) > 0""",
    "result_tasks": "SELECT task, corpus_id, count(*) AS n_rows, min(id) AS first_id FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS task, id, corpus_id FROM {t}" for t in TASKS if t not in ("corpus", "pipeline_run")) + ") GROUP BY task, corpus_id",
    "run_outcomes": """
        WITH o AS (SELECT DISTINCT ON (id) id, results, succeeded, failed FROM pipeline_run WHERE results IS NOT NULL),
        k AS (SELECT id, results, len(list_filter(results, lambda r: coalesce(r.ok, false)))::INT AS ok, succeeded, failed FROM o)
        SELECT id, len(results)::INT AS docs, ok, (len(results) - ok)::INT AS not_ok, succeeded AS stored_ok, failed AS stored_not_ok FROM k""",
    "upload_decode": f"SELECT doc_id, length(text)::INT AS length, md5({_strip('text')}) AS digest, CASE WHEN doc_id % 3 = 2 THEN 'utf-16' END AS encoding FROM documents WHERE text IS NOT NULL",
    "store_natural_order": """
        SELECT event_id, TRY_CAST(props ->> '$.k' AS DOUBLE) AS k FROM events WHERE event_type = 'view' ORDER BY k DESC NULLS LAST, event_id LIMIT 400 OFFSET 20""",
    "store_shards": """
        WITH r AS (SELECT id, max(text) AS text FROM translation WHERE id IS NOT NULL AND id NOT IN ('translate_3', 'translate_4') GROUP BY id), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM r)
        SELECT printf('shard_%06d.json', n // 100) AS shard, (n % 100)::INT AS place, id, length(text)::INT AS length FROM n""",
    "store_tasks": " UNION ALL ".join(f"SELECT '{t}' AS task, 50 AS shard_size, n AS total, ceil(n / 50)::INT AS shards, ceil(n / 50)::INT AS after_shards, n AS records FROM (SELECT count(DISTINCT id)::INT AS n FROM {t})" for t in ("keywords", "ner")),
    "engine_results": f"""
        WITH RECURSIVE {M.segmented("SELECT subject AS id, description AS text FROM subjects WHERE description <> ''")}, c AS (SELECT source.id, count(word)::INT AS n FROM source LEFT JOIN words USING (id) GROUP BY source.id)
        SELECT 'segment' AS task, id AS corpus_id, n FROM c UNION ALL SELECT 'pos', id, n FROM c""",
    "engine_documents": """
        SELECT id, coalesce(name, '未命名') AS name, length(text)::INT AS length, created_at, substring(text, 1, 80) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY text DESC, created_at DESC NULLS LAST) AS r FROM corpus WHERE text IS NOT NULL AND id IS NOT NULL) WHERE r = 1""",
    "engine_texts": f"""
        WITH asked(place, id) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(ASKED))}), c AS (SELECT id, max(text) AS text FROM corpus WHERE text IS NOT NULL GROUP BY id)
        SELECT place, id, length(text)::INT AS length FROM asked JOIN c USING (id)""",
    "engine_uploads": f"""
        SELECT subject AS name, length({_strip('description')})::INT AS length, substring({_strip('description')}, 1, 80) AS preview FROM subjects WHERE trim(description) <> ''""",
    "engine_entity_results": """
        WITH o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, _created DESC NULLS LAST) AS r FROM ner WHERE id IS NOT NULL AND created_at IS NOT NULL)
        SELECT id, created_at FROM o WHERE r = 1 AND len(list_filter(result.entities, lambda e: e.type = 'PERSON')) > 0 ORDER BY created_at DESC, id LIMIT 150 OFFSET 5""",
    "store_roundtrip": "SELECT id, length(max(text))::INT AS length FROM translation WHERE id IS NOT NULL AND id NOT IN ('translate_1', 'translate_2') GROUP BY id HAVING max(text) IS NOT NULL",
}
