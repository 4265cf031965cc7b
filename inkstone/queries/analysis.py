"""Queries of the sequence models, graphs, vectors, pipelines and streams over whole tables, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, annotated
from ..models import kernels as K
from ..models.lexicon import DEFAULT
from ..operators import vectors, weights
from ..operators.graph import pagerank
from ..operators.markov import decoded, hmm_counts, hmm_from_counts
from ..plans.pipeline import PipelineEngine, run_counts
from ..session import scratch_path, spread, spread_again, table, written
from ..streaming import stream_batches, stream_pipeline, term_trends
from . import model_sql as M
from . import text
from .text import _SENT, _TAGGED, _WORDS, _edges, _tagged, _vocab, _words, nb_posteriors


def _texts(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(id, text) of a table, each id once."""
    key = "doc_id" if name == "documents" else "id"
    rows = table(spark, d, name).select(F.col(key).alias("id"), "text").filter("text is not null")
    return spread(rows, "id") if name == "documents" else spread_again(rows.groupBy("id").agg(F.min("text").alias("text")), rows, "id")


def segment_words(spark: SparkSession, d: str) -> DataFrame:
    w = _texts(spark, d, "documents").select(F.col("id").alias("doc_id"), K.segment("text").alias("words"))
    return w.select("doc_id", F.array_join("words", "\t").alias("words"), F.size("words").alias("n"))


def pos_tags(spark: SparkSession, d: str) -> DataFrame:
    words = _texts(spark, d, "segment").select("id", K.segment("text").alias("words"))
    return words.select("id", F.array_join("words", "\t").alias("words"), F.array_join(K.pos_tags("words"), "\t").alias("tags"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "ner").select("id", F.posexplode(K.entities("text")).alias("n", "e")).select("id", "n", F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"), "e.text", "e.type")


def phrase_trees(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every parse record's tree with its span and that of its parent; a leaf's label is its tag."""
    t = _tagged(spark, d).select("id", K.phrase_tree("words", "tags").alias("t")).select("id", "t", F.explode("t").alias("x"))
    up = F.get("t", F.col("x.parent"))
    return t.select("id", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.label", "x.word", up.start.alias("up_start"), up.end.alias("up_end"))


def translate_zh_en(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "translation").select("id", K.to_english("text").alias("translation"))


def keywords_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """All keywords of every parse record, by both frequency and centrality."""
    k = _tagged(spark, d).select("id", K.keywords("words", "tags", None).alias("k"))
    return k.select("id", F.explode("k.keywords").alias("w")).select("id", "w.*")


def keywords_textrank(spark: SparkSession, d: str) -> DataFrame:
    k = _tagged(spark, d).select("id", K.keywords("words", "tags", None, "textrank").alias("k"))
    return k.select("id", F.explode("k.keywords").alias("w")).select("id", "w.*")


def summary_extract(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "documents").select(F.col("id").alias("doc_id"), K.summary("text").alias("s")).select("doc_id", "s.summary", F.size("s.sentences").alias("sentences"), F.array_join("s.top_indices", " ").alias("top_indices"))


def annotate_entities(spark: SparkSession, d: str) -> DataFrame:
    """The ner texts with their stored entities marked, those of known types and without overlaps by being in order."""
    once = table(spark, d, "ner").filter("text is not null and result.entities is not null").dropDuplicates(["id"])
    ok = F.transform(F.filter("result.entities", lambda e: e.type.isNotNull() & (e.start_pos < e.end_pos)), lambda e: F.struct(e.start_pos.alias("start"), e.end_pos.alias("end"), e.type.alias("type")))
    return once.select("id", annotated("text", ok).alias("marked"))


def pagerank_terms(spark: SparkSession, d: str) -> DataFrame:
    """Centrality of every word in the co-occurrence graph of all segment results."""
    ranked = pagerank(weights.cooccurrence(_words(spark, d), "words", 4))
    return ranked.select(F.col("node").alias("term"), F.round("score", 8).alias("score"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all vectors, for every vector whose id is divisible by 50."""
    e = _vectors(spark, d)
    found = vectors.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.select(F.col("query").alias("query_id"), F.col("neighbour").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _label_centres(e: DataFrame) -> list:
    dims = F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")
    mean = e.filter("label is not null").select("label", dims).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.transform("c", lambda p: p.x).alias("c")).orderBy("label").collect()


def centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's most similar of the labels' mean vectors."""
    e = _vectors(spark, d)
    centres = _label_centres(e)  # a row per label
    names = F.array(*(F.lit(r.label) for r in centres))
    found = vectors.assign(e, "vec_id", "embedding", np.array([r.c for r in centres]))
    return found.select(F.col("id").alias("vec_id"), F.get(names, F.col("cluster")).alias("label"), F.round("similarity", 6).alias("similarity"))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """All vectors in 5 clusters, from the vectors with the 5 smallest ids as first centres."""
    e = _vectors(spark, d)
    first = e.filter("embedding is not null").orderBy("vec_id").limit(5).collect()
    found = vectors.kmeans(e, "vec_id", "embedding", centres=np.array([r.embedding for r in first], float))[0]
    return found.select(F.col("id").alias("vec_id"), "cluster", F.round("similarity", 6).alias("similarity"))


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    points, _ = vectors.principal_components(_vectors(spark, d), "vec_id", "embedding", 2)
    return points.select(F.col("id").alias("vec_id"), F.round(F.get("point", F.lit(0)), 6).alias("x"), F.round(F.get("point", F.lit(1)), 6).alias("y"))


def embeddings_train(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors of the segment results: the squared length and the first direction of each."""
    model, values = vectors.train_embeddings(_words(spark, d), "id", "words", 200, 20, 5, 1)
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return model.select("word", "count", "rank", F.size("vector").alias("dim"), F.round(squared, 4).alias("squared"), F.round(F.get("vector", F.lit(0)), 4).alias("first"))


def _whole_model(spark: SparkSession, d: str) -> DataFrame:
    """The model with all dimensions, saved and loaded again."""
    path = scratch_path(spark, "model")
    vectors.save_model(*vectors.train_embeddings(_words(spark, d), "id", "words", 200, 200, 5, 1), path)
    return vectors.load_model(spark, path)[0]


def embedding_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of all pairs of vectors of the vocabulary, which is bounded; with all dimensions they are those of the PPMI rows."""
    model = _whole_model(spark, d).select("word", "vector")
    dot = F.aggregate(F.zip_with("a.vector", "b.vector", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = model.alias("a").join(F.broadcast(model.alias("b")), F.col("a.word") <= F.col("b.word"))
    return pairs.select(F.col("a.word").alias("word_a"), F.col("b.word").alias("word_b"), F.round(dot + F.lit(0.0), 4).alias("product"))


def nearest_words(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest words of every word of the trained model, whose vocabulary is its bound."""
    model = _whole_model(spark, d)
    return vectors.nearest(model, model, "word", "vector", 5).select("query", "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of the model's commonest word to the next ones, and to an unknown one."""
    model = _whole_model(spark, d)
    words = [r.word for r in model.orderBy("rank").limit(4).collect()]
    pairs = [(words[0], w) for w in words[1:]] + [(words[0], "?")]
    return spark.createDataFrame([(a, b, round(vectors.word_similarity(model, a, b), 6)) for a, b in pairs], "a string, b string, similarity double")


STAGES = ("clean", "segment", "pos", "ner", "sentiment", "keywords", "summary", "translate", "parse")


def pipeline_batch(spark: SparkSession, d: str) -> DataFrame:
    """All nine stages over the corpus."""
    pipeline = PipelineEngine().build({"name": "all", "stages": [{"name": s} for s in STAGES]})
    done = pipeline.run_batch(_texts(spark, d, "corpus"))
    o = F.col("output")
    named = F.array_sort(F.transform(o.ner, lambda e: F.concat_ws("/", F.lpad(e.start.cast("string"), 8, "0"), e.text, e.type)))
    heads = F.zip_with(o.parse.dependency.heads, o.parse.dependency.relations, lambda h, r: F.concat_ws(" ", h.cast("string"), r))
    return done.select(
        "id", "ok", "error", o.clean_text.alias("cleaned"), F.md5(F.array_join(o.words, "\t")).alias("words"), F.md5(F.array_join(F.transform(o.pos, lambda p: p.tag), " ")).alias("tags"),
        F.array_join(named, " ").alias("named"), o.sentiment.score.alias("score"), o.sentiment.classifier.label.alias("label"), F.size(o.keywords.keywords).alias("keywords"),
        F.round(F.aggregate(o.keywords.keywords, F.lit(0.0), lambda s, k: s + k.score), 3).alias("keyword_scores"), F.md5(o.summary.summary).alias("summary"), o.translation.translation.alias("translation"),
        F.md5(F.array_join(heads, ",")).alias("heads"),
    )


def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many documents a run over the corpus did, with a stage that fails on some of them."""
    engine = PipelineEngine()
    engine.register_rows("ratio", lambda row, p: p["of"] // (len(row["text"]) % p["every"]), "int", ("text",), {"of": 100, "every": 3})
    done = engine.build({"stages": [{"name": "segment"}, {"name": "ratio"}]}).run_batch(_texts(spark, d, "corpus"))
    return run_counts(done)


def pipeline_trees(spark: SparkSession, d: str) -> DataFrame:
    """The trees that the pipeline makes of the texts of the parse records: leaves, nodes, and how many of each label."""
    done = PipelineEngine().build({"stages": [{"name": "parse"}]}).run_batch(_texts(spark, d, "parse"))
    return done.select("id", F.explode("output.parse.constituency").alias("x")).groupBy("id", "x.label").agg(F.count("*").alias("nodes"), F.sum(F.col("x.end") - F.col("x.start")).alias("covered"))


def stream_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Segmentation and sentiment over the corpus as a stream, appended to files and read back."""
    path = scratch_path(spark, "stream")
    schema = table(spark, d, "corpus").schema
    # a table is a folder of files, or a file: the stream then watches the file's folder for that name
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/corpus.parquet*")
    pipeline = PipelineEngine().build({"stages": [{"name": "segment"}, {"name": "sentiment"}]})
    stream_pipeline(source.select("id", "text"), pipeline, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "ok", F.size("output.words").alias("words"), "output.sentiment.score", "output.sentiment.polarity")


def stream_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents done and failed as the batches of a stream over the corpus report them."""
    path = scratch_path(spark, "batches")
    source = spark.readStream.schema(table(spark, d, "corpus").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/corpus.parquet*")
    reported: list[tuple[int, int, int]] = []
    stream_batches(source.select("id", "text"), PipelineEngine().build({"stages": [{"name": "clean"}]}), f"{path}/checkpoint", lambda *x: reported.append(x), f"{path}/out").awaitTermination()
    return spark.createDataFrame([(sum(x[1] for x in reported), sum(x[2] for x in reported))], "succeeded long, failed long")


def stream_trends(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every word of the segment results by day, counted on a stream."""
    schema = table(spark, d, "segment").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/segment.parquet*").filter("created_at is not null")
    docs = source.select(F.timestamp_seconds("created_at").alias("at"), F.col("result.words").alias("words"))
    path = scratch_path(spark, "trends")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("window.start").alias("day"), "term", "count").write.mode("overwrite").parquet(f"{path}/out")

    counts = term_trends(docs, "words", "at", delay=None)
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").filter("term is not null")


def viterbi_tags(spark: SparkSession, d: str) -> DataFrame:
    """The words of the parse records tagged by a model counted from these records' own tags, decoded over the whole tag set."""
    rows = _tagged(spark, d)
    model = hmm_from_counts(written(hmm_counts(rows, "words", "tags"), "hmm-counts"), sorted(DEFAULT.tags), 0.01)
    return decoded(rows.select("id", "words"), "words", model).select("id", F.array_join("words", "\t").alias("words"), F.array_join("states", "\t").alias("states"))


QUERIES = {f.__name__: f for f in (
    segment_words, pos_tags, entities, phrase_trees, translate_zh_en, keywords_hybrid, keywords_textrank, summary_extract, annotate_entities, pagerank_terms,
    nearest_vectors, centroid_assign, kmeans_clusters, pca_2d, embeddings_train, embedding_products, embedding_similarity, nearest_words, pipeline_batch, pipeline_counts, pipeline_trees,
    stream_sentiment, stream_batch_counts, stream_trends, viterbi_tags,
)}

_DOUBLE = "embedding::DOUBLE[]"



def _once(table: str) -> str:
    return f"SELECT id, min(text) AS text FROM {table} WHERE text IS NOT NULL GROUP BY id"


_ALL_DOCUMENTS = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"
_TAGGED_ROWS = _TAGGED.replace("tagged AS (", "stored AS (") + ", tagged AS MATERIALIZED (SELECT id, generate_subscripts(words, 1) AS p, unnest(words) AS word, unnest(tags) AS tag FROM stored)"
_TRAINING = f"""
    once AS (SELECT id, list_filter(min(result.words), lambda w: w IS NOT NULL AND NOT list_contains({M.texts(sorted(DEFAULT.stop_words))}, w) AND regexp_matches(w, '[\\x{{4e00}}-\\x{{9fff}}]')) AS words FROM segment GROUP BY id HAVING min(result.words) IS NOT NULL),
    w AS (SELECT id, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS word FROM once), {_vocab(200, 1)}, {_edges(5, True, True)}, r AS (SELECT src, sum(weight) AS s FROM edges GROUP BY src),
    ppmi AS (SELECT e.src, e.dst, greatest(ln(e.weight * (SELECT sum(weight) FROM edges) / (a.s * b.s + 1e-9)), 0.0) AS ppmi FROM edges e JOIN r a ON a.src = e.src JOIN r b ON b.src = e.dst)"""
_KEYWORDS = "SELECT id, word, round(score, 4) AS score, freq FROM keywords"
_TREE = "SELECT id, (a - 1)::INT AS start_pos, (b - 1)::INT AS end_pos, label, word, (up_a - 1)::INT AS up_start, (up_b - 1)::INT AS up_end FROM labelled"


def _polarity(words: str) -> str:
    """SQL of (id, score, polarity) of the words of a query of (id, pos, word)."""
    return f"SELECT id, round(s, 4) AS score, CASE WHEN s >= 0.15 THEN 'positive' WHEN s <= -0.15 THEN 'negative' ELSE 'neutral' END AS polarity FROM (WITH w AS ({words}), {_SENT} SELECT * FROM scored)"


def _pipeline_sql() -> str:
    corpus = _once("corpus")
    stop = M.texts(sorted(DEFAULT.stop_words))
    bare = f"SELECT id, regexp_replace(regexp_replace(text, '[{SPACE_CLASS}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM ({corpus})"
    clean = f"SELECT id, coalesce(string_agg(word, ' ' ORDER BY n, i) FILTER (NOT list_contains({stop}, word)), '') AS cleaned FROM words GROUP BY id"
    chosen = "SELECT id, coalesce(nullif(cleaned, ''), text) AS text FROM cleaned"
    heads = text.ORACLES["dependency"].split("t AS (SELECT id,", 1)[1].split("FROM tagged)", 1)[1]
    return f"""
        WITH RECURSIVE cleaned AS MATERIALIZED (SELECT c.id, c.text, coalesce(k.cleaned, '') AS cleaned FROM ({corpus}) c LEFT JOIN (SELECT * FROM (WITH RECURSIVE {M.segmented(bare)} {clean})) k USING (id)),
        {M.segmented(chosen)}, {M.tagged()}, {M.translated()}, {M.entities()}, {M.keywords("hybrid")},
        summed AS (SELECT * FROM (WITH RECURSIVE {M.summaries("SELECT * FROM source")} SELECT * FROM summaries)),
        once AS (SELECT id FROM source), w AS (SELECT id, p - 1 AS pos, word FROM places_of), {nb_posteriors()},
        opinions AS ({_polarity("SELECT id, p - 1 AS pos, word FROM places_of")}),
        labels AS (SELECT id, arg_max(label, p) AS label FROM p GROUP BY id),
        cut AS (SELECT id, string_agg(word, chr(9) ORDER BY p) AS words, string_agg(tag, ' ' ORDER BY p) AS tags FROM tagged GROUP BY id),
        named AS (SELECT id, string_agg(printf('%08d', start_pos) || '/' || text || '/' || type, ' ' ORDER BY start_pos) AS named FROM entities GROUP BY id),
        keys AS (SELECT id, least(10, count(*))::INT AS keywords, round(sum(s) FILTER (r <= 10), 3) AS keyword_scores FROM (SELECT id, round(score, 4) AS s, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS r FROM keywords) GROUP BY id),
        t AS (SELECT id, (p - 1)::INT AS pos, word, tag FROM tagged){heads.replace("SELECT id, pos, word, tag,", ", tree AS (SELECT id, pos,", 1)}),
        hung AS (SELECT id, string_agg(head || ' ' || relation, ',' ORDER BY pos) AS heads FROM tree GROUP BY id)
        SELECT c.id, true AS ok, NULL::VARCHAR AS error, c.cleaned, md5(coalesce(cut.words, '')) AS words, md5(coalesce(cut.tags, '')) AS tags, coalesce(named.named, '') AS named, coalesce(o.score, 0.0) AS score, labels.label,
            coalesce(keys.keywords, 0) AS keywords, coalesce(keys.keyword_scores, 0.0) AS keyword_scores, md5(s.summary) AS summary, tr.translation, md5(coalesce(hung.heads, '')) AS heads
        FROM cleaned c LEFT JOIN cut USING (id) LEFT JOIN named USING (id) LEFT JOIN opinions o USING (id) LEFT JOIN labels USING (id) LEFT JOIN keys USING (id) LEFT JOIN summed s USING (id) LEFT JOIN translated tr USING (id) LEFT JOIN hung USING (id)"""


ORACLES = {
    "segment_words": f"""
        WITH RECURSIVE {M.segmented(_ALL_DOCUMENTS)}
        SELECT source.id AS doc_id, coalesce(string_agg(word, chr(9) ORDER BY n, i), '') AS words, count(word)::INT AS n FROM source LEFT JOIN words USING (id) GROUP BY source.id""",
    "pos_tags": f"""
        WITH RECURSIVE {M.segmented(_once("segment"))}, {M.tagged()}
        SELECT source.id, coalesce(string_agg(word, chr(9) ORDER BY p), '') AS words, coalesce(string_agg(tag, chr(9) ORDER BY p), '') AS tags FROM source LEFT JOIN tagged USING (id) GROUP BY source.id""",
    "entities": f"WITH RECURSIVE {M.segmented(_once('ner'))}, {M.entities()} SELECT * FROM entities",
    "phrase_trees": f"WITH RECURSIVE {_TAGGED_ROWS}, {M.trees()} {_TREE} UNION ALL SELECT id, 0, 0, 'S', NULL, NULL, NULL FROM stored WHERE len(words) = 0",
    "translate_zh_en": f"WITH RECURSIVE {M.segmented(_once('translation'))}, {M.translated()} SELECT * FROM translated",
    "keywords_hybrid": f"WITH RECURSIVE {_TAGGED_ROWS}, {M.keywords('hybrid')} {_KEYWORDS}",
    "keywords_textrank": f"WITH RECURSIVE {_TAGGED_ROWS}, {M.keywords('textrank')} {_KEYWORDS}",
    "summary_extract": f"WITH RECURSIVE {M.summaries(_ALL_DOCUMENTS)} SELECT id AS doc_id, summary, sentences, array_to_string(top_indices, ' ') AS top_indices FROM summaries",
    "pagerank_terms": f"""
        WITH RECURSIVE {_WORDS}, {_edges(4, False, False)}, terms AS (SELECT 0 AS id, src AS node FROM edges UNION SELECT 0, dst FROM edges), graph AS (SELECT 0 AS id, src, dst, weight FROM edges),
        {M.ranked("terms", "graph", 10)}
        SELECT node AS term, round(score, 8) AS score FROM ranked""",
    "kmeans_clusters": f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, {_DOUBLE} AS v FROM embeddings WHERE embedding IS NOT NULL), dims AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
        rounds AS (
            SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cluster, v AS c, 0 AS round FROM (SELECT * FROM e ORDER BY vec_id LIMIT 5)
            UNION ALL
            SELECT cluster, coalesce(new, c), round + 1 FROM rounds r LEFT JOIN (
                SELECT best, list(x ORDER BY i) AS new FROM (
                    SELECT best, i, avg(x) AS x FROM dims JOIN (SELECT vec_id, arg_max(cluster, (round(list_cosine_similarity(v, c), 13), -cluster)) AS best FROM e CROSS JOIN rounds GROUP BY vec_id) USING (vec_id) GROUP BY best, i)
                GROUP BY best) n ON n.best = r.cluster WHERE round < 50
        ), last AS (SELECT cluster, c FROM rounds WHERE round = 50),
        s AS (SELECT vec_id, cluster, list_cosine_similarity(v, c) AS s FROM e CROSS JOIN last)
        SELECT vec_id, arg_max(cluster, s)::INT AS cluster, round(max(s), 6) AS similarity FROM s GROUP BY vec_id""",
    "pca_2d": f"""
        WITH RECURSIVE x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest({_DOUBLE}) AS x FROM embeddings), d AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM x),
        c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM d a JOIN d b USING (vec_id) GROUP BY a.i, b.i), {M.powers("c1")},
        first AS (SELECT sum(p.v * c.v * q.v) AS value FROM c1 c JOIN c1_vector p ON p.i = c.i JOIN c1_vector q ON q.i = c.j),
        c2 AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT value FROM first) * p.v * q.v AS v FROM c1 c JOIN c1_vector p ON p.i = c.i JOIN c1_vector q ON q.i = c.j), {M.powers("c2")}
        SELECT vec_id, round(sum(x * p.v), 6) AS x, round(sum(x * q.v), 6) AS y FROM d JOIN c1_vector p USING (i) JOIN c2_vector q USING (i) GROUP BY vec_id""",
    "embedding_products": f"""
        WITH {_TRAINING}, m AS (SELECT src, dst, ppmi FROM ppmi WHERE ppmi > 0),
        g AS (SELECT a.src AS x, b.src AS y, sum(a.ppmi * b.ppmi) AS s FROM m a JOIN m b USING (dst) GROUP BY a.src, b.src)
        SELECT p.term AS word_a, q.term AS word_b, round(coalesce(s, 0.0), 4) AS product FROM vocab p JOIN vocab q ON p.term <= q.term LEFT JOIN g ON g.x = p.term AND g.y = q.term""",
    "nearest_words": f"""
        WITH {_TRAINING}, m AS (SELECT src, dst, ppmi FROM ppmi WHERE ppmi > 0),
        g AS (SELECT a.src AS x, b.src AS y, sum(a.ppmi * b.ppmi) AS s FROM m a JOIN m b USING (dst) GROUP BY a.src, b.src),
        n AS (SELECT x, sqrt(s) AS n FROM g WHERE x = y),
        c AS (SELECT p.term AS query, q.term AS neighbour, coalesce(s / (a.n * b.n), 0.0) AS s FROM vocab p JOIN vocab q ON p.term <> q.term LEFT JOIN g ON g.x = p.term AND g.y = q.term LEFT JOIN n a ON a.x = p.term LEFT JOIN n b ON b.x = q.term),
        places AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, neighbour)::INT AS rank FROM c)
        SELECT query, neighbour, round(s, 4) AS similarity, rank FROM places WHERE rank <= 5""",
    "embedding_similarity": f"""
        WITH {_TRAINING}, m AS (SELECT src, dst, ppmi FROM ppmi WHERE ppmi > 0), n AS (SELECT src, sqrt(sum(ppmi * ppmi)) AS n FROM m GROUP BY src),
        p AS (SELECT a.term AS a, b.term AS b FROM vocab a JOIN vocab b ON a.rank = 1 AND b.rank BETWEEN 2 AND 4)
        SELECT p.a, p.b, round(coalesce((SELECT sum(x.ppmi * y.ppmi) FROM m x JOIN m y USING (dst) WHERE x.src = p.a AND y.src = p.b) / ((SELECT n FROM n WHERE src = p.a) * (SELECT n FROM n WHERE src = p.b)), 0.0), 6) AS similarity FROM p
        UNION ALL SELECT DISTINCT a, '?', 0.0 FROM p""",
    "stream_batch_counts": "SELECT count(*) AS succeeded, 0::BIGINT AS failed FROM corpus",
    "pipeline_counts": """
        SELECT count(*) AS doc_count, count(*) FILTER (length(text) % 3 <> 0) AS succeeded, count(*) FILTER (length(text) % 3 = 0) AS failed FROM (SELECT min(text) AS text FROM corpus WHERE text IS NOT NULL GROUP BY id)""",
    "pipeline_trees": f"""
        WITH RECURSIVE {M.segmented(_once("parse"))}, {M.tagged()}, {M.trees()}
        SELECT id, label, count(*) AS nodes, sum(b - a)::BIGINT AS covered FROM labelled GROUP BY id, label
        UNION ALL SELECT id, 'S', 1, 0 FROM source WHERE id NOT IN (SELECT id FROM words)""",
    "stream_sentiment": f"""
        WITH RECURSIVE {M.segmented(_once("corpus"))}, opinions AS ({_polarity("SELECT id, row_number() OVER (PARTITION BY id ORDER BY n, i) AS pos, word FROM words")}), sizes_of AS (SELECT id, count(*)::INT AS words FROM words GROUP BY id)
        SELECT c.id, true AS ok, CASE WHEN text IS NULL THEN NULL ELSE coalesce(words, 0) END AS words, CASE WHEN text IS NULL THEN NULL ELSE coalesce(score, 0.0) END AS score, CASE WHEN text IS NULL THEN NULL ELSE coalesce(polarity, 'neutral') END AS polarity
        FROM corpus c LEFT JOIN sizes_of USING (id) LEFT JOIN opinions USING (id)""",
    "stream_trends": """
        SELECT CAST(to_timestamp(created_at) AS DATE) AS day, term, count(*) AS count FROM (SELECT created_at, unnest(result.words) AS term FROM segment WHERE created_at IS NOT NULL) WHERE term IS NOT NULL GROUP BY 1, 2""",
    "viterbi_tags": f"""
        WITH RECURSIVE {_TAGGED_ROWS}, k(tag) AS (VALUES {", ".join(f"('{t}')" for t in sorted(DEFAULT.tags))}), o AS (SELECT list(tag ORDER BY tag) AS tags FROM k),
        starts AS (SELECT list(ln((0.01::DOUBLE + coalesce(c, 0)) / (SELECT 0.16::DOUBLE + count(*) FROM tagged WHERE p = 1 AND tag IN (SELECT tag FROM k))) ORDER BY tag) AS s FROM k LEFT JOIN (SELECT tag, count(*) AS c FROM tagged WHERE p = 1 GROUP BY tag) USING (tag)),
        nexts AS (SELECT tag AS a, lead(tag) OVER (PARTITION BY id ORDER BY p) AS b FROM tagged), pairs AS (SELECT a, b, count(*) AS c FROM nexts WHERE b IN (SELECT tag FROM k) GROUP BY a, b),
        moves AS (SELECT list(t ORDER BY a) AS t FROM (SELECT x.tag AS a, list(ln((0.01::DOUBLE + coalesce(c, 0)) / (0.16::DOUBLE + coalesce(s, 0))) ORDER BY y.tag) AS t FROM k x CROSS JOIN k y LEFT JOIN pairs ON a = x.tag AND b = y.tag LEFT JOIN (SELECT a, sum(c) AS s FROM pairs GROUP BY a) z ON z.a = x.tag GROUP BY x.tag)),
        seen AS (SELECT word, tag, count(*) AS c FROM tagged WHERE tag IN (SELECT tag FROM k) AND word IS NOT NULL GROUP BY word, tag),
        emits AS (SELECT word, list(ln((0.01::DOUBLE + coalesce(c, 0)) / (0.16::DOUBLE + s)) ORDER BY k.tag) AS e FROM (SELECT word, sum(c) AS s FROM seen GROUP BY word) w CROSS JOIN k LEFT JOIN seen USING (word, tag) GROUP BY word),
        runs AS (SELECT id, list(coalesce(e, list_transform(generate_series(1, 16), lambda x: ln(0.01::DOUBLE))) ORDER BY p) AS es, string_agg(word, chr(9) ORDER BY p) AS words, count(*) AS n FROM tagged LEFT JOIN emits USING (word) GROUP BY id),
        v AS (
            SELECT id, es, n, 1::BIGINT AS p, list_transform(generate_series(1, 16), lambda b: s[b] + es[1][b]) AS score, NULL::BIGINT[] AS back FROM runs CROSS JOIN starts
            UNION ALL
            SELECT id, es, n, p + 1, list_transform(generate_series(1, 16), lambda b: list_max(m[b]) + es[p + 1][b]), list_transform(m, lambda x: list_position(x, list_max(x)))
            FROM (SELECT v.*, list_transform(generate_series(1, 16), lambda b: list_transform(generate_series(1, 16), lambda a: score[a] + t[a][b])) AS m FROM v CROSS JOIN moves WHERE p < n)
        ),
        ends AS (SELECT id, list(back ORDER BY p) AS backs, arg_max(list_position(score, list_max(score)), p) AS j, any_value(n) AS p FROM v GROUP BY id),
        trail AS (SELECT id, backs, p, j FROM ends UNION ALL SELECT id, backs, p - 1, backs[p][j] FROM trail WHERE p > 1),
        states AS (SELECT id, string_agg((SELECT tags FROM o)[j], chr(9) ORDER BY p) AS states FROM trail GROUP BY id)
        SELECT stored.id, coalesce(runs.words, '') AS words, coalesce(states.states, '') AS states FROM stored LEFT JOIN runs USING (id) LEFT JOIN states USING (id)""",
    "annotate_entities": """
        WITH o AS (SELECT DISTINCT ON (id) id, text, list_reverse_sort(list_transform(list_filter(result.entities, lambda e: e.type IS NOT NULL AND e.start_pos < e.end_pos), lambda e: {'s': e.start_pos, 'e': e.end_pos, 't': e.type})) AS es FROM ner WHERE text IS NOT NULL AND result.entities IS NOT NULL)
        SELECT id, CASE WHEN len(es) = 0 THEN text ELSE list_reduce(list_prepend(text, list_transform(es, lambda e: e.s || '|' || e.e || '|' || e.t)),
            lambda s, e: substring(s, 1, split_part(e, '|', 1)::INT) || '<' || split_part(e, '|', 3) || '>' || substring(s, split_part(e, '|', 1)::INT + 1, split_part(e, '|', 2)::INT - split_part(e, '|', 1)::INT) || '</' || split_part(e, '|', 3) || '>' || substring(s, split_part(e, '|', 2)::INT + 1)) END AS marked FROM o""",
    "nearest_vectors": f"""
        WITH e AS (SELECT vec_id, {_DOUBLE} AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM p)
        SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""",
    "centroid_assign": f"""
        WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest({_DOUBLE}) AS x FROM embeddings WHERE label IS NOT NULL),
        m AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i) GROUP BY label),
        s AS (SELECT vec_id, m.label, list_cosine_similarity({_DOUBLE}, c) AS s FROM embeddings CROSS JOIN m)
        SELECT vec_id, arg_max(label, s) AS label, round(max(s), 6) AS similarity FROM s GROUP BY vec_id""",
}
ORACLES["pipeline_batch"] = _pipeline_sql()
