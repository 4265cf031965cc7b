"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FULL_WIDTH, WHITE_SPACE
from ..session import table, written
from .distinctive import distinctive_terms
from .formdups import collapse_forms
from .mixing import mix_shares, mix_sources, source_name, token_sizes
from .sentences import split_sentences
from .subjects import document_subjects
from .terms import record_terms, term_frequencies
from .tokenizer import encode_corpus
from .vectors import newest_vectors, similar_vectors


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(newest_vectors(table(spark, d, "embedding_model")), 10, 0.90)
    return near.select(F.least("word", "neighbour").alias("word_a"), F.greatest("word", "neighbour").alias("word_b")).distinct()


def _all_terms(spark: SparkSession, d: str) -> DataFrame:
    segment = record_terms(table(spark, d, "segment"), "segment", F.col("result.words"))
    keywords = record_terms(table(spark, d, "keywords"), "keywords", F.col("result.keywords.word"))
    return segment.unionByName(keywords)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_all_terms(spark, d)).filter("mark is not null").select("task", "term", "mark")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(_all_terms(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "corpus"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = record_terms(table(spark, d, "segment"), "segment", F.col("result.words"))
    return distinctive_terms(records).filter("top").select("id", "term")


def p4_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Scores and parsimonious weights of the keywords' terms, beside the greatest score stored for each."""
    source = table(spark, d, "keywords")
    scored = distinctive_terms(record_terms(source, "keywords", F.col("result.keywords.word")))
    from ..functions.text import normalised_term

    stored = source.select("id", F.explode("result.keywords").alias("k")).filter("k.word is not null").groupBy("id", normalised_term("k.word").alias("term")).agg(F.max(F.nanvl("k.score", F.lit(None).cast("double"))).alias("stored"))
    return scored.join(stored, ["id", "term"], "left").select("id", "term", "occurrences", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"), "stored")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_forms(table(spark, d, "translation")).filter("id > keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """Every set of texts equal in form, by its smallest id, with the number of copies."""
    return collapse_forms(table(spark, d, "translation")).filter("id = keep_id").select("keep_id", "copies")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(token_sizes(table(spark, d, "documents")), table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = token_sizes(table(spark, d, "documents")), table(spark, d, "source_targets")
    return mix_shares(written(mix_sources(sizes, targets), "mix"), sizes, targets)


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their length in characters as size, which SQL can count as well."""
    return table(spark, d, "documents").select("doc_id", source_name("source").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The mix by lengths in characters."""
    return mix_sources(_lengths(spark, d), table(spark, d, "source_targets")).select("doc_id", "source", "pass", "n_tokens", F.round("finish", 3).alias("finish"))


def p9_length_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix of two million characters, for which small sources may have to stop at their caps."""
    sizes, targets = _lengths(spark, d), table(spark, d, "source_targets")
    shares = mix_shares(written(mix_sources(sizes, targets, 2_000_000), "mix"), sizes, targets)
    return shares.withColumns({c: F.round(c, 9) for c in ("target_share", "actual_share")})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects")).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_frequencies, p3_found, p4_found, p4_keywords, p5_found, p5_copies, p8_ids, p9_mix, p9_shares, p9_lengths, p9_length_shares, p10_found)}

_WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_FW = "".join(FULL_WIDTH)
_HW = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)


def _norm(c: str) -> str:
    return f"lower(translate(trim({c}, {_WS}), '{_FW}', '{_HW}'))"


_TERMS = f"""
    WITH once AS (
        SELECT 'segment' AS task, id, any_value(result.words) AS w FROM segment GROUP BY id
        UNION ALL SELECT 'keywords', id, any_value(list_transform(result.keywords, lambda k: k.word)) FROM keywords GROUP BY id
    ), terms AS (
        SELECT task, id, term FROM (SELECT task, id, {_norm('x')} AS term FROM (SELECT task, id, unnest(w) AS x FROM once)) WHERE term <> ''
    ), n AS (SELECT task, count(DISTINCT id) AS n FROM terms GROUP BY task),
    freq AS (SELECT task, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms GROUP BY task, term),
    marked AS (
        SELECT task, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END AS mark
        FROM freq JOIN n USING (task)
    )"""


def _mix_sql(budget: str) -> str:
    return f"""
    WITH goal AS (SELECT lower(trim(source, {_WS})) AS source, sum(target_share) AS share, min(max_repeats) AS repeats FROM source_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0 GROUP BY 1),
    sizes AS (SELECT doc_id, lower(trim(source, {_WS})) AS source, coalesce(length(text), 0)::BIGINT AS n_tokens FROM documents),
    used AS (SELECT doc_id, source, n_tokens, share, repeats FROM sizes JOIN goal USING (source) WHERE n_tokens > 0),
    have AS (SELECT source, any_value(share) AS share, any_value(repeats) AS repeats, sum(n_tokens) AS tokens FROM used GROUP BY source),
    whole AS (SELECT sum(share) AS whole FROM have), total AS (SELECT {budget} AS total FROM have CROSS JOIN whole GROUP BY ALL),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(doc_id || ':17'), doc_id) AS upto FROM used),
    timed AS (SELECT doc_id, p.source, (pass)::INT AS pass, n_tokens, ((pass - 1) * tokens + upto)::DOUBLE / (h.share / whole) AS finish FROM (SELECT *, unnest(generate_series(1, repeats)) AS pass FROM placed) p JOIN have h USING (source) CROSS JOIN whole),
    summed AS (SELECT *, sum(n_tokens) OVER (ORDER BY finish, source, doc_id, pass) AS upto FROM timed),
    mix AS (SELECT doc_id, source, pass, n_tokens, finish FROM summed WHERE upto <= (SELECT total FROM total))"""


ORACLES = {
    "p4_keywords": _TERMS.replace("WITH once", "WITH RECURSIVE once")
    + """, per AS (SELECT id, term, count(*) AS c FROM terms WHERE task = 'keywords' GROUP BY id, term), len AS (SELECT id, sum(c) AS n FROM per GROUP BY id),
        f AS (SELECT term, occurrences AS cf, records AS df FROM freq WHERE task = 'keywords'), words AS (SELECT sum(cf) AS words FROM f),
        em AS (
            SELECT id, term, c::DOUBLE AS c, 0.9 * (cf / words)::DOUBLE AS background, c::DOUBLE / n AS p, 0 AS round, true AS moving FROM per JOIN len USING (id) JOIN f USING (term) CROSS JOIN words
            UNION ALL
            SELECT id, term, c, background, q, round + 1, round < 49 AND max(abs(q - p)) OVER (PARTITION BY id) >= 1e-6
            FROM (SELECT *, e / sum(e) OVER (PARTITION BY id) AS q FROM (SELECT *, c * (0.1::DOUBLE * p) / (background + 0.1::DOUBLE * p) AS e FROM em WHERE moving))
        ),
        weights AS (SELECT id, term, arg_max(p, round) AS weight FROM em GROUP BY id, term),
        stored AS (SELECT id, """
    + _norm("k.word")
    + """ AS term, max(CASE WHEN NOT isnan(k.score) THEN k.score END) AS stored FROM (SELECT id, unnest(result.keywords) AS k FROM keywords) WHERE k.word IS NOT NULL GROUP BY 1, 2)
        SELECT id, term, c AS occurrences, round((c / len.n) * (ln(((SELECT n FROM n WHERE task = 'keywords') + 1) / (df + 1)) + 1), 6) AS score, round(weight, 6) AS weight, stored
        FROM per JOIN len USING (id) JOIN f USING (term) JOIN weights USING (id, term) LEFT JOIN stored USING (id, term)""",
    "p9_lengths": _mix_sql("floor(min(tokens * repeats * whole / share) * (1 + 1e-12))") + " SELECT doc_id, source, pass, n_tokens, round(finish, 3) AS finish FROM mix",
    "p9_length_shares": _mix_sql("max(2000000)")
    + """, named AS (SELECT lower(trim(source, """
    + _WS
    + """)) AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats FROM source_targets GROUP BY 1),
        there AS (SELECT source, count(*) AS documents, sum(n_tokens)::BIGINT AS tokens FROM sizes GROUP BY source), taken AS (SELECT source, count(*) AS uses, sum(n_tokens)::BIGINT AS mix_tokens, max(pass) AS most_repeats FROM mix GROUP BY source)
        SELECT n.source, round(target_share, 9) AS target_share, max_repeats, coalesce(documents, 0) AS documents, coalesce(tokens, 0) AS tokens, coalesce(uses, 0) AS uses, coalesce(mix_tokens, 0) AS mix_tokens, coalesce(most_repeats, 0) AS most_repeats,
            round(coalesce(mix_tokens / (SELECT sum(n_tokens) FROM mix), 0.0), 9) AS actual_share
        FROM named n LEFT JOIN there t ON t.source = n.source LEFT JOIN taken k ON k.source = n.source""",
    "p1_found": """
        WITH newest AS (SELECT vectors, dim FROM embedding_model QUALIFY row_number() OVER (PARTITION BY id ORDER BY trained_at DESC) = 1),
        kv AS (SELECT dim, unnest(map_keys(vectors)) AS word, unnest(map_values(vectors)) AS v FROM newest),
        ok AS (SELECT word, v FROM kv WHERE v IS NOT NULL AND len(v) = dim AND list_aggregate(list_transform(v, lambda x: abs(x)), 'max') > 0 AND NOT list_has_any([false], list_transform(v, lambda x: x IS NOT NULL))),
        pairs AS (SELECT a.word AS wa, b.word AS wb, list_cosine_similarity(a.v, b.v) AS s FROM ok a JOIN ok b ON a.word <> b.word),
        best AS (SELECT wa, wb, s FROM pairs WHERE s >= 0.90 QUALIFY row_number() OVER (PARTITION BY wa ORDER BY s DESC, wb) <= 10)
        SELECT DISTINCT least(wa, wb) AS word_a, greatest(wa, wb) AS word_b FROM best""",
    "p2_found": _TERMS + " SELECT task, term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_frequencies": _TERMS + " SELECT task, term, occurrences, records, mark FROM marked",
    "p4_found": _TERMS
    + """, per AS (SELECT id, term, count(*) AS c FROM terms WHERE task = 'segment' GROUP BY id, term),
        len AS (SELECT id, sum(c) AS n FROM per GROUP BY id),
        scored AS (
            SELECT id, term, (c / len.n) * (ln(((SELECT n FROM n WHERE task = 'segment') + 1) / (records + 1)) + 1) AS score
            FROM per JOIN len USING (id) JOIN freq USING (term) WHERE task = 'segment' AND records >= 2
        )
        SELECT id, term FROM scored QUALIFY score = max(score) OVER (PARTITION BY id)""",
}
