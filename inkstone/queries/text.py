"""Queries of the text operators over whole tables, and their SQL."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_TOKEN, GRAM_BREAKS, SPACE_CLASS, TOKEN_PATTERN, english_sentence, has_han, label, map_cosine, sentences, single_spaced, tokens, without_stop_words
from ..models.entities import PATTERNS
from ..models import kernels as K
from ..models.lexicon import DEFAULT
from ..operators import weights
from ..operators.dependency import dependency_heads
from ..operators.markov import hmm_counts
from ..operators.sentiment import NaiveBayes, bayes_score, labelled_model, lexicon_score, sentiment_by_windows
from ..operators.translate import to_chinese
from ..plans.pipeline import cleaned
from ..session import spread, spread_again, table, written
from . import model_sql as M

STOP = sorted(DEFAULT.stop_words)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "doc_id")


def _words(spark: SparkSession, d: str, name: str = "segment") -> DataFrame:
    """(id, words) of a result table, each id once."""
    column = "result.words" if name == "segment" else "result.dependency.words"
    return table(spark, d, name).select("id", F.col(column).alias("words")).groupBy("id").agg(F.min("words").alias("words")).filter("words is not null")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """(id, words, tags) of parse records whose arrays are of equal length and without nulls, each id once."""
    rows = table(spark, d, "parse").select("id", "result.dependency.words", "result.dependency.tags").filter("words is not null and tags is not null and size(words) = size(tags) and not exists(tags, t -> t is null)")
    return spread_again(rows.groupBy("id").agg(F.min(F.struct("words", "tags")).alias("s")).select("id", "s.*"), rows, "id")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(sentences("text")).alias("pos", "sentence"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.size(F.filter("t", has_han)).alias("n_han"))


def clean_removed(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut into words, without its stop words."""
    c = _docs(spark, d).filter("text is not null").select("doc_id", cleaned(K.segment(single_spaced("text")), STOP).alias("c"))
    return c.select("doc_id", "c.cleaned", F.size("c.tokens").alias("kept"), F.size("c.original_tokens").alias("original"), "c.removed")


def filtered_words(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("id", F.array_join(without_stop_words("words", STOP), " ").alias("content"))


def _content(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, words): the content words of every document; null texts have none."""
    return _docs(spark, d).select("doc_id", without_stop_words(F.coalesce(K.segment("text"), F.array().cast("array<string>")), STOP).alias("words"))


def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    top = weights.top_terms(weights.tfidf(_content(spark, d), "doc_id", "words"), 5)
    return top.select(F.col("id").alias("doc_id"), "term", "count", "df", F.round("weight", 6).alias("weight"), "rank")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return weights.vocabulary(_words(spark, d), "id", "words", 300, 2)


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return weights.cooccurrence(_words(spark, d), "words", 4).select("src", "dst", F.round("weight", 6).alias("weight"))


def ppmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    edges = weights.cooccurrence(words, "words", 5, True, weights.vocabulary(words, "id", "words", 200, 1))
    return weights.ppmi(edges).select("src", "dst", F.round("ppmi", 6).alias("ppmi"))


def keyword_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Stored keyword scores over the greatest of their record; null and NaN scores count as none."""
    k = table(spark, d, "keywords").select("id", F.explode("result.keywords").alias("k")).select("id", F.col("k.word").alias("word"), F.nanvl("k.score", F.lit(None).cast("double")).alias("score")).filter("word is not null and score is not null")
    best = k.groupBy("id", "word").agg(F.max("score").alias("score"))
    return weights.scaled_by_max(best, "id", "score").select("id", "word", F.round("score", 6).alias("score"))


def new_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "corpus").select("id", "text").filter("text is not null")
    once = spread_again(rows.groupBy("id").agg(F.min("text").alias("text")), rows, "id")
    return weights.new_words(once, "text", 5, 4, 6.0, None)


def lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    s = _words(spark, d).select("id", lexicon_score("words").alias("s")).select("id", "s.*")
    return s.select("id", "raw_score", "score", "polarity", F.size("positive_words").alias("positive"), F.size("negative_words").alias("negative"))


def sentiment_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _words(spark, d).select("id", F.posexplode("words").alias("pos", "word"))
    return sentiment_by_windows(rows)


def sentiment_bayes(spark: SparkSession, d: str) -> DataFrame:
    s = _words(spark, d).select("id", bayes_score("words", labelled_model()).alias("s"))
    return s.select("id", "s.label", "s.confidence", *(F.element_at("s.probabilities", k).alias(k) for k in ("negative", "neutral", "positive")))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, words, label) of documents with exactly one subject, which are cut once."""
    one = table(spark, d, "subject_labels").groupBy("doc_id").agg(F.count_distinct("subject").alias("n"), F.max("subject").alias("label")).filter("n = 1").drop("n")
    docs = table(spark, d, "documents").select("doc_id", "text").join(one, "doc_id")
    return written(spread(docs, "doc_id").select("doc_id", "label", without_stop_words(F.coalesce(K.segment("text"), F.array().cast("array<string>")), STOP).alias("words")), "labelled-words")


def nb_posterior(spark: SparkSession, d: str) -> DataFrame:
    docs = _labelled(spark, d)
    return NaiveBayes.fit(docs, "words", "label").posterior(docs, "doc_id", "words").select(F.col("id").alias("doc_id"), "label", F.round("p", 6).alias("p"))


def hmm_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return hmm_counts(_tagged(spark, d), "words", "tags")


def dependency(spark: SparkSession, d: str) -> DataFrame:
    rows = _tagged(spark, d).select("id", F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "x")).select("id", "pos", F.col("x.words").alias("word"), F.col("x.tags").alias("tag"))
    return dependency_heads(rows)


def translate_en_zh(spark: SparkSession, d: str) -> DataFrame:
    once = table(spark, d, "translation").filter("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return once.select("id", to_chinese("text").alias("translation"))


def _digits(p: str) -> str:
    return p.replace(r"\d", r"\p{Nd}")


def entity_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of each entity pattern in each ner text, before overlaps are settled."""
    once = table(spark, d, "ner").filter("text is not null").groupBy("id").agg(F.min("text").alias("text"))
    found = [F.size(F.regexp_extract_all("text", F.lit(_digits(p)), F.lit(0))).alias(f"n{i}_{kind.lower()}") for i, (kind, p) in enumerate(PATTERNS)]
    return once.select("id", *found)


NAMED = {"zh->en": "Chinese to English", "en->zh": "English to Chinese"}


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Translations as English sentences, and the names of their directions."""
    once = table(spark, d, "translation").filter("id is not null").groupBy("id").agg(F.max(F.struct("result.translation", "result.direction")).alias("r"))
    return once.select("id", english_sentence("r.translation").alias("sentence"), label("r.direction", NAMED).alias("direction"))


def keyword_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each record's keywords by score and by frequency, as sparse vectors."""
    k = table(spark, d, "keywords").select("id", F.explode("result.keywords").alias("k")).filter("k.word is not null")
    number = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    best = k.groupBy("id", "k.word").agg(F.max(number(F.col("k.score"))).alias("score"), F.max(number(F.col("k.freq"))).alias("freq"))
    maps = best.groupBy("id").agg(*(F.map_from_entries(F.collect_list(F.struct("word", c))).alias(c) for c in ("score", "freq")))
    return maps.select("id", F.round(map_cosine("score", "freq"), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    sentence_split, tokenize_counts, clean_removed, filtered_words, tfidf_top_terms, vocabulary, cooccurrence_edges, ppmi_pairs, keyword_scaled, new_words,
    lexicon_sentiment, sentiment_windows, sentiment_bayes, nb_posterior, hmm_tag_counts, dependency, translate_en_zh, entity_pattern_counts, text_functions, keyword_likeness,
)}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in row) + ")" for row in pairs)


_TOKENS = "regexp_extract_all(text, '" + TOKEN_PATTERN + "')"
_SPACES = f"[{SPACE_CLASS}]+"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}|{_SPACES}$', '', 'g')"


_STOP = _list(STOP)
_DOCS = "SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL"
_HAN_IN = "regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]')"


def _content_sql(words: str) -> str:
    return f"list_filter({words}, lambda w: w IS NOT NULL AND NOT list_contains({_STOP}, w) AND (length(w) >= 2 OR {_HAN_IN.format('w')}) AND {_strip('w')} <> '')"


_WORDS = "once AS (SELECT id, min(result.words) AS words FROM segment GROUP BY id HAVING min(result.words) IS NOT NULL), w AS (SELECT id, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS word FROM once)"
_TAGGED = """tagged AS (
    SELECT id, s.w AS words, s.t AS tags FROM (
        SELECT id, min({'w': result.dependency.words, 't': result.dependency.tags}) AS s FROM parse
        WHERE len(result.dependency.words) = len(result.dependency.tags) AND len(list_filter(result.dependency.tags, lambda t: t IS NULL)) = 0 GROUP BY id))"""


def _edges(window: int, vocab: bool, equal: bool) -> str:
    keep = " JOIN vocab va ON va.term = a.word JOIN vocab vb ON vb.term = b.word" if vocab else ""
    other = "" if equal else " AND a.word <> b.word"
    return f"""pairs AS (SELECT a.word AS x, b.word AS y, 1.0::DOUBLE / (b.pos - a.pos) AS decay FROM w a JOIN w b ON a.id = b.id AND b.pos BETWEEN a.pos + 1 AND a.pos + {window - 1}{keep} WHERE a.word IS NOT NULL AND b.word IS NOT NULL{other}),
        edges AS (SELECT src, dst, sum(decay) AS weight FROM (SELECT x AS src, y AS dst, decay FROM pairs UNION ALL SELECT y, x, decay FROM pairs) GROUP BY src, dst)"""


def _vocab(size: int, least: int) -> str:
    return f"vocab AS (SELECT term, count, rank FROM (SELECT word AS term, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(ROW(id, pos))) AS rank FROM w WHERE word IS NOT NULL GROUP BY word) WHERE rank <= {size} AND count >= {least})"


_SENT = f"""
    lex AS (SELECT * FROM (VALUES {_values([*((w, 1.0) for w in sorted(DEFAULT.positive)), *((w, -1.0) for w in sorted(DEFAULT.negative))])}) t(word, value)),
    deg AS (SELECT * FROM (VALUES {_values(sorted(DEFAULT.degree.items()))}) t(word, degree)),
    neg AS (SELECT * FROM (VALUES {_values((w, True) for w in sorted(DEFAULT.negation))}) t(word, negation)),
    joined AS (SELECT w.id, w.pos, value::DOUBLE AS value, degree::DOUBLE AS degree, negation FROM w LEFT JOIN lex USING (word) LEFT JOIN deg USING (word) LEFT JOIN neg USING (word)),
    each_word AS (SELECT id, value, coalesce(value * CASE WHEN max(coalesce(negation, false)) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) THEN -1.0 ELSE 1.0 END::DOUBLE
        * coalesce(lag(degree, 2) OVER p, lag(degree, 1) OVER p, 1.0), 0.0)::DOUBLE AS v FROM joined WINDOW p AS (PARTITION BY id ORDER BY pos)),
    total AS (SELECT id, sum(v) AS raw, count(*) AS n, count(*) FILTER (value > 0) AS positive, count(*) FILTER (value < 0) AS negative FROM each_word GROUP BY id),
    scored AS (SELECT *, tanh(raw / sqrt(greatest(n, 1)::DOUBLE)) AS s FROM total)"""
_SENT_OUT = "round(raw, 4) AS raw_score, round(s, 4) AS score, CASE WHEN s >= 0.15 THEN 'positive' WHEN s <= -0.15 THEN 'negative' ELSE 'neutral' END AS polarity"


def nb_posteriors() -> str:
    """CTEs that end in p(id, label, p): posteriors of the model of the labelled sentences, of once(id) and w(id, word)."""
    return f"""
        model AS MATERIALIZED (SELECT * FROM (
            WITH RECURSIVE labelled(id, text, label) AS (VALUES {", ".join(f"({i}, {M.text(t)}, {M.text(k)})" for i, (t, k) in enumerate(DEFAULT.labelled))}), {M.segmented("SELECT id, text FROM labelled")},
            cnt AS (SELECT label, word, count(*) AS c FROM words JOIN labelled USING (id) GROUP BY label, word), tot AS (SELECT label, sum(c) AS t FROM cnt GROUP BY label), v AS (SELECT DISTINCT word FROM words)
            SELECT label, word, ln((coalesce(c, 0) + 1.0) / (t + (SELECT count(*) FROM v))::DOUBLE) AS logp FROM v CROSS JOIN tot LEFT JOIN cnt USING (label, word))),
        prior(label, prior) AS (VALUES {", ".join(f"({M.text(k)}, ln({n} / {len(DEFAULT.labelled)}.0::DOUBLE))" for k, n in sorted(Counter(k for _, k in DEFAULT.labelled).items()))}),
        sums AS (SELECT id, label, sum(logp) AS s FROM w JOIN model USING (word) GROUP BY id, label),
        score AS (SELECT once.id, label, prior + coalesce(s, 0.0) AS s FROM once CROSS JOIN prior LEFT JOIN sums USING (id, label)),
        e AS (SELECT id, label, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM score),
        p AS (SELECT id, label, e / sum(e) OVER (PARTITION BY id) AS p FROM e)"""


def _nb_sql() -> str:
    labels = sorted({k for _, k in DEFAULT.labelled})
    return f"WITH {_WORDS}, {nb_posteriors()} SELECT id, arg_max(label, p) AS label, round(max(p), 4) AS confidence, {', '.join(f"round(max(p) FILTER (label = '{k}'), 4) AS {k}" for k in labels)} FROM p GROUP BY id"


_GRAM_BREAKS = GRAM_BREAKS.replace("'", "''")
_EN_ZH = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in DEFAULT.en_zh.items()) + "}"
_NOUNS, _NOMINALS = "('n','ns','nt','nr')", "('n','r','ns','nr','nt')"

ORACLES = {
    "text_functions": f"""
        WITH r AS (SELECT id, max({{'t': result.translation, 'd': result.direction}}) AS r FROM translation WHERE id IS NOT NULL GROUP BY id), s AS (SELECT id, {_strip('r.t')} AS s, r.d AS d FROM r)
        SELECT id, CASE WHEN s = '' THEN s ELSE upper(s[1]) || s[2:] || CASE WHEN regexp_matches(s, '[.!?]$') THEN '' ELSE '.' END END AS sentence, CASE d {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items())} ELSE d END AS direction FROM s""",
    "keyword_likeness": """
        WITH k AS (SELECT id, unnest(result.keywords) AS k FROM keywords),
        b AS (SELECT id, k.word, max(CASE WHEN isnan(k.score) THEN 0.0 ELSE coalesce(k.score, 0.0) END) AS s, max(CASE WHEN isnan(k.freq) THEN 0.0 ELSE coalesce(k.freq, 0.0) END) AS f FROM k WHERE k.word IS NOT NULL GROUP BY id, k.word)
        SELECT id, round(coalesce(sum(s * f) / nullif(sqrt(sum(s * s)) * sqrt(sum(f * f)), 0.0), 0.0), 6) AS cosine FROM b GROUP BY id""",
    "sentence_split": f"""
        WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){_SPACES}', '\\1' || chr(10), 'g'), '[。！？!?；;' || chr(10) || ']+'), lambda p: {_strip('p')}), lambda p: p <> '') AS s FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence FROM parts""",
    "tokenize_counts": f"""
        WITH t AS (SELECT doc_id, coalesce({_TOKENS}, []) AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, len(list_filter(t, lambda x: {_HAN_IN.format('x')}))::INT AS n_han FROM t""",
    "clean_removed": f"""
        WITH RECURSIVE {M.segmented(_DOCS)},
        t AS (SELECT d.doc_id, coalesce(list(word ORDER BY n, i) FILTER (word IS NOT NULL), []) AS t FROM documents d LEFT JOIN words w ON w.id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id),
        k AS (SELECT doc_id, t, list_filter(t, lambda w: NOT list_contains({_STOP}, w)) AS kept FROM t)
        SELECT doc_id, coalesce(array_to_string(kept, ' '), '') AS cleaned, len(kept)::INT AS kept, len(t)::INT AS original, (len(t) - len(kept))::INT AS removed FROM k""",
    "filtered_words": f"WITH {_WORDS} SELECT id, coalesce(array_to_string({_content_sql('words')}, ' '), '') AS content FROM once",
    "tfidf_top_terms": f"""
        WITH RECURSIVE {M.segmented(_DOCS)}, docs AS (SELECT doc_id, {_content_sql('coalesce(list(word) FILTER (word IS NOT NULL), [])')} AS words FROM documents LEFT JOIN words ON id = doc_id GROUP BY doc_id),
        c AS (SELECT doc_id, term, count(*) AS count, any_value(length) AS length FROM (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM docs) GROUP BY doc_id, term),
        f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        s AS (SELECT doc_id, term, count, df, (count / length) * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1) AS weight FROM c JOIN f USING (term)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM s)
        SELECT doc_id, term, count, df, round(weight, 6) AS weight, rank::INT AS rank FROM r WHERE rank <= 5""",
    "vocabulary": f"WITH {_WORDS}, {_vocab(300, 2)} SELECT term, count, rank::INT AS rank FROM vocab",
    "cooccurrence_edges": f"WITH {_WORDS}, {_edges(4, False, False)} SELECT src, dst, round(weight, 6) AS weight FROM edges",
    "ppmi_pairs": f"""WITH {_WORDS}, {_vocab(200, 1)}, {_edges(5, True, True)},
        r AS (SELECT src, sum(weight) AS s FROM edges GROUP BY src)
        SELECT e.src, e.dst, round(greatest(ln(e.weight * (SELECT sum(weight) FROM edges) / (a.s * b.s + 1e-9)), 0.0), 6) AS ppmi FROM edges e JOIN r a ON a.src = e.src JOIN r b ON b.src = e.dst""",
    "keyword_scaled": """
        WITH k AS (SELECT id, unnest(result.keywords) AS k FROM keywords), b AS (SELECT id, k.word AS word, max(k.score) AS score FROM k WHERE k.word IS NOT NULL AND k.score IS NOT NULL AND NOT isnan(k.score) GROUP BY id, k.word),
        t AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM b)
        SELECT id, word, round(score / top, 6) AS score FROM t WHERE top > 0""",
    "new_words": f"""
        WITH bare AS (SELECT regexp_replace(t, '{_GRAM_BREAKS}', '', 'g') AS t FROM (SELECT min(text) AS t FROM corpus WHERE text IS NOT NULL GROUP BY id)),
        p AS (SELECT t, unnest(generate_series(1, length(t))) AS i FROM bare WHERE t <> ''),
        g AS (SELECT substring(t, i, n) AS gram, n, CASE WHEN i > 1 THEN substring(t, i - 1, 1) END AS l, CASE WHEN i + n <= length(t) THEN substring(t, i + n, 1) END AS r FROM p CROSS JOIN (VALUES (1), (2), (3), (4)) v(n) WHERE i + n - 1 <= length(t)),
        f AS (SELECT gram, n, count(*) AS freq FROM g GROUP BY gram, n),
        tot AS (SELECT sum(freq)::DOUBLE AS total FROM f WHERE n = 1),
        c AS (SELECT gram, freq, unnest(string_split(gram, '')) AS ch FROM f WHERE n >= 2 AND freq >= 5 AND {_HAN_IN.format('gram')}),
        mi AS (SELECT c.gram, c.freq, log2(c.freq / any_value(total)) - sum(log2(f.freq / total)) AS mi FROM c JOIN f ON f.gram = c.ch AND f.n = 1 CROSS JOIN tot GROUP BY c.gram, c.freq HAVING round(log2(c.freq / any_value(total)) - sum(log2(f.freq / total)), 9) >= 6.0),
        hl AS (SELECT gram, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT gram, l, count(*)::DOUBLE AS c FROM g JOIN mi USING (gram) WHERE l IS NOT NULL GROUP BY gram, l) GROUP BY gram),
        hr AS (SELECT gram, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT gram, r, count(*)::DOUBLE AS c FROM g JOIN mi USING (gram) WHERE r IS NOT NULL GROUP BY gram, r) GROUP BY gram)
        SELECT gram AS word, freq, round(mi, 4) AS mi, round(mi + least(coalesce(hl.h, 0.0), coalesce(hr.h, 0.0)), 4) AS score FROM mi LEFT JOIN hl USING (gram) LEFT JOIN hr USING (gram)""",
    "lexicon_sentiment": f"WITH {_WORDS}, {_SENT} SELECT once.id, coalesce(round(raw, 4), 0.0) AS raw_score, coalesce(round(s, 4), 0.0) AS score, CASE WHEN s >= 0.15 THEN 'positive' WHEN s <= -0.15 THEN 'negative' ELSE 'neutral' END AS polarity, coalesce(positive, 0)::INT AS positive, coalesce(negative, 0)::INT AS negative FROM once LEFT JOIN scored USING (id)",
    "sentiment_windows": f"WITH {_WORDS}, {_SENT} SELECT id, {_SENT_OUT} FROM scored",
    "sentiment_bayes": _nb_sql(),
    "nb_posterior": f"""
        WITH RECURSIVE one AS (SELECT doc_id, max(subject) AS label FROM subject_labels GROUP BY doc_id HAVING count(DISTINCT subject) = 1),
        {M.segmented(_DOCS)},
        docs AS (SELECT doc_id, label, {_content_sql('coalesce(list(word) FILTER (word IS NOT NULL), [])')} AS words FROM documents JOIN one USING (doc_id) LEFT JOIN words ON id = doc_id GROUP BY doc_id, label),
        prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM docs)) AS prior FROM docs GROUP BY label),
        tok AS (SELECT doc_id, label, unnest(words) AS word FROM docs),
        cnt AS (SELECT label, word, count(*) AS c FROM tok GROUP BY label, word), tot AS (SELECT label, sum(c) AS t FROM cnt GROUP BY label),
        v AS (SELECT DISTINCT word FROM tok),
        logp AS (SELECT label, word, ln((coalesce(c, 0) + 1.0) / (coalesce(t, 0) + (SELECT count(*) FROM v))::DOUBLE) AS logp FROM v CROSS JOIN prior LEFT JOIN tot USING (label) LEFT JOIN cnt USING (label, word)),
        sums AS (SELECT doc_id, logp.label, sum(logp) AS s FROM tok JOIN logp ON tok.word = logp.word GROUP BY doc_id, logp.label),
        score AS (SELECT docs.doc_id, prior.label, prior + coalesce(s, 0.0) AS s FROM docs CROSS JOIN prior LEFT JOIN sums ON sums.doc_id = docs.doc_id AND sums.label = prior.label),
        e AS (SELECT doc_id, label, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM score)
        SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM e""",
    "hmm_tag_counts": f"""
        WITH {_TAGGED}, r AS (SELECT id, generate_subscripts(words, 1) AS pos, unnest(words) AS word, unnest(tags) AS tag FROM tagged),
        n AS (SELECT *, lead(tag) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM r)
        SELECT 'start' AS kind, tag AS a, '' AS b, count(*) AS count FROM n WHERE pos = 1 GROUP BY tag
        UNION ALL SELECT 'trans', tag, nxt, count(*) FROM n WHERE nxt IS NOT NULL GROUP BY tag, nxt
        UNION ALL SELECT 'emit', word, tag, count(*) FROM n WHERE word IS NOT NULL GROUP BY word, tag""",
    "dependency": f"""
        WITH {_TAGGED}, t AS (SELECT id, (generate_subscripts(words, 1) - 1)::INT AS pos, unnest(words) AS word, unnest(tags) AS tag FROM tagged),
        f AS (SELECT *, coalesce(min(pos) FILTER (tag = 'v') OVER w, min(pos) FILTER (tag = 'a') OVER w, min(pos) FILTER (tag IN {_NOMINALS}) OVER w, 0) AS root, count(*) OVER w AS n,
            min(pos) FILTER (tag = 'v') OVER a AS nv, min(pos) FILTER (tag IN ('v','a')) OVER a AS nva, min(pos) FILTER (tag IN ('v','n','r','ns','nt')) OVER a AS nc, min(pos) FILTER (tag IN {_NOUNS}) OVER a AS nn,
            max(pos) FILTER (tag = 'v') OVER b AS pv, max(pos) FILTER (tag IN ('n','ns','nt','nr','f')) OVER b AS pp
            FROM t WINDOW w AS (PARTITION BY id), a AS (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (SELECT *, CASE WHEN pos > 0 THEN pos - 1 ELSE root END AS l, CASE WHEN pos + 1 < n THEN pos + 1 ELSE root END AS r FROM f)
        SELECT id, pos, word, tag,
            (CASE WHEN pos = root THEN -1 WHEN tag = 'u' THEN l WHEN tag = 'd' THEN coalesce(nva, r) WHEN tag = 'p' THEN coalesce(nc, r) WHEN tag = 'c' THEN coalesce(nv, r) WHEN tag IN ('m','q') THEN coalesce(nn, l)
                WHEN tag = 'a' THEN coalesce(nn, root) WHEN tag = 'f' THEN coalesce(pp, l) WHEN tag = 't' THEN root WHEN tag IN {_NOMINALS} THEN coalesce(nv, pv, nn, root) WHEN tag = 'v' THEN root ELSE l END)::INT AS head,
            CASE WHEN pos = root THEN 'root' WHEN tag = 'u' THEN 'mark' WHEN tag = 'd' THEN 'advmod' WHEN tag = 'p' THEN 'case' WHEN tag = 'c' THEN 'conj' WHEN tag = 'q' AND nn IS NOT NULL THEN 'clf' WHEN tag IN ('m','q') THEN 'nummod'
                WHEN tag = 'a' AND nn IS NOT NULL THEN 'amod' WHEN tag = 'a' THEN 'dep' WHEN tag = 'f' THEN 'lobj' WHEN tag = 't' THEN 'tmod'
                WHEN tag IN {_NOMINALS} THEN CASE WHEN nv IS NOT NULL THEN 'nsubj' WHEN pv IS NOT NULL THEN 'dobj' WHEN nn IS NOT NULL THEN 'compound' ELSE 'dep' END WHEN tag = 'v' THEN 'conj' ELSE 'dep' END AS relation
        FROM g""",
    "translate_en_zh": f"""
        WITH t AS (SELECT id, regexp_extract_all(min(text), '{ENGLISH_TOKEN.replace("'", "''")}') AS t, {_EN_ZH} AS m FROM translation WHERE text IS NOT NULL GROUP BY id)
        SELECT id, coalesce(array_to_string(list_transform(t, lambda x: coalesce(m[lower(x)], x)), ''), '') AS translation FROM t""",
    "entity_pattern_counts": "WITH t AS (SELECT id, min(text) AS text FROM ner WHERE text IS NOT NULL GROUP BY id) SELECT id, " + ", ".join(f"len(regexp_extract_all(text, '{_digits(p)}'))::INT AS n{i}_{kind.lower()}" for i, (kind, p) in enumerate(PATTERNS)) + " FROM t",
}
