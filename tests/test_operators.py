import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as X
from inkstone.functions.registry import register_functions
from inkstone.models import kernels as K
from inkstone.models.hmm import Hmm
from inkstone.operators import vectors, weights
from inkstone.operators.dependency import dependency_heads, heads_of
from inkstone.operators.graph import pagerank, pagerank_of
from inkstone.operators.markov import hmm_counts, hmm_from_counts
from inkstone.operators.prefix import running_sum
from inkstone.operators.sentiment import NaiveBayes, bayes_score, labelled_model, lexicon_score


def one(spark, column, kind, value):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_text_expressions(spark):
    assert one(spark, X.sentences("x"), "string", "好。你好！ Fine. Next one? yes;") == ["好", "你好", "Fine.", "Next one", "yes"]
    assert one(spark, X.sentences("x"), "string", None) == [] and one(spark, X.tokens("x"), "string", None) == []
    assert one(spark, X.tokens("x"), "string", "a-b 自然　v1.2, é") == ["a-b", "自", "然", "v1.2", ",", "é"]
    assert one(spark, X.single_spaced("x"), "string", "　a  \n b ") == "a b"
    assert one(spark, X.english_sentence("x"), "string", " hello there ") == "Hello there."
    assert one(spark, X.english_sentence("x"), "string", "  ") == ""
    assert one(spark, X.without_stop_words("x", ["the"]), "array<string>", ["the", "The", "a", "的", " ", None, "ok"]) == ["The", "的", "ok"]
    assert one(spark, X.cosine("x", "x"), "array<double>", [3.0, 4.0]) == 1.0
    assert one(spark, X.cosine("x", "x"), "array<double>", [0.0, 0.0]) == 0.0 and one(spark, X.cosine("x", "x"), "array<double>", None) == 0.0
    assert one(spark, X.map_cosine("x", F.create_map(F.lit("a"), F.lit(1.0), F.lit("z"), F.lit(1.0))), "map<string,double>", {"a": 2.0, "b": 0.0}) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, X.label("x", {"n": "名词"}), "string", "n") == "名词" and one(spark, X.label("x", {"n": "名词"}), "string", "q") == "q"


def test_tfidf_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None)], "id int, w array<string>")
    got = {(r.id, r.term): r.weight for r in weights.tfidf(docs, "id", "w").collect()}
    assert got == {(1, "a"): pytest.approx(2 / 3 * (math.log(5 / 3) + 1)), (1, "b"): pytest.approx(1 / 3 * (math.log(5 / 2) + 1)), (2, "a"): pytest.approx(math.log(5 / 3) + 1)}
    assert weights.tfidf(docs.filter("false"), "id", "w").count() == 0


def test_cooccurrence_against_loops(spark):
    docs = [["a", "b", "a", "c", None, "a"], ["a"], [], ["b", "b", "c"]]
    for equal in (False, True):
        want = Counter()
        for d in docs:
            for i in range(len(d)):
                for j in range(i + 1, min(i + 4, len(d))):
                    if d[i] is not None and d[j] is not None and (equal or d[i] != d[j]):
                        want[d[i], d[j]] += 1 / (j - i)
                        want[d[j], d[i]] += 1 / (j - i)
        got = {(r.src, r.dst): r.weight for r in weights.cooccurrence(spark.createDataFrame([(d,) for d in docs], "w array<string>"), "w", 4, equal).collect()}
        assert got == pytest.approx(dict(want))


def test_new_words_of_a_corpus(spark):
    texts = [f"{a}量子{b}计算机{c}" for a in "春夏秋冬" for b in "东南西北" for c in "甲乙丙丁"]
    got = {r.word: r.score for r in weights.new_words(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 5, 4, 2.0, None).collect()}
    # what is always followed, or preceded, by the same character is no word
    assert got["计算机"] > got["计算"] and got["计算机"] > got["算机"]
    # 64 of 512 characters each: mi = log2((64/512) / (64/512)^2), and two bits on either side
    assert got["量子"] == pytest.approx(math.log2(512 / 64) + 2, abs=1e-4)
    assert weights.new_words(spark.createDataFrame([(None,), ("",)], "t string"), "t").count() == 0


def test_sentiment_of_known_words(spark):
    words = "这个 产品 非常 好 用 ， 性能 强劲 ， 我 很 喜欢 。 但是 价格 有 点贵 ， 服务 态度 一般 。".split()
    s = one(spark, lexicon_score("x"), "array<string>", words)
    assert (s.score, s.raw_score, s.polarity, s.positive_words, s.negative_words) == (0.8110, 5.3, "positive", ["好", "强劲", "喜欢"], [])
    assert one(spark, lexicon_score("x"), "array<string>", ["不", "喜欢"]).raw_score == -1.0
    assert one(spark, lexicon_score("x"), "array<string>", ["很", "太", "差"]).raw_score == -1.8  # the leftmost degree
    assert one(spark, lexicon_score("x"), "array<string>", None).polarity == "neutral"
    b = one(spark, bayes_score("x", labelled_model()), "array<string>", words)
    assert b.label == "positive" and sum(b.probabilities.values()) == pytest.approx(1, abs=1e-3)


def test_naive_bayes_predicts(spark):
    docs = spark.createDataFrame([(1, ["x", "y"], "a"), (2, ["z"], "b"), (3, ["x"], "a"), (4, None, "b"), (5, ["q"], None)], "id int, w array<string>, l string")
    model = NaiveBayes.fit(docs, "w", "l")
    got = {r.id: (r.label, r.p) for r in model.predict(docs, "id", "w").collect()}
    assert got[1][0] == "a" and got[2][0] == "b" and got[5][1] == pytest.approx(0.5)


def test_dependency_windows_and_arrays_agree(spark):
    rng = np.random.default_rng(5)
    tags = "n v a d r p c u m q t f ns nr nt x".split()
    sents = [[tags[i] for i in rng.integers(0, len(tags), rng.integers(1, 12))] for _ in range(200)]
    rows = spark.createDataFrame([(i, j, "w", t) for i, s in enumerate(sents) for j, t in enumerate(s)], "id int, pos int, word string, tag string")
    got = {(r.id, r.pos): (r.head, r.relation) for r in dependency_heads(rows).collect()}
    assert got == {(i, j): x for i, s in enumerate(sents) for j, x in enumerate(zip(*heads_of(s)))}


def test_hmm_from_a_table(spark):
    seqs = [[("x", "A"), ("y", "B")], [("y", "B"), ("x", "A"), ("x", "A")]]
    df = spark.createDataFrame([([o for o, _ in s], [t for _, t in s]) for s in seqs] + [(None, None), ([], [])], "o array<string>, s array<string>")
    a, b = hmm_from_counts(hmm_counts(df, "o", "s"), ["A", "B"], 0.5), Hmm(["A", "B"], 0.5).fit(seqs)
    assert np.allclose(a.start, b.start) and np.allclose(a.trans, b.trans) and all(np.allclose(a.emit[o], b.emit[o]) for o in "xy")


def test_distributed_pagerank(spark):
    rng = np.random.default_rng(3)
    src, dst = rng.integers(0, 20, 60), rng.integers(0, 25, 60)
    w = rng.random(60)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(src, dst, w)], "src long, dst long, weight double")
    nodes = sorted({*src.tolist(), *dst.tolist()})
    at = {x: i for i, x in enumerate(nodes)}
    want = pagerank_of(len(nodes), np.array([at[x] for x in src.tolist()]), np.array([at[x] for x in dst.tolist()]), w, rounds=10, tolerance=0)
    got = {r.node: r.score for r in pagerank(df, rounds=10, tolerance=0).collect()}
    assert got == pytest.approx({x: want[i] for x, i in at.items()})
    assert pagerank(df.filter("false")).count() == 0


def test_keywords_and_summary_kernels(spark):
    k = K.kernels(K.DEFAULT)
    assert k.keywords([], []) == {"keywords": [], "method": None}
    got = k.keywords("文本 名 文本 自动 处理 文本".split(), "n n n v v n".split(), 2)["keywords"]
    assert got[0] == {"word": "文本", "score": 1.0, "freq": 3.0} and len(got) == 2
    assert k.summary("")["sentences"] == [] and k.summary("一句话。")["summary"] == "一句话"
    s = k.summary("自然语言处理是人工智能的重要分支。它研究如何让计算机理解语言。分词是基础任务。词性标注是另一个任务。", 0.5)
    assert len(s["top_indices"]) == 2 and len(s["sentences"]) == 4
    long = k.summary("计算机理解语言。数据分析很重要。" * 1500)
    assert len(long["top_indices"]) == 900


def test_nearest_and_kmeans(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    got = {}
    for r in vectors.nearest(df, df.filter("id < 5"), "id", "v", 3).collect():
        got.setdefault(r.query, []).append((r.rank, r.neighbour))
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(5):
        s = u @ u[q]
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == np.argsort(-s)[:3].tolist()
    labels, centres = vectors.kmeans(df, "id", "v", 4)
    assert labels.count() == 300 and centres.shape == (4, 8)
    few, _ = vectors.kmeans(df.filter("id < 3"), "id", "v", 5)
    assert few.select("cluster").distinct().count() == 3


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    points, variance = vectors.principal_components(df, "id", "v", 2)
    p = np.array([r.point for r in points.orderBy("id").collect()])
    c = x - x.mean(0)
    assert np.allclose(variance, np.linalg.svd(c)[1][:2] ** 2) and np.allclose((p**2).sum(0), variance)
    assert vectors.principal_components(df.limit(1), "id", "v")[0].first().point == [0.0, 0.0]


def test_embeddings(spark, tmp_path):
    sents = ["自然语言 处理 是 人工智能 的 重要 分支", "机器 学习 是 人工智能 的 核心 技术", "深度 学习 推动 了 人工智能 的 发展", "分词 是 自然语言 处理 的 基础 任务"] * 3
    df = spark.createDataFrame([(i, s.split()) for i, s in enumerate(sents)], "id int, w array<string>")
    model, s = vectors.train_embeddings(df, "id", "w", 60, 8, 3, 1)
    assert model.orderBy("rank").first().word == "人工智能" and len(model.first().vector) == len(s) == 8
    vectors.save_model(model, s, str(tmp_path / "m"))
    again, values = vectors.load_model(spark, str(tmp_path / "m"))
    assert again.count() == model.count() and np.allclose(values, s)
    near = vectors.nearest(model, model, "word", "vector", 3)
    assert near.filter("query = neighbour").count() == 0
    empty, none = vectors.train_embeddings(df.filter("false"), "id", "w")
    assert empty.count() == 0 and none.size == 0


def test_running_sum(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("b"), (F.col("id") % 5).alias("v"))
    got = sorted((r.g, r.b, r.id, r.s) for r in running_sum(df, ["g"], "b", ["id"], "v", "s").collect())
    total = Counter()
    for g, _, i, s in got:
        total[g] += i % 5
        assert s == total[g]


def test_functions_of_sql(spark):
    register_functions(spark)
    r = spark.sql("SELECT cut('我爱自然语言') AS c, tag(cut('我爱自然语言')) AS t, to_english('你好') AS e, heads(array('n', 'v')) AS h, phrase_tree(array('x'), array('n')) AS p").first()
    assert r.c == ["我", "爱", "自然语言"] and r.t[0] == "r" and r.e == "Hello." and r.h == [1, -1] and '"n"' in r.p
    assert [x.type for x in spark.sql("SELECT e.* FROM (SELECT '在北京花了5元' AS t) d, LATERAL entities(d.t) e").collect()] == ["LOCATION", "MONEY"]
