import json
import math
import random

import numpy as np
import pytest

from inkstone.models import constituency
from inkstone.models.entities import EntityFinder, annotate
from inkstone.models.hmm import Hmm
from inkstone.models.kernels import Kernels
from inkstone.models.lexicon import DEFAULT, GRAMMAR, PREFERENCE, Lexicon, read_dictionary
from inkstone.models.segment import Segmenter
from inkstone.models.tagger import Tagger
from inkstone.models.translate import Translator
from inkstone.operators.dependency import heads_of
from inkstone.operators.graph import pagerank_of


@pytest.fixture(scope="module")
def segmenter():
    return Segmenter(DEFAULT)


def test_hmm_path_and_unseen_observations():
    h = Hmm(["A", "B"], 0.1).fit([[(1, "A"), (2, "B")], [(1, "A"), (2, "B")], [(2, "B"), (1, "A")]])
    assert h.viterbi([1, 2]) == ["A", "B"]
    assert h.viterbi([]) == []
    # emissions are normalised per observation
    assert math.isclose(math.exp(h.emission(1)[0]), 3.1 / 3.2)
    assert np.allclose(h.emission("new"), math.log(0.1))
    # ties go to the first state
    assert Hmm(["A", "B"], 1.0).fit([]).viterbi(["x", "y"]) == ["A", "A"]


@pytest.mark.parametrize("text, words", [("自然语言处理是人工智能的重要分支", {"自然语言", "人工智能", "是"}), ("我用Python写了100行代码", {"Python", "100"})])
def test_segment_finds(segmenter, text, words):
    assert words <= set(segmenter.cut(text))


def test_segment_keeps_all_characters(segmenter):
    for text in ("自然语言处理，是 AI 的分支。", "a.b-c@d 1.5%", "", "　 ", "𠀀字"):
        assert "".join(segmenter.cut(text)) == "".join(text.split())
    assert segmenter.cut(None) == []


def test_segment_takes_the_likeliest_words():
    s = Segmenter(Lexicon(dictionary={"研究": 5, "研究生": 5, "生命": 5, "命": 1, "的": 9}))
    assert s.cut("研究生命的") == ["研究", "生命", "的"]
    # equally likely: the shorter word first
    assert Segmenter(Lexicon(dictionary={"甲": 1, "乙": 1, "甲乙": 1, "丙": 1})).cut("甲乙") == ["甲乙"]


def test_segment_against_all_ways_through_the_dictionary():
    rng = random.Random(3)
    freq = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 3))): rng.randint(1, 9) for _ in range(20)} | dict.fromkeys("甲乙丙丁", 1)
    s, total = Segmenter(Lexicon(dictionary=freq)), sum(freq.values())
    def score(words):
        return sum(math.log(freq[w] / total) for w in words)

    def ways(t):
        return [[]] if not t else [[t[:i], *rest] for i in range(1, min(3, len(t)) + 1) if t[:i] in freq for rest in ways(t[i:])]
    for _ in range(50):
        t = "".join(rng.choice("甲乙丙丁") for _ in range(8))
        assert math.isclose(score(s.cut(t)), max(map(score, ways(t))))


def test_dictionary_lines():
    assert read_dictionary(["甲 3", "乙", "", "# 丙", "甲 2 n"]) == {"甲": 3, "乙": 1}
    assert read_dictionary(["甲 3", "乙"], {"甲": 5, "丁": 1}) == {"甲": 5, "乙": 1, "丁": 1}


def test_default_lists_are_whole():
    assert len(DEFAULT.dictionary) == 364 and len(DEFAULT.surnames) == 396 and len(DEFAULT.zh_en) == 163 and len(DEFAULT.en_zh) == 159
    assert {"刘", "林", "徐", "梁"} <= DEFAULT.surnames
    more = Lexicon.with_dictionary(["区块链 7", "我 3"])
    assert more.dictionary["区块链"] == 7 and more.dictionary["我"] == 3 and len(more.dictionary) == 365
    assert Segmenter(more).cut("我的区块链") == ["我", "的", "区块链"]
    assert more.fingerprint != DEFAULT.fingerprint == Lexicon().fingerprint


def test_lists_are_parameters():
    k = Kernels(Lexicon(suffix_tags={"猫": ("v",)}, key_tags=("v",), labelled=[("好", "yes")], titles=(), grammar=(("X", ("n", "n")),), preference=("X",)))
    assert k.tagger.candidates("三花大猫") == ["v"] and k.tagger.candidates("abc") == ["n", "v", "a"]
    assert [x[3] for x in k.grammar.parse(["a", "b"], ["n", "n"])] == ["X", "n", "n"]


G5 = "自然语言处理是人工智能的重要分支。分词是自然语言处理的基础任务。词性标注为每个词标注语法类别。命名实体识别从文本中抽取人名、地名与机构名。情感分析判断文本的正负面倾向。文本摘要自动提炼文章的核心内容。机器翻译实现不同语言之间的自动转换。"
G7 = "自然语言处理是人工智能的重要分支。机器学习推动了人工智能的发展。深度学习模型在图像识别中表现出色。", "这个产品非常好用，性能强劲，我很喜欢。但是价格有点贵，服务态度一般。"


def test_recorded_segmentations(segmenter):
    assert segmenter.cut("我爱自然语言处理") == "我 爱 自然语言 处理".split()
    assert segmenter.cut("自然语言处理是人工智能的重要分支，北京大学的研究团队开发了一个高效的机器学习系统。") == "自然语言 处理 是 人工智能 的 重要 分支 ， 北京 大学 的 研究 团队 开发 了 一个 高效 的 机器 学习 系统 。".split()


def test_recorded_tags():
    k = Kernels(DEFAULT)
    tagged = [" ".join(f"{w}/{t}" for w, t in zip(words, k.tagger.tag(words))) for words in map(k.segmenter.cut, G7)]
    assert tagged[0] == "自然语言/n 处理/v 是/v 人工智能/n 的/u 重要/a 分支/n 。/x 机器/n 学习/v 推动/v 了/u 人工智能/n 的/u 发展/v 。/x 深度/n 学习/v 模型/n 在/p 图像/n 识/n 别/d 中表/a 现出/n 色/v 。/x"
    assert tagged[1] == "这个/r 产品/n 非常/d 好/a 用/n ，/x 性能/n 强劲/n ，/x 我/r 很/d 喜欢/v 。/x 但是/c 价格/n 有/v 点贵/n ，/x 服务/a 态度/n 一般/v 。/x"


def test_recorded_keywords():
    k = Kernels(DEFAULT)
    def found(text):
        words = k.segmenter.cut(text)
        return [(x["word"], x["score"], x["freq"]) for x in k.keywords(words, k.tagger.tag(words))["keywords"]]
    assert found(G5) == [("文本", 1.0, 3), ("名", 0.8553, 3), ("自动", 0.6875, 2), ("处理", 0.6662, 2), ("自然语言", 0.6175, 2), ("语言", 0.3863, 1), ("实现", 0.3858, 1), ("翻译", 0.3852, 1), ("不同", 0.385, 1), ("机器", 0.3842, 1)]
    assert [x[:2] for x in found(G7[0])] == [("学习", 1.0), ("人工智能", 0.9859), ("识", 0.5498), ("图像", 0.5381), ("中表", 0.5353), ("模型", 0.5277), ("重要", 0.5237), ("分支", 0.5193), ("深度", 0.5161), ("机器", 0.5146)]
    assert [x[:2] for x in found(G7[1])] == [("性能", 1.0), ("点贵", 1.0), ("强劲", 0.9914), ("价格", 0.9914), ("喜欢", 0.9888), ("服务", 0.9673), ("用", 0.9673), ("态度", 0.9143), ("好", 0.9143), ("产品", 0.7881)]


def test_recorded_translation():
    assert Translator(DEFAULT, Segmenter(DEFAULT)).to_english("我喜欢机器学习，人工智能正在改变世界。") == "I like machine learning artificial intelligence 正 in 改变 world."


def test_tags():
    t = Tagger(DEFAULT)
    assert set(t.tag(Segmenter(DEFAULT).cut("我学习自然语言处理"))) <= set(t.tags)
    assert t.tag(["你好", "，", "世界", "。"])[1::2] == ["x", "x"]
    assert t.tag([]) == []
    for word, tags in (("北京", ["ns"]), ("3.5%", ["m"]), ("A4", ["m", "n"]), ("青石镇", ["ns", "n"]), ("远洋公司", ["nt", "n"]), ("作家", ["n"]), ("abc", ["n", "v", "a"])):
        assert t.candidates(word) == tags


def test_dependency_of_a_known_sentence():
    tags = "ns n u n n v u n u n v n".split()
    heads, relations = heads_of(tags)
    assert heads == [5, 5, 1, 5, 5, -1, 5, 10, 7, 10, 5, 10]
    assert relations == "nsubj nsubj mark nsubj nsubj root mark nsubj mark nsubj conj dobj".split()
    assert heads_of([]) == ([], []) and heads_of(["x"]) == ([-1], ["root"])


def test_phrase_tree_of_a_known_sentence():
    words, tags = "北京 大学 的 研究 团队 开发 了 高效 的 机器 学习 系统".split(), "ns n u n n v u n u n v n".split()
    want = "(S (NP (ns 北京) (NP (NP (n 大学) (u 的)) (NP (n 研究) (n 团队)))) (VP (VP (v 开发) (u 了)) (S (NP (NP (n 高效) (u 的)) (n 机器)) (VP (v 学习) (n 系统)))))"
    assert constituency.bracketed(constituency.parse(words, tags)) == want


def tree_by_loops(words, tags):
    """The same tree by a chart of sets, span by span and split by split."""
    n, cells, first = len(words), {}, {}
    for i, t in enumerate(tags):
        cells[i, i + 1] = {t} | {lhs for lhs, parts in GRAMMAR if parts == (t,)}
    for i, j in sorted(((i, j) for i in range(n) for j in range(i + 2, n + 1)), key=lambda s: s[1] - s[0]):
        cells[i, j] = set()
        for k in range(i + 1, j):
            for lhs, parts in GRAMMAR:
                if len(parts) == 2 and parts[0] in cells[i, k] and parts[1] in cells[k, j] and lhs not in cells[i, j]:
                    cells[i, j].add(lhs)
                    first[i, j, lhs] = k

    def show(i, j):
        if j - i == 1:
            return f"({tags[i]} {words[i]})"
        if not cells[i, j]:
            return f"(S {' '.join(show(k, k + 1) for k in range(i, j))})"
        lhs = min(cells[i, j], key=PREFERENCE.index)
        return f"({lhs} {show(i, first[i, j, lhs])} {show(first[i, j, lhs], j)})"

    return show(0, n)


def test_phrase_trees_by_loops():
    rng = random.Random(8)
    for _ in range(300):
        tags = rng.choices("n v a d r p c u m q t f ns nr nt x".split(), [4, 3, *[1] * 14], k=rng.randint(1, 14))
        words = [f"w{i}" for i in range(len(tags))]
        assert constituency.bracketed(constituency.parse(words, tags)) == tree_by_loops(words, tags)


def test_phrase_trees_of_any_tags():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 200, 900):
        tags = [rng.choice("n v a d r p c u m q t f ns nr nt x".split()) for _ in range(n)] if n < 900 else ["n"] * n
        words = [f"w{i}" if i % 17 else "。" for i in range(n)]
        nodes = constituency.parse(words, tags)
        leaves = sorted((x[5], x[4]) for x in nodes if x[4] is not None)
        assert [w for _, w in leaves] == words
        assert all(nodes[x[1]][5] <= x[5] and x[6] <= nodes[x[1]][6] for x in nodes[1:])
        def count(tree):
            todo, seen = [tree], 0
            while todo:
                t = todo.pop()
                seen += 1
                todo += t["children"]
            return seen
        if n <= 200:
            assert count(json.loads(constituency.as_json(nodes))) == len(nodes)


def test_entities():
    f = EntityFinder(DEFAULT, Segmenter(DEFAULT))
    assert [x[2:] for x in f.find("刘芳和林涛")] == [("刘芳", "PERSON"), ("林涛", "PERSON")]
    text = "马云在北京的阿里巴巴公司工作，2024年10月1日发布了新产品，价格为99.9元。"
    found = f.find(text)
    assert found == [(0, 2, "马云", "PERSON"), (3, 5, "北京", "LOCATION"), (6, 10, "阿里巴巴", "ORGANIZATION"), (15, 25, "2024年10月1日", "DATE"), (35, 40, "99.9元", "MONEY")]
    assert annotate(text, found).startswith("<PERSON>马云</PERSON>在<LOCATION>北京</LOCATION>")
    assert f.find(None) == [] and f.find("") == []
    assert all(a[1] <= b[0] for a, b in zip(f.find("12:30花了百分之五十3.5%" * 50), f.find("12:30花了百分之五十3.5%" * 50)[1:]))


def test_translation():
    t = Translator(DEFAULT, Segmenter(DEFAULT))
    assert "machine learning" in t.to_english("我喜欢机器学习")
    assert t.to_english("") == "" and t.to_english("你好。") == "Hello."


def test_pagerank_against_a_dense_power_iteration():
    rng = np.random.default_rng(2)
    n = 12
    m = rng.random((n, n)) * (rng.random((n, n)) < 0.3)
    m[3] = 0  # a sink
    src, dst = np.nonzero(m)
    out = m.sum(1)
    p = np.full(n, 1 / n)
    for _ in range(200):
        p = 0.15 / n + 0.85 * (p[out == 0].sum() / n + (p[out > 0] / out[out > 0]) @ m[out > 0])
    assert np.allclose(pagerank_of(n, src, dst, m[src, dst], tolerance=1e-12, rounds=500), p, atol=1e-9)
    assert pagerank_of(0, src[:0], dst[:0], m[:0, 0]).size == 0
