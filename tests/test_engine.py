import pytest

from inkstone.engine import Engine
from inkstone.operators.vectors import word_similarity

TEXTS = ["自然语言处理是人工智能的重要分支", "机器学习是人工智能的核心技术", "深度学习推动了人工智能的发展", "分词是自然语言处理的基础任务"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("engine")))


def test_corpus(engine):
    ids = [engine.add_document(t, f"d{i}") for i, t in enumerate(TEXTS)]
    with pytest.raises(ValueError):
        engine.add_document("  ")
    up = engine.upload(" 上传的文本 ".encode("gbk"))
    assert up["length"] == 7 and up["encoding"] == "gbk"
    assert engine.documents().count() == 5 and engine.documents().first().preview == "上传的文本"
    assert [r.id for r in engine.texts([ids[2], "none", ids[0], ids[2]]).collect()] == [ids[2], ids[0], ids[2]]
    assert engine.clean(ids[0])["removed_stopwords"] == 2
    assert engine.corpus.delete(up["id"]) and engine.documents().count() == 4


def test_analyses_are_kept(engine):
    text = "马云在北京工作，2024年10月1日花了99.9元，非常好。"
    got = {t: engine.analyse(t, text) for t in ("segment", "pos", "parse", "ner", "sentiment", "summary", "translate", "keywords")}
    assert got["ner"]["entities"][0] == {"start": 0, "end": 2, "text": "马云", "type": "PERSON"} and got["ner"]["annotated"].startswith("<PERSON>马云</PERSON>")
    assert got["sentiment"]["polarity"] == "positive" and got["parse"]["dependency"]["heads"].count(-1) == 1 and got["keywords"]["keywords"]
    assert engine.analyse("translate", "I like China", direction="en2zh", keep=False)["translation"] == "我喜欢中国"
    assert engine.analyse("segment", corpus_id="corpus_1")["count"] > 0
    with pytest.raises(ValueError):
        engine.analyse("segment", corpus_id="none")
    with pytest.raises(ValueError):
        engine.analyse("guess", text)
    assert engine.results("ner", "PERSON").count() == 1 and engine.results("ner", "TIME").count() == 0
    assert engine.results("segment", corpus_id="corpus_1").count() == 1 and engine.results("segment", order_by="created_at", limit=1).first().id == "segment_2"
    assert {s["task"] for s in engine.result_tasks()} >= {"segment", "ner"} and "corpus" not in {s["task"] for s in engine.result_tasks()}
    engine.annotate(text, [{"start": 0, "end": 2, "type": "PERSON"}])
    assert engine.annotations().count() == 1 and engine.status()["stages"] == 9 and engine.meta()["tags"]["n"] == "名词"


def test_embeddings(engine):
    stats = engine.train_embeddings(dim=4, window=3)
    assert stats["vocab_size"] > 5 and stats["dim"] == 4 == len(stats["singular_values"])
    near = engine.neighbours("人工智能", 3).collect()
    assert len(near) == 3 and "人工智能" not in {r.word for r in near} and engine.neighbours("none").count() == 0
    assert engine.word_map(3).count() == stats["vocab_size"]
    model, _ = engine.embeddings()
    assert word_similarity(model, "人工智能", "人工智能") == pytest.approx(1) and word_similarity(model, "人工智能", "none") == 0


def test_pipelines(engine):
    config = {"name": "p", "stages": [{"name": "segment"}, {"name": "sentiment"}]}
    pid = engine.save_pipeline(config)
    assert engine.preview(config, "很好")["output"]["words"]
    run = engine.run_pipeline(pid)
    assert (run["doc_count"], run["failed"]) == (4, 0)
    record, results = engine.run(run["run_id"])
    assert record["succeeded"] == results.count() == 4 and engine.run("none") is None
    with pytest.raises(ValueError):
        engine.run_pipeline("none")
    with pytest.raises(ValueError):
        engine.save_pipeline({"stages": [{"name": "none"}]})
