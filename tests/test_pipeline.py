import pytest

from inkstone.plans.pipeline import PipelineEngine, PipelineError, Stage, run_counts
from inkstone.streaming import once_per_document, stream_batches, stream_pipeline, term_trends

DOCS = [(1, "自然语言处理是人工智能的重要分支。机器学习推动了人工智能的发展。"), (2, "这个产品非常好用，性能强劲，我很喜欢。"), (3, None), (4, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, text string")


def build(*stages, engine=None):
    return (engine or PipelineEngine()).build({"stages": [s if isinstance(s, dict) else {"name": s} for s in stages]})


def test_all_stages(docs):
    names = [s["name"] for s in PipelineEngine().list_stages()]
    assert names == "clean segment pos ner sentiment keywords summary translate parse".split()
    got = {r.id: r for r in build(*names).run_batch(docs).collect()}
    assert all(r.ok and r.error is None for r in got.values())
    assert got[2].output.sentiment.polarity == "positive" and got[1].output.keywords.keywords and got[1].output.parse.constituency
    assert got[3].output.words is None and got[4].output.words == []
    assert run_counts(build("segment").run_batch(docs)).first().succeeded == 4


def test_order_follows_needs():
    assert [s.name for s in build("pos", "clean", "segment").stages][0] == "clean"
    assert [s.name for s in build({"name": "segment", "deps": ["ner"]}, "ner").stages] == ["ner", "segment"]
    assert build({"name": "keywords", "params": {"top_k": 1}}).stages[0].params == {"top_k": 1}


@pytest.mark.parametrize("stages", [[], ["none"], [{"name": "segment", "deps": ["pos"]}, {"name": "pos", "deps": ["segment"]}], [{"name": "segment", "deps": ["zz"]}]])
def test_what_cannot_be_built(stages):
    with pytest.raises(PipelineError):
        build(*stages)


def test_errors_stay_with_their_row(docs):
    engine = PipelineEngine()
    engine.register_rows("inverse", lambda row, p: p["of"] // (row["id"] - 1), "int", ("id",), {"of": 6})
    engine.register(Stage("twice", lambda df, p: df.withColumn("twice", df.inverse * 2), ("inverse",), ("twice",)))
    got = {r.id: r for r in build("twice", "inverse", "segment", engine=engine).run_batch(docs).collect()}
    assert not got[1].ok and "ZeroDivisionError" in got[1].error and got[1].output.words
    assert got[2].ok and got[2].output.twice == 12


def test_streams(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    stream_pipeline(source(), build("segment"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    seen = []
    stream_batches(source(), build("segment"), str(tmp_path / "c2"), lambda *x: seen.append(x), str(tmp_path / "out2")).awaitTermination()
    assert sum(ok for _, ok, _ in seen) == 4


def test_stream_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", ["a", "b"]), (1, "2024-01-01 10:05:00", ["a", "b"]), (2, "2024-01-01 11:00:00", ["a"]), (3, "2024-01-09 11:00:00", ["z"])], "id int, t string, w array<string>").selectExpr("id", "timestamp(t) t", "w")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = term_trends(once_per_document(source, "id", "t"), "w", "t", delay=None).writeStream.format("memory").queryName("trends").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.term: r["count"] for r in spark.table("trends").collect()} == {"a": 2, "b": 1, "z": 1}
