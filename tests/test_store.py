import json
import threading

import pytest
from pyspark.sql import functions as F

from inkstone.sources import store as S
from inkstone.sources.uploads import decode_files, read_texts


def test_insert_filter_page(spark, tmp_path):
    s = S.Store(spark, str(tmp_path), "t", 10)
    ids = s.insert_many([{"v": v, "deep": {"w": f"x{v}"}} for v in range(25)])
    assert ids[0] == "t_1" and s.stats() == {"task": "t", "shard_size": 10, "total": 25, "shard_count": 3}
    assert s.query([("v", "gt", 20)]).count() == 4 and s.query([("v", "in", [1, 2, 3])]).count() == 3
    assert [r.id for r in s.query([("deep.w", "startswith", "x1")], "id", "desc", 1, 2).collect()] == ["t_2", "t_19"]
    assert s.get("t_3")["v"] == 2 and s.get("none") is None
    with pytest.raises(ValueError):
        s.query([("v", "like", 1)])
    with pytest.raises(TypeError):
        s.insert_many([1])


def test_natural_order(spark, tmp_path):
    s = S.Store(spark, str(tmp_path), "t", 10)
    s.insert_many([{"v": v} for v in range(25)])
    values = lambda **a: [json.loads(r.body).get("v") for r in s.query([], "v", **a).collect()]
    assert values() == list(range(25)) and values(order="desc", offset=2, limit=3) == [22, 21, 20]
    s.insert_many([{"v": "b"}, {"v": 2.5}, {"w": 1}, {"v": "a"}, {"v": None}, {"v": [1]}, {"v": 2.5}])
    assert values()[:6] == [None, None, 0, 1, 2, 2.5] and values()[-3:] == ["a", "b", [1]] and values(order="desc")[-2:] == [None, None]
    twice = [r.id for r in s.query([("v", "eq", 2.5)], "v", "desc").collect()]
    assert twice == sorted(twice, key=lambda x: int(x[2:]))


def test_locks_on_other_file_systems(spark, tmp_path):
    files = S.Files(spark, str(tmp_path))
    with S.created_lock(files, "l"):
        with pytest.raises(S.LockTimeout), S.created_lock(files, "l", timeout=0.3):
            pass
        with S.created_lock(files, "l", abandoned=-1.0):
            pass
    assert not files.exists("l")
    files.replace("m", b"1")
    files.replace("m", b"2")
    assert files.read("m") == b"2" and files.names() == ["m"]


def test_delete_and_compact(spark, tmp_path):
    s = S.Store(spark, str(tmp_path), "t", 10)
    s.insert_many([{"v": v} for v in range(15)])
    assert s.delete("t_1") and not s.delete("t_1") and not s.delete("none")
    assert s.all().count() == 14 and s.all(True).count() == 16
    done = s.compact()
    assert done["records"] == 14 and done["after_shards"] == 2 and s.all(True).count() == 14
    assert s.merge(str(tmp_path / "out")) == {"task": "t", "total": 14, "shards": 2}
    back = S.read_json_shards(spark, str(tmp_path / "out")).orderBy("shard", "seq").collect()
    assert [r.v for r in back] == list(range(1, 15)) and {r.shard for r in back} == {"shard_000000.json", "shard_000001.json"}
    assert s.insert({"v": 99}) == "t_17"
    assert [r.seq for r in s.all().collect()] == sorted(r.seq for r in s.all().collect())
    for i in range(2, 16):
        s.delete(f"t_{i}")
    s.delete("t_17")
    assert s.compact()["records"] == 0 and s.all().count() == 0


def test_frames_are_numbered_without_gaps(spark, tmp_path):
    s = S.Store(spark, str(tmp_path), "t")
    assert s.insert_frame(spark.range(1000).select(F.col("id").alias("v")).repartition(7)) == 1000
    assert sorted(int(r.id[2:]) for r in s.all().collect()) == list(range(1, 1001))


def test_concurrent_inserts(spark, tmp_path):
    s = S.Store(spark, str(tmp_path), "t", 20)
    threads = [threading.Thread(target=lambda o=o: [s.insert_many([{"v": o * 1000 + i * 10 + j} for j in range(10)]) for i in range(3)]) for o in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert s.stats()["total"] == 180 and s.all().select("id").distinct().count() == 180


def test_registry_and_lock(spark, tmp_path):
    r = S.Registry(spark, str(tmp_path))
    r.store("b"), r.store("a").insert({"x": 1})
    (tmp_path / "models").mkdir()
    assert r.tasks() == ["a", "b"] and [c["records"] for c in r.compact_all()] == [1, 0]
    with S.file_lock(tmp_path / "l"), pytest.raises(S.LockTimeout), S.file_lock(tmp_path / "l", timeout=0.1):
        pass


def test_predicates_on_typed_columns(spark):
    df = spark.createDataFrame([(1, "ab", ["x", None], {"k": 1}, {"p": {"q": 5}}), (2, None, None, None, None)], "i int, s string, a array<string>, m map<string,int>, t struct<p:struct<q:int>>")
    hold = lambda *c: [r.x for r in df.orderBy("i").select(S.predicate(df, *c).alias("x")).collect()]
    assert hold("s", "eq", None) == [False, True] and hold("s", "ne", "ab") == [False, True] and hold("s", "eq", 5) == [False, False]
    assert hold("s", "in", ["ab", None]) == [True, True] and hold("s", "not_in", ["zz"]) == [True, True] and hold("s", "in", "xaby") == [True, False]
    assert hold("a", "contains", "x") == [True, False] and hold("a", "contains", None) == [True, False] and hold("m", "contains", "k") == [True, False] and hold("s", "contains", "b") == [True, False]
    assert hold("t.p.q", "gte", 5) == [True, False] and hold("t.p.zz", "gt", 1) == [False, False] and hold("i", "startswith", "1") == [False, False] and hold("m.k", "eq", 1) == [True, False]


def test_json_shards(spark, tmp_path):
    (tmp_path / "shard_000000.json").write_text('[{"id": "a", "v": 1},\n {"id": "b", "v": 2}]', encoding="utf-8")
    (tmp_path / "shard_000001.json").write_text('[{"id": "c", "v": 3}]', encoding="utf-8")
    got = S.read_json_shards(spark, str(tmp_path), "id string, v int").orderBy("shard", "seq").collect()
    assert [r.id for r in got] == ["a", "b", "c"]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(" 自然语言\n".encode())
    (tmp_path / "b.txt").write_bytes("自然语言".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"")
    got = {r.path[-5:]: (r.text, r.length, r.encoding) for r in read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"a.txt": ("自然语言", 6, "utf-8"), "b.txt": ("自然语言", 4, "gbk")}
    odd = spark.createDataFrame([("n", None), ("x", bytearray(b"\xff\xff\xff"))], "path string, content binary")
    assert {r.path: r.text for r in decode_files(odd).collect()} == {"n": None, "x": None}
