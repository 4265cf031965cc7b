"""Consolidation of small files (6) and nested records as tables (7)."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from inkstone.operators.nested import child_table, structural_tables
from inkstone.sources import consolidate as C

FILES = "file_no long, written_at timestamp, body string, id int, line string"


def files(spark, *bodies):
    rows = [(i, None if t is None else f"2024-01-{t:02d}", b, 7, "clash") for i, (t, b) in enumerate(bodies)]
    return spark.createDataFrame(rows, "file_no long, t string, body string, id int, line string").select("file_no", F.to_timestamp("t").alias("written_at"), "body", "id", "line")


@pytest.mark.parametrize("body, n", [("[]", 0), (" \n[1]\t", 1), ('﻿[{"a": "]"}, {"b": 2}]', 2), ("[1", 0), ("[1,]", 0), ("[1] x", 0), ('{"a": 1}', 0), ("", 0), (None, 0), ("[NaN]", 0), ('[{"a": " \\n"}]', 1), ("[" * 100_000, 0)])
def test_array_elements(body, n):
    assert len(C.array_elements(body)) == n


def test_newest_states(spark, rows):
    df = files(
        spark,
        (1, '[{"id": "a", "run_id": "r1"}, {"id": "b", "run_id": "r2"}]'),
        (3, '[{"run_id": "r1",\n "id": "a", "x": 2}]'),
        (2, '[{"id": "a", "run_id": "r1", "x": 1}, {"id": "b", "_deleted": true}]'),
        (4, '[{"id": "a", "run_id": "cut'),
        (4, '[{"id": "c", "run_id": null}, {"run_id": "no id"}, 5, null]'),
        (None, '[{"id": "a", "run_id": "r1", "x": 9}, {"id": "d", "run_id": "r4"}]'),
        (None, None),
    )
    assert rows(C.live_places(df.union(df)), "id", "run_id", "file_no") == [("a", "r1", 1), ("c", None, 4), ("d", "r4", 5)]


def test_consolidated_files(spark, tmp_path, rows):
    df = files(spark, *((1, json.dumps([{"id": f"i{k}-{j}", "run_id": f"r{k}-{j}", "pad": "é" * 300} for j in range(5)], indent=2, ensure_ascii=False)) for k in range(40)))
    done = C.consolidate(df.union(df.limit(3)), str(tmp_path / "out"), 100).verify()
    assert done.index.count() == 200 and 1 <= done.manifest.count() <= done.parts.count()
    assert done.parts.agg(F.sum("whole"), F.sum("cut")).first()[:] == (40, 0)
    lines = [json.loads(r.line) for r in done.lines().collect()]
    assert {x["run_id"] for x in lines} == {f"r{k}-{j}" for k in range(40) for j in range(5)}
    parts = C.read_checked(done.parts).withColumnRenamed("path", "part")
    joined = parts.join(done.index, ["part", "line_no"])
    assert joined.filter(F.get_json_object("line", "$.run_id") != F.col("run_id")).count() == 0 and joined.count() == 200
    path = done.manifest.first().path
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-3])
    with pytest.raises(Exception, match="length or checksum"):
        done.verify()


def test_nothing_to_consolidate(spark, tmp_path):
    done = C.consolidate(files(spark, (1, "[]"), (1, None)), str(tmp_path / "out")).verify()
    assert done.index.count() == 0 and done.manifest.count() == 0
    assert C.live_places(files(spark, (1, "[]")).filter("false")).count() == 0


def test_superseded_elements_are_cut_out(spark, tmp_path):
    df = files(spark, (1, '\ufeff [{"id": "é1", "run_id": "a"},\n{"id": "2", "run_id": "b", "x": [1,\r\n 2]}] '), (2, '[{"id": "é1", "run_id": "a", "y": 1}]')).withColumn("file_no", F.when(F.col("file_no") > 0, F.col("file_no")))
    done = C.consolidate(df, str(tmp_path / "out")).verify()
    assert sorted(json.loads(r.line)["id"] for r in done.lines().collect()) == ["2", "é1"]
    assert sorted((r.run_id, r.file_no) for r in done.index.collect()) == [("a", 1), ("b", None)]
    assert done.parts.agg(F.sum("whole"), F.sum("cut")).first()[:] == (1, 1)


def test_joining_bytes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(30):
        (source / f"{i:02d}.csv").write_text(f"h\n{i}" + ("\n" if i % 2 else ""))
    (source / "zz.csv").write_text("")
    out = C.concatenate_files(spark, str(source), "*.csv", str(tmp_path / "out"), 50, header=True).collect()
    values = [x for r in out for x in open(r.path).read().splitlines() if x != "h"]
    assert sorted(map(int, values)) == list(range(30)) and 2 < len(out) < 10 and sum(r.parts for r in out) == 30
    packed = tmp_path / "z"
    packed.mkdir()
    for i in range(10):
        (packed / f"{i}.zst").write_bytes(zstandard.compress(f"{i}\n".encode()))
    (one,) = C.concatenate_files(spark, str(packed), "*.zst", str(tmp_path / "out2")).collect()
    raw = zstandard.ZstdDecompressor().stream_reader(open(one.path, "rb"), read_across_frames=True).read()
    assert raw.decode().split() == [str(i) for i in range(10)]


NESTED = "id string, r struct<a: struct<words: array<string>, n: int>, list: array<struct<p: array<array<string>>, ok: boolean>>, m: map<string, int>>, place_1 string, elem int"


@pytest.fixture
def nested(spark):
    data = [
        ("1", ((["x", None, "y"], 5), [([["w", "t"], None, ["w"]], True), None, (None, None)], {"k": 1}), "clash", 1),
        ("1", ((["x", None, "y"], 5), [([["w", "t"], None, ["w"]], True), None, (None, None)], {"k": 1}), "clash", 2),
        ("2", (None, [], None), None, None),
        ("3", None, None, None),
        (None, (([], None), None, {}), None, None),
    ]
    return spark.createDataFrame(data, NESTED)


def test_child_tables(nested, rows):
    t = structural_tables(nested, "id", "r", "id")
    assert t.child_paths() == ["r.a.words", "r.list", "r.list[].p", "r.list[].p[]"]
    assert rows(t.child("a.words")) == [("1", 0, "x", "."), ("1", 1, None, "-"), ("1", 2, "y", ".")]
    assert rows(t.child("list[].p")) == [("1", 0, 0, ["w", "t"], "[.]"), ("1", 0, 1, None, "-"), ("1", 0, 2, ["w"], "[.]")]
    assert rows(t.child("list"), "place_1", "variant") == [(0, "{p:[-|[.]],ok:.}"), (1, "-"), (2, "{}")]
    assert rows(t.child("list[].p[]"), "place_1", "place_2", "place_3", "elem") == [(0, 0, 0, "w"), (0, 0, 1, "t"), (0, 2, 0, "w")]
    assert child_table(nested.filter("false"), "id", "r.list").count() == 0


def test_variants(nested, rows):
    t = structural_tables(nested, "id", "r", "id")
    shapes = dict(rows(t.supertype))
    assert shapes["3"] == "-" and shapes["2"] == "{list:[]}" and shapes["1"].startswith("{a:{words:[-|.],n:.}")
    assert sum(r.records for r in t.variants().collect()) == 4
    assert t.subtype(shapes["1"]).columns == ["id", "r_a_n"] and t.subtype(shapes["1"]).count() == 1
    assert t.subtype("-").columns == ["id"]
