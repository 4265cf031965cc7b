"""A document store: tasks of JSON records, tombstone deletes, queries of filter, order, offset and limit, compaction.

Records are Parquet rows (id, seq, _created, _deleted, body) with the record itself as JSON text; seq is the order of
insertion. Files are only ever added. A small meta file per task names the current generation and the next number, and is
replaced in one step under a lock, which makes every write one transaction: rows of a generation or number range the meta
file does not name are not seen.
"""

from __future__ import annotations

import fcntl
import io
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import filesystem, written

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("_created", T.DoubleType()), T.StructField("_deleted", T.BooleanType()), T.StructField("body", T.StringType())])

Predicate = tuple[str, str, object]


class LockTimeout(TimeoutError):
    pass


@contextmanager
def file_lock(path: str | os.PathLike, shared: bool = False, timeout: float = 10.0, poll: float = 0.02) -> Iterator[None]:
    """A lock between processes on `path`; raises LockTimeout when it is not to be had within `timeout` seconds."""
    with open(path, "a") as f:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, (fcntl.LOCK_SH if shared else fcntl.LOCK_EX) | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise LockTimeout(str(path)) from None
                time.sleep(poll)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


# -- predicates -------------------------------------------------------------------------------------------------------


def field_of(df: DataFrame, path: str, value: object) -> tuple[Column, T.DataType]:
    """The column at a dotted path, descending structs, and JSON text with the type of `value`; null where there is none."""
    names = path.split(".")
    kind: T.DataType = df.schema
    column: Column | None = None
    for i, name in enumerate(names):
        if isinstance(kind, T.StructType):
            if name not in kind.fieldNames():
                return F.lit(None), T.NullType()
            column = F.col(f"`{name}`") if column is None else column[name]
            kind = kind[name].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
        elif isinstance(kind, T.StringType):
            wanted = _json_type(value)
            return F.try_variant_get(F.try_parse_json(column), "$." + ".".join(names[i:]), wanted), T._parse_datatype_string(wanted)
        else:
            return F.lit(None), T.NullType()
    return column, kind


def _json_type(value: object) -> str:
    sample = next((v for v in value if v is not None), "") if isinstance(value, (list, tuple, set)) else value
    return "boolean" if isinstance(sample, bool) else "double" if isinstance(sample, (int, float)) else "string"


def _comparable(kind: T.DataType, value: object) -> bool:
    if isinstance(kind, T.NullType) or value is None:
        return False
    if isinstance(value, bool):
        return isinstance(kind, (T.BooleanType, T.NumericType))
    if isinstance(value, (int, float)):
        return isinstance(kind, (T.NumericType, T.BooleanType))
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def predicate(df: DataFrame, field: str, op: str, value: object) -> Column:
    """One condition as a column that is never null. An unknown operator is refused at once.

    eq and ne treat null as a value; the others are false for a missing field, for a null and across types, but not_in,
    which is true where in is false. startswith is false for what is no string.
    """
    c, kind = field_of(df, field, value)
    false = F.lit(False)
    if op == "eq":
        return c.isNull() if value is None else c.eqNullSafe(F.lit(value)) if _comparable(kind, value) else false
    if op == "ne":
        return ~predicate(df, field, "eq", value)
    if op == "in":
        if isinstance(value, str):
            return F.coalesce(F.instr(F.lit(value), c) > 0, false) if isinstance(kind, T.StringType) else false
        some = [v for v in value if _comparable(kind, v)]
        within = F.coalesce(c.isin(*some), false) if some else false
        return within | c.isNull() if None in value else within
    if op == "not_in":
        return ~predicate(df, field, "in", value)
    if op == "contains":
        if isinstance(kind, T.StringType):
            return F.coalesce(F.contains(c, F.lit(value)), false) if isinstance(value, str) else false
        if isinstance(kind, T.ArrayType):
            if not _comparable(kind.elementType, value):
                return F.coalesce(F.exists(c, lambda x: x.isNull()), false) if value is None else false
            return F.coalesce(F.exists(c, lambda x: x.eqNullSafe(F.lit(value))), false)
        if isinstance(kind, T.MapType):
            return F.coalesce(F.map_contains_key(c, value), false) if value is not None else false
        return F.coalesce(c.isNotNull() & F.lit(value in kind.fieldNames()), false) if isinstance(kind, T.StructType) else false
    if op == "startswith":
        return F.coalesce(F.startswith(c, F.lit(value)), false) if isinstance(kind, T.StringType) and isinstance(value, str) else false
    compare = {"gt": c > F.lit(value), "gte": c >= F.lit(value), "lt": c < F.lit(value), "lte": c <= F.lit(value)}
    if op not in compare:
        raise ValueError(f"no such operator: {op}")
    return F.coalesce(compare[op], false) if _comparable(kind, value) else false


def order_keys(df: DataFrame, path: str) -> list[Column]:
    """Columns by which the values at a dotted path have their natural order: missing and null, numbers, strings, others as JSON.

    Typed columns are a key as they are; a field of JSON text gets its rank by type first, so that 9 comes before 10.
    """
    names = path.split(".")
    kind: T.DataType = df.schema
    column: Column | None = None
    for i, name in enumerate(names):
        if isinstance(kind, T.StructType):
            if name not in kind.fieldNames():
                return [F.lit(0)]
            column = F.col(f"`{name}`") if column is None else column[name]
            kind = kind[name].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
        elif isinstance(kind, T.StringType):
            value = F.try_variant_get(F.try_parse_json(column), "$." + ".".join(names[i:]), "variant")
            of = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            rank = F.when(of == "VOID", 0).when(of.isin("BOOLEAN", "BIGINT", "DOUBLE", "FLOAT") | of.startswith("DECIMAL"), 1).when(of == "STRING", 2).otherwise(3)
            text = F.when(rank == 2, F.try_variant_get(value, "$", "string")).when(rank == 3, F.to_json(value))
            number = F.when(of == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(rank == 1, F.try_variant_get(value, "$", "double"))
            return [rank, number, text]
        else:
            return [F.lit(0)]
    return [F.coalesce(column, F.lit("")) if isinstance(kind, T.StringType) else column]


def query(df: DataFrame, where: Sequence[Predicate] = (), order_by: str | None = None, order: str = "asc", offset: int = 0, limit: int | None = None, seq: str = "seq") -> DataFrame:
    """Rows for which all conditions hold, in the natural order of one field (missing as least, ties in order of `seq`), a page of them."""
    for field, op, value in where:
        df = df.filter(predicate(df, field, op, value))
    if order_by:
        df = df.orderBy(*(k.desc_nulls_last() if order == "desc" else k.asc_nulls_first() for k in order_keys(df, order_by)), F.col(seq).asc())
    elif offset or limit is not None:
        df = df.orderBy(seq)
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def live(df: DataFrame, deleted: str = "_deleted") -> DataFrame:
    return df.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def newest_live(df: DataFrame, id: str, order: Column, deleted: Column) -> DataFrame:
    """Of each id the row that is last in `order` (a struct), unless that one is a tombstone."""
    last = df.groupBy(F.col(id).alias("_id")).agg(F.max_by(F.struct(*df.columns), order).alias("_row"), F.max_by(deleted, order).alias("_gone"))
    return last.filter("not coalesce(_gone, false)").select("_row.*")


def listing(corpus: DataFrame, id: str = "id", name: str = "name", text: str = "text", created: str = "created_at", unnamed: str = "未命名") -> DataFrame:
    """Id, name, length, time and first 80 characters of live documents with a text, newest first."""
    shown = [F.col(id).alias("id"), F.coalesce(name, F.lit(unnamed)).alias("name"), F.length(text).alias("length"), F.col(created).alias("created_at"), F.substring(text, 1, 80).alias("preview")]
    rows = live(corpus) if "_deleted" in corpus.columns else corpus
    return rows.filter(F.col(text).isNotNull()).select(*shown).orderBy(F.desc("created_at"), "id")


def texts_of(requests: DataFrame, corpus: DataFrame, text: str = "text", corpus_id: str = "corpus_id") -> DataFrame:
    """Each request's own text, or that of the corpus document it names; null where it names none. Documents count once by id."""
    found = live(corpus).groupBy(F.col("id").alias("_corpus_id")).agg(F.max("text").alias("_corpus_text"))
    joined = requests.join(found, F.col(corpus_id) == F.col("_corpus_id"), "left")
    return joined.withColumn("resolved", F.coalesce(F.nullif(F.col(text), F.lit("")), "_corpus_text")).drop("_corpus_id", "_corpus_text")


# -- the store --------------------------------------------------------------------------------------------------------


class Files:
    """What a store asks of its file system, over Hadoop's interface: any that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        root = root if ":/" in root else f"file://{os.path.abspath(root)}"
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        #: The folder as a path of this machine, where it is one.
        self.local = None if not self._fs.getUri().toString().startswith("file:") else self.root.removeprefix("file://").removeprefix("file:")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{name}".rstrip("/")))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, overwrite: bool = False) -> None:
        """A new file; fails where there is one, unless that may be overwritten."""
        stream = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def replace(self, name: str, data: bytes) -> None:
        """A file's contents in one step: written under another name, then renamed over it."""
        temporary = f"{name}-{uuid.uuid4().hex}.tmp"
        self.create(temporary, data)
        fs = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
        options[0] = fs.Options.Rename.OVERWRITE
        source, target = (self._path(f"{self.root}/{n}") for n in (temporary, name))
        fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def names(self, name: str = "") -> list[str]:
        path = self._path(f"{self.root}/{name}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime() / 1000


@contextmanager
def created_lock(files: Files, name: str, timeout: float = 10.0, poll: float = 0.2, abandoned: float = 600.0) -> Iterator[None]:
    """A lock on file systems without flock: a file that only one can create. One older than `abandoned` seconds is removed."""
    end = time.monotonic() + timeout
    while True:
        try:
            files.create(name, str(os.getpid()).encode())
            break
        except Exception as x:
            if not files.exists(name):
                raise
            if files.age(name) > abandoned:
                files.delete(name)
            elif time.monotonic() > end:
                raise LockTimeout(f"{files.root}/{name}") from x
            time.sleep(poll)
    try:
        yield
    finally:
        files.delete(name)


class Store:
    """One task's records under `root`/`task`, on a file system all executors share."""

    def __init__(self, spark: SparkSession, root: str, task: str, shard_size: int = 100):
        self.spark, self.task = spark, task
        self.files = Files(spark, f"{root}/{task}")
        self.files.make()
        with self._locked():
            if not self.files.exists("meta.json"):
                self._save({"task": task, "shard_size": shard_size, "next_id": 1, "next_seq": 0, "batches": [], "created_at": time.time()})

    def _locked(self):
        return file_lock(f"{self.files.local}/meta.lock") if self.files.local else created_lock(self.files, "meta.lock")

    def meta(self) -> dict:
        return json.loads(self.files.read("meta.json"))

    def _save(self, meta: dict) -> None:
        self.files.replace("meta.json", json.dumps(meta, ensure_ascii=False).encode())

    def _add(self, rows: DataFrame, meta: dict) -> None:
        """Write a batch and name it in the meta file, all or nothing."""
        batch = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.files.root}/{batch}")
        self._save(meta | {"batches": [*meta["batches"], batch]})

    def insert(self, record: dict) -> str:
        return self.insert_many([record])[0]

    def insert_many(self, records: Sequence[dict]) -> list[str]:
        """Append all records or none; an id is made of the task's name and the next number where a record has none.

        The records, which the caller holds in memory, become one Parquet file without a Spark job.
        """
        for r in records:
            if not isinstance(r, dict):
                raise TypeError("a record is a dict")
        with self._locked():
            meta, rows, ids = self.meta(), [], []
            for r in records:
                r = {"id": f"{self.task}_{meta['next_id']}", "_created": time.time()} | r
                rows.append((str(r["id"]), meta["next_seq"], float(r["_created"]), bool(r.get("_deleted", False)), json.dumps(r, ensure_ascii=False)))
                ids.append(str(r["id"]))
                meta["next_id"] += 1
                meta["next_seq"] += 1
            if rows:
                buffer = io.BytesIO()
                pq.write_table(pa.table({f.name: pa.array(c, to_arrow_type(f.dataType)) for f, c in zip(SCHEMA, zip(*rows))}), buffer)
                batch = f"rows-{uuid.uuid4().hex}"
                self.files.create(f"{batch}/part-00000.parquet", buffer.getvalue())
                self._save(meta | {"batches": [*meta["batches"], batch]})
        return ids

    def insert_frame(self, df: DataFrame) -> int:
        """Append the rows of a frame as records, numbered without gathering them in one place; returns their number."""
        from ..operators.prefix import running_sum

        with self._locked():
            meta = self.meta()
            body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
            own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
            rows = df.select(body.alias("body"), F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"), F.lit(1).cast("long").alias("one"), own.alias("own"))
            incoming = f"incoming-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.files.root}/{incoming}")
            frozen = self.spark.read.parquet(f"{self.files.root}/{incoming}")
            n = frozen.count()
            numbered = running_sum(frozen, [], "part", ["at"], "one", "n")
            done = numbered.select(F.coalesce("own", F.concat(F.lit(f"{self.task}_"), (F.col("n") + meta["next_id"] - 1).cast("string"))).alias("id"), (F.col("n") + meta["next_seq"] - 1).alias("seq"), F.lit(time.time()).alias("_created"), F.lit(False).alias("_deleted"), "body")
            self._add(done, meta | {"next_id": meta["next_id"] + n, "next_seq": meta["next_seq"] + n})
            self.files.delete(incoming)
        return n

    def _raw(self) -> DataFrame:
        batches = self.meta()["batches"]
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.files.root}/{b}" for b in batches))

    def rows(self, include_deleted: bool = False) -> DataFrame:
        """All records in no order. A tombstone hides the records of its id that are older; include_deleted shows both."""
        rows = self._raw()
        if include_deleted:
            return rows
        dead = rows.filter("_deleted").groupBy("id").agg(F.max("seq").alias("dead"))
        return rows.filter("not _deleted").join(dead, "id", "left").filter("dead is null or seq > dead").drop("dead")

    def all(self, include_deleted: bool = False) -> DataFrame:
        """All records in order of insertion."""
        return self.rows(include_deleted).orderBy("seq")

    def get(self, id: str) -> dict | None:
        """The first record with an id that is not deleted."""
        row = self.rows().filter(F.col("id") == id).orderBy("seq").limit(1).collect()
        return json.loads(row[0].body) if row else None

    def query(self, where: Sequence[Predicate] = (), order_by: str | None = None, order: str = "asc", offset: int = 0, limit: int | None = None, include_deleted: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Predicates and order name fields of the record; (id, seq, _created, body) of a page of those that fit.

        keep: a further filter of the rows, before they are ordered and paged. Without an order, records come as they were inserted.
        """
        prefix = lambda f: f if f in ("id", "_created") else f"body.{f}"
        rows = query(keep(self.rows(include_deleted)), [(prefix(f), op, v) for f, op, v in where], order_by and prefix(order_by), order, offset, limit)
        return rows if order_by or offset or limit is not None else rows.orderBy("seq")

    def delete(self, id: str) -> bool:
        """Write a tombstone; False if there is no live record of that id (deleting twice changes nothing)."""
        if self.get(id) is None:
            return False
        self.insert_many([{"id": id, "_deleted": True}])
        return True

    def stats(self) -> dict:
        """Task, shard size, live records, and shards they fill."""
        meta, n = self.meta(), self.rows().count()
        return {"task": self.task, "shard_size": meta["shard_size"], "total": n, "shard_count": -(-n // meta["shard_size"])}

    def compact(self, records_per_file: int = 1_000_000) -> dict:
        """Rewrite live records as one batch of well-filled files and drop the old ones; order and numbers stay.

        Files of up to `records_per_file` records are cut by ranges of numbers, so that each is in order and so are their names.
        """
        with self._locked():
            meta = self.meta()
            before = sum(1 for b in meta["batches"] for n in self.files.names(b) if n.endswith(".parquet"))
            rows = self.rows()
            n = rows.count()
            shards = -(-n // meta["shard_size"])
            if n:
                self._add(rows.repartitionByRange(max(1, -(-n // records_per_file)), "seq").sortWithinPartitions("seq"), meta | {"batches": []})
            else:
                self._save(meta | {"batches": []})
            for batch in meta["batches"]:
                self.files.delete(batch)
        return {"task": self.task, "before_files": before, "after_shards": shards, "records": n}

    def merge(self, target: str) -> dict:
        """Export all live records, in order, as shards of JSON arrays in the folder `target`: shard_000000.json and so on.

        Records are numbered by running sums over ranges, and every shard is written by one task. A repeated task writes the
        same bytes under the same name.
        """
        from ..operators.prefix import running_sum

        size = self.meta()["shard_size"]
        target = target.rstrip("/")
        live = written(self.rows().select("seq", "body", F.lit(1).cast("long").alias("one"), F.floor(F.col("seq") / 100_000).alias("range")), "live-records")
        numbered = running_sum(live, [], "range", ["seq"], "one", "n").select(((F.col("n") - 1) / size).cast("long").alias("shard"), "n", "body")

        def write(part: pa.Table) -> pa.Table:
            shard = part["shard"][0].as_py()
            lines = [x for _, x in sorted(zip(part["n"].to_pylist(), part["body"].to_pylist()))]
            system, path = filesystem(f"{target}/shard_{shard:06d}.json")
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path, compression=None) as out:
                out.write(("[\n  " + ",\n  ".join(lines) + "\n]\n").encode())
            return pa.table({"shard": pa.array([shard], pa.int64()), "records": pa.array([len(lines)], pa.int64())})

        done = numbered.groupBy("shard").applyInArrow(write, "shard long, records long").agg(F.count("*").alias("shards"), F.coalesce(F.sum("records"), F.lit(0)).alias("total")).first()
        return {"task": self.task, "total": done.total, "shards": done.shards}


class Registry:
    """All tasks under a folder."""

    def __init__(self, spark: SparkSession, root: str, shard_size: int = 100):
        self.spark, self.root, self.shard_size = spark, root.rstrip("/"), shard_size
        self.files = Files(spark, self.root)
        self.files.make()

    def store(self, task: str) -> Store:
        return Store(self.spark, self.root, task, self.shard_size)

    def tasks(self) -> list[str]:
        return [name for name in self.files.names() if self.files.exists(f"{name}/meta.json")]

    def compact_all(self) -> list[dict]:
        return [self.store(t).compact() for t in self.tasks()]


def read_json_shards(spark: SparkSession, folder: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Records of shard files that are JSON arrays of objects, with the file's name and place for their order."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(folder)
    return df.select("*", F.col("_metadata.file_name").alias("shard")).withColumn("seq", F.row_number().over(W.partitionBy("shard").orderBy(F.monotonically_increasing_id())) - 1)
