"""Many tiny files as few well-sized ones, joined as bytes.

concatenate joins newline-delimited files, or complete zstandard frames, byte by byte. Files that are JSON arrays with several
states of a record first need to be told which of their elements live: a scan gives each element's id and place, the newest
state of every id is found among these alone, and the live elements' bytes are then cut out of the bodies as lines (line
breaks between JSON tokens become spaces, a JSON string holds none) and packed to complete frames, one part per task. The
parts are joined byte by byte to the final files.

Parts and files carry attempt-unique names and count only if the table written at the end of a successful task names them, so
a repeated task neither loses nor doubles records. Lengths and checksums are checked when the files are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running_sum
from ..session import filesystem, scratch_path, spread, spread_again, written

#: Bytes of a file, of a frame before compression, and of what is copied at once.
FILE_BYTES, FRAME_BYTES, BLOCK_BYTES = 128 << 20, 1 << 20, 8 << 20

_SPACE = " \t\n\r"


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_constant=_refuse)


def array_elements(body: str | None) -> list[tuple[object, int, int]]:
    """(value, start, end) of each element of a complete JSON array, apart from a byte order mark and white space; else []."""
    if not body:
        return []
    inner = body.lstrip("\ufeff" + _SPACE)
    at = len(body) - len(inner)
    n = len(body.rstrip("\ufeff" + _SPACE))
    if not inner.startswith("["):
        return []
    found: list[tuple[object, int, int]] = []

    def skip(i: int) -> int:
        while i < n and body[i] in _SPACE:
            i += 1
        return i

    try:
        at = skip(at + 1)
        if body[at] == "]":
            return found if at == n - 1 else []
        while True:
            value, end = _decoder.raw_decode(body, at)
            found.append((value, at, end))
            at = skip(end)
            if body[at] == "]":
                return found if at == n - 1 else []
            if body[at] != ",":
                return []
            at = skip(at + 1)
    except (ValueError, IndexError, RecursionError):
        return []


def live_places(files: DataFrame) -> DataFrame:
    """(file_no, digest, run_id, id, start, stop, of) of each live record of (file_no, written_at, body) files, in its newest state.

    The newest state of an id is that of the greatest (written_at, file_no, place in the file); a null time is the oldest.
    Where it is a tombstone, the record is not live. Bodies that are no complete array and elements without id hold none.
    `digest` is the body's, by which a file is told from another one of the same number; `of` is the number of elements of the file. Only ids and places are shuffled.
    """
    source = spread(files.select("file_no", F.coalesce(F.col("written_at").cast("double"), F.lit(float("-inf"))).alias("at"), "body", F.xxhash64("body").alias("digest")), "file_no")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for no, at, body, digest in zip(*(c.to_pylist() for c in batch.columns)):
                elements = array_elements(body)
                for place, (value, start, stop) in enumerate(elements):
                    if isinstance(value, dict) and value.get("id") is not None:
                        run = value.get("run_id")
                        rows.append((str(value["id"]), None if run is None else str(run), bool(value.get("_deleted")), no, at, place, start, stop, len(elements), digest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_SCANNED), _SCANNED.values())], list(_SCANNED))

    states = source.mapInArrow(scan, "id string, run_id string, deleted boolean, file_no long, at double, place int, start int, stop int, of int, digest long")
    newest = states.groupBy("id").agg(F.max_by(F.struct("run_id", "deleted", "file_no", "digest", "start", "stop", "of"), F.struct("at", "file_no", "place")).alias("s"))
    return newest.filter("not s.deleted").select("s.file_no", "s.digest", "s.run_id", "id", "s.start", "s.stop", "s.of")


_SCANNED = {"id": pa.string(), "run_id": pa.string(), "deleted": pa.bool_(), "file_no": pa.int64(), "at": pa.float64(), "place": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "of": pa.int32(), "digest": pa.int64()}


@dataclass(frozen=True)
class Consolidated:
    """Files written by consolidate.

    index: (part, line_no, id, run_id, file_no) of every record; parts: (path, records, raw_bytes, file_bytes, checksum, whole,
    cut), with how many source files went in with all their elements and with some; manifest: (path, parts, records, raw_bytes,
    file_bytes, checksum) of the final files.
    """

    index: DataFrame
    parts: DataFrame
    manifest: DataFrame

    def lines(self) -> DataFrame:
        """(path, line_no, line) of all files, each checked against its length and checksum as it is read."""
        return read_checked(self.manifest)

    def verify(self) -> "Consolidated":
        """Read everything back: raises unless each file's lengths, checksum and number of records agree with what was written."""
        counted, written_records = self.lines().count(), self.index.count()
        if counted != written_records:
            raise ValueError(f"{written_records} records were written, {counted} read")
        return self


def read_checked(manifest: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                with system.open_input_stream(path, compression=None) as f:
                    data = f.read()
                if len(data) != row["file_bytes"] or xxhash.xxh64_hexdigest(data) != row["checksum"]:
                    raise ValueError(f"{row['path']}: length or checksum differs")
                raw = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
                lines = raw.decode().split("\n")[:-1]
                if row["raw_bytes"] not in (None, len(raw)) or row["records"] not in (None, len(lines)):
                    raise ValueError(f"{row['path']}: {len(lines)} records of {len(raw)} bytes")
                for i in range(0, len(lines), 10_000):
                    part = lines[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part)], ["path", "line_no", "line"])

    return spread(manifest.select("path", "records", "raw_bytes", "file_bytes", "checksum"), "path").mapInArrow(read, "path string, line_no int, line string")


def consolidate(files: DataFrame, target: str | None = None, file_bytes: int = FILE_BYTES) -> Consolidated:
    """The live records of (file_no, written_at, body) files as lines of files of about `file_bytes`, in a shared folder.

    Repeated rows of one file_no and body count once. No record at all gives no file. Bodies are shuffled once, with their live places; a part's
    frames are never decoded again until they are read.
    """
    spark = files.sparkSession
    folder = (target or scratch_path(spark, "consolidated")).rstrip("/")
    once = files.filter("body is not null").groupBy("file_no", F.xxhash64("body").alias("digest")).agg(F.min("body").alias("body"))
    live = written(live_places(files), "live-places")
    places = live.groupBy(F.col("file_no").alias("no"), F.col("digest").alias("of_digest")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "id", "run_id"))).alias("places"), F.max("of").alias("of"))
    bodies = spread_again(once.join(places, F.col("no").eqNullSafe(F.col("file_no")) & (F.col("digest") == F.col("of_digest"))), files, "file_no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        name = out = None
        check, packer, pending = xxhash.xxh64(), zstandard.ZstdCompressor(level=3, write_checksum=True), bytearray()
        raw_bytes = sent_bytes = n = whole = cut = 0

        def flush():
            nonlocal sent_bytes
            if pending:
                frame = packer.compress(bytes(pending))
                out.write(frame)
                check.update(frame)
                sent_bytes += len(frame)
                pending.clear()

        for batch in batches:
            index: list[tuple] = []
            for no, body, live, of in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/parts/part-{uuid.uuid4().hex}.zst"
                    system, path = filesystem(name)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                whole += len(live) == of
                cut += len(live) < of
                for x in live:
                    line = body[x["start"] : x["stop"]].replace("\r", " ").replace("\n", " ").encode() + b"\n"
                    pending += line
                    raw_bytes += len(line)
                    index.append((x["id"], x["run_id"], no, n))
                    n += 1
                if len(pending) >= FRAME_BYTES:
                    flush()
            if index:
                columns = dict(zip(("id", "run_id", "file_no", "line_no"), zip(*index))) | {"path": [name] * len(index)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(index), f.type) for f in _WRITTEN], schema=_WRITTEN)
        if out is not None:
            flush()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n, "raw_bytes": raw_bytes, "file_bytes": sent_bytes, "checksum": check.hexdigest(), "whole": whole, "cut": cut}], _WRITTEN)

    done = written(bodies.select("file_no", "body", "places", "of").mapInArrow(write, "path string, id string, run_id string, file_no long, line_no int, records long, raw_bytes long, file_bytes long, checksum string, whole long, cut long"), "consolidated-index")
    parts = done.filter("records is not null").select("path", "records", "raw_bytes", "file_bytes", "checksum", "whole", "cut")
    joined = concatenate(spark, parts.select(F.col("path").alias("part"), F.col("file_bytes").alias("bytes"), "records", "raw_bytes", "checksum"), f"{folder}/files", file_bytes)
    return Consolidated(done.filter("records is null").select(F.col("path").alias("part"), "line_no", "id", "run_id", "file_no"), parts, joined)


_WRITTEN = pa.schema([("path", pa.string()), ("id", pa.string()), ("run_id", pa.string()), ("file_no", pa.int64()), ("line_no", pa.int32()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("file_bytes", pa.int64()), ("checksum", pa.string()), ("whole", pa.int64()), ("cut", pa.int64())])


def concatenate_files(spark: SparkSession, source: str, pattern: str = "*", target: str | None = None, file_bytes: int = FILE_BYTES, header: bool = False) -> DataFrame:
    """concatenate of the files of a folder that fit a pattern; empty files add nothing."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    none = F.lit(None).cast("long")
    parts = listed.select(F.col("path").alias("part"), F.col("length").alias("bytes"), none.alias("records"), none.alias("raw_bytes"), F.lit(None).cast("string").alias("checksum"))
    return concatenate(spark, parts.filter("bytes > 0"), target, file_bytes, header)


def concatenate(spark: SparkSession, parts: DataFrame, target: str | None = None, file_bytes: int = FILE_BYTES, header: bool = False) -> DataFrame:
    """Join newline-delimited files, or complete zstandard frames (*.zst), byte by byte; returns the manifest.

    parts: (part, bytes, records, raw_bytes, checksum), null where not known; what is known is checked. Result: (path, parts,
    records, raw_bytes, file_bytes, checksum). Plain files get a missing last line break; with `header`, the first line of all
    but the first of a file's parts is left out. Compressed files are joined as they are, frame after frame, and may not be
    mixed with plain ones in one call. A part is copied in blocks, so its size does not matter.
    """
    folder = (target or scratch_path(spark, "joined")).rstrip("/")
    sizes = parts.withColumn("bucket", F.pmod(F.xxhash64("part"), F.lit(1024)))
    placed = written(running_sum(sizes, [], "bucket", ["part"], "bytes", "upto").withColumn("file", F.floor((F.col("upto") - 1) / F.lit(file_bytes))), "joined-plan")

    def join(plan: pa.Table) -> pa.Table:
        import xxhash

        rows = sorted(plan.to_pylist(), key=lambda r: r["part"])
        packed = rows[0]["part"].endswith(".zst")
        name = f"{folder}/joined-{uuid.uuid4().hex}.{'ndjson.zst' if packed else 'txt'}"
        system, path = filesystem(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        check, size = xxhash.xxh64(), 0
        with system.open_output_stream(path, compression=None) as out:
            for i, row in enumerate(rows):
                if row["part"].endswith(".zst") != packed:
                    raise ValueError("compressed and plain files cannot be joined")
                part_system, part_path = filesystem(row["part"])
                own, read, skip, last = xxhash.xxh64(), 0, header and i > 0 and not packed, b"\n"
                with part_system.open_input_stream(part_path, compression=None) as f:
                    while block := f.read(BLOCK_BYTES):
                        own.update(block)
                        read += len(block)
                        if skip:  # the header's line ends in this block or in a later one
                            _, end, block = block.partition(b"\n")
                            skip = not end
                        if block:
                            out.write(block)
                            check.update(block)
                            size += len(block)
                            last = block[-1:]
                if read != row["bytes"] or row["checksum"] not in (None, own.hexdigest()):
                    raise ValueError(f"{row['part']}: {read} bytes of {row['bytes']}, or another checksum")
                if not packed and last != b"\n":
                    out.write(b"\n")
                    check.update(b"\n")
                    size += 1
        known = lambda c: None if any(r[c] is None for r in rows) else sum(r[c] for r in rows)
        return pa.table({"path": [name], "parts": pa.array([len(rows)], pa.int64()), "records": pa.array([known("records")], pa.int64()), "raw_bytes": pa.array([known("raw_bytes")], pa.int64()), "file_bytes": pa.array([size], pa.int64()), "checksum": [check.hexdigest()]})

    schema = "path string, parts long, records long, raw_bytes long, file_bytes long, checksum string"
    return written(placed.groupBy("file").applyInArrow(join, schema), "joined-manifest")
