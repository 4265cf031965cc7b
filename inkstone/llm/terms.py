"""Frequency of every distinct term: recursive radix partitions, each aggregated out of core by DuckDB.

Every task first aggregates its own records' terms, so a term that is in a third of all records arrives as one row per
task. These partial rows are written to the shared folder with the hash of their term. Rows above a limit are split by the
leading eight bits of the hash, partitions still above it by the next eight bits, again and again. Each final partition is
aggregated by a DuckDB of bounded memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_terms
from ..session import scratch_path, written

#: Partial rows that one final partition may have, and hash bits of one level.
LIMIT, BITS, MEMORY = 200_000, 8, "256MB"

_SCHEMA = "task string, term string, occurrences long, records long"


def _duck(spill: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"SET memory_limit = '{MEMORY}'")
    # DuckDB spills to folders it can open as files; elsewhere it has to do with its memory, which a partition's limit fits
    local = spill.startswith(("file:", "/"))
    con.execute(f"SET temp_directory = '{spill.removeprefix('file://').removeprefix('file:') + '/' + uuid.uuid4().hex if local else ''}'")
    con.execute("CREATE TABLE part (task VARCHAR, term VARCHAR, occurrences BIGINT, records BIGINT)")
    return con


def _add(con, batch: pa.RecordBatch | pa.Table) -> None:
    con.register("incoming", pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch)
    con.execute("INSERT INTO part SELECT task, term, sum(occurrences)::BIGINT, sum(records)::BIGINT FROM incoming GROUP BY task, term")
    con.unregister("incoming")


def _batches(con) -> Iterator[pa.RecordBatch]:
    yield from con.sql("SELECT task, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY task, term").to_arrow_reader(50_000)


def record_terms(df: DataFrame, task: str, words: Column, id: str = "id") -> DataFrame:
    """(task, id, terms): normalised terms of each record; rows of one id count once (the least array of them)."""
    return df.select(F.col(id).alias("id"), normalised_terms(words).alias("terms")).groupBy("id").agg(F.min("terms").alias("terms")).select(F.lit(task).alias("task"), "id", "terms")


def term_frequencies(records: DataFrame, rare_below: int = 3, common_above: float = 0.2, limit: int = LIMIT) -> DataFrame:
    """(task, term, occurrences, records, mark) of every distinct term of (task, id, terms) records.

    mark is 'rare' for a term in fewer than `rare_below` records, else 'common' for one in more than `common_above` of the
    task's records with at least one term, else null. Null and empty arrays give nothing; a null id is a record like others.
    """
    spark = records.sparkSession
    spill = scratch_path(spark, "radix-spill")
    # the empty term, which no record has, counts the records
    one = records.filter(F.size("terms") > 0).select("task", "id", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    per_record = one.groupBy("task", "id", "term").agg(F.count("*").alias("occurrences")).select("task", "term", "occurrences", F.lit(1).cast("long").alias("records"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, rows = _duck(spill), 0
        for batch in batches:
            _add(con, batch)
            rows += batch.num_rows
            if rows > limit:
                con.execute("CREATE TABLE less AS SELECT task, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY task, term")
                con.execute("DROP TABLE part")
                con.execute("ALTER TABLE less RENAME TO part")
                rows = 0
        yield from _batches(con)
        con.close()

    parts = written(per_record.mapInArrow(partial, _SCHEMA).withColumn("h", F.xxhash64("task", "term")), "terms")
    totals = {r.task: r.n for r in parts.filter("term = ''").groupBy("task").agg(F.sum("records").alias("n")).collect()}

    def prefix(level: int) -> Column:
        return F.shiftrightunsigned("h", 64 - BITS * level) if level else F.lit(0).cast("long")

    # a partition above the limit is split by the next bits, unless all of its rows have one hash. Of such partitions there is
    # no more than one for every `limit` rows, so the table of their prefixes (8 bytes each) is small beside the rows
    placed = parts.withColumns({"depth": F.lit(0), "path": prefix(0)})
    for level in range(64 // BITS):
        within = placed.filter(F.col("depth") == level)
        over = written(within.groupBy("path").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).filter((F.col("n") > limit) & (F.col("a") != F.col("b"))).select("path", F.lit(True).alias("over")), "terms-over")
        if not over.limit(1).count():
            break
        split = (F.col("depth") == level) & F.col("over").isNotNull()
        placed = placed.join(F.broadcast(over), "path", "left").select("task", "term", "occurrences", "records", "h", F.when(split, level + 1).otherwise(F.col("depth")).alias("depth"), F.when(split, prefix(level + 1)).otherwise(F.col("path")).alias("path"))

    def final_table(part: pa.Table) -> pa.Table:
        con = _duck(spill)
        _add(con, part.select(["task", "term", "occurrences", "records"]))
        out = pa.Table.from_batches(list(_batches(con)), schema=pa.schema([("task", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())]))
        con.close()
        return out

    done = placed.select("task", "term", "occurrences", "records", "depth", "path").groupBy("depth", "path").applyInArrow(final_table, _SCHEMA)
    n = F.create_map(*(x for k, v in (totals or {"": 0}).items() for x in (F.lit(k), F.lit(v).cast("long"))))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * n[F.col("task")], "common")
    return done.filter("term <> ''").withColumn("mark", mark)
