"""Nested records as related flat tables.

A bottom-up tree automaton gives every value a state: that of a struct follows from which of its fields are there and from
their states, that of an array from the set of its elements' states. A record's state is its variant. The supertype table
keeps key and variant of every record, each variant has a subtype table with just the fields it has, and every array
becomes a child table that keeps the parent's key and the place of each element on every level.

All of it is column expressions over the given rows: what a query does not read is not computed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def state(value: Column, kind: T.DataType) -> Column:
    """The automaton's state of a value, as a string: '-' null, '.' scalar, '{..}' struct, '[..]' array, '<..>' map."""
    if isinstance(kind, T.StructType):
        parts = [F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{f.name}:"), state(value[f.name], f.dataType))) for f in kind.fields]
        inner = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        inner = F.concat(F.lit("["), F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(value, lambda x: state(x, kind.elementType))))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        inner = F.concat(F.lit("<"), F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(F.map_values(value), lambda x: state(x, kind.valueType))))), F.lit(">"))
    else:
        inner = F.lit(".")
    return F.when(value.isNull(), F.lit("-")).otherwise(inner)


def _leaves(kind: T.DataType, path: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}")]
    return [] if isinstance(kind, (T.ArrayType, T.MapType)) else [path]


def _arrays(kind: T.DataType, path: str) -> list[tuple[str, T.DataType]]:
    """(path, element type) of all arrays below a value, those within arrays marked by [] in the path."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _arrays(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return [(path, kind.elementType), *_arrays(kind.elementType, f"{path}[]")]
    return []


def child_table(df: DataFrame, key: str, path: str) -> DataFrame:
    """(parent_key, place_1 .. place_n, elem) of the arrays at a path such as 'results[].output.pos': a row per element.

    Places count from 0 on every level, null elements keep theirs and come out as null. Null and empty arrays give no row.
    """
    levels = path.split("[]")
    current = df.select(F.col(key).alias("parent_key"), F.col(levels[0]).alias("value"))
    for i, below in enumerate(levels, 1):
        field = F.col("value" + below) if i > 1 else F.col("value")
        kept = ["parent_key", *(f"place_{j}" for j in range(1, i))]
        current = current.select(*kept, F.posexplode(field).alias(f"place_{i}", "value"))
    return current.withColumnRenamed("value", "elem")


@dataclass(frozen=True)
class StructuralTables:
    """The flat tables of one nested column; see structural_tables."""

    raw: DataFrame
    key: str
    column: str
    once_by: str | None = None

    @property
    def source(self) -> DataFrame:
        """Key and column of every record, each once."""
        rows = self.raw.select(*dict.fromkeys([*([self.once_by] if self.once_by else []), self.key, self.column]))
        return rows.dropDuplicates([self.once_by]) if self.once_by else rows

    @property
    def kind(self) -> T.DataType:
        return self.raw.schema[self.column].dataType

    @property
    def supertype(self) -> DataFrame:
        """(key, variant) of every record."""
        return self.source.select(self.key, state(F.col(self.column), self.kind).alias("variant"))

    def variants(self) -> DataFrame:
        """(variant, records) of every variant."""
        return self.supertype.groupBy("variant").agg(F.count("*").alias("records"))

    def subtype(self, variant: str) -> DataFrame:
        """The records of one variant: the key and those scalar fields, by path, that records of this variant have."""
        there = [p for p in _leaves(self.kind, self.column) if self._present(p, variant)]
        rows = self.source.filter(state(F.col(self.column), self.kind) == variant)
        return rows.select(self.key, *(F.col(p).alias(p.replace(".", "_")) for p in there))

    def _present(self, path: str, variant: str) -> bool:
        at = variant
        for name in path.split(".")[1:]:
            depth, found = 0, None
            for i, c in enumerate(at):
                if depth == 1 and at.startswith(f"{name}:", i) and at[i - 1] in "{,":
                    found = i + len(name) + 1
                    break
                depth += (c in "{[<") - (c in "}]>")
            if found is None:
                return False
            at = at[found:]
        return True

    def child_paths(self) -> list[str]:
        return [p for p, _ in _arrays(self.kind, self.column)]

    def child(self, path: str) -> DataFrame:
        """The child table at a path within the column, e.g. 'dependency.words' or '[].output.pos' for an array column.

        Besides the columns of child_table it has `variant`, the automaton's state of the element ('-' for a null one), by
        which elements are told apart as records are.
        """
        full = self.column + (path if path.startswith("[]") or not path else f".{path}")
        rows = child_table(self._pruned(full), self.key, full)
        return rows.withColumn("variant", state(F.col("elem"), dict(_arrays(self.kind, self.column))[full]))

    def _pruned(self, full: str) -> DataFrame:
        """The records with only the fields on the way to an array: what is not read of a column is neither scanned nor shuffled."""

        def only(value: Column, kind: T.DataType, names: list[str]) -> Column:
            if isinstance(kind, T.ArrayType):
                return F.transform(value, lambda x: only(x, kind.elementType, names)) if names else value
            if not names or not isinstance(kind, T.StructType):
                return value
            return F.when(value.isNotNull(), F.struct(only(value[names[0]], kind[names[0]].dataType, names[1:]).alias(names[0])))

        names = [n for n in full.replace("[]", "").split(".")[1:] if n]
        rows = self.raw.select(*dict.fromkeys([*([self.once_by] if self.once_by else []), self.key]), only(F.col(self.column), self.kind, names).alias(self.column))
        return rows.dropDuplicates([self.once_by]) if self.once_by else rows


def structural_tables(df: DataFrame, key: str, column: str, once_by: str | None = None) -> StructuralTables:
    """The flat tables of a nested column. once_by: rows with one value of this column count once (their contents agree).

    Null values of the column are records of variant '-' and have no children; null keys are keys like others. Other columns
    are dropped first, so clashing names among them do no harm.
    """
    return StructuralTables(df, key, column, once_by)


def routed(rows: DataFrame, by: list[str], most: int = 10_000) -> dict[tuple, DataFrame]:
    """Each row written to the table of its variant, all tables in one pass: (values of `by`) -> table.

    by: columns that tell subtypes apart, such as kind and variant. Of these there can be no more than `most`, which is checked:
    shapes are bounded by the schema, not by the data.
    """
    spark = rows.sparkSession
    kinds = T.StructType([rows.schema[c] for c in by])
    path = scratch_path(spark, "subtypes")
    named = [f"_by_{c}" for c in by]
    rows.withColumns({n: F.coalesce(F.col(c), F.lit("")) for n, c in zip(named, by)}).drop(*by).write.partitionBy(*named).parquet(path)
    body = T.StructType([f for f in rows.schema.fields if f.name not in by] + [T.StructField(n, f.dataType) for n, f in zip(named, kinds.fields)])
    whole = spark.read.schema(body).parquet(path)
    found = whole.select(*named).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} subtypes")
    tables = {}
    for r in found:
        same = whole
        for n in named:
            same = same.filter(F.col(n) == r[n])
        tables[tuple(r[n] for n in named)] = same.select(*(F.col(n).alias(c) for n, c in zip(named, by)), *(f.name for f in rows.schema.fields if f.name not in by))
    return tables
