"""Queries of the general problems (6 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import routed, structural_tables
from ..session import table
from ..sources.consolidate import consolidate


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    done = consolidate(table(spark, d, "run_files")).verify()
    return done.index.filter("run_id is not null").select("run_id", "file_no")


def p6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the records as they are read back from the joined files, with their lengths without white space."""
    lines = consolidate(table(spark, d, "run_files")).lines()
    return lines.select(F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.run_id").alias("run_id"), F.length(F.regexp_replace("line", r"\s+", "")).alias("length"))


def _elements(children: DataFrame, kind: str, item: str | None, place: str, elem) -> DataFrame:
    item_no = F.col(item) if item else F.lit(0)
    return children.select(F.lit(kind).alias("kind"), "variant", F.col("parent_key").alias("parent_id"), item_no.cast("int").alias("item_no"), F.col(place).alias("elem_no"), elem.alias("elem"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The child tables of the three nested results, routed to a table for each kind and variant of their elements, put together
    again without those of the variant of null elements."""
    words = structural_tables(table(spark, d, "parse"), "id", "result", "id").child("dependency.words")
    entities = structural_tables(table(spark, d, "ner"), "id", "result", "id").child("entities")
    # both columns of a run come from one row, so that repeated rows are dropped once
    runs = table(spark, d, "pipeline_run").select("id", "run_id", "output.pos", F.col("results.output.pos").alias("all_pos"))
    run = structural_tables(runs.select("id", "run_id", F.struct("pos", "all_pos").alias("run")), "run_id", "run", "id")
    tag = F.coalesce(F.get("elem", F.lit(1)), F.lit(""))
    children = (
        _elements(words, "dependency", None, "place_1", F.col("elem"))
        .unionByName(_elements(entities, "entity", None, "place_1", F.coalesce("elem.type", F.lit(""))))
        .unionByName(_elements(run.child("pos"), "pos", None, "place_1", tag))
        .unionByName(_elements(run.child("all_pos[]"), "pos", "place_1", "place_2", tag))
    )
    tables = routed(children, ["kind", "variant"])
    out = children.sparkSession.createDataFrame([], children.schema)
    for (_, variant), rows in sorted(tables.items()):
        if variant != "-":
            out = out.unionByName(rows)
    return out.select("kind", "parent_id", "item_no", "elem_no", "elem")


def p7_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many records there are of each shape of parse.result, ner.result and pipeline_run's results."""
    of = [("parse", "result"), ("ner", "result"), ("pipeline_run", "output"), ("pipeline_run", "results")]
    parts = [structural_tables(table(spark, d, t), "id", c, "id").variants().select(F.lit(f"{t}.{c}").alias("source"), "variant", "records") for t, c in of]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {"p6_found": p6_found, "p6_lines": p6_lines, "p7_found": p7_found, "p7_variants": p7_variants}


def _state(value: str, kind) -> str:
    """SQL of the automaton's state of a value; kind: '.' a scalar, [kind] an array, {name: kind} a struct, ('map', kind) a map."""
    if isinstance(kind, dict):
        parts = ", ".join(f"CASE WHEN ({value}).{n} IS NOT NULL THEN '{n}:' || {_state(f'({value}).{n}', k)} END" for n, k in kind.items())
        inner = f"'{{' || array_to_string(list_filter([{parts}], lambda p: p IS NOT NULL), ',') || '}}'"
    elif isinstance(kind, (list, tuple)):
        x = f"x{value.count('x')}"
        listed, bounds = (value, "[]") if isinstance(kind, list) else (f"map_values({value})", "<>")
        inner = f"'{bounds[0]}' || coalesce(array_to_string(list_sort(list_distinct(list_transform({listed}, lambda {x}: {_state(x, kind[-1])}))), '|'), '') || '{bounds[1]}'"
    else:
        inner = "'.'"
    return f"(CASE WHEN {value} IS NULL THEN '-' ELSE {inner} END)"


_OUT = {
    "text": ".", "doc_index": ".", "words": ["."], "pos": [["."]],
    "sentiment": {"score": ".", "raw_score": ".", "polarity": ".", "positive_words": ["."], "negative_words": ["."], "classifier": {"label": ".", "probabilities": {"negative": ".", "neutral": ".", "positive": "."}}, "confidence": "."},
    "keywords": {"keywords": [{"word": ".", "score": ".", "freq": "."}], "method": "."},
}
_SHAPES = {
    "parse.result": {"dependency": {"words": ["."], "tags": ["."], "heads": ["."], "relations": ["."]}, "constituency": {"words": ["."], "tags": ["."], "tree": "."}, "dep_rel_names": ("map", ".")},
    "ner.result": {"entities": [{"start_pos": ".", "end_pos": ".", "text": ".", "type": "."}], "entity_type_names": ("map", ".")},
    "pipeline_run.output": _OUT,
    "pipeline_run.results": [{"ok": ".", "error": ".", "output": _OUT}],
}

_STATES = """
        WITH bodies AS (
            SELECT file_no, written_at, trim(ltrim(body, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)), ' ' || chr(9) || chr(10) || chr(13)) AS b
            FROM run_files WHERE body IS NOT NULL
        ), elements AS (
            SELECT file_no, written_at, unnest(from_json(b::JSON, '["JSON"]')) AS e, generate_subscripts(from_json(b::JSON, '["JSON"]'), 1) AS place
            FROM bodies WHERE json_valid(b) AND starts_with(b, '[')
        ), states AS (
            SELECT e ->> '$.id' AS id, e ->> '$.run_id' AS run_id, coalesce(CAST(e ->> '$._deleted' AS BOOLEAN), false) AS deleted, file_no,
                row_number() OVER (PARTITION BY e ->> '$.id' ORDER BY written_at DESC NULLS LAST, file_no DESC, place DESC) AS r
            FROM elements WHERE e ->> '$.id' IS NOT NULL
        )"""

ORACLES = {
    "p6_found": _STATES + " SELECT run_id, file_no FROM states WHERE r = 1 AND NOT deleted AND run_id IS NOT NULL",
    "p6_lines": _STATES.replace("SELECT e ->> '$.id' AS id", "SELECT e, e ->> '$.id' AS id") + " SELECT id, run_id, length(regexp_replace(e, '[ \\t\\n\\r]+', '', 'g'))::INT AS length FROM states WHERE r = 1 AND NOT deleted",
    "p7_variants": " UNION ALL ".join(f"SELECT '{name}' AS source, {_state('v', kind)} AS variant, count(*) AS records FROM (SELECT any_value({name.split('.')[1]}) AS v FROM {name.split('.')[0]} GROUP BY id) GROUP BY 2" for name, kind in _SHAPES.items()),
    "p7_found": """
        WITH words AS (SELECT id, any_value(result.dependency.words) AS a FROM parse GROUP BY id),
        entities AS (SELECT id, any_value(result.entities) AS a FROM ner GROUP BY id),
        runs AS (SELECT DISTINCT ON (id) id, run_id, output, results FROM pipeline_run),
        items AS (
            SELECT run_id, 0 AS item_no, output.pos AS a FROM runs
            UNION ALL
            SELECT run_id, generate_subscripts(results, 1) - 1, unnest(results).output.pos FROM runs
        ),
        w AS (SELECT id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS x FROM words),
        e AS (SELECT id, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS x FROM entities),
        p AS (SELECT run_id, item_no, generate_subscripts(a, 1) - 1 AS n, unnest(a) AS x FROM items)
        SELECT 'dependency' AS kind, id AS parent_id, 0::INT AS item_no, n::INT AS elem_no, x AS elem FROM w WHERE x IS NOT NULL
        UNION ALL SELECT 'entity', id, 0, n::INT, coalesce(x.type, '') FROM e WHERE x IS NOT NULL
        UNION ALL SELECT 'pos', run_id, item_no::INT, n::INT, coalesce(x[2], '') FROM p WHERE x IS NOT NULL""",
}
