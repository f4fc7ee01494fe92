"""Queries of the general data-processing operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import instants, nested, units
from millrace.session import table

TIME_FIELDS = ("posted_at", "source_fetched_at", "first_seen_at")


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.normalize(table(spark, sf_dir, "job_observations"), "obs_id", TIME_FIELDS, "source", table(spark, sf_dir, "feed_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants.instants(_times(spark, sf_dir), "obs_id")


def p4_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each column are readable, blank, ambiguous and so on."""
    return _times(spark, sf_dir).groupBy("field_name", "status").agg(F.count("*").alias("n"))


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, rates, spans = (table(spark, sf_dir, t) for t in ("normalized_jobs", "fx_rates", "pay_units"))
    return units.convert(jobs, "record_id", "salary_min", "salary_max", "salary_currency", "raw_salary_interval", rates, spans)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pay(spark, sf_dir).filter("value is not null").select("record_id", "bound", F.col("value").cast("long").alias("usd_year"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(table(spark, sf_dir, "raw_records")).select("raw_id", "entity", "id_path")


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, records and objects without id of every table, the root's, the history's and those of plain texts included."""
    made = None
    for name, rows in nested.tables(table(spark, sf_dir, "raw_records")).items():
        one = rows.agg(F.lit(name).alias("entity"), F.count("*").alias("n"), F.countDistinct("raw_id").alias("records"), F.count_if(F.col("parent_pre").isNull()).alias("without_parent"))
        made = one if made is None else made.union(one)
    return made


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_status, p5_found, p6_found, p6_tables)}

# Arrays come as lists, bare objects, objects keyed by position, or text of these.
_ARRAY = """(CASE
    WHEN json_type({0}) = 'VARCHAR' THEN CAST(CASE WHEN json_valid({0} ->> '$') THEN {0} ->> '$' END AS JSON)
    ELSE {0} END)"""
_ITEMS = """(CASE
    WHEN json_type({0}) = 'ARRAY' THEN CAST({0} AS JSON[])
    WHEN json_type({0}) = 'OBJECT' AND json_exists({0}, '$.{1}') THEN [{0}]
    WHEN json_type({0}) = 'OBJECT' THEN map_values(CAST({0} AS MAP(VARCHAR, JSON)))
    ELSE CAST([] AS JSON[]) END)"""


def _level(name: str, parent: str, array: str, id_key: str) -> str:
    return f"""
    {name}_a AS (SELECT raw_id, path, {_ARRAY.format(f"json_extract(node, '{array}')")} AS a FROM {parent}),
    {name}_i AS (SELECT raw_id, path, unnest({_ITEMS.format("a", id_key)}) AS node FROM {name}_a),
    {name} AS (
        SELECT raw_id, CASE WHEN path = '' THEN '' ELSE path || '/' END || coalesce(node ->> '$.{id_key}', '') AS path, node
        FROM {name}_i WHERE json_type(node) = 'OBJECT'
    )"""


_P6_LEVELS = ",".join(
    _level(*x)
    for x in (
        ("opening", "model", "$.openings", "opening_id"), ("shift", "opening", "$.shifts", "shift_id"), ("slot", "shift", "$.slots", "slot_id"),
        ("band", "model", "$.compensation.bands", "band_id"), ("component", "band", "$.components", "component_id"),
        ("question", "model", "$.application.form.questions", "question_id"), ("option", "question", "$.options", "option_id"), ("revision", "model", "$.metadata.history", "rev"),
    )
)

_P6_MODEL = f"""parsed AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM raw_records),
        m1 AS (SELECT raw_id, json_extract(p, '$.job_model_json') AS m FROM parsed WHERE json_type(p) = 'OBJECT'),
        m2 AS (SELECT raw_id, {_ARRAY.format("m")} AS m FROM m1),
        m3 AS (SELECT raw_id, {_ARRAY.format("m")} AS m FROM m2),
        model AS (SELECT raw_id, '' AS path, m AS node FROM m3 WHERE json_type(m) = 'OBJECT'),
        {_P6_LEVELS}"""
_P6_NAMES = ("opening", "shift", "slot", "band", "component", "question", "option")

ORACLE_SQL: dict[str, str] = {
    "p6_found": f"""
        WITH {_P6_MODEL}
        {" UNION ALL ".join(f"SELECT raw_id, '{e}' AS entity, path AS id_path FROM {e}" for e in _P6_NAMES)}
    """,
    "p6_tables": f"""
        WITH {_P6_MODEL},
        benefit_a AS (SELECT raw_id, {_ARRAY.format("json_extract(node, '$.compensation.benefits')")} AS a FROM model),
        benefit AS (SELECT raw_id, unnest(CASE WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) WHEN json_type(a) = 'OBJECT' THEN map_values(CAST(a AS MAP(VARCHAR, JSON))) END) AS node FROM benefit_a),
        requirement_a AS (SELECT raw_id, {_ARRAY.format("json_extract(node, '$.requirements')")} AS a FROM model),
        requirement AS (SELECT raw_id, unnest(CASE WHEN json_type(a) = 'ARRAY' THEN CAST(a AS JSON[]) WHEN json_type(a) = 'OBJECT' THEN map_values(CAST(a AS MAP(VARCHAR, JSON))) END) AS node FROM requirement_a)
        SELECT 'posting' AS entity, count(*) AS n, count(DISTINCT raw_id) AS records, count(*) AS without_parent FROM model
        UNION ALL SELECT * FROM ({" UNION ALL ".join(f"SELECT '{e}' AS entity, count(*), count(DISTINCT raw_id), 0 FROM {e}" for e in (*_P6_NAMES, "revision"))})
        UNION ALL SELECT * FROM ({" UNION ALL ".join(f"SELECT '{e}', count(*), count(DISTINCT raw_id), 0 FROM {e} WHERE json_type(node) NOT IN ('NULL', 'OBJECT', 'ARRAY')" for e in ("benefit", "requirement"))})
    """,
}
