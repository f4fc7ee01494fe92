"""The query surface: filters, sorts, pages, facets, statistics, directory and health.

Everything is declared on DataFrames; tables and their column names are parameters, so the same
operators serve any table of listings.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import search as text_search

MOST_ROWS = 100


@dataclass(frozen=True)
class Filters:
    """Optional predicates by column; an empty one says nothing. ``without`` clears a facet's own filter."""

    equal: Mapping[str, object] = field(default_factory=dict)
    among: Mapping[str, Sequence[object]] = field(default_factory=dict)
    begins: Mapping[str, str] = field(default_factory=dict)
    holds: Mapping[str, str] = field(default_factory=dict)
    at_least: Mapping[str, object] = field(default_factory=dict)
    since: Mapping[str, object] = field(default_factory=dict)
    flags: Sequence[str] = ()

    def without(self, name: str) -> Filters:
        drop = lambda m: {k: v for k, v in m.items() if k != name}
        return replace(self, equal=drop(self.equal), among=drop(self.among))


def _escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def predicate(f: Filters) -> Column:
    """All clauses together; wildcards in texts of users count as ordinary signs."""
    clauses = [F.col(c) == v for c, v in f.equal.items() if v is not None]
    clauses += [F.col(c).isin(*v) for c, v in f.among.items() if v]
    clauses += [F.col(c).ilike(_escaped(v) + "%") for c, v in f.begins.items() if v]
    clauses += [F.col(c).ilike("%" + _escaped(v) + "%") for c, v in f.holds.items() if v]
    clauses += [F.col(c) >= v for c, v in {**f.at_least, **f.since}.items() if v is not None]
    clauses += [F.col(c) for c in f.flags]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def not_among(column: Column, values: Sequence[object]) -> Column:
    """Negated membership that keeps nulls."""
    return column.isNull() | ~column.isin(*values) if values else F.lit(True)


def changed(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new)


def within(explicit: datetime | None, hours: int | None, as_of: datetime) -> Column | None:
    """The start of a window; an explicit instant comes before a number of hours."""
    if explicit is not None:
        return F.lit(explicit)
    return None if hours is None else F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))


# --- sorting and pages

@dataclass(frozen=True)
class Sort:
    name: str
    column: str | None
    keyset: bool = True


def sort_of(name: str | None, allowed: Sequence[Sort], has_query: bool = True) -> Sort:
    """The named sort; an unknown one, or relevance without a query, gives the first."""
    found = next((s for s in allowed if s.name == name), allowed[0])
    return allowed[0] if not found.keyset and not has_query else found


@dataclass(frozen=True)
class Cursor:
    sort: str
    value: object
    id: int


def encode_cursor(cursor: Cursor) -> str:
    value = cursor.value
    kind = "t" if isinstance(value, datetime) else "d" if isinstance(value, Decimal) else "v"
    plain = value.isoformat() if isinstance(value, datetime) else str(value) if isinstance(value, Decimal) else value
    text = json.dumps({"id": cursor.id, "kind": kind, "sort": cursor.sort, "value": plain}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str) -> Cursor:
    """Raises ValueError for a malformed cursor or one of another sort."""
    try:
        if len(text) > 512:
            raise ValueError("too long")
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if set(got) != {"id", "kind", "sort", "value"} or not isinstance(got["id"], int) or isinstance(got["id"], bool) or got["id"] < 0:
            raise ValueError("unknown form")
        value = got["value"]
        if got["kind"] == "t":
            value = datetime.fromisoformat(value)
            value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        elif got["kind"] == "d":
            value = Decimal(value)
    except (ValueError, TypeError, ArithmeticError) as e:
        raise ValueError(f"malformed cursor: {e}") from e
    if got["sort"] != sort:
        raise ValueError("the cursor is of another sort")
    return Cursor(got["sort"], value, got["id"])


def after(sort_column: str, id_column: str, cursor: Cursor) -> Column:
    """Rows behind the cursor in descending order with nulls last; nulls have pages of their own at the end."""
    k, i = F.col(sort_column), F.col(id_column)
    if cursor.value is None:
        return k.isNull() & (i < cursor.id)
    return (k < F.lit(cursor.value)) | ((k == F.lit(cursor.value)) & (i < cursor.id)) | k.isNull()


def page(df: DataFrame, sort_column: str, id_column: str, limit: int = 20, cursor: Cursor | None = None) -> DataFrame:
    """One row more than ``limit``, which tells whether there is another page; a top-k without a full sort."""
    n = max(1, min(limit, MOST_ROWS))
    rows = df if cursor is None else df.filter(after(sort_column, id_column, cursor))
    return rows.orderBy(F.col(sort_column).desc_nulls_last(), F.col(id_column).desc()).limit(n + 1)


def next_cursor(rows: list, limit: int, sort: Sort, id_column: str) -> tuple[list, str | None]:
    """The rows of the page and the cursor of the next one, if there is one and the sort allows it."""
    n = max(1, min(limit, MOST_ROWS))
    if len(rows) <= n or not sort.keyset or sort.column is None:
        return rows[:n], None
    last = rows[n - 1]
    return rows[:n], encode_cursor(Cursor(sort.name, last[sort.column], last[id_column]))


# --- counts

def facet(df: DataFrame, column: str, filters: Filters, top: int | None = None) -> DataFrame:
    """Rows by value under all filters but the facet's own; nulls don't count."""
    counts = df.filter(predicate(filters.without(column)) & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), column).limit(top)


def facet_of_all(values: DataFrame, value_key: str, df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Rows by every value of a list, zeros too: the condition holds before the join, the fact side is counted before it."""
    counts = df.filter(condition).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
    return values.join(counts, values[value_key] == F.col("_k"), "left").drop("_k").withColumn("n", F.coalesce("n", F.lit(0)))


def counters(df: DataFrame, conditions: Mapping[str, Column], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """Any number of conditional counts and exact distinct counts in one pass."""
    aggs = [F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return df.agg(*aggs, *[F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()])


def windows(column: str, as_of: Column, hours: Mapping[str, int]) -> dict[str, Column]:
    return {n: F.col(column) >= as_of - F.make_dt_interval(hours=F.lit(h)) for n, h in hours.items()}


def directory(owners: DataFrame, owner_key: str, df: DataFrame, column: str, active: Column, name: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """Owners with their rows, active ones first, paged with a unique order; counted before the join."""
    counts = df.groupBy(F.col(column).alias(owner_key)).agg(F.count_if(active).alias("active"), F.count("*").alias("total"))
    rows = owners.join(counts, owner_key)
    return rows.orderBy(F.desc("active"), F.desc("total"), name, owner_key).offset(offset).limit(limit)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def child_counts(df: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """A correlated count, aggregated before the join."""
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, values, coverage): rows, nulls, distinct values and coverage in percent of each column, in one pass.

    A row gives a pair of hashes per column instead of its values, combined before the shuffle; 128 bits stand for a value.
    """
    each = [F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("none"), F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g")) for c in columns]
    seen = df.select(F.explode(F.array(*each)).alias("v")).select("v.*").groupBy("column", "none", "h", "g").agg(F.count("*").alias("k"))
    out = seen.groupBy("column").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("none"), F.col("k")).otherwise(0)).alias("nulls"), F.count_if(~F.col("none")).alias("values"))
    return out.withColumn("coverage", F.round(100.0 * (F.col("n") - F.col("nulls")) / F.nullif(F.col("n"), F.lit(0)), 1).cast("double"))


def top_values(facet_rows: DataFrame, column: str, limit: int, other: str = "other") -> DataFrame:
    """The first values of a facet for a list of choices: without the rest category and empty ones (a top-k report)."""
    return facet_rows.filter((F.col("n") > 0) & (F.col(column) != other)).orderBy(F.desc("n"), column).limit(limit)


def frequent(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column, value, n): the most frequent values of each column as text, by one pass over all (a top-k report)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")
    counts = df.select(each).select("v.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= top).drop("_k")


def probe(df: DataFrame, expected: Mapping[str, str], unique: str, instant: str, as_of: Column) -> DataFrame:
    """(check, n): whether a source is as promised: columns missing or of another type, rows, repeated and null ids, instants ahead of time."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = sum(c not in kinds for c in expected)
    other = sum(c in kinds and kinds[c] != t for c, t in expected.items())
    one = df.agg(
        F.count("*").alias("rows"), (F.count(unique) - F.countDistinct(unique)).alias("repeated_ids"), F.count_if(F.col(unique).isNull()).alias("null_ids"), F.count_if(F.col(instant) > as_of).alias("ahead_of_time"),
    )
    named = [F.struct(F.lit(n).alias("check"), F.lit(v).cast("long").alias("n")) for n, v in (("missing_columns", missing), ("other_types", other))]
    named += [F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("n")) for n in ("rows", "repeated_ids", "null_ids", "ahead_of_time")]
    return one.select(F.explode(F.array(*named)).alias("c")).select("c.*")


def column_sizes(spark, paths: Sequence[str]) -> DataFrame:
    """(column, bytes, share): compressed bytes of each column of Parquet files, from their footers, each read by a task of its own."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            sizes: dict[str, int] = {}
            for path in batch.column(0).to_pylist():
                meta = pq.ParquetFile(path.removeprefix("file:")).metadata
                for g in range(meta.num_row_groups):
                    for i in range(meta.num_columns):
                        c = meta.row_group(g).column(i)
                        name = c.path_in_schema.split(".")[0]
                        sizes[name] = sizes.get(name, 0) + c.total_compressed_size
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["column", "bytes"])

    parts = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    sums = parts.mapInArrow(run, "column string, bytes long").groupBy("column").agg(F.sum("bytes").alias("bytes"))
    return sums.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(Window.partitionBy()), 4))  # one row per column


# --- entry points

CARD = (
    "job_id", "title", "city", "state_code", "country_code", "remote_type", "employment_type", "category_slug", "seniority_level", "salary_min", "salary_max", "salary_currency",
    "salary_interval", "posted_at", "posted_at_is_valid", "first_seen_at", "last_seen_at", "last_updated_at", "status", "source",
)


def card(jobs: DataFrame, companies: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The columns of a listing in a list, with the name of its company."""
    named = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return jobs.select(*CARD, "company_id", *more).join(named, "company_id", "left")


SORTS = (Sort("posted", "posted_at"), Sort("first_seen", "first_seen_at"), Sort("salary", "salary_max"), Sort("relevance", None, keyset=False))


def search(jobs: DataFrame, companies: DataFrame, filters: Filters, query: str | None = None, sort: str = "posted", limit: int = 20, cursor: str | None = None, doc: str = "search_doc") -> DataFrame:
    """A page of cards with one row more than ``limit``: filtered, by full text if there is a query, sorted, behind the cursor.

    Sorting by relevance needs a query and has no cursor. A cursor of another sort is a ValueError.
    The page is cut before companies are joined.
    """
    asked = text_search.parse(query) if query else None
    by = sort_of(sort, SORTS, asked is not None)
    rows = jobs.filter(predicate(filters))
    if asked is not None:
        rows = rows.filter(text_search.matches(text_search.whole(F.col(doc)), asked))
    if by.column is None:
        rank = F.round(text_search.rank([F.col(doc)[n] for n in "abcd"], asked), 6)
        return card(page(rows.withColumn("rank", rank), "rank", "job_id", limit), companies, ["rank"]).orderBy(F.desc("rank"), F.desc("job_id"))
    at = decode_cursor(cursor, by.name) if cursor else None
    return card(page(rows, by.column, "job_id", limit, at), companies).orderBy(F.col(by.column).desc_nulls_last(), F.desc("job_id"))


def count(jobs: DataFrame, filters: Filters) -> int:
    """The exact number of rows under the filters; a page doesn't need it."""
    return jobs.filter(predicate(filters)).count()


def detail(jobs: DataFrame, companies: DataFrame, sources: DataFrame, job_id: int) -> DataFrame:
    """One listing with its company and the number of its sources; no row for an unknown id."""
    about = companies.select(F.col("id").alias("company_id"), *[F.col(c).alias(f"company_{c}") for c in ("name", "website", "career_url", "industry", "size")])
    n = sources.filter(F.col("job_id") == job_id).agg(F.count("*").alias("n_sources"))
    return jobs.filter(F.col("job_id") == job_id).join(about, "company_id", "left").crossJoin(F.broadcast(n))  # one row


def health(runs: DataFrame, ledgers: DataFrame, by: str = "source", started: str = "started_at") -> tuple[DataFrame, DataFrame]:
    """The latest run of each source, and the most frequent reasons of refusal."""
    from millrace.operators import quality

    return latest(runs, [by], [F.desc(started)]), quality.breakdown(ledgers)
