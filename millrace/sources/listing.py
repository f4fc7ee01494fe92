"""Daily delta files: discovery, gaps, pending work, projected scans, archive."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import jsonx
from millrace.functions.text import clean, prefix

#: Columns of a delta file; ``full`` adds the nested record.
MINIMAL = ("id", "job_id", "company_id", "title", "department", "employment_type", "workplace_type", "country", "is_remote", "posted_at", "apply_url", "fetched_time", "status", "close_time")
FULL = (*MINIMAL, "job_model_json")
#: Columns of a listing after ``normalized``, as connectors deliver them.
NORMALIZED = (
    "source", "external_id", "title", "company_name", "company_external_id", "description_text", "department", "seniority", "raw_country", "raw_state", "raw_city", "raw_postal_code",
    "raw_location_text", "raw_workplace_type", "source_is_remote", "raw_employment_type", "salary_min", "salary_max", "salary_currency", "raw_salary_interval", "posted_at",
    "source_fetched_at", "close_at", "closed_at", "apply_url", "raw_status", "ats_provider",
)
REGISTRY = ("id", "name", "website", "industry", "size", "country", "linkedin_url")
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("version", T.StringType()), T.StructField("file_date", T.DateType())])


def retried(call: Callable, attempts: int = 4, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; failures are retried after a wait that grows with each, a missing folder is not."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except FileNotFoundError:
            raise
        except Exception:
            if n == attempts:
                raise
            sleep(wait * n)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size, version, file_date of the files named YYYY-MM-DD.parquet with a date that exists.

    Version is size and change time, so a file that was published again is new work.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    rows = [(s.getPath().toString(), s.getPath().getName(), s.getLen(), f"{s.getLen()}-{s.getModificationTime()}") for s in fs.listStatus(path)]
    listed = spark.createDataFrame(rows, "path string, name string, size long, version string")
    day = F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})\.parquet$", 1).try_cast("date")
    return listed.withColumn("file_date", day).filter("file_date is not null")


def since(listed: DataFrame, first: date | None) -> DataFrame:
    return (listed if first is None else listed.filter(F.col("file_date") >= F.lit(first))).orderBy("file_date")


def gaps(listed: DataFrame, column: str = "file_date", by: Sequence[str] = ()) -> DataFrame:
    """Dates between the first and last, of each of ``by`` if given, that have no file."""
    ends = listed.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).filter("lo is not null")
    days = ends.select(*by, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(column))
    return days.join(listed.select(*by, column).distinct(), [*by, column], "left_anti")


def pending(listed: DataFrame, done: DataFrame, newest: int | None = None) -> DataFrame:
    """Files whose path and version were not processed yet, oldest first; of these only the newest few if asked."""
    left = listed.withColumn("_v", F.coalesce("version", F.lit("")))
    right = done.select(F.col("path"), F.coalesce("version", F.lit("")).alias("_v"))
    todo = left.join(right, ["path", "_v"], "left_anti").drop("_v")
    if newest is not None:
        todo = todo.orderBy(F.desc("file_date"), F.desc("path")).limit(newest)
    return todo.orderBy("file_date", "path")


def should_act(listed: DataFrame | None, done: DataFrame | None) -> bool:
    """Whether the newest file is still to be processed; what can't be known counts as work."""
    if listed is None or done is None:
        return True
    newest = listed.orderBy(F.desc("file_date"), F.desc("path")).limit(1)
    return not pending(newest, done).isEmpty()


def scan(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = MINIMAL) -> DataFrame:
    """The wanted columns with source_path and row_index of every row; columns that are never named are never read."""
    return spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.row_index").alias("row_index"))


def registry(spark: SparkSession, path: str, columns: Sequence[str] = REGISTRY) -> DataFrame:
    """Companies with an id; an unreadable registry is empty rather than fatal."""
    try:
        return spark.read.parquet(path).select(*columns).filter("id is not null")
    except Exception:  # noqa: BLE001
        return spark.createDataFrame([], ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in columns))


def with_registry(df: DataFrame, companies: DataFrame, column: str = "company_id") -> DataFrame:
    """Left join by the number in ``column``; anything else finds nothing. Spark broadcasts the registry if its size allows."""
    named = companies.select(F.col("id").alias("_id"), *[F.col(c).alias(f"company_{c}") for c in companies.columns if c != "id"])
    return df.join(named, F.col(column).try_cast("long") == F.col("_id"), "left").drop("_id")


def workplace(value: Column) -> Column:
    """The stated workplace; "tbc" says nothing."""
    stated = clean(value)
    return F.when(F.lower(stated) != "tbc", stated)


def normalized(df: DataFrame, source: str, record: str = "payload") -> DataFrame:
    """NORMALIZED and the other columns of ``df`` from the nested record of a delta file.

    ``record`` is a text {id, company_id, status, job_model_json}; the model may be encoded several
    times. Absent parts, parts of another type and blank texts are null; a closure time is kept for
    closed records only.
    """
    rows = jsonx.with_decoded(df, "_top", F.col(record))
    rows = jsonx.with_decoded(rows, "_model", jsonx.member(F.col("_top"), "$.job_model_json", "variant"), parsed=True)
    top = lambda path: clean(jsonx.member(F.col("_top"), path))
    model = lambda path: clean(jsonx.member(F.col("_model"), path))
    closed = F.lower(top("$.status")) == "closed"
    made = {
        "source": F.lit(source), "external_id": top("$.id"), "title": model("$.title"), "company_name": F.lit(None).cast("string"), "company_external_id": top("$.company_id"),
        "description_text": model("$.description_plain"), "department": F.coalesce(model("$.department"), model("$.metadata.team")),
        "seniority": F.coalesce(model("$.seniority"), model("$.metadata.experience_level")), "raw_country": model("$.location.country"), "raw_state": model("$.location.state"),
        "raw_city": model("$.location.city"), "raw_postal_code": model("$.location.postal_code"), "raw_location_text": model("$.location.raw_location_text"),
        "raw_workplace_type": workplace(model("$.location.workplace_type")), "source_is_remote": jsonx.boolean(model("$.location.is_remote")), "raw_employment_type": model("$.employment_type"),
        "salary_min": model("$.compensation.min_amount"), "salary_max": model("$.compensation.max_amount"), "salary_currency": model("$.compensation.currency"),
        "raw_salary_interval": model("$.compensation.interval"), "posted_at": jsonx.instant(model("$.posted_at")), "source_fetched_at": jsonx.instant(top("$.fetched_time")),
        "close_at": jsonx.instant(model("$.expires_at")), "closed_at": F.when(closed, jsonx.instant(top("$.close_time"))), "apply_url": model("$.apply_url"), "raw_status": top("$.status"),
        "ats_provider": F.coalesce(model("$.ats_provider"), prefix(top("$.id"))),
    }
    kept = [c for c in df.columns if c not in made and c != record]
    return rows.select(*kept, *[made[c].alias(c) for c in NORMALIZED])


def archive_key(source: str, variant: str, kind: str, name: str) -> str:
    if any(".." in part or part.startswith("/") for part in (source, variant, kind, name)):
        raise ValueError("a key must stay below its root")
    return f"raw/{source}/{variant}/{kind}/{name}"


def archive(spark: SparkSession, path: str, root: str, key: str) -> str:
    """Copies a file below ``root`` once; a copy that is there is kept."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        draft = jvm.org.apache.hadoop.fs.Path(f"{root}/{key}.part")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, draft, False, True, conf)
        fs.rename(draft, target)
    return f"{root}/{key}"


def readable(spark: SparkSession, path: str, root: str, key: str) -> str:
    """The archived copy of a file if there is one, else the file itself."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    return f"{root}/{key}" if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else path


class ObjectStore:
    """put, get, stat, list and delete of small objects below a root on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.base = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, key: str):
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError("a key must stay below its root")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def put(self, key: str, data: bytes) -> None:
        """Replaces the object; readers see the old or the new one."""
        path = self._at(key)
        draft = path.suffix(".part")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(data))
        stream.close()
        self.fs.delete(path, False)
        if not self.fs.rename(draft, path):
            raise OSError(f"{key} could not be written")

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise FileNotFoundError(key)
        stream = self.fs.open(self._at(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._at(key))

    def stat(self, key: str) -> tuple[int, int]:
        """Bytes and time of the last change in milliseconds."""
        if not self.exists(key):
            raise FileNotFoundError(key)
        found = self.fs.getFileStatus(self._at(key))
        return found.getLen(), found.getModificationTime()

    def list(self, prefix: str = "") -> list[str]:
        """Keys of the objects whose key begins so, in order."""
        if not self.fs.exists(self.base):
            return []
        walk, out, above = self.fs.listFiles(self.base, True), [], len(self.fs.makeQualified(self.base).toString()) + 1
        while walk.hasNext():
            key = walk.next().getPath().toString()[above:]
            if key.startswith(prefix) and not key.endswith((".part", ".crc")):
                out.append(key)
        return sorted(out)

    def delete(self, key: str) -> bool:
        return self.fs.delete(self._at(key), False)
