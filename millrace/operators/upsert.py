"""Insert, merge, update or touch: an idempotent load without MERGE.

The state is a set of versioned Parquet directories and a small manifest that names the live
version. A load classifies the incoming rows with joins, derives the next state, writes it beside
the old one and then makes a new manifest appear at once, checkpoint rows included.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import session

INSERT, UPDATE, TOUCH, MERGE = "inserted", "updated", "unchanged", "merged"


def classify(incoming: DataFrame, known: DataFrame, key: Sequence[str], content: str, matchers: Sequence[str] = (), targets: DataFrame | None = None) -> DataFrame:
    """Adds ``action``, ``target_id`` and ``matched_by`` to rows that are unique by ``key``.

    ``known`` has id, the key and the content; ``targets`` (``known`` unless given) has id and the
    matcher columns. A known key is updated or unchanged by its content; another row is merged with
    the smallest id that shares a matcher, the first matcher first, or inserted. A null key or
    matcher matches nothing.
    """
    stored = known if targets is None else targets
    old = known.select("id", *[F.col(k).alias(f"_k_{k}") for k in key], F.col(content).alias("_old"))
    on = [F.col(k) == F.col(f"_k_{k}") for k in key]
    out = incoming.join(old, on, "left").drop(*[f"_k_{k}" for k in key])
    targets = []
    for i, m in enumerate(matchers):
        # One target per matcher value, combined before the shuffle.
        best = stored.filter(F.col(m).isNotNull()).groupBy(F.col(m).alias(f"_m{i}")).agg(F.min("id").alias(f"_t{i}"))
        out = out.join(best, F.col(m) == F.col(f"_m{i}"), "left").drop(f"_m{i}")
        targets.append(F.col(f"_t{i}"))
    match = F.coalesce(*targets) if targets else F.lit(None).cast("long")
    action = (
        F.when(F.col("id").isNotNull(), F.when(F.col("_old").eqNullSafe(F.col(content)), TOUCH).otherwise(UPDATE)).when(match.isNotNull(), MERGE).otherwise(INSERT)
    )
    level = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(matchers))):
        level = F.when(F.col(f"_t{i}").isNotNull(), m).otherwise(level)
    made = out.withColumn("action", action).withColumn("target_id", F.coalesce("id", match)).withColumn("matched_by", F.when(F.col("action") == MERGE, level))
    return made.drop("id", "_old", *[f"_t{i}" for i in range(len(matchers))])


def event(action: Column, old_status: Column, new_status: Column) -> Column:
    """What happened to a listing, null if nothing did."""
    return (
        F.when(action == INSERT, "CREATED").when(action == MERGE, "MERGED").when((new_status == "EXPIRED") & (old_status != "EXPIRED"), "EXPIRED")
        .when((old_status == "EXPIRED") & (new_status == "ACTIVE"), "REACTIVATED").when(action == UPDATE, "UPDATED")
    )


def new_ids(rows: DataFrame, order: Sequence[str], above: int) -> DataFrame:
    """Adds ``id``: numbers above ``above`` in order. Cut from its lineage before it is numbered, so that counts and rows agree.

    Rows are sorted range by range and each keeps its place within its range; what comes before a
    range is the sum of the sizes of those before it, one row per range.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = session.cut(placed.withColumn("_p", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_p").agg((F.max("_at") + 1).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(sizes), "_p").withColumn("id", F.lit(above) + F.col("_ahead") + F.col("_at") + 1).drop("_p", "_at", "_ahead")


def next_state(
    state: DataFrame, changes: DataFrame, columns: Sequence[str], keep_old_if_null: Sequence[str], seen_at: Column, order: Sequence[str] = ()
) -> DataFrame:
    """The state after updates and touches: changed columns are replaced, some keep the old value where the new is null; first_seen_at stays.

    Of several updates of one row the last in ``order`` holds; updates and touches of a row are
    combined before the join, so each row of the state stays one row.
    """
    updated = F.col("action") == UPDATE
    last = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    news = changes.filter(F.col("action").isin(UPDATE, TOUCH)).groupBy(F.col("target_id").alias("_id")).agg(
        F.bool_or(updated).alias("_updated"), F.max_by(F.when(updated, F.struct(*[F.col(c) for c in columns])), F.when(updated, last)).alias("_new")
    )
    out = state.join(news, F.col("id") == F.col("_id"), "left")
    changed = F.coalesce(F.col("_updated"), F.lit(False))
    new = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in keep_old_if_null else F.col(f"_new.{c}")
    out = out.withColumns({c: F.when(changed, new(c)).otherwise(F.col(c)) for c in columns})
    out = out.withColumn("last_seen_at", F.when(F.col("_id").isNotNull(), seen_at).otherwise(F.col("last_seen_at")))
    out = out.withColumn("last_updated_at", F.when(changed, seen_at).otherwise(F.col("last_updated_at")))
    return out.drop("_id", "_updated", "_new")


@dataclass(frozen=True)
class Loaded:
    """The tables after a load, the events that it made, and its classified rows with the id that each ended at."""

    state: DataFrame
    provenance: DataFrame
    events: DataFrame
    rows: DataFrame


#: What a load keeps of every (source, external_id) pair.
PROVENANCE = "id long, source string, external_id string, is_primary boolean, matched_by string, first_seen_at timestamp, last_seen_at timestamp"


def load(
    state: DataFrame | None, provenance: DataFrame | None, incoming: DataFrame, columns: Sequence[str], content: str = "content_hash", matchers: Sequence[tuple[str, str]] = (),
    keep_old_if_null: Sequence[str] = (), seen_at: Column | None = None, order: Sequence[str] = (), status: str = "status",
) -> Loaded:
    """One batch of rows, unique by source and external_id, brought into the state.

    The state has id, ``columns`` (content, matchers and status among them), first_seen_at,
    last_seen_at and last_updated_at; None stands for no table yet. Known rows are updated or touched,
    the others are attached to a stored row that shares a matcher, given as (column, name of the
    match), or inserted with new ids in the order of source and external_id. Provenance is renewed for
    all rows seen and gets a row for each inserted (primary) or attached one. Events tell what
    happened to which id; a touch makes none. Loading the same rows again inserts nothing.
    """
    spark = incoming.sparkSession
    now = F.current_timestamp() if seen_at is None else seen_at
    kinds = incoming.schema
    times = ("first_seen_at", "last_seen_at", "last_updated_at")
    if state is None:
        fields = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in columns)
        state = spark.createDataFrame([], f"id long, {fields}, {', '.join(f'{t} timestamp' for t in times)}")
    provenance = spark.createDataFrame([], PROVENANCE) if provenance is None else provenance
    key = ["source", "external_id"]
    known = provenance.select("id", *key).join(state.select("id", content, F.col(status).alias("_was")), "id")
    made = classify(incoming, known.drop("_was"), key, content, [m for m, _ in matchers], state)
    names = F.create_map(*[F.lit(x) for pair in matchers for x in pair]) if matchers else None
    made = made.withColumn("matched_by", F.element_at(names, F.col("matched_by")) if matchers else F.lit(None).cast("string"))
    made = session.cut(made.join(state.select(F.col("id").alias("target_id"), F.col(status).alias("_was")), "target_id", "left"))
    top = state.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = new_ids(made.filter(F.col("action") == INSERT), key, top)
    done = made.filter(F.col("action") != INSERT).withColumn("id", F.col("target_id")).unionByName(fresh)
    after = next_state(state, made, columns, keep_old_if_null, now, order)
    after = after.unionByName(fresh.select("id", *columns, *[now.alias(t) for t in times]))
    seen = made.select(F.col("source").alias("_s"), F.col("external_id").alias("_e"))
    renewed = provenance.join(seen, (F.col("source") == F.col("_s")) & (F.col("external_id") == F.col("_e")), "left")
    renewed = renewed.withColumn("last_seen_at", F.when(F.col("_s").isNotNull(), now).otherwise(F.col("last_seen_at"))).drop("_s", "_e")
    primary = F.col("action") == INSERT
    added = done.filter(F.col("action").isin(INSERT, MERGE)).select(
        "id", *key, primary.alias("is_primary"), F.when(primary, "L1_SOURCE_ID").otherwise(F.col("matched_by")).alias("matched_by"), now.alias("first_seen_at"), now.alias("last_seen_at"),
    )
    what = event(F.col("action"), F.col("_was"), F.col(status))
    events = done.withColumn("event", what).filter("event is not null").select(
        "id", "event", now.alias("occurred_at"), F.when(F.col("action") != MERGE, F.col("_was")).alias("previous_status"), F.when(F.col("action") != MERGE, F.col(status)).alias("new_status"),
    )
    return Loaded(after, renewed.unionByName(added), events, done)


def missing_rows(known: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows whose key ``known`` lacks, the first in order per key; null parts of a key equal each other."""
    first = first_wins(incoming, key, order)
    on = [F.coalesce(F.col(k).cast("string"), F.lit("")) == F.coalesce(F.col(f"_k_{k}").cast("string"), F.lit("")) for k in key]
    return first.join(known.select(*[F.col(k).alias(f"_k_{k}") for k in key]), on, "left_anti")


def _winner(pick, rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_g_{k}") for k in key]).agg(pick(whole, F.struct(*[F.col(o) for o in order])).alias("_row")).select("_row.*")


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order, combined before the shuffle."""
    return _winner(F.min_by, rows, key, order)


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in order, combined before the shuffle."""
    return _winner(F.max_by, rows, key, order)


def upsert_dimension(known: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], replace: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """``known`` (id, key, columns) after an insert that updates on conflict of a key that may be null.

    A row whose key is stored replaces ``replace`` and fills the other columns where it has a value;
    one without a key, or with a new one, is inserted with a new id. The last in order of a key holds.
    """
    order = order or [key]
    keyed = last_wins(incoming.filter(F.col(key).isNotNull()), [key], order)
    news = keyed.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    old = known.join(news, F.col(key) == F.col("_k"), "left")
    old = old.withColumns({c: F.when(F.col("_k").isNotNull() & F.lit(c in replace), F.col(f"_new_{c}")).otherwise(F.coalesce(F.col(f"_new_{c}"), F.col(c))) for c in columns})
    added = keyed.join(known.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(incoming.filter(F.col(key).isNull()).select(*keyed.columns))
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = new_ids(added, [key, *columns], top)
    return old.select("id", key, *columns).unionByName(added.select("id", key, *columns))


class Store:
    """Versioned tables under one folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        path = self._path(f"{self.folder}/{name}")
        if not self.fs.exists(path):
            return None
        lines = self.spark.read.text(f"{self.folder}/{name}").collect()
        return json.loads("".join(r[0] for r in lines))

    def versions(self) -> list[int]:
        """Committed versions; each has a manifest that appeared by an atomic rename."""
        if not self.fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def tables(self) -> dict[str, str]:
        versions = self.versions()
        return self._read(f"manifest-{versions[-1]}.json")["tables"] if versions else {}

    def table(self, name: str) -> DataFrame | None:
        path = self.tables().get(name)
        return None if path is None else self.spark.read.parquet(path)

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
        """Writes the tables, then makes them live together with the unchanged ones; a crash before that leaves the old version."""
        version = (self.versions() or [0])[-1] + 1
        paths = dict(self.tables())
        mark = uuid.uuid4().hex[:8]
        for name, df in tables.items():
            path = f"{self.folder}/{name}/v{version}-{mark}"
            writer = df.write.mode("errorifexists")
            if cols := (partition_by or {}).get(name):
                writer = writer.partitionBy(*cols)
            writer.parquet(path)
            paths[name] = path
        text = json.dumps({"version": version, "tables": paths, "at": time.time()})
        if not self._create(f"manifest-{version}.json", text, mark):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def _create(self, name: str, text: str, mark: str) -> bool:
        """Makes a whole file appear under a name that no file has; False if one has it. One of several writers wins.

        A local folder links the finished draft, which fails if the name is taken; other file systems
        create the file exclusively, which HDFS and stores with conditional writes do at once.
        """
        def write(path, replace: bool) -> None:
            stream = self.fs.create(path, replace)
            stream.write(bytearray(text.encode()))
            stream.close()

        final = self._path(f"{self.folder}/{name}")
        if self.fs.getScheme() != "file":
            try:
                write(final, False)
            except Py4JJavaError:
                if self.fs.exists(final):
                    return False
                raise
            return True
        draft = self._path(f"{self.folder}/.draft-{mark}.json")
        write(draft, True)
        jvm = self.spark._jvm
        place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(place(self.fs.makeQualified(final)), place(self.fs.makeQualified(draft)))
        except Py4JJavaError:
            if self.fs.exists(final):
                return False
            raise
        finally:
            self.fs.delete(draft, False)
        return True

    def begin(self, name: str = "load") -> None:
        """At most one run at a time: takes the lock ``name`` or raises RuntimeError. ``end`` gives it back; ``reclaim`` does for a run that never ended."""
        if not self.fs.exists(self._path(self.folder)):
            self.fs.mkdirs(self._path(self.folder))
        if not self._create(f"lock-{name}.json", json.dumps({"at": time.time()}), uuid.uuid4().hex[:8]):
            raise RuntimeError(f"another run of {name} is active")

    def end(self, name: str = "load") -> None:
        self.fs.delete(self._path(f"{self.folder}/lock-{name}.json"), False)

    def reclaim(self, minutes: int = 30, name: str = "load") -> bool:
        """Gives back a lock that is older than so many minutes."""
        held = self._read(f"lock-{name}.json")
        if held is None or time.time() - held["at"] < minutes * 60:
            return False
        self.end(name)
        return True
