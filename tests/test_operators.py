from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import components, feed, maintain, quality, skew, upsert
from millrace.sources import listing
from millrace.streaming import events, microbatch


def test_cursors_round_trip_and_refuse():
    for value in (None, 5, "x", Decimal("1.50"), datetime(2026, 1, 2, tzinfo=timezone.utc)):
        c = feed.Cursor("posted", value, 7)
        assert feed.decode_cursor(feed.encode_cursor(c), "posted") == c
    for bad in ("", "%%%", "e30", feed.encode_cursor(feed.Cursor("posted", 1, -1)), "x" * 600):
        with pytest.raises(ValueError):
            feed.decode_cursor(bad, "posted")
    with pytest.raises(ValueError):
        feed.decode_cursor(feed.encode_cursor(feed.Cursor("salary", 1, 1)), "posted")


def test_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(50)], "id long, k int")
    sort, seen, cursor = feed.Sort("k", "k"), [], None
    while True:
        rows = feed.page(df, "k", "id", 7, cursor).collect()
        rows, following = feed.next_cursor(rows, 7, sort, "id")
        seen += [r["id"] for r in rows]
        if following is None:
            break
        cursor = feed.decode_cursor(following, "k")
    want = sorted(range(50), key=lambda i: (i % 3 == 0, -(i % 4) if i % 3 else 0, -i))
    assert seen == want


def test_sort_names_and_wildcards(spark):
    sorts = (feed.Sort("a", "a"), feed.Sort("relevance", None, keyset=False))
    assert feed.sort_of("zzz", sorts).name == "a" and feed.sort_of("relevance", sorts, has_query=False).name == "a"
    df = spark.createDataFrame([("100% real",), ("100 x",), ("a_b",), ("acb",)], "n string")
    assert df.filter(feed.predicate(feed.Filters(begins={"n": "100%"}))).count() == 1
    assert df.filter(feed.predicate(feed.Filters(holds={"n": "A_B"}))).count() == 1


def test_load_twice_changes_nothing(spark, tmp_path):
    store = upsert.Store(spark, str(tmp_path / "store"))
    new = spark.createDataFrame([(f"k{i}", f"c{i % 3}", None if i % 2 else f"u{i // 4}") for i in range(20)], "k string, content string, url string")

    def load(rows):
        known = store.table("jobs")
        known = known if known is not None else spark.createDataFrame([], "k string, content string, url string, id long")
        return upsert.classify(rows, known, ["k"], "content", ["url"])

    first = load(new)
    assert {r["action"] for r in first.collect()} == {upsert.INSERT}
    top = upsert.new_ids(first.select("k", "content", "url"), ["k"], 0)
    store.commit({"jobs": top})
    assert sorted(r["id"] for r in store.table("jobs").collect()) == list(range(1, 21))
    assert {r["action"] for r in load(new).collect()} == {upsert.TOUCH}
    changed = new.withColumn("content", F.lit("other")).filter("k in ('k1', 'k2')").unionByName(spark.createDataFrame([("new1", "z", "u0"), ("new2", "z", None)], new.schema))
    got = {r["k"]: (r["action"], r["matched_by"]) for r in load(changed).collect()}
    assert got == {"k1": (upsert.UPDATE, None), "k2": (upsert.UPDATE, None), "new1": (upsert.MERGE, "url"), "new2": (upsert.INSERT, None)}


def test_files_once_per_version_with_atomic_commit(spark, tmp_path):
    folder, store = tmp_path / "in", upsert.Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    import pandas as pd

    for day, n in (("2026-01-01", 3), ("2026-01-03", 2), ("2026-02-31", 9)):
        pd.DataFrame({"id": [f"{day}-{i}" for i in range(n)]}).to_parquet(folder / f"{day}.parquet")
    (folder / "notes.tmp").write_text("x")

    def process(rows, tables):
        kept = rows.select("id", "row_index")
        old = tables.get("jobs")
        return {"jobs": kept if old is None else old.unionByName(kept)}

    assert microbatch.run(spark, str(folder), store, ("id",), process) == ["2026-01-01.parquet", "2026-01-03.parquet"]
    assert microbatch.run(spark, str(folder), store, ("id",), process) == []
    assert store.table("jobs").count() == 5
    pd.DataFrame({"id": ["again"] * 4}).to_parquet(folder / "2026-01-03.parquet")
    assert microbatch.run(spark, str(folder), store, ("id",), process) == ["2026-01-03.parquet"]

    def broken(rows, tables):
        raise RuntimeError("no")

    pd.DataFrame({"id": ["x"]}).to_parquet(folder / "2026-01-04.parquet")
    before = store.tables()
    with pytest.raises(RuntimeError):
        microbatch.run(spark, str(folder), store, ("id",), broken)
    assert store.tables() == before
    assert [r[0] for r in listing.gaps(listing.files(spark, str(folder))).collect()] == [date(2026, 1, 2)]
    from millrace.sources.plugin import ListingSource

    spark.dataSource.register(ListingSource)
    assert spark.read.format("daily_listing").option("path", str(folder)).load().count() == 3
    out = spark.readStream.format("daily_listing").option("path", str(folder)).load().writeStream.format("memory").queryName("days").trigger(availableNow=True).start()
    assert out.awaitTermination(120) and spark.table("days").count() == 3
    assert listing.should_act(listing.files(spark, str(folder)), store.table("files").select("path", "version")) and not listing.should_act(listing.files(spark, str(folder)).filter("name < '2026-01-04'"), store.table("files").select("path", "version"))
    assert listing.should_act(None, None)
    copied = listing.archive(spark, str(folder / "2026-01-01.parquet"), str(tmp_path / "raw"), listing.archive_key("s", "full", "delta", "2026-01-01.parquet"))
    assert spark.read.parquet(copied).count() == 3
    assert listing.readable(spark, "elsewhere", str(tmp_path / "raw"), "raw/s/full/delta/2026-01-01.parquet") == copied and listing.readable(spark, "elsewhere", str(tmp_path / "raw"), "no") == "elsewhere"
    with pytest.raises(ValueError):
        listing.archive_key("..", "a", "b", "c")
    with pytest.raises(FileNotFoundError):
        listing.retried(lambda: listing.files(spark, str(tmp_path / "none")))


def test_retries():
    waits, left = [], [1, 1]

    def call():
        if left:
            left.pop()
            raise OSError("busy")
        return "done"

    assert listing.retried(call, sleep=waits.append) == "done" and waits == [5.0, 10.0]


def test_components_agree_with_union_find(spark):
    import random

    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_hot_keys_give_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_ROWS", 10)
    left = spark.range(200).select(F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.coalesce("k", F.lit("none"))).cache()
    got = skew.join_to_one(left, right, ["k"], "n").collect()
    assert len(got) == 200 and all(r["v"] == (r["k"] or "none") for r in got)


def test_maintenance(spark):
    now = F.lit(datetime(2026, 1, 10, tzinfo=timezone.utc)).cast("timestamp")
    runs = spark.createDataFrame([("RUNNING", datetime(2026, 1, 9), None), ("SUCCEEDED", datetime(2026, 1, 8), datetime(2026, 1, 8, 12))], "status string, started_at timestamp, finished_at timestamp")
    assert [r["status"] for r in maintain.reclaim(runs, now).collect()] == ["FAILED", "SUCCEEDED"]
    assert maintain.staleness(runs, now).first()["state"] == "STALE" and maintain.staleness(runs.limit(0), now).first()["state"] == "NEVER"


def test_gates_and_amounts(spark):
    row = spark.range(1).select(
        quality.country_gate(F.lit(None).cast("string"), ["US"]), quality.country_gate(F.lit("DE"), ["US"]), quality.country_gate(F.lit("DE"), []), text.amounts_in_order(F.lit(9), F.lit(3))["low"],
        text.amounts_in_order(F.lit(None).cast("int"), F.lit(3))["high"], text.amounts_in_order(F.lit(-1), F.lit(3))["low"],
    ).first()
    assert tuple(row) == ("INVALID_COUNTRY", "COUNTRY_NOT_ALLOWED", None, Decimal("3.00"), Decimal("3.00"), None)


def test_windows_on_a_stream_equal_the_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    out = events.tumbling(stream, "ts", "1 day", "event_type", "value", watermark="1 hour")
    running = out.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    pick = lambda df: sorted(map(tuple, df.select("window_start", "event_type", "n").collect()))
    assert pick(spark.table("daily")) == pick(events.tumbling(batch, "ts", "1 day", "event_type", "value"))
