"""Mixing sources to target shares of all tokens.

The van der Corput sequence (the bits of k in reverse order) mapped through the cumulative weights
gives the source of slot k, so every stretch of the mix has the shares of the whole. Texts of a
source are put in a pseudo-random order once per repetition and cut into blocks of equal tokens;
the n-th slot of a source takes its n-th block. All arithmetic is in integers and no step looks at
where a row lies, so the mix is the same on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import session
from millrace.llm import tokens

#: Parts of a source and repetition over which running sums are added up in two levels.
PARTS = 4096


@dataclass(frozen=True)
class Quota:
    """What one source brings: tokens of one pass over it, of all allowed passes, and in the mix."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    quota: int


def quotas(available: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Quota]:
    """Tokens of each source by water filling.

    A source gets its share of ``total`` unless its repetitions run out; what these lack goes to the
    others in proportion to their targets, as far as they last. ``total`` is the tokens of one pass
    over all targeted sources unless given. Null, negative and repeated targets count as zero, as zero and together.
    """
    merged: dict[str, list] = {}
    for source, share, repeats in targets:
        if source is None:
            continue
        at = merged.setdefault(source, [0.0, 0])
        at[0] += max(0.0, share or 0.0)
        at[1] = max(at[1], repeats or 0)
    weight = sum(share for share, _ in merged.values()) or 1.0
    limit = {s: available.get(s, 0) * repeats for s, (_, repeats) in merged.items()}
    total = sum(available.get(s, 0) for s in merged) if total is None else total
    left, open_, quota = float(total), {s: share / weight for s, (share, _) in merged.items() if share > 0}, dict.fromkeys(merged, 0)
    while open_:
        share = sum(open_.values())
        short = {s for s, w in open_.items() if left * w / share >= limit[s]}
        if not short:
            for s, w in open_.items():
                quota[s] = int(left * w / share)
            break
        for s in sorted(short):
            quota[s] = limit[s]
        left -= sum(limit[s] for s in short)
        for s in short:
            del open_[s]
    return [Quota(s, share / weight, repeats, available.get(s, 0), quota[s]) for s, (share, repeats) in sorted(merged.items())]


def ordered(counted: DataFrame, plan: list[Quota], key: str, seed: int) -> DataFrame:
    """Texts with repetition and the tokens that come before them in their source (``before``), as far as the quota goes.

    The order is by a hash of key and text, repetition by repetition; rows that agree in both are
    interchangeable. Running sums have two levels: the sums of PARTS ranges of the hash per source
    and repetition, and sums within a range, so a source that holds most of the rows is spread over
    all tasks. Both sides of the join of the two are parted alike; Spark broadcasts the sums where they are small.
    """
    spark = counted.sparkSession
    wanted = [(q.source, rep, q.quota) for q in plan for rep in range(q.max_repeats) if q.available * rep < q.quota]
    table = spark.createDataFrame(wanted, "source string, repetition int, quota long")
    rows = counted.join(table, "source").withColumn("order", F.xxhash64(key, "content", "repetition", F.lit(seed)))
    rows = rows.withColumn("part", F.shiftright("order", 52).cast("int"))  # signed: orders like the hash
    sums = rows.groupBy("source", "repetition", "part").agg(F.sum("n_tokens").alias("in_part"))
    ahead = Window.partitionBy("source").orderBy("repetition", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_part").over(ahead), F.lit(0))).drop("in_part")
    within = Window.partitionBy("source", "repetition", "part").orderBy("order", key, "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.join(sums, ["source", "repetition", "part"]).withColumn("before", F.col("ahead") + F.col("inner"))
    return rows.filter(F.col("before") < F.col("quota")).drop("order", "part", "ahead", "inner", "quota", "content")


def reversed_bits(value: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse order."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, i).bitwiseAND(F.lit(1).cast("long")), bits - 1 - i))
    return out


def rank_of(slot: Column, point: Column, low: Column, high: Column, bits: int) -> Column:
    """How many of the slots before ``slot`` have their point in [low, high); ``point`` is that of the slot.

    The slots before it are, for every bit that is set, those that agree above the bit and have 0
    there; their points are evenly spaced, so each such set is counted by two divisions.
    """
    one = F.lit(1).cast("long")

    def step(total: Column, t: Column) -> Column:
        gap = F.lit(bits) - t  # the points of these slots differ by 2^gap
        base = point % F.call_function("shiftleft", one, gap - 1)
        upto = lambda edge: F.call_function("shiftright", edge - base + F.call_function("shiftleft", one, gap) - 1, gap)
        return total + F.when(F.call_function("shiftright", slot, t).bitwiseAND(one) == 1, upto(high) - upto(low)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), step) if bits else F.lit(0).cast("long")


def schedule(spark, plan: list[Quota], block_tokens: int) -> DataFrame:
    """(slot, source, block): the source of every slot by van der Corput points, and the rank of the slot in its source.

    There are 2^m points, no fewer than blocks, and each occurs once; a source with b of n blocks owns an interval
    of at least b points, so every block has a slot whatever the sizes. Slots behind a source's last block stay empty,
    which leaves gaps in the numbers. Ranks are worked out slot by slot, without a shuffle.
    """
    blocks = {q.source: -(-q.quota // block_tokens) for q in plan if q.quota > 0}
    n = sum(blocks.values())
    if n == 0:
        return spark.createDataFrame([], "slot long, source string, block long")
    bits = (n - 1).bit_length()
    edges, below = [], 0
    for s, b in sorted(blocks.items()):
        low, high = (-(-(x << bits) // n) for x in (below, below + b))
        edges.append((s, low, high, b))
        below += b
    point = F.col("point")
    owner = None
    for s, low, high, b in edges:
        about = F.struct(F.lit(s).alias("source"), *[F.lit(v).cast("long").alias(k) for k, v in (("low", low), ("high", high), ("blocks", b))])
        owner = F.when(point < high, about) if owner is None else owner.when(point < high, about)
    once = lambda c: F.explode(F.array(c)).alias("x")  # noqa: E731  # a generator keeps what it makes from being worked out again for every use
    slots = spark.range(1 << bits).select(once(F.struct(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point")))).select("x.*")
    slots = slots.select("slot", "point", once(owner)).select("slot", "point", "x.*")
    slots = slots.withColumn("block", rank_of(F.col("slot"), point, F.col("low"), F.col("high"), bits))
    return slots.filter(F.col("block") < F.col("blocks")).select("slot", "source", "block")


def _counted(df: DataFrame, key: str, text: str, source: str, folder: str, name: str) -> DataFrame:
    """Key, source, a hash of the text and tokens of every text that has any; written once, for it is read twice."""
    body = F.col(text).cast("string")
    rows = df.select(F.col(key), F.col(source).alias("source"), F.xxhash64(body).alias("content"), body.alias("text"))
    return session.cut(tokens.count(rows, (key, "source", "content"), "text", folder, name).filter("n_tokens > 0 and source is not null"))


def _plan(counted: DataFrame, targets: DataFrame, total: int | None) -> list[Quota]:
    # Both are one row per target: the targets are a small table of the caller.
    wanted = [(r[0], r[1], r[2]) for r in targets.select("source", "target_share", "max_repeats").collect()]
    names = targets.select("source").distinct()
    sizes = counted.join(names, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return quotas({r["source"]: r["n"] for r in sizes}, wanted, total)


def mix(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total: int | None = None,
    block_tokens: int = 16_384,
    seed: int = 17,
    folder: str = tokens.DEFAULT_FOLDER,
    name: str = tokens.DEFAULT_NAME,
) -> DataFrame:
    """The mix: slot, block, source, repetition, position (tokens before it in its source), key, n_tokens.

    Reading by (slot, position) gives the mix in order, the same for the same rows however they are stored. No text comes more often than its source's
    ``max_repeats``. Texts without tokens, without a source or of a source without a target are not
    in the mix. Empty tables give an empty mix.
    """
    counted = _counted(df, key, text, source, folder, name)
    plan = _plan(counted, targets, total)
    rows = ordered(counted, plan, key, seed).withColumn("block", F.floor(F.col("before") / block_tokens))
    slots = schedule(df.sparkSession, plan, block_tokens)
    out = rows.join(slots, ["source", "block"])
    return out.select("slot", "block", "source", "repetition", F.col("before").alias("position"), key, "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, texts, tokens, share and most_repeats reached; zeros for a source without text."""
    reached = mixed.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), (F.max("repetition") + 1).alias("most_repeats"))
    reached = reached.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # one row per source with a target
    out = targets.join(reached, "source", "left")
    zero: Column = F.lit(0)
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("texts", zero).alias("texts"), F.coalesce("tokens", zero).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("most_repeats", zero).alias("most_repeats"),
    )
