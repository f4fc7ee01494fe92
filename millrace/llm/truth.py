"""The best representative of each duplicate group, with a latent two-sided model of the sources.

Every distinct value of a field in a group is a fact that is true or false; several may be true.
A source states a true fact with its sensitivity and a false one with one minus its specificity.
Expectation-maximisation infers both rates and the probability of every fact together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import text as text_functions
from millrace.operators import components, skew

#: Words that stand for "nothing known" (fixed values), compared in lower case.
GAP_WORDS = (
    "", "-", "--", "?", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "tbc", "tbd", "to be confirmed",
    "to be determined", "to be discussed", "not specified", "not available", "unspecified", "undefined", "missing", "(none)", "(blank)", "...",
)

FULLNESS_FIELDS = ("department", "seniority", "city", "state_code", "employment_type", "salary_min", "salary_max", "salary_currency")
OTHER_SOURCE = "(other)"


@dataclass(frozen=True)
class Priors:
    """Pseudo-counts of the beta priors; the defaults say that most statements are true and few are false."""

    true_positive: float = 8.0
    false_negative: float = 4.0
    false_positive: float = 1.0
    true_negative: float = 9.0
    fact_true: float = 2.0
    fact_false: float = 1.0


def real(value: Column) -> Column:
    """The trimmed text of a value, null for blanks, not-a-number and words that stand for a gap."""
    text = text_functions.strip(value.cast("string"))
    return F.when(~F.lower(text).isin(*GAP_WORDS), text)


def groups(df: DataFrame, node: str, keys: Sequence[Column]) -> DataFrame:
    """(node, group_id): rows that share a non-null key, directly or through others; group_id is the smallest node."""
    links = None
    for key in keys:
        part = components.star_links(df, node, key)
        links = part if links is None else links.union(part)
    return components.connected_components(links).select(F.col("node").alias(node), F.col("component").alias("group_id"))


def _stated(rows: DataFrame, fields: Sequence[str], *columns: str) -> DataFrame:
    """(columns, field, value) of every real value."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), real(F.col(f)).alias("value")) for f in fields])).alias("c")
    return rows.select(*columns, each).select(*columns, "c.field", "c.value").filter("value is not null")


def facts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(group_id, field, value, said, denied, n_rows): which sources state a value and which state only others for the field; cut from its lineage.

    Rows are combined by source before they meet, so sets hold no more entries than there are
    sources. The sayers of all values of a field are gathered from the facts, not from the rows again.
    """
    said = _stated(rows, fields, "group_id", "source_name").groupBy("group_id", "field", "value").agg(F.collect_set("source_name").alias("said"), F.count("*").alias("n_rows"))
    said = session.cut(said)
    anyone = said.select("group_id", "field", F.explode("said").alias("s")).groupBy("group_id", "field").agg(F.collect_set("s").alias("speakers"))
    out = said.join(anyone, ["group_id", "field"])
    return session.cut(out.select("group_id", "field", "value", F.array_sort("said").alias("said"), F.array_sort(F.array_except("speakers", "said")).alias("denied"), "n_rows"))


def _log_odds(params: dict[str, tuple[float, float]], priors: Priors) -> Column:
    """log(p(true) / p(false)) of a fact from who says and who denies it."""
    if not params:
        return F.lit(0.0)
    yes = F.create_map(*[F.lit(x) for s, (sens, fpr) in params.items() for x in (s, math.log(sens / fpr))])
    no = F.create_map(*[F.lit(x) for s, (sens, fpr) in params.items() for x in (s, math.log((1 - sens) / (1 - fpr)))])
    weigh = lambda names, by: F.aggregate(names, F.lit(0.0), lambda a, s: a + F.coalesce(F.element_at(by, s), F.lit(0.0)))
    return F.lit(math.log(priors.fact_true / priors.fact_false)) + weigh("said", yes) + weigh("denied", no)


def probability(params: dict[str, tuple[float, float]], priors: Priors) -> Column:
    return 1 / (1 + F.exp(-_log_odds(params, priors)))


def infer(fact_rows: DataFrame, priors: Priors = Priors(), rounds: int = 1000, tolerance: float = 1e-3) -> dict[str, tuple[float, float]]:
    """Sensitivity and false-positive rate of each source.

    Facts with the same sayers and deniers count together, so a round goes over the distinct
    patterns only and returns one row per source to the driver. Rates that haven't settled to the
    tolerance after ``rounds`` are an error.
    """
    patterns = session.cut(fact_rows.groupBy("said", "denied").agg(F.count("*").alias("n")))
    names = [r[0] for r in patterns.select(F.explode(F.array_union("said", "denied")).alias("s")).distinct().collect()]
    start = (priors.true_positive / (priors.true_positive + priors.false_negative), priors.false_positive / (priors.false_positive + priors.true_negative))
    params = {s: start for s in sorted(names)}
    for _ in range(rounds):
        p = patterns.withColumn("p", probability(params, priors))
        each = F.explode(F.concat(F.transform("said", lambda s: F.struct(s.alias("s"), F.lit(1).alias("yes"))), F.transform("denied", lambda s: F.struct(s.alias("s"), F.lit(0).alias("yes")))))
        sums = p.select("n", "p", each.alias("c")).groupBy("c.s").agg(
            F.sum(F.col("n") * F.col("p") * F.col("c.yes")).alias("tp"), F.sum(F.col("n") * F.col("p")).alias("t"),
            F.sum(F.col("n") * (1 - F.col("p")) * F.col("c.yes")).alias("fp"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f"),
        ).collect()
        new = {}
        for r in sums:
            sens = (r["tp"] + priors.true_positive) / (r["t"] + priors.true_positive + priors.false_negative)
            fpr = (r["fp"] + priors.false_positive) / (r["f"] + priors.false_positive + priors.true_negative)
            new[r["s"]] = (min(max(sens, 1e-6), 1 - 1e-6), min(max(fpr, 1e-6), 1 - 1e-6))
        moved = max((abs(a - b) for s in new for a, b in zip(new[s], params[s])), default=0.0)
        params = new
        if moved < tolerance:
            return params
    raise RuntimeError(f"rates of sources not settled after {rounds} rounds: moved by {moved:.2g}")


def grouped_rows(df: DataFrame, sources: DataFrame, node: str = "source_row_id", fields: Sequence[str] = FULLNESS_FIELDS) -> DataFrame:
    """The rows of groups of two or more with group_id, source_name, trust, fullness; cut from their lineage.

    A source that ``sources`` lacks keeps its name and has the worst trust; a null one is "(other)".
    Rows without an id, and rows that share no key, are in no group. Further rows of one id count as that row.
    """
    g = groups(df, node, [F.concat(F.lit("u:"), F.col("apply_url_hash")), F.concat(F.lit("f:"), F.col("content_fingerprint"))])
    about = sources.groupBy(F.col("source").alias("source_name")).agg(F.min("trust_rank").alias("trust"))
    full = sum((F.when(real(F.col(f)).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    kept = dict.fromkeys(["title", *fields])
    rows = df.select(F.col(node), F.col("source").alias("_s"), "last_updated_at", full.alias("fullness"), *kept).join(g, node)
    rows = rows.join(F.broadcast(about), F.col("_s") == F.col("source_name"), "left")
    rows = rows.withColumn("source_name", F.coalesce("_s", F.lit(OTHER_SOURCE))).drop("_s").withColumn("trust", F.coalesce("trust", F.lit(2**31 - 1)))
    return session.cut(rows)


def dominance(rows: DataFrame) -> DataFrame:
    """Adds ``beaten``: whether another row of the group is at least equal in fullness, update and trust, and ahead in one.

    Only the latest update of each fullness and trust can beat a row, so a group brings a small
    array that is bounded by the number of fullness levels times trust levels. Groups of very many
    rows get theirs by broadcast.
    """
    when = F.coalesce(F.col("last_updated_at"), F.lit("0001-01-01").cast("timestamp"))
    rows = rows.withColumn("_at", when)
    cells = rows.groupBy("group_id", "fullness", "trust").agg(F.max("_at").alias("at"), F.count("*").alias("n"))
    cells = session.cut(cells.groupBy("group_id").agg(F.collect_list(F.struct("fullness", "trust", "at")).alias("cells"), F.sum("n").alias("_rows")))
    f, t, at = F.col("fullness"), F.col("trust"), F.col("_at")
    beaten = F.exists("cells", lambda c: (c["fullness"] >= f) & (c["trust"] <= t) & (c["at"] >= at) & ((c["fullness"] > f) | (c["trust"] < t) | (c["at"] > at)))
    return skew.join_to_one(rows, cells, ["group_id"], "_rows").withColumn("beaten", beaten).drop("cells", "_at")


def scored(rows: DataFrame, known: DataFrame, params: dict[str, tuple[float, float]], fields: Sequence[str], node: str, priors: Priors = Priors()) -> DataFrame:
    """(group_id, <node>, expected_true): how many values of each row the model expects to be true; rows without a real value are left out."""
    judged = known.select("group_id", "field", "value", probability(params, priors).alias("p"), "n_rows")
    met = skew.join_to_one(_stated(rows, fields, "group_id", node), judged, ["group_id", "field", "value"], "n_rows")
    return met.groupBy("group_id", node).agg(F.round(F.sum("p"), 6).alias("expected_true"))


def representatives(df: DataFrame, sources: DataFrame, node: str = "source_row_id", fields: Sequence[str] = FULLNESS_FIELDS, priors: Priors = Priors()) -> DataFrame:
    """(group_id, best_<node>, expected_true): the row of the group with most values expected to be true, among those that no other beats.

    The model scores every row of every group; a row that another beats in fullness, update and trust
    gives way whatever its score. Ties go to the smallest id. Nulls and gap words are no values; a null
    update counts as oldest and an unknown source as least trusted. An empty table gives an empty result.
    """
    rows = grouped_rows(df, sources, node, fields)
    known = facts(rows, fields)
    score = scored(rows, known, infer(known, priors), fields, node, priors)
    ranked = dominance(rows).groupBy("group_id", node).agg(F.min("beaten").alias("beaten")).join(score, ["group_id", node], "left")
    first = F.struct("beaten", (-F.coalesce("expected_true", F.lit(0.0))).alias("loss"), F.col(node).alias("id"))
    best = ranked.groupBy("group_id").agg(F.min(first).alias("b"))
    return best.select("group_id", F.col("b.id").alias(f"best_{node}"), (-F.col("b.loss")).alias("expected_true"))


def survivors(df: DataFrame, sources: DataFrame, node: str = "source_row_id", fields: Sequence[str] = ("title", *FULLNESS_FIELDS), priors: Priors = Priors()) -> DataFrame:
    """One built record per group and field: the likeliest value and every value judged true.

    Columns group_id, field, value, probability, true_values. A field that no row of a group states has no row.
    """
    known = facts(grouped_rows(df, sources, node), fields)
    params = infer(known, priors)
    judged = known.select("group_id", "field", "value", F.round(probability(params, priors), 6).alias("p"), F.size("said").alias("votes"))
    best = judged.groupBy("group_id", "field").agg(
        F.min(F.struct((-F.col("p")).alias("loss"), (-F.col("votes")).alias("few"), "value")).alias("b"),
        F.array_sort(F.collect_set(F.when(F.col("p") >= 0.5, F.col("value")))).alias("true_values"),
    )
    return best.select("group_id", "field", F.col("b.value").alias("value"), (-F.col("b.loss")).alias("probability"), "true_values")
