"""Sum, count and big-sum trees, and sums read under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import Overflow, WrongElementType
from ..model import BIG_SUM_TREE, COLUMNS, COUNTING, ELEMENT_COLUMNS, ITEM_WITH_SUM, KEYED_TREES, SUM_ITEM, SUMMING, any_of, contribution, contributions, tree_id
from ..plans.compile import in_tree, near
from ..plans.query import AggregateSumQuery
from ..sources.store import written
from .references import follow

HARD_CAP = 1024  # elements one budget query may read; a fixed value
BUDGET_HOPS = 3
AGG = ["sum_value", "big_sum_value", "count_value"]


def tree_aggregates(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """For each tree of ``trees`` (path, key, element_type) the aggregates of what it holds, one level deep.

    A sum by tree with map-side combining, so one tree may hold most rows. A
    tree that holds nothing sums to 0. Sums that do not fit 64 bits are errors.
    """
    t = trees.select(F.concat("path", F.array("key")).alias("tree_path"), F.col("element_type").alias("tree_type"))
    t = t.withColumn("t_id", tree_id(F.col("tree_path")))
    held = nodes.join(t, (F.col("tree_id") == F.col("t_id")) & (F.col("path") == F.col("tree_path")))
    s, b, c = contribution(F.col("tree_type"))
    sums = held.groupBy("tree_path").agg(F.sum(s).alias("s"), F.sum(b).cast("decimal(38,0)").alias("b"), F.sum(c).alias("c"), F.count("*").alias("n"))
    x = t.join(sums, "tree_path", "left")
    zero = F.lit(0).cast("bigint")
    return x.select(
        "tree_path",
        F.when(F.col("tree_type").isin(*SUMMING), F.coalesce("s", zero)).alias("sum_value"),
        F.when(F.col("tree_type") == BIG_SUM_TREE, F.coalesce("b", F.lit(0).cast("decimal(38,0)"))).alias("big_sum_value"),
        F.when(F.col("tree_type").isin(*COUNTING), F.coalesce("c", zero)).alias("count_value"),
        F.coalesce("n", zero).alias("n_elements"),
    )


def propagate(nodes: DataFrame) -> DataFrame:
    """nodes with the aggregates of all trees made anew, deepest first.

    One pass per level of nesting: the levels are few, whatever the rows. Only
    tree elements change; each pass joins the trees of one level with what
    they hold, and the result of a level is written before the next reads it.
    """
    trees = nodes.where(F.col("element_type").isin(*KEYED_TREES))
    depths = sorted((r["d"] for r in trees.select(F.size("path").alias("d")).distinct().collect()), reverse=True)
    plain = nodes.where(~F.col("element_type").isin(*KEYED_TREES))
    below = None
    done: list[DataFrame] = []
    for d in depths:
        level = trees.where(F.size("path") == d)
        held = plain.where(F.size("path") == d + 1)
        held = held if below is None else held.unionByName(below)
        agg = tree_aggregates(held, level)
        level = level.withColumn("at", F.concat("path", F.array("key"))).drop(*AGG).join(agg, F.col("at") == F.col("tree_path"), "left").select(*nodes.columns)
        below = written(level, "level")
        done.append(below)
    out = plain
    for level in done:
        out = out.unionByName(level)
    return out


def settled(nodes: DataFrame, gone: DataFrame, put: DataFrame) -> DataFrame | None:
    """Tree rows with new aggregates after a change: only trees above what changed, by what changed in them.

    nodes: the forest after the change but for the aggregates. gone, put: rows
    that the change took out and put in. Level by level, deepest first, the
    differences are summed by tree, added to what the tree has stored, and the
    tree's own change passes to the level above. So stored aggregates that
    were right before are right after, and nothing that did not change is
    read, but for the trees' own rows. None where no aggregate changes.
    """
    trees = nodes.where(F.col("element_type").isin(*SUMMING, BIG_SUM_TREE, *COUNTING))

    def told(rows: DataFrame, sign: int) -> DataFrame:
        s, b, c = contributions()
        return rows.select("path", *((F.lit(sign) * x).alias(n) for n, x in zip("sbc", (s, b, c), strict=True)))

    changes = told(gone, -1).unionByName(told(put, 1)).where(F.size("path") > 0)
    changes = written(changes.groupBy("path").agg(*(F.sum(c).alias(c) for c in "sbc")).where("s <> 0 or b <> 0 or c <> 0"), "changes")
    deepest = changes.agg(F.max(F.size("path"))).first()[0] or 0
    above, done = None, None
    for d in range(deepest, 0, -1):  # as many rounds as levels of nesting
        here = changes.where(F.size("path") == d)
        if above is not None:
            here = here.unionByName(above).groupBy("path").agg(*(F.sum(c).alias(c) for c in "sbc"))
        here = here.select(F.slice("path", 1, F.size("path") - 1).alias("up__"), F.element_at("path", -1).alias("own__"), "s", "b", "c")
        here = written(here.withColumn("up_id__", tree_id(F.col("up__"))), "above")
        hit = near(trees, here.select(F.col("up__").alias("path"), F.col("own__").alias("key"))).join(here, (F.col("tree_id") == F.col("up_id__")) & (F.col("path") == F.col("up__")) & (F.col("key") == F.col("own__")))
        t = F.col("element_type")
        zero = F.lit(0).cast("bigint")
        new = {
            "sum_value": F.when(t.isin(*SUMMING), F.coalesce("sum_value", zero) + F.col("s")).otherwise(F.col("sum_value")).cast("bigint"),
            "big_sum_value": F.when(t == BIG_SUM_TREE, F.coalesce("big_sum_value", zero.cast("decimal(38,0)")) + F.col("b")).otherwise(F.col("big_sum_value")).cast("decimal(38,0)"),
            "count_value": F.when(t.isin(*COUNTING), F.coalesce("count_value", zero) + F.col("c")).otherwise(F.col("count_value")).cast("bigint"),
        }
        was = [x.alias(f"was_{n}") for n, x in zip("sbc", contributions(), strict=True)]
        level = written(hit.select(*COLUMNS, *was, "s", "b", "c").select(*(new.get(c, F.col(c)).alias(c) for c in COLUMNS), "was_s", "was_b", "was_c"), "settled")
        if level.isEmpty():
            above = None
            continue
        now = contributions()
        above = level.select("path", *((x - F.col(f"was_{n}")).alias(n) for n, x in zip("sbc", now, strict=True))).where("(s <> 0 or b <> 0 or c <> 0) and size(path) > 0")
        rows = level.select(*COLUMNS)
        done = rows if done is None else done.unionByName(rows)
    return done


def with_aggregates(trees: DataFrame, found: DataFrame) -> DataFrame:
    """Tree rows with the aggregates of ``found`` (tree_path and the three values), by kind: what a kind has no use for is null. Flags and all else stay."""
    x = trees.withColumn("at__", F.concat("path", F.array("key"))).join(found.select("tree_path", *(F.col(c).alias(f"new_{c}") for c in AGG)), F.col("at__") == F.col("tree_path"), "left")
    t = F.col("element_type")
    use = {"sum_value": t.isin(*SUMMING), "big_sum_value": t == BIG_SUM_TREE, "count_value": t.isin(*COUNTING)}
    return x.select(*(F.when(use[c], F.coalesce(f"new_{c}", c)).alias(c) if c in AGG else F.col(c) for c in trees.columns))


def verify_aggregates(nodes: DataFrame) -> DataFrame:
    """Trees whose stored aggregates are not those of what they hold, with how many elements they hold; a tree that holds nothing sums to 0."""
    trees = nodes.where(F.col("element_type").isin(*SUMMING, BIG_SUM_TREE, *COUNTING))
    agg = tree_aggregates(nodes, trees).withColumnsRenamed({c: f"now_{c}" for c in AGG})
    x = trees.withColumn("at", F.concat("path", F.array("key"))).join(agg, F.col("at") == F.col("tree_path"))
    same = F.lit(True)
    for c in AGG:
        same = same & F.coalesce(F.col(c), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"now_{c}"), F.lit(0)))
    return x.where(~same).select("path", "key", "element_type", *AGG, *(f"now_{c}" for c in AGG), "n_elements")


def budgeted(rows: DataFrame, group: list[str], order: list[Column], value: str, limit: int, item_limit: int | None = None, cap: int = HARD_CAP) -> DataFrame:
    """Per group, in order, the rows read until their running sum reaches ``limit``.

    Values may be negative, so a row is read while the largest sum of an
    earlier prefix, not the last, is below the limit. At most ``cap`` rows of a group are looked at (a row number below a bound,
    which Spark cuts before the shuffle), so no window holds more. Adds
    running_sum and hard_limit_reached (a row past the cap was there, and
    nothing had stopped the reading).
    """
    if limit > 2**63 - 1:
        raise Overflow("the sum limit has 63 bits")
    by = W.partitionBy(*group).orderBy(*order)
    if limit <= 0 or item_limit == 0:
        return rows.limit(0).withColumn("running_sum", F.lit(0).cast("bigint")).withColumn("hard_limit_reached", F.lit(False))
    x = rows.withColumn("n__", F.row_number().over(by)).where(F.col("n__") <= cap + 1)
    x = x.withColumn("pre__", F.coalesce(F.sum(value).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("top__", F.max("pre__").over(by.rowsBetween(W.unboundedPreceding, 0)))
    x = x.where(F.col("top__") < limit)
    if item_limit is not None:
        x = x.where(F.col("n__") <= item_limit)
    x = x.withColumn("hard_limit_reached", F.max("n__").over(W.partitionBy(*group)) > cap).where(F.col("n__") <= cap)
    return x.withColumn("running_sum", F.col("pre__") + F.col(value)).drop("n__", "pre__", "top__")


def query_aggregate_sums(nodes: DataFrame, q: AggregateSumQuery, error_if_other: bool = True, ignore_references: bool = False) -> DataFrame:
    """Keys and values of one tree in order until their sum reaches the budget.

    References are followed up to BUDGET_HOPS times. Elements without a sum
    are errors, or skipped if ``error_if_other`` is off; skipped ones count to
    the hard cap only. At most HARD_CAP + 1 elements are read, by the sort's
    own limit, so the windows after it are small.
    """
    if q.sum_limit > 2**63 - 1:
        raise Overflow("the sum limit has 63 bits")
    key = F.col("key").asc() if q.left_to_right else F.col("key").desc()
    n = len(q.items)
    item = F.coalesce(*(F.when(i.matches(F.col("key")), F.lit(k if q.left_to_right else n - 1 - k)) for k, i in enumerate(q.items)))
    rows = in_tree(nodes, q.path).where(any_of(i.matches(F.col("key")) for i in q.items)).withColumn("item__", item)
    first = rows.orderBy("item__", key).limit(HARD_CAP + 1)
    first = written(first.select("item__", "path", "key", *ELEMENT_COLUMNS), "budget")
    seen = follow(first, nodes, BUDGET_HOPS)
    fit = F.col("element_type").isin(SUM_ITEM, ITEM_WITH_SUM) & (F.col("ref_state") == 0)
    if ignore_references:
        fit = fit & (F.col("hops") == 0)
    order = W.orderBy("item__", key)
    x = seen.withColumn("place", F.row_number().over(order)).withColumn("value", F.when(fit, F.coalesce("sum_value", F.lit(0))))
    pre = F.coalesce(F.sum("value").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.coalesce(F.count("value").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("pre", pre).withColumn("taken", taken).withColumn("top", F.max("pre").over(order.rowsBetween(W.unboundedPreceding, 0)))
    keep = (F.col("top") < q.sum_limit) & F.lit(q.sum_limit > 0)
    if q.item_limit is not None:
        keep = keep & (F.col("taken") < q.item_limit)
    x = written(x.where(keep), "budget")
    if error_if_other:
        odd = x.where(F.col("value").isNull() & (F.col("place") <= HARD_CAP)).select("key").first()
        if odd:
            raise WrongElementType(f"only sum items are expected, {bytes(odd['key'])} is none")
    hit = x.where(F.col("place") > HARD_CAP).select(F.lit(True).alias("h"))
    reached = not hit.isEmpty()
    return x.where((F.col("place") <= HARD_CAP) & F.col("value").isNotNull()).orderBy("place").select("key", "value", (F.col("pre") + F.col("value")).alias("running_sum"), F.lit(reached).alias("hard_limit_reached"))
