"""More of the engine's operators over the driver's tables: values and shapes of results, algebra of items, proofs, logs, sync, flags and costs."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import errors
from . import model as m
from .functions import costs, flags, paths, serde
from .functions.scalar import hex_to_ascii, is_any_item, type_name
from .model import element, key_of, nodes, number_of
from .operators import aggregates, integrity, log_proofs, logs, read, references, writes
from .plans.compile import Options, query, query_raw
from .plans.query import AggregateSumQuery, PathQuery, Query, QueryItem, intersect_many, normalised, span
from .queries import BY, GEO, GEO_SQL, LOG, OLD_SQL, ORDER_SQL, ORDERS, PAIR_SQL, POS_SQL, _ops, _pair, _state, _state_sql, by_customer, case, cents, chain_forest, event_log, geography, hashed, k8, kept, num, orders_forest, path, roots, table
from .sources import sync
from .sources.store import Store, shared_dir, written

# Values and optional keys


def mixed(spark, sf) -> DataFrame:
    """[mixed] / orderkey: an item, a sum item, an item with a sum or a reference to the order before, by the key's remainder by 4."""
    o = table(spark, sf, "orders")
    k, r = F.col("o_orderkey"), F.col("o_orderkey") % 4
    kind = F.when(r == 0, m.ITEM).when(r == 1, m.SUM_ITEM).when(r == 2, m.ITEM_WITH_SUM).otherwise(m.REFERENCE)
    to = F.struct(F.lit(m.ABSOLUTE).cast("tinyint").alias("kind"), F.lit(0).cast("tinyint").alias("n"), path(b"mixed", key_of(k - 2)).alias("segs"))
    text = F.when(r.isin(0, 2), F.col("o_orderstatus").cast("binary"))
    out = nodes(o, path(b"mixed"), key_of(k), kind, item_value=text, sum_value=F.when(r.isin(1, 2), cents("o_totalprice")), ref=F.when(r == 3, to))
    return out.unionByName(roots(spark, (b"mixed", m.COUNT_SUM_TREE)))


MIXED_SQL = """SELECT o_orderkey AS k, o_orderkey % 4 AS r, CASE WHEN o_orderkey % 4 IN (0, 2) THEN o_orderstatus END AS item, CASE WHEN o_orderkey % 4 IN (1, 2) THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents,
    o_orderkey % 4 = 3 AS is_ref, o_orderkey - 2 AS target FROM orders"""


@case(f"SELECT a.k, CASE WHEN a.is_ref THEN b.cents ELSE a.cents END AS cents FROM ({MIXED_SQL}) a LEFT JOIN ({MIXED_SQL}) b ON a.is_ref AND b.k = a.target WHERE a.r IN (1, 3) AND a.k >= 100 AND (NOT a.is_ref OR b.k IS NOT NULL)")
def query_sums(spark, sf):
    """Sums of sum items, and of those that references lead to."""
    f = kept(mixed, spark, sf)
    rows = read.query_sums(f.where(F.col("element_type").isin(m.SUM_ITEM, m.REFERENCE) | (F.size("path") == 0)), PathQuery((b"mixed",), Query([span("range_from", k8(100))])))
    return num(rows, F.col("sum_value").alias("cents"))


@case(f"SELECT k, item FROM ({MIXED_SQL}) WHERE r IN (0, 2)")
def query_item_value(spark, sf):
    """The bytes of items."""
    f = kept(mixed, spark, sf).where(F.col("element_type").isin(m.ITEM, m.ITEM_WITH_SUM) | (F.size("path") == 0))
    return num(read.query_item_value(f, PathQuery((b"mixed",), Query.all())), F.col("value").cast("string").alias("item"))


@case(f"SELECT k, CASE r WHEN 0 THEN 'item' WHEN 1 THEN 'sum' ELSE 'item and sum' END AS kind, item, cents FROM ({MIXED_SQL}) WHERE r < 3")
def query_item_value_or_sum(spark, sf):
    f = kept(mixed, spark, sf).where(F.col("element_type") != m.REFERENCE)
    rows = read.query_item_value_or_sum(f, PathQuery((b"mixed",), Query.all()))
    return num(rows, "kind", F.col("item_value").cast("string").alias("item"), F.col("sum_value").alias("cents"))


@case(f"SELECT w.k, o.cents FROM (SELECT i * 7 AS k FROM range(0, 40) t(i)) w LEFT JOIN ({ORDER_SQL}) o USING (k)")
def query_keys_optional(spark, sf):
    """Forty keys asked for by name, some of them not there, references followed."""
    pq = PathQuery((ORDERS,), Query(normalised(QueryItem.key(k8(7 * i)) for i in range(40))), 40)
    return num(read.query_keys_optional(kept(orders_forest, spark, sf), pq), F.col("sum_value").alias("cents"))


@case(f"SELECT k, coalesce(cents, 0) AS cents, CAST(1 AS BIGINT) AS n FROM ({MIXED_SQL})")
def or_default(spark, sf):
    """What each element counts for in a tree that sums and counts."""
    rows = read.or_default(kept(mixed, spark, sf).where("size(path) = 1"))
    return num(rows, F.col("sum_or_default").alias("cents"), F.col("count_or_default").alias("n"))


@case(f"SELECT k, target FROM ({MIXED_SQL}) WHERE is_ref")
def ref_absolute_form(spark, sf):
    rows = references.absolute(kept(mixed, spark, sf)).where(F.col("element_type") == m.REFERENCE)
    return num(rows, number_of(F.element_at(F.col("ref")["segs"], -1)).alias("target"))


@case("SELECT o_orderkey AS k, upper('00' || lpad(to_hex(strlen(o_orderstatus)), 2, '0') || hex(o_orderstatus) || '00') AS bytes FROM orders WHERE o_orderkey % 4 = 0")
def element_encoding(spark, sf):
    """Items as the engine writes them: a kind, a length, the bytes, and no flags."""
    f = kept(mixed, spark, sf).where((F.col("element_type") == m.ITEM) | (F.size("path") == 0))
    return num(read.query_encoded_many(f, [PathQuery((b"mixed",), Query.all())]), F.hex("element").alias("bytes"))


@case(f"SELECT k, CASE r WHEN 0 THEN 'item' WHEN 1 THEN 'sum item' WHEN 2 THEN 'item with sum item' ELSE 'reference' END AS kind, r < 3 AS any_item, false AS any_tree FROM ({MIXED_SQL})")
def element_kinds(spark, sf):
    t = F.col("element_type")
    return num(kept(mixed, spark, sf).where("size(path) = 1"), type_name(t).alias("kind"), is_any_item(t).alias("any_item"), m.is_tree().alias("any_tree"))


# Algebra of items and merging of queries

_OURS = [(10, 60), (100, 300), (500, 900)]
_THEIRS = [(40, 120), (250, 600)]
_IN = lambda spans: "(" + " OR ".join(f"(o_orderkey >= {a} AND o_orderkey < {b})" for a, b in spans) + ")"


def _spans(pairs) -> list[QueryItem]:
    return [span("range", k8(a), k8(b)) for a, b in pairs]


def _items_case(name: str, which: int, where: str):
    def f(spark, sf):
        items = intersect_many(_spans(_OURS), _spans(_THEIRS))[which]
        return num(query_raw(kept(orders_forest, spark, sf), PathQuery((ORDERS,), Query(items))), F.col("sum_value").alias("cents"))

    f.__name__ = name
    case(f"{ORDER_SQL} WHERE {where}")(f)


_items_case("q_items_both", 0, f"{_IN(_OURS)} AND {_IN(_THEIRS)}")
_items_case("q_items_only_ours", 1, f"{_IN(_OURS)} AND NOT {_IN(_THEIRS)}")
_items_case("q_items_only_theirs", 2, f"{_IN(_THEIRS)} AND NOT {_IN(_OURS)}")


@case(f"SELECT o_orderkey AS k, {_IN(_OURS)} AS hit FROM orders")
def q_contains(spark, sf):
    """Each key held against the items."""
    o = table(spark, sf, "orders").select(key_of(F.col("o_orderkey")).alias("key"))
    return num(o, m.any_of(i.matches(F.col("key")) for i in normalised([*_spans(_OURS), span("range", k8(20), k8(30))])).alias("hit"))


@case(PAIR_SQL + " WHERE (c_custkey BETWEEN 3 AND 30 AND o_orderkey < 4000) OR (c_custkey BETWEEN 20 AND 60 AND o_orderkey >= 9000) OR (c_custkey = 100)")
def q_merge_branches(spark, sf):
    """Queries whose trees overlap: where both hold, a tree is asked for what either asks for."""
    parts = [
        PathQuery((BY,), Query([span("range_inclusive", k8(3), k8(30))]).subquery(Query([span("range_to", end=k8(4000))]))),
        PathQuery((BY,), Query([span("range_inclusive", k8(20), k8(60))]).subquery(Query([span("range_from", k8(9000))]))),
        PathQuery((BY, k8(100)), Query.all()),
    ]
    return _pair(query_raw(kept(by_customer, spark, sf), PathQuery.merge(parts)))


@case(PAIR_SQL + " WHERE o_custkey < 40 ORDER BY c DESC, k LIMIT 20 OFFSET 5")
def q_subquery_desc_page(spark, sf):
    """Trees downwards, what is in them upwards; customers without orders cost a place each, so only those with some are asked."""
    o = table(spark, sf, "orders").where("o_custkey < 40").select("o_custkey").distinct().orderBy("o_custkey").collect()
    q = Query(normalised(QueryItem.key(k8(r[0])) for r in o), left_to_right=False).subquery(Query.all())
    rows = query_raw(kept(by_customer, spark, sf), PathQuery((BY,), q, None, 5), Options(error_if_path_missing=False))
    return _pair(rows.limit(20))


# Shapes of results


def _all_pairs(spark, sf) -> DataFrame:
    return query_raw(kept(by_customer, spark, sf), PathQuery((BY,), Query.all().subquery(Query.all())))


@case(PAIR_SQL)
def shape_keys(spark, sf):
    return _pair(read.map_elements(_all_pairs(spark, sf), sum_value=F.col("sum_value")))


@case("SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey")
def shape_by_key(spark, sf):
    x = read.by_key(_all_pairs(spark, sf))
    return num(x, F.col("element")["sum_value"].alias("cents"))


@case(f"SELECT c, count(*) AS n, min(k) AS first_key FROM ({PAIR_SQL}) GROUP BY c")
def shape_by_path(spark, sf):
    x = read.elements_by_path(_all_pairs(spark, sf))
    return x.select(number_of(F.get("path", F.lit(1))).alias("c"), "n", number_of(F.col("elements")[0]["key"]).alias("first_key"))


@case(f"SELECT c, count(*) AS n FROM ({PAIR_SQL}) GROUP BY c")
def shape_by_last_segment(spark, sf):
    x = read.elements_by_last_segment(_all_pairs(spark, sf))
    return x.select(number_of(F.col("segment")).alias("c"), F.size("elements").cast("bigint").alias("n"))


@case(f"SELECT r, count(*) AS n FROM ({GEO_SQL}) GROUP BY r")
def shape_by_segment_before_last(spark, sf):
    rows = query_raw(kept(geography, spark, sf), PathQuery((GEO,), Query.all().subquery(Query.all().subquery(Query.all()))))
    x = read.keys_by_last_segment(rows, -2)
    return x.select(number_of(F.col("segment")).alias("r"), F.size("keys").cast("bigint").alias("n"))


@case(f"SELECT r, n, count(*) AS size FROM ({GEO_SQL}) GROUP BY r, n")
def shape_counts_below(spark, sf):
    rows = query_raw(kept(geography, spark, sf), PathQuery((GEO,), Query.all().subquery(Query.all().subquery(Query.all()))))
    x = read.counts_below(rows, 3)
    return x.select(number_of(F.get("path", F.lit(1))).alias("r"), number_of(F.get("path", F.lit(2))).alias("n"), F.col("n").alias("size"))


@case(f"SELECT r, n, k, cents FROM ({GEO_SQL}) WHERE r = 1")
def shape_levels(spark, sf):
    """A result as a tree of levels, told out again."""
    rows = query_raw(kept(geography, spark, sf), PathQuery((GEO, k8(1)), Query.all().subquery(Query.all())))
    deep = read.level_results(rows)
    out = [(int.from_bytes(r, "big"), int.from_bytes(n, "big"), int.from_bytes(k, "big"), e["sum_value"]) for r, ns in deep.get(GEO, {}).items() for n, ks in ns.items() for k, e in ks.items()]
    return spark.createDataFrame(out, "r bigint, n bigint, k bigint, cents bigint")


@case("SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n, CAST(2 AS INTEGER) AS above, false AS is_root FROM nation")
def path_algebra(spark, sf):
    """Of each nation's tree: the region its parent path ends with, its own key, how many paths are above."""
    x = kept(geography, spark, sf).where(m.is_tree() & (F.size("path") == 2)).select(paths.child(F.col("path"), F.col("key")).alias("p"))
    p = F.col("p")
    return x.where(paths.is_below(p, m.path_literal((GEO,)))).select(number_of(paths.last(paths.parent(p))).alias("r"), number_of(paths.last(p)).alias("n"), (F.size(paths.ancestors(p)) - 1).cast("int").alias("above"), paths.is_root(p).alias("is_root"))


@case("SELECT event_id AS k, CASE WHEN regexp_full_match(event_type, '[A-Za-z0-9_/.\\[\\]-]*') THEN event_type ELSE '0x' || lower(hex(event_type)) END AS said FROM events")
def readable_bytes(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), hex_to_ascii(F.col("event_type").cast("binary")).alias("said"))


# Sums under a budget


@case(f"""WITH e AS (SELECT * FROM ({MIXED_SQL})), a AS (SELECT k, CASE WHEN r IN (1, 2) THEN cents END AS v, row_number() OVER (ORDER BY k) AS i, coalesce(sum(CASE WHEN r IN (1, 2) THEN cents END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM e)
SELECT k, CAST(v AS BIGINT) AS v, CAST(pre + v AS BIGINT) AS running FROM a WHERE pre < 700000000 AND i <= 1024 AND v IS NOT NULL""")
def agg_sum_skipping(spark, sf):
    """Elements without a sum and references are passed over."""
    q = AggregateSumQuery((b"mixed",), [span("range_full")], 700_000_000)
    rows = aggregates.query_aggregate_sums(kept(mixed, spark, sf).where((F.col("element_type") != m.REFERENCE) | (F.size("path") == 0)).unionByName(kept(mixed, spark, sf).where((F.col("element_type") == m.REFERENCE) & (F.size("path") > 0)).withColumn("element_type", F.lit(m.ITEM).cast("tinyint"))), q, error_if_other=False)
    return num(rows, F.col("value").alias("v"), F.col("running_sum").alias("running"))


@case(f"""WITH e AS ({ORDER_SQL} WHERE o_orderkey < 200 OR o_orderkey BETWEEN 300 AND 400), a AS (SELECT k, cents, row_number() OVER (ORDER BY k DESC) AS i, coalesce(sum(cents) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM e)
SELECT k, cents AS v, CAST(pre + cents AS BIGINT) AS running FROM a WHERE pre < 900000000 AND i <= 60""")
def agg_sum_merged(spark, sf):
    """Two queries as one: their items, their budgets together."""
    parts = [AggregateSumQuery((ORDERS,), [span("range_to", end=k8(200))], 400_000_000, 20, False), AggregateSumQuery((ORDERS,), [span("range_inclusive", k8(300), k8(400))], 500_000_000, 40, False)]
    rows = aggregates.query_aggregate_sums(kept(orders_forest, spark, sf), AggregateSumQuery.merge(parts))
    return num(rows, F.col("value").alias("v"), F.col("running_sum").alias("running"))


# Batches


def _keys_of(df: DataFrame) -> DataFrame:
    return df.select(path(BY, key_of(F.col("o_custkey"))).alias("path"), key_of(F.col("o_orderkey")).alias("key"))


def _delete_ops(df: DataFrame) -> DataFrame:
    x = _keys_of(df).select("path", "key", *(F.lit(None).cast(t).alias(c) for c, t in m.ELEMENT))
    return _ops(x, writes.DELETE, F.lit(0))


@case(_state_sql(OLD_SQL + " WHERE o_orderstatus NOT IN ('P', 'F')"))
def batch_partial(spark, sf):
    """A batch, and what it makes the caller add: first the pending orders go, then the finished ones."""
    o = table(spark, sf, "orders")
    return _state(writes.apply_partial_batch(kept(by_customer, spark, sf), _delete_ops(o.where("o_orderstatus = 'P'")), lambda middle: _delete_ops(o.where("o_orderstatus = 'F'"))))


@case(_state_sql(f"{OLD_SQL} UNION ALL SELECT o_custkey, o_orderkey + 10000000, 1 FROM orders WHERE o_orderkey % 2 = 1"))
def batch_if_not_exists(spark, sf):
    """Inserts of which half are for keys that are there: these are skipped."""
    o = table(spark, sf, "orders")
    k = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 10_000_000)
    new = nodes(o, path(BY, key_of(F.col("o_custkey"))), key_of(k), m.SUM_ITEM, sum_value=F.lit(1))
    return _state(writes.apply_batch(kept(by_customer, spark, sf), _ops(new, writes.INSERT_IF_NOT_EXISTS, F.lit(0)), writes.BatchOptions(error_if_exists=False)))


def _tree_ops(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return _ops(nodes(c, path(BY), key_of(F.col("c_custkey")), m.SUM_TREE), writes.DELETE_TREE, F.lit(0))


_REST = "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"


@case(_state_sql(f"{OLD_SQL} WHERE o_custkey IN ({_REST})", _REST))
def batch_delete_children(spark, sf):
    return _state(writes.apply_batch(kept(by_customer, spark, sf), _tree_ops(spark, sf), writes.BatchOptions(deleting_trees=writes.CHECK_DELETE_CHILDREN)))


@case(_state_sql(OLD_SQL, "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders)"))
def batch_skip_full_trees(spark, sf):
    """Of the trees to delete those that hold something stay."""
    return _state(writes.apply_batch(kept(by_customer, spark, sf), _tree_ops(spark, sf), writes.BatchOptions(deleting_trees=writes.CHECK_SKIP)))


@case(_state_sql(OLD_SQL + " WHERE o_orderstatus <> 'P'"))
def delete_as_ops(spark, sf):
    """Deletes planned as ops, then applied."""
    f = kept(by_customer, spark, sf)
    return _state(writes.apply_batch(f, writes.delete_ops(f, _keys_of(table(spark, sf, "orders").where("o_orderstatus = 'P'")))))


@case("SELECT o_custkey AS c, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderkey % 3 = 0")
def existing_elements(spark, sf):
    """What is already there where elements would be put."""
    o = table(spark, sf, "orders")
    k = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 10_000_000)
    return _pair(writes.existing(kept(by_customer, spark, sf), nodes(o, path(BY, key_of(F.col("o_custkey"))), key_of(k), m.SUM_ITEM)))


@case("SELECT o_orderkey AS k, CAST(1 AS INTEGER) AS base, CAST(2 + o_orderkey % 3 AS INTEGER) AS epoch, CAST(5 + o_orderkey % 50 AS BIGINT) AS bytes FROM orders")
def flags_grow(spark, sf):
    """Elements of epoch 1 that grow in a later one: their flags book the growth there."""
    o = table(spark, sf, "orders")
    old = m.binary(flags.serialize(1))
    new = F.concat(m.binary(b"\0\0"), F.unhex(F.lpad(F.hex(2 + F.col("o_orderkey") % 3), 2, "0")))
    x = o.select(F.col("o_orderkey").alias("k"), flags.update_flags(old, new, F.lit(100).cast("bigint"), (F.lit(105) + F.col("o_orderkey") % 50).cast("bigint")).alias("f"))

    @F.pandas_udf("base int, epoch int, bytes bigint")
    def told(f: pd.Series) -> pd.DataFrame:
        rows = [flags.deserialize(bytes(v)) for v in f]
        return pd.DataFrame([(b, *next(iter(e.items()))) for b, e, _ in rows], columns=["base", "epoch", "bytes"])

    return x.select("k", told("f").alias("t")).select("k", "t.*")


@case("SELECT o_orderkey AS k, 3 AS epoch, CAST(least(20, 10 + o_orderkey % 40) AS BIGINT) AS removed FROM orders UNION ALL SELECT o_orderkey, 1, CAST(10 + o_orderkey % 40 - 20 AS BIGINT) FROM orders WHERE 10 + o_orderkey % 40 > 20")
def flags_split(spark, sf):
    """Removed bytes dealt to epochs, newest first: the later epoch gives 20, the base what is left."""
    o = table(spark, sf, "orders").select(path(ORDERS).alias("path"), key_of(F.col("o_orderkey")).alias("key"), m.binary(flags.serialize(1, {3: 23})).alias("flags"), (10 + F.col("o_orderkey") % 40).cast("bigint").alias("bytes_left"))
    return num(flags.split_removal_bytes(o), "epoch", "removed")


@case("SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'delete' ELSE 'insert new' END AS what FROM orders")
def batch_byte_changes(spark, sf):
    """What each op of a batch does to the stored bytes."""
    f = kept(by_customer, spark, sf)
    o = table(spark, sf, "orders")
    new = nodes(o.where("o_orderkey % 2 = 1"), path(BY, key_of(F.col("o_custkey"))), key_of(F.col("o_orderkey") + 10_000_000), m.ITEM, item_value=F.col("o_orderstatus").cast("binary"))
    x = costs.batch_bytes(f, _ops(new, writes.INSERT_OR_REPLACE, F.lit(0)).unionByName(_delete_ops(o.where("o_orderkey % 2 = 0"))))
    k = number_of(F.col("key"))
    return x.select(number_of(F.get("path", F.lit(1))).alias("c"), F.when(k >= 10_000_000, k - 10_000_000).otherwise(k).alias("k"), F.col("transition").alias("what"))


@case("SELECT doc_id AS k, CASE WHEN doc_id % 2 = 0 THEN 11 WHEN doc_id % 3 = 0 THEN 20 END AS bytes FROM documents")
def cost_specialised(spark, sf):
    """Bytes that sums and counts count for whatever their numbers."""
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 2 == 0, m.SUM_ITEM).when(F.col("doc_id") % 3 == 0, m.COUNT_SUM_TREE).otherwise(m.ITEM)
    return d.select(F.col("doc_id").alias("k"), costs.specialised_value_bytes(t).alias("bytes"))


# Proofs: rows read from verified bytes


def _proved(spark, sf, build: Callable, pq: PathQuery, schema: str, row: Callable) -> DataFrame:
    hashes = hashed(build, spark, sf)
    data = integrity.get_proved_path_query(kept(build, spark, sf), pq, hashes)
    rows = integrity.verify_query(data, pq, integrity.root_hash_of(hashes))
    return spark.createDataFrame([row(*r) for r in rows], schema)


_n = lambda b: int.from_bytes(b, "big")
_PAIRS = "c bigint, k bigint, cents bigint"


@case(PAIR_SQL + " WHERE c_custkey >= 5 ORDER BY c, k LIMIT 40")
def prove_limited(spark, sf):
    """A limited query proved: only what it reads is shown. Customers with orders alone are asked, as others cost a place."""
    o = table(spark, sf, "orders").where("o_custkey >= 5").select("o_custkey").distinct().orderBy("o_custkey").limit(40).collect()
    q = Query(normalised(QueryItem.key(k8(r[0])) for r in o)).subquery(Query.all())
    return _proved(spark, sf, by_customer, PathQuery((BY,), q, 40), _PAIRS, lambda p, k, e: (_n(p[1]), _n(k), e["sum"]))


@case(f"SELECT k, cents FROM ({ORDER_SQL}) WHERE k < 50 OR k BETWEEN 5000 AND 5010")
def prove_many(spark, sf):
    """One proof for two queries, read by each of them."""
    f = kept(orders_forest, spark, sf)
    two = [PathQuery((ORDERS,), Query([span("range_to", end=k8(50))])), PathQuery((ORDERS,), Query([span("range_inclusive", k8(5000), k8(5010))]))]
    hashes = hashed(orders_forest, spark, sf)
    root = integrity.root_hash_of(hashes)
    proof = integrity.prove_query_many(f, two, hashes)
    rows = [(_n(k), e["sum"]) for q in two for _, k, e in integrity.verify_query(proof, q, root)]
    return spark.createDataFrame(rows, "k bigint, cents bigint")


@case(f"SELECT w.k, o.cents FROM (SELECT i * 11 AS k FROM range(0, 30) t(i)) w LEFT JOIN ({ORDER_SQL}) o USING (k)")
def prove_absence(spark, sf):
    """Thirty keys, each proved to be there or not to be."""
    f = kept(orders_forest, spark, sf)
    pq = PathQuery((ORDERS,), Query(normalised(QueryItem.key(k8(11 * i)) for i in range(30))))
    hashes = hashed(orders_forest, spark, sf)
    rows = integrity.verify_with_absence(integrity.prove_query(f, pq, hashes), pq, integrity.root_hash_of(hashes), 30)
    return spark.createDataFrame([(_n(k), e["sum"] if e else None) for _, k, e in rows], "k bigint, cents bigint")


@case(PAIR_SQL + " WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def prove_chained(spark, sf):
    """The first query finds a customer, the second, made from its row, the orders: both on one proof."""
    f = kept(by_customer, spark, sf)
    c = k8(table(spark, sf, "orders").agg(F.min("o_custkey")).first()[0])
    one, whole = PathQuery((BY,), Query.one(c)), PathQuery((BY,), Query.one(c).subquery(Query.all()))
    hashes = hashed(by_customer, spark, sf)
    rows = integrity.verify_chained(integrity.prove_query(f, whole, hashes), one, [lambda found: PathQuery((BY, found[0][1]), Query.all())], integrity.root_hash_of(hashes))
    return spark.createDataFrame([(_n(p[1]), _n(k), e["sum"]) for p, k, e in rows[1]], _PAIRS)


@case(f"SELECT c, k, cents FROM ({PAIR_SQL}) WHERE c BETWEEN 3 AND 9 UNION ALL SELECT c_custkey, -1, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey BETWEEN 3 AND 9 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_custkey")
def prove_with_parents(spark, sf):
    """Orders from a proof, each customer's tree before them."""
    inner = Query.all()
    inner.add_parent_tree = True
    full = [r[0] for r in table(spark, sf, "orders").where("o_custkey between 3 and 9").select("o_custkey").distinct().collect()]
    pq = PathQuery((BY,), Query(normalised(QueryItem.key(k8(c)) for c in full)).subquery(inner))
    if not full:
        return spark.createDataFrame([], _PAIRS)
    return _proved(spark, sf, by_customer, pq, _PAIRS, lambda p, k, e: (_n(p[1]), _n(k), e["sum"]) if len(p) == 2 else (_n(k), -1, e["sum"]))


@case("SELECT count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, (SELECT count(*) FROM orders WHERE o_orderkey < 30) AS shown FROM orders")
def prove_parent_info(spark, sf):
    """What the tree that was asked sums and counts to, from the proof."""
    f = kept(counted_orders, spark, sf)
    pq = PathQuery((ORDERS,), Query([span("range_to", end=k8(30))]))
    hashes = hashed(counted_orders, spark, sf)
    (_, total, n), rows = integrity.verify_query_get_parent_tree_info(integrity.get_proved_path_query(f, pq, hashes), pq, integrity.root_hash_of(hashes))
    return spark.createDataFrame([(n, total, len(rows))], "n bigint, cents bigint, shown bigint")


def counted_orders(spark, sf) -> DataFrame:
    return orders_forest(spark, sf).where("size(path) = 1").unionByName(roots(spark, (ORDERS, m.PROVABLE_COUNT_SUM_TREE)))


@case("SELECT 'roots' AS what, count(*) AS n FROM orders")
def provable_counts(spark, sf):
    """The count that the root hash of a tree of provable counts covers."""
    hashes = hashed(counted_orders, spark, sf)
    return hashes.roots.where(F.size("path") == 1).select(F.lit("roots").alias("what"), "n")


@case(f"SELECT k, cents FROM ({ORDER_SQL}) WHERE k IN (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 25)")
def trunk_and_branches(spark, sf):
    """The 25 first keys found by a trunk of five levels and the branches below it, each verified."""
    f = kept(orders_forest, spark, sf)
    first = [r[0] for r in table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(25).collect()]
    found = integrity.elements_by_chunks(f, (ORDERS,), [k8(k) for k in first], 5, 12, hashed(orders_forest, spark, sf))
    return spark.createDataFrame([(k, found[k8(k)]["sum"]) for k in first], "k bigint, cents bigint")


@case("SELECT CAST(2 AS INTEGER) AS depth, count(DISTINCT n_nationkey) AS n FROM nation UNION ALL SELECT 1, count(*) FROM region UNION ALL SELECT 0, 1")
def roots_checked(spark, sf):
    """Trees whose root changes where every customer's balance does: all that hold customers, and those above."""
    f = kept(geography, spark, sf)
    other = f.withColumn("sum_value", F.when(F.size("path") == 3, F.col("sum_value") + 1).otherwise(F.col("sum_value")))
    bad = integrity.verify_roots(other, integrity.tree_roots(f)).groupBy(F.size("path").alias("d")).agg(F.count("*").alias("n"))
    return bad.where("d > 0").select((F.col("d") - 1).cast("int").alias("depth"), "n")


# Logs


@case(f"SELECT i, CAST(1 + length(regexp_extract(bin(i), '1*$')) AS BIGINT) AS hashes, 2 * (i + 1) - bit_count(i + 1) AS size FROM ({POS_SQL})")
def mmr_push_costs(spark, sf):
    i = F.col("position")
    return event_log(spark, sf).select(i.alias("i"), logs.hash_count_for_push(i).cast("bigint").alias("hashes"), logs.mmr_size(i + 1).cast("bigint").alias("size"))


@case(f"SELECT i, v FROM ({POS_SQL}) WHERE i < 300 AND i % 7 = 0")
def mmr_proof_values(spark, sf):
    """Values of a range of 300 leaves read from a verified proof."""
    rows = event_log(spark, sf).where("position < 300").orderBy("position").collect()
    values = [bytes(r["value"]) for r in rows]
    r = logs.Mmr(values)
    at = range(0, len(values), 7)
    got = logs.verify_mmr(r.prove(list(at)), {i: values[i] for i in at}, r.root())
    return spark.createDataFrame([(i, _n(v)) for i, v in got.items()], "i bigint, v bigint")


@case(f"SELECT i, v FROM ({POS_SQL}) WHERE i BETWEEN 40 AND 299")
def bulk_proof_values(spark, sf):
    """Entries of a bulk tree of 300 read from a verified proof."""
    log = written(event_log(spark, sf).where("position < 300"), "log")
    values = [bytes(r["value"]) for r in log.orderBy("position").collect()]
    got = logs.bulk_verify(logs.bulk_prove(values, 4, 40, 300), logs.bulk_state_root(log, (LOG,), 4), 40, 300)
    return spark.createDataFrame([(i, _n(v)) for i, v in got.items()], "i bigint, v bigint")


@case(f"SELECT i, v FROM ({POS_SQL}) WHERE i BETWEEN 3 AND 17")
def dense_proof_values(spark, sf):
    """Values of a dense tree read from a verified proof."""
    log = written(event_log(spark, sf).where("position < 127"), "log")
    values = [bytes(r["value"]) for r in log.orderBy("position").collect()]
    items = [span("range_inclusive", (3).to_bytes(2, "big"), (17).to_bytes(2, "big"))]
    proof = logs.dense_prove(values, logs.positions_of(items, len(values), 2))
    got = logs.dense_verify_for_query(proof, logs.dense_tree_root(log, (LOG,), 7), items)
    return spark.createDataFrame([(i, _n(v)) for i, v in got.items()], "i bigint, v bigint")


@case(f"SELECT i // 32 AS chunk, i % 32 AS slot, v FROM ({POS_SQL}) WHERE i < (SELECT count(*) // 32 * 32 FROM events)")
def bulk_blob_roundtrip(spark, sf):
    """Chunks written as blobs and read back."""
    @F.pandas_udf("array<binary>")
    def through(values: pd.Series) -> pd.Series:
        return pd.Series([logs.deserialize_chunk(logs.serialize_chunk([bytes(v) for v in vs])) for vs in values])

    c = logs.bulk_chunks(event_log(spark, sf), (LOG,), 5).select(F.col("chunk").cast("bigint").alias("chunk"), F.posexplode(through("values")).alias("slot", "value"))
    return c.select("chunk", F.col("slot").cast("bigint").alias("slot"), number_of(F.col("value")).alias("v"))


def _log_forest(spark, sf, kind: int, **values) -> tuple[DataFrame, DataFrame]:
    log = written(event_log(spark, sf), "log")
    return m.frame(spark, [element([], LOG, kind, **values)]), log


def _log_case(name: str, kind: int, where: str, a: int, b: int, **values):
    def f(spark, sf):
        f_nodes, log = _log_forest(spark, sf, kind, **values)
        hashes = integrity.hash_forest(f_nodes, log)
        items = [span("range_inclusive", k8(a), k8(b))]
        proof = log_proofs.prove_log(f_nodes, log, (LOG,), items, hashes).to_bytes()
        got = log_proofs.verify_log(proof, (LOG,), items, integrity.root_hash_of(hashes))
        return spark.createDataFrame([(i, _n(v)) for i, v in got.items()], "i bigint, v bigint")

    f.__name__ = name
    case(f"SELECT i, v FROM ({POS_SQL}) WHERE {where}")(f)


# Entries of a log of all events, from the forest's root hash down.
_log_case("prove_mmr_entries", m.MMR_TREE, "i BETWEEN 100 AND 140", 100, 140, mmr_size=0)
_log_case("prove_bulk_entries", m.BULK_APPEND_TREE, "i BETWEEN 100 AND 180", 100, 180, chunk_power=5)
_log_case("prove_commitment_entries", m.COMMITMENT_TREE, "i BETWEEN 7 AND 90", 7, 90, chunk_power=4)


@case(f"SELECT i AS k, v FROM ({POS_SQL}) WHERE i < 3 OR i BETWEEN 100 AND 130")
def log_range_query(spark, sf):
    x = logs.of(event_log(spark, sf), (LOG,)).where(logs.query_positions([span("range_to", end=k8(3)), span("range_inclusive", k8(100), k8(130))], F.col("position"), 8))
    return x.select(F.col("position").alias("k"), number_of(F.col("value")).alias("v"))


@case("SELECT CAST(event_id % 5 AS BIGINT) AS log, count(*) AS n FROM events GROUP BY 1")
def log_counts(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 5).alias("log"), "event_id")
    log = e.select(m.tree_id(path(key_of(F.col("log"), 1))).alias("tree_id"), path(key_of(F.col("log"), 1)).alias("path"), F.col("event_id").alias("position"), key_of(F.col("event_id")).alias("value"))
    return logs.counts(log).select(number_of(F.get("path", F.lit(0))).alias("log"), "n")


# Stores and sync


@case(_state_sql(OLD_SQL + " WHERE o_orderstatus <> 'P'"))
def sync_state(spark, sf):
    """A store with all orders brought, by verified chunks, to the state of one without the pending ones."""
    f = kept(by_customer, spark, sf)
    ours = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")
    ours.write(f)
    new = written(writes.delete(f, _keys_of(table(spark, sf, "orders").where("o_orderstatus = 'P'"))), "new")
    sync.sync(ours, sync.Provider(new))
    return _state(ours.read())


@case("SELECT CAST(count(*) AS VARCHAR) AS v FROM orders")
def meta_value(spark, sf):
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")
    s.put_meta(b"orders", b"old")
    s.put_meta(b"orders", str(table(spark, sf, "orders").count()).encode())
    return spark.createDataFrame([(s.get_meta(b"orders").decode(),)], "v string")


@case(ORDER_SQL + " WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 2 = 0")
def tree_view(spark, sf):
    """One tree of a store: elements taken out, some of them put back with another value."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")
    s.write(kept(orders_forest, spark, sf))
    t = s.transaction()
    view = t.tree((ORDERS,))
    o = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(key_of(F.col("o_orderkey")).alias("key"), "o_orderkey")
    view.delete(o)
    view.put(nodes(o.where("o_orderkey % 2 = 0"), path(), F.col("key"), m.SUM_ITEM, sum_value=F.lit(1)))
    t.commit()
    return num(s.tree((ORDERS,)).read(), F.col("sum_value").alias("cents"))


# Errors, hashes, references and options


@case("SELECT w.k, CASE WHEN c_custkey IS NULL THEN 'PathNotFound' ELSE 'ok' END AS said FROM (VALUES (CAST(1 AS BIGINT)), (7), (99999999)) w(k) LEFT JOIN customer ON c_custkey = w.k")
def subtree_checks(spark, sf):
    """Whether there is a tree for each of three customers."""
    f = kept(by_customer, spark, sf)

    def said(k: int) -> str:
        try:
            read.check_subtree_exists(f, (BY, k8(k)))
        except errors.ForestError as e:
            return type(e).__name__
        return "ok"

    return spark.createDataFrame([(k, said(k)) for k in (1, 7, 99999999)], "k bigint, said string")


@case("SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)")
def root_key(spark, sf):
    """The key in the middle, which is the tree's root."""
    return spark.createDataFrame([(_n(integrity.root_key(kept(orders_forest, spark, sf), (ORDERS,))),)], "k bigint")


@case(f"SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM ({ORDER_SQL}) GROUP BY cents) GROUP BY size")
def value_hash_classes(spark, sf):
    """Value hashes are alike just where values are: how many are shared by how many elements."""
    f = kept(orders_forest, spark, sf)
    x = integrity.with_value_hash(f, hashed(orders_forest, spark, sf)).where("size(path) = 1")
    return x.groupBy("value_hash").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@case(ORDER_SQL)
def element_decoding(spark, sf):
    """Elements written as bytes and read back."""
    f = kept(orders_forest, spark, sf)
    x = read.query_encoded_many(f, [PathQuery((ORDERS,), Query.all())])

    @F.pandas_udf("bigint")
    def total(data: pd.Series) -> pd.Series:
        return pd.Series([serde.deserialize(bytes(v))["sum"] for v in data])

    return num(x, total("element").alias("cents"))


@case("SELECT o_orderkey AS k, CAST(4 AS INTEGER) AS state FROM orders")
def ref_hop_limit(spark, sf):
    """References that lead to references are too far for one hop."""
    f = kept(chain_forest, spark, sf)
    rows = references.follow(query_raw(f, PathQuery((b"alias",), Query.all())), f, 1)
    return num(rows.where("ref_state > 0"), F.col("ref_state").cast("int").alias("state"))


@case("SELECT o_orderkey AS k, CAST(o_orderkey % 1000 AS BIGINT) AS v FROM orders")
def batch_references(spark, sf):
    """A batch of elements and of references to them: the references see what the batch puts in. Read back through them."""
    f = kept(orders_forest, spark, sf)
    o = table(spark, sf, "orders")
    k = key_of(F.col("o_orderkey"))
    to = F.struct(F.lit(m.COUSIN).cast("tinyint").alias("kind"), F.lit(0).cast("tinyint").alias("n"), path(b"fresh").alias("segs"))
    trees = m.frame(spark, [element([], b"fresh", m.TREE), element([], b"links", m.TREE)])
    new = nodes(o, path(b"fresh"), k, m.SUM_ITEM, sum_value=F.col("o_orderkey") % 1000).unionByName(nodes(o, path(b"links"), k, m.REFERENCE, ref=to)).unionByName(trees)
    out = written(writes.apply_batch(f, _ops(new, writes.INSERT_OR_REPLACE, F.lit(0))), "out")
    return num(query(out, PathQuery((b"links",), Query.all())), F.col("sum_value").alias("v"))


@case(_state_sql("SELECT o_custkey AS c, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 1 THEN 5 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_custkey, o_orderkey + 10000000, 9 FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderkey % 3 = 2"))
def batch_kinds(spark, sf):
    """Replaces of what is there and inserts of what is not, held to their word."""
    o = table(spark, sf, "orders")
    at = path(BY, key_of(F.col("o_custkey")))
    old = nodes(o.where("o_orderkey % 3 = 1"), at, key_of(F.col("o_orderkey")), m.SUM_ITEM, sum_value=F.lit(5))
    new = nodes(o.where("o_orderkey % 3 = 2"), at, key_of(F.col("o_orderkey") + 10_000_000), m.SUM_ITEM, sum_value=F.lit(9))
    ops = _ops(old, F.when(F.crc32("key") % 2 == 0, writes.REPLACE).otherwise(writes.PATCH), F.lit(0)).unionByName(_ops(new, writes.INSERT_KNOWN, F.lit(1)))
    return _state(writes.apply_batch(kept(by_customer, spark, sf), ops, writes.BatchOptions(check_existence=True)))


@case("SELECT o_orderkey AS k, CAST(2 AS INTEGER) AS base, true AS fits FROM orders WHERE o_orderstatus = 'P'")
def delete_with_flags(spark, sf):
    """Deletes whose bytes go back to the epoch that the flags name."""
    f = kept(by_customer, spark, sf).withColumn("flags", F.when(F.size("path") == 2, m.binary(flags.serialize(2))))
    wanted = _keys_of(table(spark, sf, "orders").where("o_orderstatus = 'P'"))
    _, removed = writes.delete_with_removed_bytes(f, wanted, flags.split_removal_bytes)
    return num(removed, F.col("epoch").alias("base"), F.col("removed").between(1, 999).alias("fits"))


@case("SELECT c_custkey AS k, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents, count(o_orderkey) AS n, 'kept' AS flags FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def aggregates_rewritten(spark, sf):
    """Trees' rows with new aggregates and their own flags."""
    f = kept(by_customer, spark, sf, m.COUNT_SUM_TREE)
    trees = f.where(m.is_tree() & (F.size("path") == 1)).withColumns({"sum_value": F.lit(-1).cast("bigint"), "count_value": F.lit(None).cast("bigint"), "flags": m.binary(b"kept")})
    x = aggregates.with_aggregates(trees, aggregates.tree_aggregates(f, trees))
    return num(x, F.col("sum_value").alias("cents"), F.col("count_value").alias("n"), F.col("flags").cast("string").alias("flags"))


@case("""SELECT a.i, b.j, greatest(a.i * 10, b.j * 7) < least(a.i * 10 + 25, b.j * 7 + 9) AS meets, CASE WHEN greatest(a.i * 10, b.j * 7) < least(a.i * 10 + 25, b.j * 7 + 9) THEN greatest(a.i * 10, b.j * 7) END AS both_from,
CASE WHEN greatest(a.i * 10, b.j * 7) < least(a.i * 10 + 25, b.j * 7 + 9) THEN least(a.i * 10 + 25, b.j * 7 + 9) END AS both_to, least(a.i * 10, b.j * 7) AS all_from, greatest(a.i * 10 + 25, b.j * 7 + 9) AS all_to
FROM (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation) a, (SELECT CAST(n_nationkey AS BIGINT) AS j FROM nation) b""")
def item_grid(spark, sf):
    """Every two of two families of ranges: whether they meet, what both cover, and what spans them. As many of each as there are nations."""
    numbers = [r[0] for r in table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint")).collect()]
    out = []
    for i in numbers:
        for j in numbers:
            a, b = span("range", k8(10 * i), k8(10 * i + 25)), span("range", k8(7 * j), k8(7 * j + 9))
            both, whole = a.intersect(b).both, a.merge(b)
            out.append((i, j, a.collides_with(b), both and _n(both.lower_bound()[0]), both and _n(both.upper_bound()[0]), _n(whole.lower_bound()[0]), _n(whole.upper_bound()[0])))
    return spark.createDataFrame(out, "i bigint, j bigint, meets boolean, both_from bigint, both_to bigint, all_from bigint, all_to bigint")


@case("SELECT doc_id AS k, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(log2(n)) + 1 AS INTEGER) END AS levels, CAST(1 + greatest(n - 1, 0) // 64 AS INTEGER) AS blocks, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS length FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def cost_sizes(spark, sf):
    """Levels of a tree of so many elements, hash blocks and length bytes of so many bytes."""

    @F.pandas_udf("levels int, blocks int, length int")
    def sizes(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"levels": [costs.levels(int(v)) for v in n], "blocks": [costs.hash_blocks(int(v)) for v in n], "length": [costs.length_bytes(int(v)) for v in n]})

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), sizes(F.octet_length(F.coalesce("text", F.lit("")))).alias("s"))
    return d.select("k", "s.*")


@case("SELECT event_id AS i, CAST(64 + strlen(event_type) AS BIGINT) AS size FROM events WHERE strlen(event_type) = (SELECT min(strlen(event_type)) FROM events)")
def commitment_entries(spark, sf):
    """Notes of fixed parts as a log's values: those whose payload has the length asked for."""
    e = table(spark, sf, "events")
    n = e.agg(F.min(F.octet_length("event_type"))).first()[0]
    notes = e.where(F.octet_length("event_type") == n).select("event_id", F.lpad(key_of(F.col("event_id")), 32, m.binary(b"\0")).alias("cmx"), F.lpad(key_of(F.col("event_id")), 32, m.binary(b"\1")).alias("rho"), F.col("event_type").cast("binary").alias("payload"))
    return logs.commitment_rows(notes, n).select(F.col("event_id").alias("i"), F.octet_length("value").cast("bigint").alias("size"))


@case(PAIR_SQL + " WHERE o_custkey = 7")
def raw_options(spark, sf):
    """A tree that is not there is an error only where the options say so."""
    f = kept(by_customer, spark, sf)
    pq = PathQuery((BY,), Query(normalised([QueryItem.key(k8(7)), QueryItem.key(k8(1 << 41))])).subquery(Query.all()))
    return _pair(query_raw(f, pq, Options(error_if_path_missing=False)))


@case(f"SELECT c, k, cents FROM ({PAIR_SQL}) WHERE k % 2 = 0")
def batch_one_by_one(spark, sf):
    """Two batches, one after the other: what is left."""
    o = table(spark, sf, "orders")
    parts = [_delete_ops(o.where("o_orderkey % 4 = 1")), _delete_ops(o.where("o_orderkey % 4 = 3"))]
    return _pair(writes.apply_one_by_one(kept(by_customer, spark, sf), parts).where("size(path) = 2"))
