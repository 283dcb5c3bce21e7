"""Path queries as DataFrame plans.

A query is a tree of levels. All queries of a level, one for each branch that
leads to it, are run together: the trees entered so far, each with the number
of the query that it is entered for, are joined once with the nodes that any of
these queries asks for. Each level adds its place in the result order as
columns (item, key upwards or key downwards), so the result needs one sort and
no window over a tree, however large. A limit over several levels has rules of
its own about trees; only as many places as it may cost come to the driver,
the first of the order, and of them no values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import InvalidQuery, PathParentLayerNotFound, WrongElementType
from ..model import ELEMENT_COLUMNS, LOG_TREES, TREE, any_of, is_tree, path_literal, tree_id
from ..operators.references import resolve
from .query import Branch, PathQuery, Query

RESULT = ["path", "key", *ELEMENT_COLUMNS]
MAX_TREES_NAMED, MAX_SPANS_NAMED = 500, 20  # as many as a filter on a scan may name


@dataclass
class Options:
    allow_get_raw: bool = True
    decrease_limit_on_empty: bool = True
    error_if_path_missing: bool = True


ROW, ENTERED, LOOKED_UP = range(3)  # events of a traversal: a row, a tree entered for a subquery, a key looked up below a tree


@dataclass
class _Plan:
    nodes: DataFrame
    options: Options
    depth: int
    events: list[DataFrame] = field(default_factory=list)
    checks: list[DataFrame] = field(default_factory=list)  # what must not be there

    def order_names(self, upto: int | None = None) -> list[str]:
        return [f"{c}{d}" for d in range(self.depth if upto is None else upto) for c in ("item__", "up__", "down__")]

    def add(self, df: DataFrame, level: int, kind: int) -> None:
        """Events of a kind; there__ says whether a key looked up is there."""
        names, have = self.order_names(), self.order_names(level)
        types = {"item__": "int", "up__": "binary", "down__": "binary"}
        empty = [F.lit(None).cast(types[n.rstrip("0123456789")]).alias(n) for n in names if n not in have]
        there = F.col("there__") if kind == LOOKED_UP else F.lit(kind == ROW)
        # The tree that is entered, or below which a key is looked up.
        tree = F.col("tree__") if kind == LOOKED_UP else F.concat("path", F.array("key")) if kind == ENTERED else F.lit(None).cast("array<binary>")
        self.events.append(df.select(*have, *empty, F.lit(level).alias("level__"), F.lit(kind).alias("kind__"), there.alias("there__"), tree.alias("tree__"), *RESULT))

    def refuse(self, df: DataFrame) -> None:
        self.checks.append(df.select(F.lit("you must provide a subquery or a subquery path for trees").alias("error"), "path", "key"))


def _matching(q: Query) -> Column:
    return any_of(i.matches(F.col("key")) for i in q.items)


def _by(column: str, values: list[Column]) -> Column:
    """values[k] where the column is k."""
    if len(values) == 1:
        return values[0]
    out = values[-1]
    for k in reversed(range(len(values) - 1)):
        out = F.when(F.col(column) == k, values[k]).otherwise(out)
    return out


def _with_item(df: DataFrame, queries: list[Query], level: int) -> DataFrame:
    """Rows in one of the items of their query, with the item's place; a row in several items of a list that is not normalised comes once for each."""

    def places(q: Query) -> list[Column]:
        n = len(q.items)
        return [F.when(i.matches(F.col("key")), F.lit(k if q.left_to_right else n - 1 - k)) for k, i in enumerate(q.items)]

    df = df.where(_by("query__", [_matching(q) for q in queries]))
    if all(q.disjoint for q in queries):
        item = _by("query__", [F.coalesce(*places(q)) if q.items else F.lit(None) for q in queries])
        df = df.withColumn(f"item__{level}", item.cast("int"))
    else:
        hits = _by("query__", [F.array(*places(q)).cast("array<int>") for q in queries])
        df = df.withColumn(f"item__{level}", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    key, none = F.col("key"), F.lit(None).cast("binary")
    up = _by("query__", [key if q.left_to_right else none for q in queries])
    down = _by("query__", [none if q.left_to_right else key for q in queries])
    return df.withColumn(f"up__{level}", up).withColumn(f"down__{level}", down)


def _run(plan: _Plan, found: DataFrame, queries: list[Query]) -> None:
    """Adds the events of ``queries``, by query__ of found, level by level."""
    for level in range(plan.depth):
        found = _with_item(found, queries, level)
        names = plan.order_names(level + 1)
        # Every branch of every query of this level is numbered; a row's branch is the first of its query that matches.
        branches: list[Branch] = []
        numbers = []
        for q in queries:
            first = len(branches)
            branches += q.branches
            which = F.lit(first + len(q.conditional))
            for k in reversed(range(len(q.conditional))):
                which = F.when(q.conditional[k][0].matches(F.col("key")), first + k).otherwise(which)
            numbers.append(which)
        if any(b.path == () and b.query is None for b in branches):
            raise InvalidQuery("a subquery path has at least one key")
        found = found.withColumn("branch__", _by("query__", numbers).cast("int"))
        going = [k for k, b in enumerate(branches) if not b.empty]
        leaf = ~(is_tree() & F.col("branch__").isin(going)) if going else F.lit(True)
        plan.add(found.where(leaf), level + 1, ROW)
        if not plan.options.allow_get_raw:
            plan.refuse(found.where(leaf & is_tree()))
        if not going:
            return
        trees = found.where(is_tree())

        def below(some: list[int], trees: DataFrame = trees, names: list[str] = names, branches: list[Branch] = branches) -> DataFrame:
            """Trees of some branches, numbered anew, with the path that the branch walks to."""
            number = F.lit(None).cast("int")
            walked = F.lit(None).cast("array<binary>")
            for n, k in enumerate(some):
                b = branches[k]
                steps = list(b.path or ())
                number = F.when(F.col("branch__") == k, n).otherwise(number)
                walked = F.when(F.col("branch__") == k, F.concat("path", F.array("key"), path_literal(steps if b.query else steps[:-1]))).otherwise(walked)
            return trees.where(F.col("branch__").isin(some)).withColumn("in_path__", walked).withColumn("query__", number.cast("int"))

        looks = [k for k in going if branches[k].query is None]
        if looks:
            wanted = [path_literal(branches[k].path[-1:])[0] for k in looks]
            to = below(looks).select(*names, "in_path__", _by("query__", wanted).alias("in_key__"), F.concat("path", F.array("key")).alias("tree__"))
            n = plan.nodes.where(any_of(F.col("key") == w for w in wanted)).select("tree_id", *RESULT)
            t = to.withColumn("in_id__", tree_id(F.col("in_path__")))
            hit = t.join(n, (F.col("in_id__") == F.col("tree_id")) & (F.col("in_path__") == F.col("path")) & (F.col("in_key__") == F.col("key")), "left")
            plan.add(hit.withColumn("there__", F.col("element_type").isNotNull()), level + 1, LOOKED_UP)
        enters = [k for k in going if branches[k].query is not None]
        if not enters:
            return
        queries = [branches[k].query for k in enters]
        to = below(enters)
        plan.add(to, level + 1, ENTERED)
        strict = [n for n, k in enumerate(enters) if branches[k].path and any(i.is_key for i in branches[k].query.items)]
        if strict:
            plan.checks.append(_missing(plan.nodes, to.where(F.col("query__").isin(strict)).select(*names, "in_path__")))
        # The items of the next level reach its scan before the join.
        found = _in_trees(plan.nodes.where(any_of(_matching(q) for q in queries)), to.select(*names, "in_path__", "query__"))


def _in_trees(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Nodes in the trees named by in_path__, with the trees' other columns."""
    t = trees.withColumn("in_id__", tree_id(F.col("in_path__")))
    return nodes.join(t, (F.col("tree_id") == F.col("in_id__")) & (F.col("path") == F.col("in_path__")))


def _missing(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """Of the trees named by in_path__ those that are not there."""
    there = nodes.where(is_tree()).select(F.concat("path", F.array("key")).alias("tree_path__"))
    gone = trees.join(there, F.col("in_path__") == F.col("tree_path__"), "left_anti")
    return gone.select(F.lit("no such tree").alias("error"), F.slice("in_path__", 1, F.size("in_path__") - 1).alias("path"), F.element_at("in_path__", -1).alias("key"))


def tree_exists(nodes: DataFrame, path) -> bool:
    path = tuple(path)
    return not path or not nodes.where((F.col("path") == path_literal(path[:-1])) & (F.col("key") == path_literal(path[-1:])[0]) & is_tree()).isEmpty()


def in_tree(nodes: DataFrame, path) -> DataFrame:
    p = path_literal(tuple(path))
    return nodes.where((F.col("tree_id") == tree_id(p)) & (F.col("path") == p))


def near(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """nodes, or, where (path, key) of ``keys`` lie in few trees, those in the trees and, of very few, between the first and last key.

    The bounds reach the scan, whose files are sorted by tree and key: a small
    change then reads a small part of a store. Where the trees are many the
    join that follows decides alone. ``keys`` should be a written table.
    """
    spans = keys.groupBy(tree_id(F.col("path")).alias("id")).agg(F.min("key").alias("first"), F.max("key").alias("last")).limit(MAX_TREES_NAMED + 1).collect()
    if len(spans) > MAX_TREES_NAMED:
        return nodes
    if len(spans) > MAX_SPANS_NAMED:
        return nodes.where(F.col("tree_id").isin([r["id"] for r in spans]))
    return nodes.where(any_of((F.col("tree_id") == r["id"]) & F.col("key").between(F.lit(r["first"]), F.lit(r["last"])) for r in spans))


def _order(plan: _Plan) -> list[Column]:
    return [F.col(n).desc_nulls_first() if n.startswith("down__") else F.col(n).asc_nulls_first() for n in plan.order_names()]


def query_raw(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """Rows of the query in its order: path, key and element columns. References and trees without a branch come as they are."""
    rows, order = _placed(nodes, pq, options or Options())
    return rows.orderBy(*order).select(*RESULT)


def _placed(nodes: DataFrame, pq: PathQuery, options: Options) -> tuple[DataFrame, list[Column]]:
    """(rows of the query with columns that say where they stand, the order by these)"""
    q = pq.query
    if any(i.is_key for i in q.items) and options.error_if_path_missing and not tree_exists(nodes, pq.path):
        raise PathParentLayerNotFound(str(pq.path))
    plan = _Plan(nodes, options, q.max_depth())
    _run(plan, in_tree(nodes, pq.path).withColumn("query__", F.lit(0)), [q])
    if options.error_if_path_missing or not options.allow_get_raw:
        for c in plan.checks:
            bad = c.first()
            if bad:
                if bad["error"] == "no such tree":
                    if options.error_if_path_missing:
                        raise PathParentLayerNotFound(f"{bad['path']} / {bad['key']}")
                else:
                    raise InvalidQuery(bad["error"])
    events = reduce(DataFrame.unionByName, plan.events)
    order = _order(plan)
    rows = events.where("there__")
    if pq.limit == 0:
        # Range items stop at once; a key item, if it is the first, is read before the limit is looked at.
        first = (q.items if q.left_to_right else q.items[::-1])[:1]
        if first and first[0].is_key and not pq.offset and q.branch_for(first[0].start).empty:
            return rows.where(F.col("level__") == 1).where(first[0].matches(F.col("key"))), order
        return rows.limit(0), order
    if pq.limit is not None and q.descends:
        return _limited(plan, events, pq)
    if pq.offset:
        # An offset takes places, of rows and of keys looked up, there or not; without a limit trees cost none.
        rows = events.where(F.col("kind__") != ENTERED).orderBy(*order).offset(pq.offset).where("there__")
    return (rows if pq.limit is None else rows.orderBy(*order).limit(pq.limit)), order


def _after(names: list[str], place: tuple) -> Column:
    """Whether a row comes after all rows that begin with ``place``, in the order of the plan."""
    out = F.lit(False)
    for name, v in reversed(list(zip(names, place, strict=False))):
        c = F.col(name)
        value = F.lit(bytearray(v) if isinstance(v, bytes | bytearray) else v)
        later = c.isNotNull() if v is None else (c < value if name.startswith("down__") else c > value)
        same = c.isNull() if v is None else c == value
        out = F.coalesce(later, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out


def _at_once(pq: PathQuery) -> int:
    return max(1024, 2 * (pq.limit + (pq.offset or 0)))


def _walked(plan: _Plan, events: DataFrame, pq: PathQuery, visit: Callable[[Row], None] | None = None) -> Walk:
    """The walk over the events of a limited query, to its end; visit is told those that count."""
    names = plan.order_names()
    at_once = _at_once(pq)
    places = events.select(*names, "level__", "kind__", "there__", "tree__", "path", "key")
    walk = Walk(pq, plan.options)
    after: tuple | None = None
    while not walk.done:
        part = places if after is None else places.where(_after(names, after))
        rows = part.orderBy(*_order(plan)).limit(at_once).collect()
        for r in rows:
            if walk.see(r["level__"], r["kind__"], r["there__"], r["path"], r["key"]) and visit:
                visit(r)
            if walk.done:
                break
        if len(rows) < at_once:
            break
        last = rows[-1]
        inside = walk.used_up()
        after = tuple(last[n] for n in names[: 3 * inside if inside else None])
    return walk


def seen(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> tuple[set[tuple[bytes, ...]], tuple[bytes, ...] | None]:
    """Of a query with a limit: (trees that it enters or looks below, place of the last thing it reads, or None if it runs to its end)."""
    options = options or Options(error_if_path_missing=False)
    plan = _Plan(nodes, options, pq.query.max_depth())
    _run(plan, in_tree(nodes, pq.path).withColumn("query__", F.lit(0)), [pq.query])
    trees: set[tuple[bytes, ...]] = set()
    last: list[tuple[bytes, ...]] = []

    def visit(r: Row) -> None:
        at = tuple(map(bytes, r["tree__"] if r["tree__"] is not None else [*r["path"], r["key"]]))
        if r["tree__"] is not None:
            trees.add(at)
        last[:] = [at]

    walk = _walked(plan, reduce(DataFrame.unionByName, plan.events), pq, visit)
    walk.back_to(1)
    return trees, last[0] if last and walk.done else None


def _limited(plan: _Plan, events: DataFrame, pq: PathQuery) -> tuple[DataFrame, list[Column]]:
    """The rows that a limit of at most 65,535 admits.

    The first places of the order, twice as many as limit and offset name, are
    taken at a time, without values; where trees that cost less than they hold
    use these up, the next ones are taken from there on, past any tree whose
    own copy of the limit is used up. Rows are joined by path and key.
    """
    walk = _walked(plan, events, pq)
    spark = plan.nodes.sparkSession
    chosen = spark.createDataFrame([(p, k, n) for n, (p, k) in enumerate(walk.out)], "p__ array<binary>, k__ binary, n__ int")
    chosen = chosen.withColumn("id__", tree_id(F.col("p__")))
    trees = {tuple(map(bytes, p)) for p, _ in walk.out}
    near = plan.nodes
    if 0 < len(trees) <= MAX_TREES_NAMED:  # few enough to be named to the scan
        near = near.where(F.col("tree_id").isin([r["id"] for r in chosen.select(F.col("id__").alias("id")).distinct().collect()]))
    found = near.join(chosen, (F.col("tree_id") == F.col("id__")) & (F.col("path") == F.col("p__")) & (F.col("key") == F.col("k__")))
    return found.select(*RESULT, "n__"), [F.col("n__").asc()]


class Walk:
    """Which rows the limit and offset of a query admit, told events in traversal order.

    Each tree entered has its own copy of the limit: back outside, the limit
    has dropped by the rows returned, or by one if there were none and the
    option says so. A key looked up costs a place of the offset or the limit,
    there or not.
    """

    def __init__(self, pq: PathQuery, options: Options):
        self.options = options
        self.left = [pq.limit]  # limit left, by level of nesting
        self.got = [0]
        self.offset = pq.offset or 0
        self.out: list[tuple] = []
        self.done = False

    def _spend(self, n: int) -> None:
        if self.left[-1] is not None:
            self.left[-1] = max(0, self.left[-1] - n)

    def used_up(self) -> int:
        """The level of nesting of the outermost tree whose copy of the limit is used up; 0 where there is none."""
        return next((k for k, x in enumerate(self.left) if k and x == 0), 0)

    def back_to(self, level: int) -> bool:
        """Leaves the trees that lie deeper than ``level``; whether the limit still lets something in there."""
        while len(self.left) > level:
            self.left.pop()
            n = self.got.pop()
            self._spend(n or int(self.options.decrease_limit_on_empty))
            self.got[-1] += n
        if self.left[0] == 0:
            self.done = True
        return all(x != 0 for x in self.left)

    def see(self, level: int, kind: int, there: bool, path, key) -> bool:
        """Takes an event; whether it counts, or lies past a limit."""
        if not self.back_to(level):
            return False
        if kind == ENTERED:
            self.left.append(self.left[-1])
            self.got.append(0)
        elif self.offset:
            self.offset -= 1
        else:
            if there:
                self.out.append((path, key))
                self.got[-1] += 1
            self._spend(1)
        return True


def resolved(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """query_raw with references followed, in the query's order: path and key of the query, the element found, and hops."""
    rows, order = _placed(nodes, pq, options or Options())
    return resolve(rows, nodes).orderBy(*order).select(*RESULT, "hops")


def query(nodes: DataFrame, pq: PathQuery, options: Options | None = None) -> DataFrame:
    """query_raw with references resolved; plain and log trees in the result are errors, aggregate trees pass."""
    out = resolved(nodes, pq, options)
    bad = out.where(F.col("element_type").isin(TREE, *LOG_TREES)).select("path", "key").first()
    if bad:
        raise WrongElementType(f"path queries can only refer to items and references: {bad}")
    return out.select(*RESULT)
