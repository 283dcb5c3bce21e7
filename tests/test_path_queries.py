import random

import pytest

from sylvan import errors, model as m
from sylvan.model import int_key
from sylvan.plans.compile import Options, query, query_raw
from sylvan.plans.query import FULL, KINDS, AggregateSumQuery, Branch, PathQuery, Query, QueryItem, intersect_many, key, normalised, span
from tests.interp import forest, run

LEAF = b"test_leaf"


def load(spark, rows):
    return m.frame(spark, rows).cache(), forest([(r[0], r[1], r[2]) for r in rows])


def got(df):
    return [(tuple(map(bytes, r.path)), bytes(r.key)) for r in df.collect()]


@pytest.fixture(scope="module")
def years(spark):
    """Fifteen trees, each with a subtree of fifty items."""
    rows = [m.element([], LEAF, m.TREE)]
    for i in range(1985, 2000):
        rows += [m.element([LEAF], int_key(i), m.TREE), m.element([LEAF, int_key(i)], b"\0", m.TREE)]
        rows += [m.element([LEAF, int_key(i), b"\0"], int_key(i) + int_key(j), m.ITEM, item=int_key(i) + int_key(j)) for j in range(100, 150)]
    return load(spark, rows)


def below(lo, hi, limit=None, offset=None, asc=(True, True)):
    return PathQuery((LEAF,), Query([span("range", int_key(lo), int_key(hi))], left_to_right=asc[0]).subquery(Query.all(asc[1]), [b"\0"]), limit, offset)


@pytest.mark.parametrize(
    "pq, n, first, last",
    [
        (below(1988, 1992), 200, (1988, 100), (1991, 149)),
        (below(1990, 1995), 250, (1990, 100), (1994, 149)),
        (below(1990, 1995, asc=(False, False)), 250, (1994, 149), (1990, 100)),
        (below(1990, 1995, limit=55), 55, (1990, 100), (1991, 104)),
        (below(1990, 1995, limit=60, offset=14), 60, (1990, 114), (1991, 123)),
        (below(1990, 1995, limit=60, offset=10, asc=(False, False)), 60, (1994, 139), (1993, 130)),
        (below(1990, 1995, limit=5, offset=5000), 0, None, None),
    ],
)
def test_subqueries_over_years(years, pq, n, first, last):
    nodes, trees = years
    rows = got(query_raw(nodes, pq))
    assert rows == run(trees, pq) and len(rows) == n
    if n:
        assert rows[0][1] == int_key(first[0]) + int_key(first[1]) and rows[-1][1] == int_key(last[0]) + int_key(last[1])


def random_forest(rng):
    rows, keys = [], [b"", b"\1", b"a", b"ab", b"b", b"\x80", b"\xff"]

    def grow(path, depth):
        for k in rng.sample(keys, rng.randrange(0, 6)):
            if depth < 3 and rng.random() < 0.6:
                rows.append(m.element(path, k, rng.choice([m.TREE, m.SUM_TREE])))
                grow([*path, k], depth + 1)
            else:
                rows.append(m.element(path, k, m.ITEM, item=b"v"))

    grow([], 0)
    return rows, keys


def random_query(rng, keys, depth=0):
    def item():
        kind = rng.choice(list(KINDS))
        a, b = sorted(rng.sample(keys, 2))
        lo, hi = KINDS[kind]
        return key(a) if kind == "key" else QueryItem(kind, None if lo is None else a, None if hi is None else b)

    items = [item() for _ in range(rng.randrange(1, 4))]
    q = Query(normalised(items) if rng.random() < 0.7 else items, left_to_right=rng.random() < 0.6)

    def branch():
        path = tuple(rng.sample(keys, rng.randrange(1, 3))) if rng.random() < 0.4 else None
        sub = random_query(rng, keys, depth + 1) if depth < 2 and rng.random() < 0.7 else None
        return path, sub

    if rng.random() < 0.6:
        p, s = branch()
        q.subquery(s, p)
    for _ in range(rng.choice([0, 0, 1, 2])):
        p, s = branch()
        q.when(item(), s, p)
    return q


@pytest.mark.parametrize("seed", range(4))
def test_random_queries_against_the_interpreter(spark, seed):
    rng = random.Random(seed)
    rows, keys = random_forest(rng)
    nodes, trees = load(spark, rows)
    options = Options(error_if_path_missing=False)
    for _ in range(5):
        path = tuple(rng.choice([p for p in trees] or [()]))
        pq = PathQuery(path, random_query(rng, keys), rng.choice([None, None, 1, 2, 5]), rng.choice([None, None, 1, 3]))
        assert got(query_raw(nodes, pq, options)) == run(trees, pq), pq


def test_limits_taken_a_few_places_at_a_time(spark, monkeypatch):
    from sylvan.plans import compile

    rng = random.Random(77)
    rows, keys = random_forest(rng)
    rows += [m.element([], b"many", m.TREE)] + [m.element([b"many"], int_key(i), m.TREE) for i in range(9)] + [m.element([b"many", int_key(8)], b"k", m.ITEM, item=b"")]
    nodes, trees = load(spark, rows)
    monkeypatch.setattr(compile, "_at_once", lambda pq: rng.randrange(1, 4))
    deep = Query.all().subquery(Query.all().subquery(Query.all()))
    for q in (deep, Query.all(False).subquery(deep)):
        for limit, offset in ((2, None), (4, 2)):
            for shrink in (True, False):
                pq = PathQuery((), q, limit, offset)
                assert got(query_raw(nodes, pq, Options(error_if_path_missing=False, decrease_limit_on_empty=shrink))) == run(trees, pq, shrink), pq


def test_references_keep_the_order(spark):
    rows = [m.element([], LEAF, m.TREE)] + [m.element([LEAF], int_key(i), m.ITEM, item=b"v") if i % 2 else m.element([LEAF], int_key(i), m.REFERENCE, ref=m.Reference(m.SIBLING, (int_key(1),))) for i in range(10)]
    nodes, _ = load(spark, rows)
    for asc in (True, False):
        assert [k for _, k in got(query(nodes, PathQuery((LEAF,), Query.all(asc))))] == [int_key(i) for i in (range(10) if asc else range(9, -1, -1))]


def test_missing_trees_and_limits(spark, years):
    nodes, _ = years
    with pytest.raises(errors.PathParentLayerNotFound):
        query_raw(nodes, PathQuery((b"nowhere",), Query.one(b"k")))
    assert got(query_raw(nodes, PathQuery((b"nowhere",), Query.all()))) == []
    with pytest.raises(errors.InvalidQuery):
        PathQuery((), Query.all(), limit=70_000)
    assert got(query_raw(nodes, PathQuery((LEAF,), Query.all(), limit=0))) == []
    assert got(query_raw(nodes, PathQuery((LEAF,), Query.one(int_key(1990)), limit=0))) == [((LEAF,), int_key(1990))]
    with pytest.raises(errors.WrongElementType):
        query(nodes, PathQuery((LEAF,), Query.all())).collect()


def test_items_cover_what_they_say():
    rng = random.Random(0)
    keys = [bytes(rng.randrange(4) for _ in range(rng.randrange(3))) for _ in range(40)]

    def item():
        kind = rng.choice(list(KINDS))
        a, b = rng.choice(keys), rng.choice(keys)
        lo, hi = KINDS[kind]
        return key(a) if kind == "key" else QueryItem(kind, None if lo is None else min(a, b), None if hi is None else max(a, b))

    cover = lambda items: {k for k in keys if any(i.contains(k) for i in items)}
    for _ in range(600):
        a, b = item(), item()
        x = a.intersect(b)
        assert cover([i for i in [x.both] if i]) == cover([a]) & cover([b])
        assert cover([i for i in (x.ours_left, x.ours_right) if i]) == cover([a]) - cover([b])
        assert cover([i for i in (x.theirs_left, x.theirs_right) if i]) == cover([b]) - cover([a])
        if cover([a]) and cover([b]):
            assert cover([a.merge(b)]) >= cover([a, b])
        items = [item() for _ in range(4)]
        flat = normalised([i for i in items if cover([i])])
        assert cover(flat) >= cover([i for i in items]) and all(not p.collides_with(q) for i, p in enumerate(flat) for q in flat[:i])
        ours, theirs = normalised(items[:2]), normalised(items[2:])
        both, left, right = intersect_many(ours, theirs)
        assert cover(both) == cover(ours) & cover(theirs) and cover(left) == cover(ours) - cover(theirs) and cover(right) == cover(theirs) - cover(ours)
    assert [QueryItem(k, b"a", b"b").number for k in KINDS] == list(range(10))
    assert span("range", b"", b"\2").keys() == [b"", b"\0", b"\1"] and span("range_inclusive", b"a", b"c").keys() == [b"a", b"b", b"c"]
    with pytest.raises(errors.InvalidInput):
        FULL.keys()


def test_merge_covers_every_query(spark):
    rows = [m.element([], a, m.TREE) for a in (b"A", b"B")] + [m.element([a], x, m.TREE) for a in (b"A", b"B") for x in (b"x", b"y")]
    rows += [m.element([a, x], bytes([k]), m.ITEM, item=b"v") for a in (b"A", b"B") for x in (b"x", b"y") for k in range(6)]
    nodes, trees = load(spark, rows)
    parts = [
        PathQuery((b"A", b"x"), Query([span("range", b"\0", b"\2")])),
        PathQuery((b"A", b"y"), Query.one(b"\3")),
        PathQuery((b"B",), Query.one(b"x").subquery(Query([span("range_from", b"\4")]))),
        PathQuery((b"A", b"x"), Query.one(b"\5")),
    ]
    whole = PathQuery.merge(parts)
    want = {r for p in parts for r in run(trees, p)}
    assert set(run(trees, whole)) == want == set(got(query_raw(nodes, whole))) and len(want) == 6
    with pytest.raises(errors.NotSupported):
        PathQuery.merge([parts[0], PathQuery((), Query.all(), limit=1)])
    assert Branch((b"a", b"b"), Query.one(b"k")).merge(Branch((b"a", b"c"), Query.one(b"k"))).path == (b"a",)
    assert PathQuery.merge(parts[:1]) is parts[0]


def test_terminal_keys_and_items_at_path():
    q = Query([span("range", b"a", b"c")]).subquery(Query([key(b"k")]), [b"s"]).when(key(b"b"), None, [b"p", b"q"])
    pq = PathQuery((b"r",), q)
    assert pq.terminal_keys(10) == [((b"r", b"a", b"s"), b"k"), ((b"r", b"b", b"p"), b"q")]
    with pytest.raises(errors.InvalidQuery):
        pq.terminal_keys(1)
    with pytest.raises(errors.NotSupported):
        PathQuery((), Query.all()).terminal_keys(5)
    assert pq.query_items_at_path((b"r",)) == q.items and pq.query_items_at_path((b"r", b"a")) == [key(b"s")]
    assert pq.query_items_at_path((b"r", b"a", b"s")) == [key(b"k")] and pq.query_items_at_path((b"z",)) is None
    assert q.max_depth() == 2 and q.has_subquery_on_key(b"b")
    merged = AggregateSumQuery.merge([AggregateSumQuery((), [key(b"a")], 3, 1), AggregateSumQuery((), [key(b"b")], 4, 2)])
    assert (merged.sum_limit, merged.item_limit, len(merged.items)) == (7, 3, 2)
