"""Path queries as data: items (key predicates), queries with branches, sizes and start paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput, InvalidQuery, NotSupported
from ..model import binary

Path = tuple[bytes, ...]

#: name: (has a lower bound that it includes, has an upper bound that it includes); None: no such bound. The order gives the variants' fixed numbers.
KINDS = {
    "key": (True, True),
    "range": (True, False),
    "range_inclusive": (True, True),
    "range_full": (None, None),
    "range_from": (True, None),
    "range_to": (None, False),
    "range_to_inclusive": (None, True),
    "range_after": (False, None),
    "range_after_to": (False, False),
    "range_after_to_inclusive": (False, True),
}
_BY_BOUNDS = {v: k for k, v in KINDS.items() if k != "key"}
MAX_DEPTH = 64


@dataclass(frozen=True)
class QueryItem:
    """One of ten predicates on a key."""

    kind: str
    start: bytes | None = None
    end: bytes | None = None

    @staticmethod
    def key(k: bytes) -> QueryItem:
        return QueryItem("key", k, k)

    @staticmethod
    def of(lo: bytes | None, lo_in: bool | None, hi: bytes | None, hi_in: bool | None) -> QueryItem | None:
        """The item with these bounds; None if no key can be within."""
        if lo is not None and hi is not None and (lo > hi or (lo == hi and not (lo_in and hi_in))):
            return None
        if lo is not None and lo == hi:
            return QueryItem.key(lo)
        return QueryItem(_BY_BOUNDS[None if lo is None else lo_in, None if hi is None else hi_in], lo, hi)

    @property
    def number(self) -> int:
        return list(KINDS).index(self.kind)

    def lower_bound(self) -> tuple[bytes | None, bool]:
        """Lower bound, and whether it is excluded."""
        return self.start, KINDS[self.kind][0] is False

    def upper_bound(self) -> tuple[bytes | None, bool]:
        """Upper bound, and whether it is included."""
        return self.end, KINDS[self.kind][1] is not False

    @property
    def lower_unbounded(self) -> bool:
        return KINDS[self.kind][0] is None

    @property
    def upper_unbounded(self) -> bool:
        return KINDS[self.kind][1] is None

    @property
    def is_key(self) -> bool:
        return self.kind == "key"

    @property
    def is_range(self) -> bool:
        return not self.is_key

    @property
    def is_single(self) -> bool:
        return self.is_key or (self.kind == "range_inclusive" and self.start == self.end)

    @property
    def is_unbounded_range(self) -> bool:
        return self.lower_unbounded or self.upper_unbounded

    def contains(self, key: bytes) -> bool:
        lo_in, hi_in = KINDS[self.kind]
        low = lo_in is None or key > self.start or (lo_in and key == self.start)
        return bool(low and (hi_in is None or key < self.end or (hi_in and key == self.end)))

    def matches(self, key: Column) -> Column:
        """The predicate on a binary column; bounds reach the scan as pushed filters."""
        if self.is_key:
            return key == binary(self.start)
        lo_in, hi_in = KINDS[self.kind]
        out = []
        if lo_in is not None:
            out.append(key >= binary(self.start) if lo_in else key > binary(self.start))
        if hi_in is not None:
            out.append(key <= binary(self.end) if hi_in else key < binary(self.end))
        return out[0] & out[1] if len(out) == 2 else out[0] if out else F.lit(True)

    def _bounds(self) -> tuple[tuple, tuple]:
        """Comparable bounds: lower (has, key, excluded), upper (unbounded, key, included)."""
        lo_in, hi_in = KINDS[self.kind]
        lower = (0, b"", 0) if lo_in is None else (1, self.start, int(not lo_in))
        return lower, ((1, b"", 0) if hi_in is None else (0, self.end, int(hi_in)))

    @staticmethod
    def _from(lower: tuple, upper: tuple) -> QueryItem | None:
        return QueryItem.of(lower[1] if lower[0] else None, not lower[2], None if upper[0] else upper[1], bool(upper[2]))

    def collides_with(self, other: QueryItem) -> bool:
        return self.intersect(other).both is not None

    def merge(self, other: QueryItem) -> QueryItem:
        """The smallest item that covers both."""
        (a, b), (c, d) = self._bounds(), other._bounds()
        return QueryItem._from(min(a, c), max(b, d))

    def intersect(self, other: QueryItem) -> Intersection:
        """What both cover, and what of each lies left and right of it."""
        (a, b), (c, d) = self._bounds(), other._bounds()
        both = QueryItem._from(max(a, c), min(b, d))
        if both is None:
            left_first = a < c
            return Intersection(None, self if left_first else None, None if left_first else self, None if left_first else other, other if left_first else None)
        lo, hi = both._bounds()
        before = (0, lo[1], lo[2])  # up to the start of the common part
        after = (1, hi[1], hi[2])
        left = lambda x: QueryItem._from(x, before) if x < lo else None
        right = lambda x: QueryItem._from(after, x) if x > hi else None
        return Intersection(both, left(a), right(b), left(c), right(d))

    def keys(self) -> list[bytes]:
        """All keys, where they can be listed: a key, or a range whose ends have one byte."""
        if self.is_key:
            return [self.start]
        if self.kind not in ("range", "range_inclusive"):
            raise InvalidInput("the keys of an unbounded range cannot be listed")
        if len(self.start) > 1 or len(self.end) != 1:
            raise InvalidInput("only ranges over single bytes can be listed")
        first = self.start[0] if self.start else 0
        last = self.end[0] + (self.kind == "range_inclusive")
        return ([b""] if not self.start else []) + [bytes([k]) for k in range(first, last)]

    @property
    def footprint(self) -> int:
        """Bytes of the keys that the item names."""
        if self.is_key:
            return len(self.start)
        return len(self.lower_bound()[0] or b"") + len(self.upper_bound()[0] or b"")

    def could_have_items(self, key: bytes, left: bool) -> bool:
        """Whether a key left (or right) of ``key`` can match."""
        if left:
            return self.lower_unbounded or self.start < key
        return self.upper_unbounded or self.end > key


@dataclass(frozen=True)
class Intersection:
    both: QueryItem | None
    ours_left: QueryItem | None = None
    ours_right: QueryItem | None = None
    theirs_left: QueryItem | None = None
    theirs_right: QueryItem | None = None


def key(k: bytes) -> QueryItem:
    return QueryItem.key(k)


def span(kind: str, start: bytes | None = None, end: bytes | None = None) -> QueryItem:
    """An item by name of its kind; see KINDS."""
    return QueryItem(kind, start, end)


FULL = QueryItem("range_full")


def normalised(items: Iterable[QueryItem]) -> list[QueryItem]:
    """Sorted items without overlaps: those that collide are merged."""
    out: list[QueryItem] = []
    for item in items:
        while hit := next((x for x in out if x.collides_with(item)), None):
            out.remove(hit)
            item = hit if hit == item else hit.merge(item)
        out.append(item)
    return sorted(out, key=lambda x: x._bounds())


def intersect_many(ours: Sequence[QueryItem], theirs: Sequence[QueryItem]) -> tuple[list[QueryItem], list[QueryItem], list[QueryItem]]:
    """(in both, only in ours, only in theirs) of two lists without overlaps."""
    both, left, right = [], list(ours), list(theirs)
    for i in list(left):
        for j in theirs:
            if (x := i.intersect(j).both) is not None:
                both.append(x)

    def without(items: list[QueryItem], cut: list[QueryItem]) -> list[QueryItem]:
        for c in cut:
            items = [y for x in items for r in [x.intersect(c)] for y in ([x] if r.both is None else [r.ours_left, r.ours_right]) if y is not None]
        return items

    return normalised(both), without(left, both), without(right, both)


@dataclass
class Branch:
    """What to do below a tree: walk ``path``, then run ``query``."""

    path: Path | None = None
    query: Query | None = None

    @property
    def empty(self) -> bool:
        return self.path is None and self.query is None

    def merge(self, other: Branch) -> Branch:
        if self.empty or other.empty:
            return replace(other if self.empty else self)
        a, b = self.path or (), other.path or ()
        k = common_prefix(a, b)
        if a == b and self.query and other.query:
            return Branch(self.path, self.query.merged(other.query))
        if a == b and not self.query and not other.query:
            return replace(self)
        out = Query()
        for rest, q in ((a[k:], self.query), (b[k:], other.query)):
            out._take(rest, q)
        return Branch(a[:k] or None, out)


def common_prefix(a: Sequence, b: Sequence) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@dataclass
class Query:
    """Items in order, a default branch, conditional branches of which the first that matches counts, and a direction."""

    items: list[QueryItem] = field(default_factory=list)
    default: Branch = field(default_factory=Branch)
    conditional: list[tuple[QueryItem, Branch]] = field(default_factory=list)
    left_to_right: bool = True
    add_parent_tree: bool = False

    @staticmethod
    def all(left_to_right: bool = True) -> Query:
        return Query([FULL], left_to_right=left_to_right)

    @staticmethod
    def one(k: bytes) -> Query:
        return Query([QueryItem.key(k)])

    def insert(self, *items: QueryItem) -> Query:
        """Adds items, keeping the list sorted and without overlaps."""
        self.items = normalised([*self.items, *items])
        return self

    def subquery(self, query: Query | None = None, path: Sequence[bytes] | None = None) -> Query:
        """Sets the default branch."""
        self.default = Branch(None if path is None else tuple(path), query)
        return self

    def when(self, item: QueryItem, query: Query | None = None, path: Sequence[bytes] | None = None) -> Query:
        """Adds a conditional branch."""
        self.conditional.append((item, Branch(None if path is None else tuple(path), query)))
        return self

    def branch_for(self, k: bytes) -> Branch:
        return next((b for item, b in self.conditional if item.contains(k)), self.default)

    def has_subquery_on_key(self, k: bytes) -> bool:
        return self.default.query is not None or any(item.contains(k) and b.query for item, b in self.conditional)

    @property
    def disjoint(self) -> bool:
        return normalised(self.items) == self.items

    @property
    def branches(self) -> list[Branch]:
        return [*(b for _, b in self.conditional), self.default]

    @property
    def descends(self) -> bool:
        return any(not b.empty for b in self.branches)

    def max_depth(self) -> int:
        return 1 + max((b.query.max_depth() for b in self.branches if b.query), default=0)

    def terminal_keys(self, path: Path, most: int, depth: int = 0) -> list[tuple[Path, bytes]]:
        """All (path, key) that the query can return, where they can be listed."""
        if depth > MAX_DEPTH:
            raise InvalidQuery("a query has at most 64 levels")
        out: list[tuple[Path, bytes]] = []
        for item in self.items:
            if item.is_unbounded_range:
                raise NotSupported("terminal keys are not supported with unbounded ranges")
            for k in item.keys():
                b = self.branch_for(k)
                if b.query is not None:
                    out += b.query.terminal_keys((*path, k, *(b.path or ())), most - len(out), depth + 1)
                elif b.path:
                    out.append(((*path, k, *b.path[:-1]), b.path[-1]))
                else:
                    out.append((path, k))
                if len(out) > most:
                    raise InvalidQuery("too many terminal keys")
        return out

    def _take(self, path: Sequence[bytes], query: Query | None) -> None:
        """Adds what ``query`` asks for below ``path``; an empty path is this level."""
        if not path:
            if query is not None:
                m = self.merged(query)
                self.items, self.default, self.conditional = m.items, m.default, m.conditional
            return
        k = QueryItem.key(path[0])
        branch = Branch(tuple(path[1:]) or None, query)
        if not branch.empty or k not in self.items:
            self._merge_conditional(k, branch)
        self.insert(k)

    def _merge_conditional(self, item: QueryItem, branch: Branch) -> None:
        """Adds a conditional branch; where it overlaps others, both hold there."""
        out: list[tuple[QueryItem, Branch]] = []
        left = [item]
        for other, b in self.conditional:
            rest: list[QueryItem] = []
            for part in left:
                x = part.intersect(other)
                if x.both is None:
                    rest.append(part)
                    continue
                out.append((x.both, b.merge(branch)))
                rest += [p for p in (x.ours_left, x.ours_right) if p]
            out.append((other, b))
            left = rest
        out += [(p, self.default.merge(branch) if any(i.collides_with(p) for i in self.items) else branch) for p in left]
        self.conditional = out

    def merged(self, other: Query) -> Query:
        """A query for all that either asks for."""
        out = replace(self, items=normalised([*self.items, *other.items]), conditional=list(self.conditional))
        if self.default != other.default:
            # A default holds for its own query's items only, so unlike defaults become conditions.
            both, ours, theirs = intersect_many(normalised(self.items), normalised(other.items))
            mine = list(self.conditional)
            out.conditional, out.default = [], Branch()
            for items, b in ((both, self.default.merge(other.default)), (ours, self.default), (theirs, other.default)):
                out.conditional += [(i, b) for i in items]
            for item, b in mine + list(other.conditional):
                q = replace(out, conditional=list(out.conditional))
                q._merge_conditional(item, b)
                out.conditional = q.conditional
        else:
            for item, b in other.conditional:
                out._merge_conditional(item, b)
        return out


@dataclass
class PathQuery:
    """A query from a start path, with a limit and an offset over all its levels."""

    path: Path
    query: Query
    limit: int | None = None
    offset: int | None = None

    def __post_init__(self) -> None:
        self.path = tuple(self.path)
        for v in (self.limit, self.offset):
            if v is not None and not 0 <= v <= 65_535:
                raise InvalidQuery("limits and offsets have 16 bits")

    def terminal_keys(self, most: int) -> list[tuple[Path, bytes]]:
        return self.query.terminal_keys(self.path, most)

    def query_items_at_path(self, path: Sequence[bytes]) -> list[QueryItem] | None:
        """The items that apply at an absolute path; None if the query does not get there."""
        path = tuple(path)
        if path[: len(self.path)] != self.path:
            k = len(path)
            return [QueryItem.key(self.path[k])] if self.path[:k] == path else None
        query, rest = self.query, path[len(self.path) :]
        while rest:
            if not any(i.contains(rest[0]) for i in query.items):
                return None
            b, rest = query.branch_for(rest[0]), rest[1:]
            walk = b.path or ()
            k = common_prefix(walk, rest)
            if k < len(walk):
                return [QueryItem.key(walk[k])] if k == len(rest) else None
            rest = rest[k:]
            if b.query is None:
                return None
            query = b.query
        return list(query.items)

    def adds_parent_tree_at(self, path: Sequence[bytes]) -> bool:
        """Whether the query that applies at an absolute path asks for the element of the tree it runs in as well."""
        path = tuple(path)
        if path[: len(self.path)] != self.path:
            return False
        query, rest = self.query, path[len(self.path) :]
        while rest:
            b, rest = query.branch_for(rest[0]), rest[1:]
            walk = tuple(b.path or ())
            if b.query is None or rest[: len(walk)] != walk:
                return False
            query, rest = b.query, rest[len(walk) :]
        return query.add_parent_tree

    @staticmethod
    def merge(queries: Sequence[PathQuery]) -> PathQuery:
        """One query for all that any asks for; none may have a limit or an offset."""
        if not queries:
            raise InvalidInput("there is nothing to merge")
        if len(queries) == 1:
            return queries[0]
        if any(q.limit is not None or q.offset is not None for q in queries):
            raise NotSupported("path queries with limits or offsets cannot be merged")
        k = len(queries[0].path)
        for q in queries[1:]:
            k = min(k, common_prefix(queries[0].path, q.path))
        out = Query(left_to_right=queries[0].query.left_to_right)
        for q in sorted(queries, key=lambda q: len(q.path)):
            if len(q.path) == k:
                out = out.merged(q.query) if out.items else replace(q.query, items=list(q.query.items), conditional=list(q.query.conditional))
            else:
                out._take(q.path[k:], q.query)
        return PathQuery(queries[0].path[:k], out)


@dataclass
class AggregateSumQuery:
    """Items of one tree, read until their sum reaches a budget."""

    path: Path
    items: list[QueryItem]
    sum_limit: int
    item_limit: int | None = None
    left_to_right: bool = True

    @staticmethod
    def merge(queries: Sequence[AggregateSumQuery]) -> AggregateSumQuery:
        """One query with all items; paths and directions must agree, budgets add up."""
        first = queries[0]
        if any(q.path != first.path for q in queries):
            raise NotSupported("aggregate sum queries on different paths cannot be merged")
        if any(q.left_to_right != first.left_to_right for q in queries):
            raise NotSupported("aggregate sum queries in different directions cannot be merged")
        limits = [q.item_limit for q in queries if q.item_limit is not None]
        return AggregateSumQuery(first.path, normalised(i for q in queries for i in q.items), sum(q.sum_limit for q in queries), sum(limits) if limits else None, first.left_to_right)
