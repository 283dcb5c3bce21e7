"""Secret scans with linking of credential parts.

Strong findings stand alone: assignments to a telling name, access key
identifiers, long hexadecimal runs. Weak ones (identifiers of accounts, random
looking tokens, endpoints) are reported only where an interval join finds a
complementary part within the same scope.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
ACCOUNT = re.compile(r"""\b(client_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
SCHEME_START = re.compile(r"\b[a-z]", re.ASCII | re.IGNORECASE)
SCHEME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-"
ADDRESS = re.compile(r"""[^\s"'<>]{4,}""", re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "account", "endpoint", "weak")
SCOPE = 300  # characters between parts that belong together
LEAST_BITS = 3.5

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(n in low for n in ASSIGN_NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def endpoints(text: str) -> list[tuple[int, int]]:
    r"""Matches of ``\b[a-z][a-z0-9+.-]*://[^\s"'<>]{4,}``, in either case, found from each :// to its left: a search from the left is quadratic."""
    out, last = [], 0
    colon = text.find("://")
    while colon >= 0:
        run = text[last:colon]
        start = SCHEME_START.search(text, colon - (len(run) - len(run.rstrip(SCHEME))), colon)
        address = ADDRESS.match(text, colon + 3) if start else None
        if address:
            out.append((start.start(), address.end()))
        last = address.end() if address else colon + 3  # a scheme holds no colon, so none starts before this one
        colon = text.find("://", last)
    return out


def looks_random(token: str) -> bool:
    """Letters of both cases and digits, and many different characters."""
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token))) >= LEAST_BITS


def near(spans: list[Span], others: list[Span], scope: int) -> list[bool]:
    """Whether each span has one of others, disjoint from it, within ``scope`` characters; both sorted and without overlaps."""
    starts = [o[0] for o in others]
    out = []
    for s, _, e in spans:
        k = bisect_left(starts, e)
        after = k < len(others) and others[k][0] - e <= scope
        k = bisect_left(starts, s) - 1
        before = k >= 0 and others[k][2] <= s and s - others[k][2] <= scope
        if not before and k >= 1 and others[k][2] > s:  # the last one to start before overlaps the span
            before = others[k - 1][2] <= s and s - others[k - 1][2] <= scope
        out.append(after or before)
    return out


def _clear(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of spans that overlap none of taken."""
    starts = [t[0] for t in taken]
    longest = 0
    ends = []
    for t in taken:
        longest = max(longest, t[2])
        ends.append(longest)
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak findings near what complements them: tokens near an identifier, accounts near a secret, endpoints near both."""
    has_account = ":" in text or "=" in text
    accounts = _clear([(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)], base) if has_account else []
    identifiers = sorted([s for s in base if s[1] == 1] + accounts)
    strong = [s for s in base if s[1] != 1]
    if not identifiers:
        return []
    ends = _clear([(s, 4, e) for s, e in endpoints(text)], sorted(base + accounts)) if "://" in text else []
    tokens = _clear([(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if looks_random(m[0])], sorted(base + accounts + ends))
    tokens = [t for t, ok in zip(tokens, near(tokens, identifiers, scope), strict=True) if ok]
    secrets = _merged(strong + tokens)
    accounts = [a for a, ok in zip(accounts, near(accounts, secrets, scope), strict=True) if ok]
    identifiers = sorted([s for s in base if s[1] == 1] + accounts)
    both = [a and b for a, b in zip(near(ends, identifiers, scope), near(ends, secrets, scope), strict=True)]
    return sorted(accounts + tokens + [e for e, ok in zip(ends, both, strict=True) if ok])


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans):
        if out and s[0] < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], s[2]))
        else:
            out.append(s)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Strong and linked findings, by start and kind; offsets are code points."""
    base = base_spans(text)
    return base, linked_spans(text, base, scope)


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256 (of the strong findings), spans (all findings).

    A finding is kind:start:end, joined by commas. Whole texts are read; null
    and empty texts have no finding. Repeated rows and null ids are scanned
    like any other; other columns are ignored; no rows give no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("t").to_pylist():
                base, more = scan(text, scope)
                n = [sum(s[1] == k for s in base) for k in range(3)]
                rows.append((*n, sha256(written(base).encode()).hexdigest(), written(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
