import random

import pytest
from pyspark.sql import functions as F

from sylvan.llm.packing import CAPACITIES, best_fit_packing, cost, pack, packed_sequences
from sylvan.llm.tokens import encode, token_counts


def plain(lengths, caps, choose):
    """Best fit by scanning all bins."""
    rooms, used, of = [], [], []
    for k, n in enumerate(lengths):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(choose(lengths, k, caps))
            used.append(0)
        rooms[b] -= n
        used[b] += n
        of.append(b)
    return of, [min(c for c in caps if c >= u) for u in used]


def least_cost(lengths, k, caps):
    best = None
    for c in sorted(caps):
        if c < lengths[k]:
            continue
        room = c - lengths[k]
        got = lengths[k] + min(room, sum(x for x in lengths[k + 1 :] if x <= room))
        rate = cost(min(x for x in caps if x >= got)) / got
        if best is None or rate < best[0]:
            best = rate, c
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_pack_against_a_scan(seed):
    rng = random.Random(seed)
    caps = (16, 64, 100)
    lengths = sorted((min(100, int(rng.expovariate(1 / 20)) + 1) for _ in range(rng.choice([0, 1, 40, 150]))), reverse=True)
    tries = [plain(lengths, caps, least_cost), plain(lengths, caps, lambda *_: 100)]
    best = min(tries, key=lambda t: sum(map(cost, t[1])))
    of, sizes = pack(lengths, caps)
    assert sum(map(cost, sizes)) == pytest.approx(sum(map(cost, best[1]))) and (of, sizes) == best


def check(rows, docs):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in b] == [sum(x.n_tokens for x in b[:i]) for i in range(len(b))]
        used = sum(r.n_tokens for r in b)
        assert {(r.bin_used, r.capacity) for r in b} == {(used, min(c for c in CAPACITIES if c >= used))}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.piece_start, r.n_tokens))
    want = {}
    for d, n in docs:
        want.setdefault(d, []).extend((k, k * 4096, min(4096, n - k * 4096)) for k in range(-(-n // 4096)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def texts():
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(int(rng.paretovariate(1)) * 20))) for i in range(700)]
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "x " * 20000), (5, rows[5][1]), (None, "a b"), (1004, "x " * 4095)]


def test_every_token_once(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, capacity int")
    want = [(i, len(encode(t or "")) + 1) for i, t in rows]
    for shard_pieces in (20_000, 100):
        packed = best_fit_packing(docs, shard_pieces=shard_pieces).collect()
        check(packed, want)
    assert sum(r.n_tokens for r in packed) > 0.9 * sum({r.bin_id: r.capacity for r in best_fit_packing(docs).collect()}.values())
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    check(best_fit_packing(docs, length=words).collect(), [(i, len((t or "").split(" "))) for i, t in rows])
    assert best_fit_packing(docs.limit(0)).count() == 0


def test_sequences_hold_the_encoded_texts(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    end = 50256
    got = packed_sequences(docs, end, shard_pieces=100).collect()
    assert all(len(r.tokens) <= r.capacity and r.starts[0] == 0 for r in got)
    # As many tokens as the token counts say, and an end mark a row.
    assert sum(len(r.tokens) for r in got) == token_counts(docs).first().tokens_total + len(rows)
    pieces = {}
    for r in got:
        for d, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.tokens)]):
            pieces.setdefault(d, []).append(tuple(r.tokens[a:b]))
    want = {}
    for d, t in rows:
        ids = (*encode(t or ""), end)
        want.setdefault(d, []).extend(ids[k : k + 4096] for k in range(0, len(ids), 4096))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    assert packed_sequences(docs.limit(0), end).count() == 0
