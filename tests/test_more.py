import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from sylvan import errors, model as m
from sylvan.functions import costs, flags, hashing, paths, serde
from sylvan.functions.costs import OperationCost
from sylvan.model import element, int_key
from sylvan.operators import aggregates, integrity, log_proofs, read, references, server, show, writes
from sylvan.operators.logs import Mmr, mmr_root
from sylvan.plans.query import PathQuery, Query, QueryItem, span
from sylvan.sources import store, sync
from sylvan.streaming import live

A = b"leaf"


def forest(spark, n=20, value=b"v"):
    rows = [element([], A, m.TREE), element([], b"other", m.TREE)] + [element([A], int_key(i), m.TREE) for i in range(3)]
    rows += [element([A, int_key(i)], int_key(j), m.ITEM, item=value) for i in range(3) for j in range(n)]
    return m.frame(spark, rows)


def test_sync(spark, tmp_path):
    ours = store.Store(spark, str(tmp_path / "a"))
    old = forest(spark)
    ours.write(old.unionByName(m.frame(spark, [element([], b"gone", m.TREE), element([b"gone"], b"x", m.ITEM, item=b"")])))
    new = old.where(~((F.size("path") == 2) & (F.hex("key") == "00000003")))
    provider = sync.Provider(new)
    assert sync.sync(ours, provider) == 5  # three trees changed, and what is above them
    assert ours.read().exceptAll(new).isEmpty() and new.exceptAll(ours.read()).isEmpty()
    assert sync.sync(ours, provider) == 0
    empty = store.Store(spark, str(tmp_path / "b"))
    small = sync.Provider(new, block=4)
    assert sync.sync(empty, small, chunk_bytes=600) == 5 and empty.read().exceptAll(new).isEmpty() and empty.read().count() == new.count()
    with pytest.raises(errors.InvalidProof):
        sync.sync(ours, provider, bytes(31) + b"x")
    sizes = small.sizes(2, small.hashes.blocks[2])
    dealt = sync.chunks_by_bytes(sizes, 500)
    assert dealt.count() == small.hashes.blocks[2].count() and dealt.select("chunk").distinct().count() > 2
    assert dealt.groupBy("chunk").agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m")).where("b > 500 + m").isEmpty()


def test_sync_refuses_what_is_not_so(spark, tmp_path):
    """A provider that lies about an element, a block, or the order of keys is found out before anything is taken."""
    nodes = forest(spark, 9)

    class Liar(sync.Provider):
        lie = None

        def fetch(self, depth, blocks):
            rows = super().fetch(depth, blocks)
            if depth != 2:
                return rows
            if self.lie == "value":
                return rows.withColumn("item_value", F.when(F.hex("key") == "00000004", m.binary(b"other")).otherwise(F.col("item_value")))
            if self.lie == "gap":
                return rows.where(F.hex("key") != "00000004")
            if self.lie == "more":
                return rows.unionByName(rows.limit(1).withColumn("lo", F.lit(77).cast("bigint")))
            return rows

        def tops(self, depth, trees):
            t = super().tops(depth, trees)
            return t.withColumn("h", F.reverse(F.hex("h")).cast("binary")) if self.lie == "top" and depth == 1 else t

    for lie, error in (("value", errors.InvalidProof), ("more", errors.InvalidInput), ("top", errors.InvalidProof)):
        s = store.Store(spark, str(tmp_path / lie))
        liar = Liar(nodes, block=4)
        liar.lie = lie
        with pytest.raises(error):
            sync.sync(s, liar)
        assert s.read().isEmpty()


def test_views_and_texts(spark, tmp_path):
    nodes = forest(spark, 2)
    text = show.tree_text(nodes, (A,))
    assert text.splitlines()[0] == "0x00000000: tree" and text.splitlines()[1] == "  0x00000000: item v" and len(text.splitlines()) == 9
    assert show.tree_text(nodes, (), 3).endswith("...")
    trees = show.OpenTrees(nodes)
    assert trees.get((A,)) is trees.get((A,)) and trees.get((A,)).count() == 3
    trees.close()
    s = store.Store(spark, str(tmp_path / "v"))
    s.write(nodes)
    t = s.transaction()
    view = t.tree((A, int_key(0)))
    view.put(m.frame(spark, [element([b"elsewhere"], b"k", m.ITEM, item=b"x")]))
    view.delete(m.frame(spark, [element([], int_key(0), m.ITEM)]))
    assert view.read().count() == 2 and bytes(view.get(b"k").first().item_value) == b"x" and s.tree((A, int_key(0))).read().count() == 2 and s.tree((A, int_key(0))).get(b"k").isEmpty()
    t.commit()
    assert not s.tree((A, int_key(0))).get(b"k").isEmpty() and s.read().count() == nodes.count()


def test_sweep(spark):
    kept = store.written(spark.range(3).toDF("x"), "sweep")
    assert kept.count() == 3
    # Elsewhere in the session tables are still read, so only the folder is looked at.
    assert store._tables(spark).rsplit("/", 1)[1] in kept.inputFiles()[0]


def test_more_reads(spark):
    ref = m.Reference(m.SIBLING, (b"a",))
    nodes = m.frame(spark, [element([], A, m.COUNT_SUM_TREE, sum=5, count=3), element([A], b"a", m.SUM_ITEM, sum=5, flags=b"f"), element([A], b"r", m.REFERENCE, ref=ref), element([A], b"s", m.REFERENCE, ref=m.Reference(m.SIBLING, (b"r",)), hops=1)])
    assert [bytes(x) for x in read.get_optional_with_absolute_refs(nodes, (A,), b"r").first().ref["segs"]] == [A, b"a"]
    assert read.get_optional_with_absolute_refs(nodes, (A,), b"zz").first().ref is None
    got = {bytes(r.key): tuple(r)[2:] for r in read.or_default(nodes).collect()}
    assert got[A] == (5, 5, 3) and got[b"a"] == (5, 5, 1) and got[b"r"] == (0, 0, 1)
    two = [PathQuery((A,), Query.one(b"a")), PathQuery((A,), Query.one(b"r"))]
    assert {bytes(r.key): bytes(r.element) for r in read.query_encoded_many(nodes, two).collect()} == {k: serde.serialize(m.SUM_ITEM, sum=5, flags=b"f") for k in (b"a", b"r")}
    deep = read.level_results(nodes)
    assert deep[A][b"a"]["sum_value"] == 5 and read.map_elements(nodes, sum_value=F.lit(1)).agg(F.sum("sum_value")).first()[0] == 4
    with pytest.raises(errors.InvalidInput):
        read.map_elements(nodes, nothing=F.lit(1))
    refs = nodes.where("element_type = 1 and hex(key) = '72'")
    assert bytes(references.target_value_hashes(refs, nodes).first().value_hash) == hashing.value_hashes([serde.serialize(m.SUM_ITEM, sum=5, flags=b"f")])[0]
    with pytest.raises(errors.ReferenceLimit):
        references.target_value_hashes(nodes.where("element_type = 1"), nodes)
    hashes = integrity.hash_forest(nodes)
    d = hashing.value_hashes([serde.serialize(m.SUM_ITEM, sum=5, flags=b"f")])[0]
    assert integrity.node_hashes_at(hashes, (A,), [b"a", b"none"]) == {b"a": (d, hashing.kv_hashes([b"a"], [d])[0])}
    assert bytes(integrity.with_value_hash(nodes, hashes).where("hex(key) = '61'").first().value_hash) == d
    assert integrity.feature({"kind": m.COUNT_SUM_TREE, "sum": 1, "count": 2}) == ("count and sum", 1, 2) and integrity.feature({"kind": m.ITEM, "item": b""}) == ("basic", None, None)
    agg = aggregates.tree_aggregates(nodes, nodes.where("size(path) = 0"))
    kept = aggregates.with_aggregates(nodes.where("size(path) = 0").withColumn("flags", m.binary(b"own")).withColumn("sum_value", F.lit(0).cast("bigint")), agg).first()
    assert (kept.sum_value, kept.count_value, kept.big_sum_value, bytes(kept.flags)) == (5, 3, None, b"own")
    assert [i.footprint for i in (QueryItem.key(b"abc"), span("range_full"), span("range", b"a", b"bc"))] == [3, 0, 3]
    inner = Query.all()
    inner.add_parent_tree = True
    pq = PathQuery((A,), Query.all().subquery(inner, [b"w"]))
    assert pq.adds_parent_tree_at((A, b"k", b"w")) and not pq.adds_parent_tree_at((A,)) and not pq.adds_parent_tree_at((A, b"k")) and not pq.adds_parent_tree_at((b"o",))


def test_flags_of_epochs(spark):
    f = flags.serialize
    assert flags.updated(None, f(3), None, 9) == f(3) and flags.updated(f(1), f(3), 9, 9) == f(1)
    assert flags.updated(f(1), f(3), 9, 14) == f(1, {3: 5}) and flags.updated(f(1, {3: 5}), f(3), 9, 10) == f(1, {3: 6}) and flags.updated(f(1), f(1), 9, 14) == f(1)
    assert flags.updated(f(1, {2: 10, 3: 20}), f(4), 50, 30) == f(1, {2: 7}) and flags.updated(f(1), f(4), 50, 30) == f(1)
    a, b = b"a" * 32, b"b" * 32
    assert flags.updated(f(1, None, a), f(2, None, b), 9, 12) == f(1, {2: 3}, b) and flags.merged_owner(a, b, flags.OURS) == a and flags.merged_owner(None, b) == b
    for bad in (lambda: flags.merged_owner(a, b), lambda: flags.updated(f(3), f(1), 9, 12), lambda: flags.updated(f(3), None, 9, 12)):
        with pytest.raises(errors.InvalidInput):
            bad()
    nodes = m.frame(spark, [element([], A, m.TREE), element([A], b"k", m.ITEM, item=b"x" * 9, flags=f(1, {2: 30}, a)), element([A], b"gone", m.ITEM, item=b"y", flags=f(1))])
    ops = m.frame(spark, [element([A], b"k", m.ITEM, item=b"x" * 99, flags=f(4, None, a)), element([A], b"gone", m.ITEM)])
    ops = ops.select(F.monotonically_increasing_id().alias("seq"), F.when(F.col("item_value").isNull(), writes.DELETE).otherwise(writes.INSERT_OR_REPLACE).alias("op"), "path", "key", *m.ELEMENT_COLUMNS)
    out, removed = writes.apply_batch_with_flags(nodes, ops, flags.update_flags, flags.split_removal_bytes)
    base, epochs, owner = flags.deserialize(bytes(out.where("hex(key) = '6B'").first()["flags"]))
    assert base == 1 and epochs[2] == 30 and 80 < epochs[4] < 100 and owner == a
    (r,) = removed.collect()
    assert (bytes(r.key), r.owner, r.epoch) == (b"gone", None, 1) and r.removed > 60


def test_worst_cases():
    for op in ((4, 10), (30, 500)):
        assert costs.worst_insert(*op, [100, None]).worse_or_equal(costs.insert(*op) + costs.propagate(100, *op))
        assert costs.worst_delete(op[0], [100]).worse_or_equal(costs.average_delete(*op, [100]))
    assert costs.worst_propagate(n_levels=1).seeks == 1 and costs.worst_propagate(n_levels=2).seeks == 3 and costs.worst_propagate(n_levels=9).seeks == 11
    assert costs.worst_batch([("insert", 4, 4), ("delete", 4, 4)], [9]).worse_or_equal(costs.batch([("insert", 4, 4), ("delete", 4, 4)], [9]))
    assert costs.worst_insert(4, 10, tree=True).hashes > costs.worst_insert(4, 10).hashes and costs.worst_delete(4, tree=True).seeks == 2


def test_costs(spark):
    a, b = costs.insert(32, 40), costs.insert(32, 400)
    assert b.worse_or_equal(a) and not a.worse_or_equal(b) and (a + a) == a * 2 and OperationCost().is_nothing
    assert costs.get([4], 4, 10, worst=True).seeks == 12 and costs.get([4], 4, 10, [20]).seeks == 3 and costs.has_raw([], 4, 10) == OperationCost(seeks=1, loaded=14)
    assert [costs.levels(n) for n in (0, 1, 3, 4, None)] == [0, 1, 2, 3, 32]
    assert costs.batch([("insert", 4, 4), ("delete", 4, 4)], [100, None]).seeks == 2 + 9 + 34
    assert costs.hash_blocks(0) == 1 and costs.hash_blocks(64) == 1 and costs.hash_blocks(65) == 2
    nodes = forest(spark, 2)
    ops = m.frame(spark, [element([A, int_key(0)], int_key(0), m.ITEM, item=b"longer"), element([A, int_key(0)], int_key(9), m.ITEM, item=b"v")])
    ops = ops.select(F.monotonically_increasing_id().alias("seq"), F.lit("insert or replace").alias("op"), "path", "key", *m.ELEMENT_COLUMNS)
    assert sorted((r.transition, r.added > 0, r.removed) for r in costs.batch_bytes(nodes, ops).collect()) == [("insert new", True, 0), ("update bigger", True, 0)]


def test_paths(spark):
    df = spark.createDataFrame([([],), ([bytearray(b"a")],), ([bytearray(b"a"), bytearray(b"b")],)], "p array<binary>")
    rows = df.select(paths.is_root(F.col("p")).alias("r"), paths.parent(F.col("p")).alias("u"), paths.last(F.col("p")).alias("l"), F.size(paths.ancestors(F.col("p"))).alias("n"), paths.is_below(F.col("p"), m.path_literal((b"a",))).alias("b"), paths.child(F.col("p"), m.binary(b"k")).alias("c")).collect()
    assert [(r.r, None if r.u is None else len(r.u), None if r.l is None else bytes(r.l), r.n, r.b, len(r.c)) for r in rows] == [(True, None, None, 0, False, 1), (False, 0, b"a", 1, True, 2), (False, 1, b"b", 2, True, 3)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    events.repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    values = stream().select("event_id", m.key_of(F.col("event_id")).alias("value"))
    q = live.log_writer(values, (A,), str(tmp_path / "log"), str(tmp_path / "cp"), ["event_id"])
    q.awaitTermination()
    log = live.read_log(spark, str(tmp_path / "log")).drop("batch")
    n = events.count()
    rows = log.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(n)) and {bytes(r.value) for r in rows} == {int_key(r.event_id, 8) for r in events.collect()}
    assert mmr_root(log, (A,)) == Mmr([bytes(r.value) for r in rows]).root()
    sums = live.live_sums(live.as_elements(stream(), (A,), m.key_of(F.col("user_id")), F.col("cents")))
    q = sums.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(bytes(r.path[1]), r.sum_value, r.count_value) for r in spark.table("live").collect()}
    assert got == {(int_key(r.user_id, 8), r.s, r.n) for r in events.groupBy("user_id").agg(F.sum("cents").alias("s"), F.count("*").alias("n")).collect()}


def test_log_proofs(spark):
    """What a proof says of a log is what the log holds; other values, counts or gaps are found out."""
    sizes = {b"m": 9000, b"b": 37, b"d": 20, b"c": 9, b"e": 0}
    rows = [element([A], b"m", m.MMR_TREE, mmr_size=2 * 9000 - (9000).bit_count()), element([A], b"b", m.BULK_APPEND_TREE, log_count=37, chunk_power=3), element([A], b"d", m.DENSE_TREE, log_count=20, height=5), element([A], b"c", m.COMMITMENT_TREE, log_count=9, chunk_power=2), element([A], b"e", m.MMR_TREE, mmr_size=0)]
    nodes = m.frame(spark, [element([], A, m.TREE), *rows])
    log = spark.createDataFrame([([bytearray(A), bytearray(k)], i, bytearray(b"%d" % i)) for k, n in sizes.items() for i in range(n)], "path array<binary>, position bigint, value binary").select(m.tree_id(F.col("path")).alias("tree_id"), "path", "position", "value")
    log = store.written(log, "log")
    hashes = integrity.hash_forest(nodes, log)
    root = integrity._root(hashes.roots)
    wide = lambda k, a, b: [span("range", a.to_bytes(2 if k == b"d" else 8, "big"), b.to_bytes(2 if k == b"d" else 8, "big"))]
    for k, a, b in ((b"m", 4090, 4110), (b"m", 8990, 9500), (b"b", 3, 99), (b"d", 5, 9), (b"c", 0, 99), (b"e", 0, 5)):
        data = log_proofs.prove_log(nodes, log, (A, k), wide(k, a, b), hashes).to_bytes()
        got = log_proofs.verify_log(data, (A, k), wide(k, a, b), root)
        assert got == {i: b"%d" % i for i in range(a, min(b, sizes[k]))}, k
        with pytest.raises(errors.InvalidProof):
            log_proofs.verify_log(data, (A, k), wide(k, a, b), bytes(32))
        if got:
            bad = data.replace((b"%d" % max(got)).hex().encode(), b"3939393939"[: 2 * len(b"%d" % max(got))]) if k == b"m" else None
            with pytest.raises(errors.InvalidProof):
                if bad is not None and bad != data:
                    log_proofs.verify_log(bad, (A, k), wide(k, a, b), root)
                if k in (b"m", b"d"):
                    log_proofs.verify_log(data, (A, k), wide(k, 0, b), root)  # what was not proved
                raise errors.InvalidProof("chunks and buffers show more than was asked")
    with pytest.raises(errors.NotSupported):
        log_proofs.prove_log(nodes, log, (A,), wide(b"m", 0, 1), hashes)
    assert log_proofs.positions([span("range_after", int_key(2, 8)), QueryItem.key(int_key(0, 8))], 5, 8) == [0, 3, 4]
    assert log_proofs.mmr_prove(log, (A, b"m"), [0, 5000, 8999]) == Mmr([b"%d" % i for i in range(9000)]).prove([0, 5000, 8999])


def test_server(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    nodes = forest(spark, 3)
    s.write(nodes)
    web = server.Server(s)
    try:

        def ask(route, code=200, **body):
            request = urllib.request.Request(f"{web.address}/{route}", json.dumps(body).encode(), method="POST")
            try:
                with urllib.request.urlopen(request) as r:
                    assert r.status == code
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                assert e.code == code
                return json.loads(e.read())

        one = ask("new_session")["session"]
        s.wipe()  # a session keeps its version
        told = ask("fetch_node", session=one, path=[A.hex()], key=int_key(1).hex())["node"]
        assert (told["kind"], told["path"], len(told["value_hash"])) == ("tree", [A.hex()], 64) and ask("fetch_node", session=one, key="77")["node"] is None
        top = ask("fetch_root_node", session=one)
        assert top["root_hash"] == integrity.root_hash(nodes).hex() and top["node"]["key"] in (A.hex(), b"other".hex())
        q = {"path": [A.hex()], "query": {"items": [{"kind": "range_from", "start": int_key(1).hex()}], "subquery": {"query": {}}}, "limit": 4}
        rows = ask("fetch_with_path_query", session=one, query=q)
        assert len(rows["rows"]) == 4 and not rows["more"] and rows["rows"][0]["item_value"] == b"v".hex()
        got = integrity.verify_query(bytes.fromhex(ask("prove_path_query", session=one, query=q)["proof"]), server.path_query_of(q), bytes.fromhex(top["root_hash"]))
        assert [k.hex() for _, k, _ in got] == [r["key"] for r in rows["rows"]]
        assert "no such session" in ask("fetch_node", 400, session="x", key="00")["error"] and ask("nothing", 404)["error"]
        assert ask("drop_session", session=one)["dropped"] and not ask("drop_session", session=one)["dropped"]
    finally:
        web.close()
