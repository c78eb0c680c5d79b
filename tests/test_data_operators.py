"""Orphan references, hierarchies and incremental processing against brute force, with their edge cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphlens.operators import hierarchy, incremental, references, skew

T0 = datetime.datetime(2025, 1, 1)
NODE = "node_id string, parent_id string, row_seq long, path string, cur string, depth string"


def nodes(spark, pairs):
    """Rows with columns that clash with names the operator uses itself."""
    return spark.createDataFrame([(a, b, k, "x", "y", "z") for k, (a, b) in enumerate(pairs)], NODE)


def solve(parent):
    out = {}
    for n in parent:
        seen, x = {}, n
        while True:
            seen[x] = len(seen)
            p = parent[x]
            if p not in parent:
                out[n] = (x, len(seen) - 1)
                break
            x = p
            if x in seen:
                chain = list(seen)
                out[n] = (min(chain[seen[x] :]), -1)
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_random(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(150)]
    parent = {n: r.choice([*names, "", None, "absent"]) if r.random() < 0.2 else names[max(0, int(n[1:]) - r.randint(0, 3))] for n in names}
    got = {x.node_id: (x.root_id, x.depth) for x in hierarchy.resolve(nodes(spark, parent.items()), split=5).collect()}
    assert got == solve(parent)


def test_hierarchy_chain_loop_and_dirt(spark):
    chain = [(f"c{k:03}", f"c{k - 1:03}" if k else None) for k in range(90)]
    loop = [("l1", "l3"), ("l2", "l1"), ("l3", "l2"), ("tail", "l2"), ("self", "self")]
    rows = [*chain, *loop, ("c005", "nowhere"), (None, "c001"), ("c005", "c004"), ("c005", "c004")]
    df = hierarchy.resolve(nodes(spark, rows), paths=True).cache()
    got = {x.node_id: x for x in df.collect()}
    assert got["c089"].depth == 89 and got["c089"].root_id == "c000" and got["c089"].path == [f"c{k:03}" for k in range(90)]
    assert (got["tail"].root_id, got["tail"].depth, got["tail"].path) == ("l1", -1, None)
    assert (got["self"].root_id, got["self"].depth) == ("self", -1)
    assert len(got) == 95
    below = hierarchy.descendants(df).filter("node_id = 'c080'").count()
    assert below == 9
    assert hierarchy.resolve(nodes(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_descendants_in_and_below_loops(spark, seed):
    r = random.Random(seed)
    names = [f"n{k:02}" for k in range(60)]
    parent = {n: r.choice([*names, "", "absent"]) if r.random() < 0.3 else r.choice(names[max(0, k - 4) : k + 2]) for k, n in enumerate(names)}
    parent |= {"x1": "x4", "x2": "x1", "x3": "x2", "x4": "x3", "y1": "x3", "y2": "y1", "y3": "y2", "z": "x1", "self": "self", "s1": "self"}
    up = {}
    for n in parent:
        x, steps = parent[n], 1
        while x in parent and (x, n) not in up:
            up[(x, n)], x, steps = steps, parent[x], steps + 1
    want = {(a, b, k) for (a, b), k in up.items() if a != b}
    rows = nodes(spark, parent.items())
    resolved = hierarchy.resolve(rows, paths=True).cache()
    looped = hierarchy.loops(rows, resolved).cache()
    got = [tuple(x) for x in hierarchy.descendants(resolved).unionByName(hierarchy.loop_descendants(looped)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    stuck = {n: root for n, (root, depth) in solve(parent).items() if depth == -1}
    assert {x.node_id: (x.loop_id, x.in_loop) for x in looped.collect()} == {n: (root, (n, n) in up) for n, root in stuck.items()}
    assert {x.node_id: x.path for x in looped.collect() if x.node_id in ("y3", "x2", "s1", "self")} == {"y3": ["x3", "y1", "y2", "y3"], "x2": ["x2"], "s1": ["self", "s1"], "self": ["self"]}


def test_hierarchy_hub(spark):
    rows = [("root", None), *((f"k{k}", "root") for k in range(600)), *((f"g{k}", "k1") for k in range(600))]
    got = {x.node_id: (x.root_id, x.depth) for x in hierarchy.resolve(nodes(spark, rows)).collect()}
    assert got == solve(dict(rows))


def test_join_unique_keeps_all_rows(spark):
    left = spark.createDataFrame([("h",)] * 500 + [(f"x{k}",) for k in range(300)] + [(None,)], "k string")
    right = spark.createDataFrame([("h", 1), ("x1", 2)], "k string, v int")
    assert skew.hot_keys(left, "k") == ["h"]
    assert skew.join_unique(left, right, "k").count() == 501
    assert skew.join_unique(left, right, "k", "left").count() == 801


def test_resolved_path(spark):
    cases = {"a/b": "a/b", "./a//b": "a/b", "a\\b\\..\\c": "a/c", "a/./b/": "a/b", "/a/../b": "/b", "../a": "../a", "": "", None: None, "a/../../b": "../b", "/..": "/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.q for r in df.select("p", references.resolved_path(F.col("p")).alias("q")).collect()} == cases


EDGES = "edge_id long, repo string, source_id string, target_name string, edge_type string, target_file_hint string, seen_at timestamp, key string, state string, hint string"
NODES = "node_id string, file_path string, name string, parsed_at timestamp"


def day(n):
    return T0 + datetime.timedelta(days=n)


def test_orphans(spark):
    n = spark.createDataFrame([("a", "r/f.py", "foo", day(1)), ("a", "r/f.py", "foo", day(5)), ("late", "r/f.py", "bar", day(9)), (None, None, None, None)], NODES)
    f = spark.createDataFrame([("r/f.py", day(1)), (None, day(1))], "file_path string, parsed_at timestamp")
    gone = spark.createDataFrame([("node", "a", day(3)), ("file", "r/f.py", day(2)), ("node", None, day(1)), (None, "a", None)], "object_kind string, object_key string, removed_at timestamp")
    s = spark.createDataFrame([("log.debug", "p"), (None, "p")], "symbol string, package string")
    e = [
        (1, "r", "a", "x.foo", None, None, day(2)),  # fine
        (2, "r", "a", "foo", None, "r\\f.py", day(4)),  # source deleted, file deleted
        (3, "r", "a", "foo", None, "./r//f.py", day(6)),  # parsed again; file deleted
        (4, "r", "late", "nope", None, "", day(2)),  # late; name missing
        (5, "r", "none", "log.debug", None, "r/absent.py", day(2)),  # source missing, hint missing
        (6, "r", "a", "m.nope", None, "r/f.py", day(1)),  # name not in the file
        (7, "q", "a", "foo", None, None, day(1)),  # name of another repository
        (8, None, None, None, None, None, None),
        (9, "r", "none", None, None, None, None),
        (None, "r", "none", None, None, None, day(1)),
    ]
    edges = spark.createDataFrame([(*x, "k", "s", "h") for x in [*e, e[0]]], EDGES)
    found = references.orphans(edges, n, f, gone, s).cache()
    got = sorted((r.edge_id, r.ref_field, r.state) for r in found.collect())
    assert got == [
        (2, "source_id", "deleted"),
        (2, "target_file_hint", "deleted"),
        (3, "target_file_hint", "deleted"),
        (4, "source_id", "late"),
        (4, "target_name", "missing"),
        (5, "source_id", "missing"),
        (5, "target_file_hint", "missing"),
        (6, "target_name", "missing"),
        (7, "target_name", "missing"),
        (9, "source_id", "missing"),
    ]
    assert references.report(found, edges).agg(F.sum("n")).first()[0] == 10
    assert references.orphans(edges.limit(0), n, f, gone, s).count() == 0
    assert references.orphans(edges, n.limit(0), f.limit(0), gone.limit(0), s.limit(0)).filter("ref_field = 'target_name'").count() == 3


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_dangling_of_composite_keys(spark, match):
    r = random.Random(7)
    part = lambda: r.choice(["a", "b", "a|1:b", None])
    refs = [(k, part(), part(), part(), "clash") for k in range(120)] + [(None, "a", "a", "a", "clash")]
    targets = [(part(), part(), part()) for _ in range(12)]
    want = set()
    for k, *parts, _ in refs[:-1]:
        nulls = [p is None for p in parts]
        found = any(all(p is None or p == t for p, t in zip(parts, row)) for row in targets)
        if all(nulls) or (any(nulls) and match == "simple"):
            continue
        if (any(nulls) and match == "full") or not found:
            want.add(k)
    df = spark.createDataFrame(refs + refs[:5], "id long, x string, y string, z string, key string")
    to = spark.createDataFrame(targets, "x string, y string, z string")
    got = [x.id for x in references.dangling(df, to, ["x", "y", "z"], match).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert references.dangling(df.limit(0), to, ["x"], match).count() == 0
    assert references.dangling(df, to.limit(0), ["x"], "simple").count() == sum(x[1] is not None for x in refs[:-1])
    with pytest.raises(ValueError):
        references.rule("odd", 0, 1)


def test_as_of_against_brute_force(spark):
    """Most rows belong to one key, so its ranges hand their values on."""
    r = random.Random(8)
    key = lambda: bytearray(r.choice([b"h", b"h", b"h", b"a", b"z"]))
    events = [(key(), day(r.randint(0, 40)), r.choice([0, 0, 1])) for _ in range(400)]
    refs = [(k, 1, key(), day(r.randint(-1, 41))) for k in range(400)]
    last = lambda k, t, kind: max((at for e, at, n in events if e == k and n == kind and at <= t), default=None)
    want = {k: (last(x, t, 0), last(x, t, 1)) for k, _, x, t in refs}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = references.as_of(spark.createDataFrame(refs, "id long, field int, key binary, t timestamp"), spark.createDataFrame(events, "key binary, t timestamp, kind int")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 400 and {x.id: (x.p, x.r) for x in out} == want


SCANS = "scan_id long, repo string, file_path string, event_type string, content_hash string, observed_at timestamp, arrived_at timestamp, key string"
RUNS = "run_id int, cutoff_at timestamp, status string, logged_at timestamp"


def brute_runs(scans, runs):
    out, before = set(), None
    for run, cutoff in runs:
        state = {}
        for r in sorted((x for x in scans if x[6] <= cutoff and (x[4] is not None or x[3] == "deleted")), key=lambda x: (x[5], x[0])):
            state[r[2]] = r
        for path, r in state.items():
            if r[3] == "deleted":
                continue
            old = (before or {}).get(path)
            if old is None or old[3] == "deleted" or old[4] != r[4]:
                out.add((run, path, r[4]))
        before = state
    return out


def test_incremental(spark, tmp_path):
    r = random.Random(3)
    scans = []
    for k in range(300):
        at = T0 + datetime.timedelta(hours=r.randint(0, 400))
        event = r.choice(["created", "modified", "deleted", None])
        scans.append((k, "r", f"f{r.randint(0, 12)}", event, None if event == "deleted" or r.random() < 0.1 else f"h{r.randint(0, 4)}", at, at + datetime.timedelta(hours=r.randint(0, 60)), "x"))
    scans += r.sample(scans, 30)
    runs = [(k, T0 + datetime.timedelta(hours=25 * k), s, T0) for k, s in enumerate(["ok", "failed", "ok", "started", "ok", "ok", "ok", "rolled_back", "ok", "ok", "ok", "ok", "ok", "ok", "ok", "ok", "ok", "ok"], 1)]
    log = spark.createDataFrame([*runs, runs[0], (1, runs[0][1], "started", T0 - datetime.timedelta(1)), (None, None, None, None)], RUNS)
    good = incremental.successful_runs(log)
    assert [g[0] for g in good] == [k for k, _, s, _ in runs if s == "ok"]
    df = spark.createDataFrame([*scans, (None, None, None, None, None, None, None, None)], SCANS)
    want = brute_runs(scans, [(k, c) for k, c, s, _ in runs if s == "ok"])
    for size in (1, 100):  # runs per commit
        store = incremental.StateStore(spark, f"file://{tmp_path}/s{size}")
        got = [(x.run_id, x.file_path, x.content_hash) for x in incremental.process(df, good, store, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


class Crash(Exception):
    pass


@pytest.mark.parametrize("size", [1, 3, 24])
def test_incremental_survives_a_crash_anywhere(spark, tmp_path, monkeypatch, size):
    """Die before and behind every write and every swap in turn, run the same call again: no row lost, none twice."""
    monkeypatch.setattr(incremental, "COMPACT", 2)
    scans = [(k, "r", f"f{k % 3}", "deleted" if k == 7 else "modified", None if k == 7 else f"h{k // 2}", day(k), day(k), "x") for k in range(10)]
    df = spark.createDataFrame(scans, SCANS)
    runs = [(k, day(3 * k)) for k in range(1, 4)]
    want = brute_runs(scans, runs)
    for name in ("write", "put", "swap"):
        for behind in (False, True):
            for at in (1, 2) if size == 1 and name != "put" else (1,):
                store = incremental.StateStore(spark, f"file://{tmp_path}/{size}-{name}-{behind}-{at}")
                real, calls = getattr(store, name), []

                def dying(*args, real=real, calls=calls, at=at, behind=behind):
                    calls.append(1)
                    if len(calls) == at and not behind:
                        raise Crash
                    real(*args)
                    if len(calls) == at:
                        raise Crash

                setattr(store, name, dying)
                try:
                    incremental.process(df, runs, store, size)
                except Crash:
                    pass
                fresh = incremental.StateStore(spark, store.path)
                got = [tuple(x) for x in incremental.process(df, runs, fresh, size).collect()]
                assert len(got) == len(set(got)) and set(got) == want


def test_incremental_goes_on(spark, tmp_path):
    rows = [(k, "r", f"f{k}", "created", "h", day(k), day(k), "x") for k in range(6)]
    df = spark.createDataFrame([*rows, (9, "r", "f0", "created", "h", day(4), day(4), "x")], SCANS)
    store = incremental.StateStore(spark, f"file://{tmp_path}/s")
    names = lambda out: sorted((x.run_id, x.file_path) for x in out.collect())
    assert names(incremental.process(df, [(1, day(1))], store)) == [(1, "f0"), (1, "f1")]
    # not acknowledged: again, with what a later run adds
    assert names(incremental.process(df, [(1, day(1)), (2, day(3))], store)) == [(1, "f0"), (1, "f1"), (2, "f2"), (2, "f3")]
    store.acknowledge()
    assert names(incremental.process(df, [(1, day(1)), (2, day(3))], store)) == []
    store.acknowledge()
    # f0 was seen again with the same content
    assert names(incremental.process(df, [(2, day(3)), (3, day(5))], incremental.StateStore(spark, store.path))) == [(3, "f4"), (3, "f5")]
    with pytest.raises(ValueError):
        incremental.process(df, [(7, day(2))], store)
    assert names(incremental.process(df, [], store)) == [(3, "f4"), (3, "f5")]
    assert incremental.process(df.limit(0), [(4, day(9))], incremental.StateStore(spark, f"file://{tmp_path}/e")).count() == 0
