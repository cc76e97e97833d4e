"""Folder trees on every kind of path, and sequences in many tasks, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import jobs, library, scan, scenes, snapshots, throttle, tree
from millrace.plans import job_queries

LEAVES = [("/data/lib/a/1.mkv", True), ("/data/lib/a/2.mkv", True), ("/data/lib/b/3.mkv", False), ("/4.mkv", True), ("a/5.mkv", True), ("a/b/6.mkv", False), ("7.mkv", True)]


def leaves(spark, rows=None):
    return spark.createDataFrame(rows or LEAVES, "path string, checked boolean")


def folders(spark, *paths, name="folder"):
    return spark.createDataFrame([(p,) for p in paths], f"{name} string")


@pytest.mark.parametrize(("path", "normal", "folder", "depth"), [
    ("/", "/", None, 0), ("", "", None, 0), ("//", "/", None, 0), ("/a", "/a", "/", 1), ("a", "a", "", 1), ("a//b/", "a/b", "a", 2), ("//a///b//", "/a/b", "/a", 2), (".hidden/x", ".hidden/x", ".hidden", 2),
])
def test_normal_paths(spark, path, normal, folder, depth):
    row = spark.range(1).select(text.normal_path(F.lit(path)).alias("p")).select("p", text.folder_of(F.col("p")).alias("f"), text.depth_of(F.col("p")).alias("d")).first()
    assert tuple(row) == (normal, folder, depth)


def test_backslashes(spark):
    rows = spark.createDataFrame([("/lib/x//y/f.mkv", "q\\r", True), ("/f.mkv", "q", True), ("/lib/f.mkv", "a\\b/c", False), (None, None, None), ("/x/f", "\\a\\", False)], "i string, r string, s boolean")
    got = [r[0] for r in rows.select(tree.job_folder(F.col("i"), F.col("r"), F.col("s"))).collect()]
    assert got == ["lib/x/y", "", "a/b/c", "", "a"]


@pytest.mark.parametrize("root", ["/data/lib", "/data/lib/", "//data//lib"])
def test_paths_below_absolute_roots(spark, root):
    got = lambda *roots: sorted(r.path for r in tree.within(leaves(spark), folders(spark, *roots, name="root")).collect())
    below = [p for p, _ in LEAVES if p.startswith("/data/lib/")]
    assert got(root) == below
    assert got("/") == sorted(p for p, _ in LEAVES if p.startswith("/")) and got("") == sorted(p for p, _ in LEAVES if not p.startswith("/"))
    assert got("a", "/data/lib/a/1.mkv", "data") == ["/data/lib/a/1.mkv", "a/5.mkv", "a/b/6.mkv"]


def test_states_of_mixed_paths(spark):
    got = {r.folder: r.state for r in tree.check_states(leaves(spark)).collect()}
    assert got == {"/": "some", "/data": "some", "/data/lib": "some", "/data/lib/a": "all", "/data/lib/b": "none", "": "some", "a": "some", "a/b": "none"}
    assert sorted(r.path for r in tree.maximal_checked(leaves(spark)).collect()) == ["/4.mkv", "/data/lib/a", "7.mkv", "a/5.mkv"]
    checked = leaves(spark, [(p, True) for p, _ in LEAVES])
    assert sorted(r.path for r in tree.maximal_checked(checked).collect()) == ["", "/"]
    roots = folders(spark, "/data/lib", "a", name="root")
    assert sorted(r.path for r in tree.maximal_checked(checked, roots).collect()) == ["/4.mkv", "/data/lib", "7.mkv", "a"]
    after = {r.path: r.checked for r in tree.toggled(leaves(spark), folders(spark, "/data/lib/", "a/b")).collect()}
    assert after == {p: c and not p.startswith("/data/lib/") or p == "a/b/6.mkv" for p, c in LEAVES}


def test_counts_keep_the_root(spark):
    got = {r.folder: (r.total, r.one) for r in tree.recursive_counts(leaves(spark), one=F.col("checked")).collect()}
    assert got["/"] == (4, 3) and got["/data/lib"] == (3, 2) and got[""] == (3, 2) and got["a"] == (2, 1)
    assert sorted(map(tuple, tree.folder_tree(leaves(spark)).collect())) == [("/data", "/", "data"), ("/data/lib", "/data", "lib"), ("/data/lib/a", "/data/lib", "a"), ("/data/lib/b", "/data/lib", "b"), ("a", "", "a"), ("a/b", "a", "b")]


def test_walk_of_mixed_paths(spark):
    rows = [(1, "/b/x", 5), (2, "b/x", 1), (3, "/x", 9), (4, "x", 0), (5, "/a/x", 7), (6, "/b/c/x", 8), (7, "z/x", 6)]
    df = spark.createDataFrame([(i, p, "queued", o) for i, p, o in rows], "id int, path string, status string, queue_order bigint")
    places = {r.id: r.place for r in tree.depth_first_places(df).collect()}
    assert sorted(places, key=places.get) == [2, 6, 1, 5, 3, 7, 4] and sorted(places.values()) == list(range(1, 8))


def test_nested_sets_are_intervals(spark):
    rng = random.Random(3)
    paths = ["/" * (i % 2) + "/".join(rng.choice(["a", "a b", "b", "a.b", "é"]) for _ in range(rng.randint(1, 5))) + "/f" for i in range(60)]
    sets = {r.folder: r for r in tree.nested_sets(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    for a in sets.values():
        for b in sets.values():
            if a.folder.startswith("/") == b.folder.startswith("/"):
                inside = b.folder == a.folder or a.folder in ("", "/") or b.folder.startswith(a.folder + "/")
                assert inside == (a["first"] <= b["first"] <= a["last"])


def clicked(state, clicks):
    for _, target in sorted(clicks):
        below = [p for p in state if p == target or p.startswith(target.rstrip("/") + "/") or (target == "" and not p.startswith("/"))]
        to = not any(state[p] for p in below)
        state |= {p: to for p in below}
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_toggles_in_order(spark, seed):
    rng = random.Random(seed)
    paths = sorted({rng.choice(["/", ""]) + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{i}" for i in range(40)})
    state = {p: rng.random() < 0.4 for p in paths}
    targets = [*paths, *{p.rsplit("/", k)[0] or "/" for p in paths for k in (1, 2) if p.count("/") > k}, "/", "", "nowhere"]
    clicks = [(i, rng.choice(targets)) for i in range(20)]
    got = tree.toggled_in_order(leaves(spark, list(state.items())), spark.createDataFrame(clicks, "place bigint, path string"))
    assert {r.path: r.checked for r in got.collect()} == clicked(dict(state), clicks)


@pytest.mark.parametrize("seed", [3, 4])
def test_rounds_of_toggles_do_not_follow_the_clicks(spark, seed, monkeypatch):
    """Clicks of which each depends on all before: there are few folders, and those of some leaves are all clicked."""
    rng = random.Random(seed)
    paths = [f"/{a}/{b}/f{i}" for a in "xy" for b in "mn" for i in range(2)] + (["r/f", "s"] if seed % 2 else ["/x/g"])
    state = {p: rng.random() < 0.4 for p in paths}
    targets = [*paths, *paths, *{p.rsplit("/", 1)[0] for p in paths if "/" in p}, "/x", "/y", "/"]
    clicks = [(i, rng.choice(targets)) for i in range(200)]
    stores = []
    monkeypatch.setattr(tree, "stored", lambda df, label, store=tree.stored: stores.append(label) or store(df, label))
    got = tree.toggled_in_order(leaves(spark, list(state.items())), spark.createDataFrame(clicks, "place bigint, path string"))
    assert {r.path: r.checked for r in got.collect()} == clicked(dict(state), clicks)
    assert len(stores) < 40


def test_no_toggles(spark):
    assert sorted(map(tuple, tree.toggled_in_order(leaves(spark), spark.createDataFrame([], "place bigint, path string")).collect())) == sorted(LEAVES)


def test_running_sum_of_one_long_sequence(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("int").alias("video"), F.col("id").alias("frame"), (F.col("id") * 7919 % 13).alias("v"))
    summed = scan.running_sum(rows, "upto", F.col("v"), ["video"], {"_block": scan.block_of(F.col("frame"), 500)}, ["frame"])
    total, want = 0, []
    for i in range(20_000):
        total += i * 7919 % 13
        want.append(total)
    assert [r.upto for r in summed.orderBy("frame").collect()] == want
    assert summed.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


@pytest.mark.parametrize("scores", [[5.0], [1.0, 2.0], [3.0] * 9, [float(x * 37 % 101) / 3 for x in range(500)], [0.0, 0.0, 99.0], [1e-9 * i for i in range(40)]])
def test_percentile_by_ranks(spark, scores):
    rows = spark.createDataFrame([("v", s) for s in scores] + [(None, s + 1) for s in scores], "video string, score double")
    got = {r.video: r.p15 for r in scenes.score_stats(rows, ["video"]).collect()}
    want = lambda xs: xs[0] if len(xs) == 1 else statistics.quantiles(xs, n=100)[14]
    assert got["v"] == pytest.approx(want([min(s, 100) for s in scores])) and got[None] == pytest.approx(want([min(s + 1, 100) for s in scores]))


def passes(events, least):
    last, kept = {}, []
    for key, at, tie in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in last or at - last[key] >= least:
            last[key] = at
            kept.append((key, tie))
    return sorted(kept)


@pytest.mark.parametrize("block", [None, 7, 50])
def test_exact_throttle(spark, block):
    rng = random.Random(4)
    events = [(rng.choice("ab"), rng.randint(0, 400), i) for i in range(300)] + [("c", 5, 900), ("d", 0, 901), ("d", 10, 902), ("d", 9, 903)] + [("e", 1_000 * i, 1_000 + i) for i in range(40)]
    got = throttle.throttled(spark.createDataFrame(events, "key string, at bigint, tie bigint"), ["key"], "at", "tie", 10, block)
    assert sorted((r.key, r.tie) for r in got.collect()) == passes(events, 10)


def test_edits_in_order_equal_plain_python(spark, small):
    got = {r.id: r.new_order for r in job_queries.edits_in_order(spark, small).collect()}
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").collect()
    queues, everyone = {}, {}
    for key, queue, status in orders:
        everyone.setdefault(queue, []).append(key)
        if status == "O":
            queues.setdefault(queue, {})[key] = key
    for key, queue, _ in sorted(orders):
        held = queues.get(queue, {})
        kind = "reorder" if key % 13 == 0 else "slots" if key % 11 == 0 else ("up", "down", "top", "bottom")[key % 4]
        listed = [k for k in sorted(everyone[queue], key=lambda k: (k * 7919 % 10007, k)) if k in held]
        ranked = sorted(held, key=lambda k: (held[k], k))
        if kind == "reorder":
            held |= {k: i for i, k in enumerate(listed, 1)}
        elif kind == "slots":
            held |= dict(zip(listed, sorted(held[k] for k in listed), strict=True))
        elif key in held:
            at = ranked.index(key)
            if kind == "top" and at:
                held[key] = held[ranked[0]] - 1
            elif kind == "bottom" and at + 1 < len(ranked):
                held[key] = held[ranked[-1]] + 1
            elif kind == "up" and at:
                held[key], held[ranked[at - 1]] = held[ranked[at - 1]], held[key]
            elif kind == "down" and at + 1 < len(ranked):
                held[key], held[ranked[at + 1]] = held[ranked[at + 1]], held[key]
    assert got == {k: v for held in queues.values() for k, v in held.items()}
    assert jobs.by_id(spark.createDataFrame([(1,), (2,)], "id int"), 2).count() == 1


def test_edits_of_many_queues_equal_one_by_one(spark):
    """Reorders of a whole queue, of a part of it and by the listing that edits share; equal orders; queues without edits, jobs or a name."""
    rng = random.Random(6)
    queued = [(q, f"{q}{i}", rng.randint(-3, 9)) for q in ("a", "b", "c", None) for i in range(12)] + [("quiet", "x", 4), ("one", "y", 5)]
    names = {q: [i for p, i, _ in queued if p == q] for q, _, _ in queued}
    listing = [(q, k, i) for q in ("a", None) for k, i in enumerate(rng.sample(names[q], 12))] + [("b", k, i) for k, i in enumerate(["no", *names["b"][3:8]])] + [("nobody", 1, "z")]
    edits = [("one", 1, "top", "y", None), ("one", 2, "reorder", None, ["q", "y"]), ("nobody", 1, "up", "z", None)]
    for q in ("a", "b", "c", None):
        for k in range(60):
            kind = rng.choice(["up", "down", "top", "bottom"] * 3 + ["reorder", "slots"])
            ids = rng.choice([None, [], rng.sample(names[q], 5), ["no", *rng.sample(names[q], 12)]])
            edits.append((q, k, kind, rng.choice([*names[q], "no"]), ids))
    schema = "queue string, place int, kind string, id string, ids array<string>"
    for shared in ([], listing):
        held = {q: {i: o for p, i, o in queued if p == q} for q in names}
        for q, _, kind, target, ids in sorted(edits, key=lambda e: (str(e[0]), e[1])):
            orders = held.get(q, {})
            ranked = sorted(orders, key=lambda i: (orders[i], i))
            known = [i for i in (ids if ids is not None else [i for p, _, i in shared if p == q]) if i in orders]
            if kind in ("reorder", "slots"):
                orders |= dict(zip(known, range(1, len(known) + 1) if kind == "reorder" else sorted(orders[i] for i in known), strict=True))
            elif target in orders:
                at = ranked.index(target)
                other = at - 1 if kind == "up" else at + 1
                if kind in ("up", "down") and 0 <= other < len(ranked):
                    orders[target], orders[ranked[other]] = orders[ranked[other]], orders[target]
                elif kind == "top" and at:
                    orders[target] = orders[ranked[0]] - 1
                elif kind == "bottom" and at + 1 < len(ranked):
                    orders[target] = orders[ranked[-1]] + 1
        got = jobs.edited_in_order(
            spark.createDataFrame(queued, "queue string, id string, queue_order int"), spark.createDataFrame(edits, schema),
            listing=spark.createDataFrame(shared, "queue string, place int, id string") if shared else None,
        )
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((q, i, o, held[q][i]) for q, i, o in queued), key=str)


def test_snapshots(spark):
    schema = "id int, a string, b double"
    before = spark.createDataFrame([(1, "x", 1.0), (2, None, 2.0), (3, "z", None), (4, "w", 4.0)], schema)
    after = spark.createDataFrame([(1, "x", 1.0), (2, "y", 3.0), (3, "z", None), (5, "v", 5.0)], schema)
    assert sorted((r.id, r.change, r.columns) for r in snapshots.difference(before, after, "id").collect()) == [(2, "changed", ["a", "b"]), (4, "removed", []), (5, "added", [])]
    assert snapshots.same(before, before.orderBy(F.desc("id")).repartition(3)) and not snapshots.same(before, after)
    assert not snapshots.same(before, before.union(before)) and snapshots.same(before.limit(0), after.limit(0))


def test_collated_names(spark):
    names = ["zeta", "été", "Ep 10", "ep 9", "Éa", "a", "b", "Z"]
    rows = spark.createDataFrame([(n, n == "Z") for n in names], "n string, folder boolean")
    got = [r.n for r in rows.orderBy(library.listing_key(F.col("n"), F.col("folder"))).collect()]
    assert got == ["Z", "a", "b", "Éa", "ep 9", "Ep 10", "été", "zeta"]
