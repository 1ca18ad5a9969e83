"""Writes, merging, deltas of tracked queries, procedures."""

import json
import pathlib
import random

import pyspark
import pytest

from tests.test_queries import CATALOG, ROWS
from tideframe.builder import Optimistic, Session
from tideframe.operators.merge import LOG_SCHEMA, Overlaid, accepted, fold, log_rows
from tideframe.procedures import Hooks, InvalidInput, OneShot, Procedures, fields
from tideframe.sources.tables import Files, Frames, Jdbc
from tideframe.streaming.live import LiveQueries, write_stream
from tideframe.streaming.scope import applied, deltas


@pytest.fixture(scope="module")
def base(spark):
    return Frames.of_rows(spark, CATALOG, ROWS)


def log(spark, *writes):
    """(collection, values, ts[, seq]) as log rows."""
    rows = [r for n, (name, values, ts, *seq) in enumerate(writes) for r in log_rows(CATALOG[name], values, ts, seq[0] if seq else n)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_last_writer_wins(spark, base):
    got = Overlaid(CATALOG, base, log(
        spark,
        ("posts", {"id": "1", "likes": 31.0, "title": "new"}, "2024-02-01T00:00:00Z"),
        ("posts", {"id": "1", "likes": 7.0}, "2024-01-01T00:00:00Z"),
        ("posts", {"id": "2", "title": "first"}, "2024-01-01T00:00:00Z"),
        ("posts", {"id": "2", "title": "second"}, "2024-01-01T00:00:00Z"),
        ("posts", {"id": "3", "title": None}, "2024-01-01T00:00:00Z"),
        ("posts", {"id": "9", "title": "fresh"}, "2024-01-01T00:00:00Z"),
        ("posts", {"id": "4", "likes": "many"}, "2024-01-01T00:00:00Z"),
    ))["posts"]
    rows = {r["id"]: r for r in got.collect()}
    assert (rows["1"]["likes"], rows["1"]["title"]) == (31.0, "new")
    assert rows["2"]["title"] == "second" and rows["3"]["title"] is None
    assert rows["9"]["title"] == "fresh" and rows["9"]["likes"] is None
    assert rows["4"]["likes"] is None and len(rows) == 5


def test_fold_ignores_order_and_repeats(spark):
    writes = [("posts", {"id": str(i % 3), "likes": float(i)}, f"2024-01-{1 + i % 9:02d}", i) for i in range(20)]
    want = fold(log(spark, *writes), CATALOG["posts"]).orderBy("key").collect()
    random.Random(1).shuffle(writes)
    assert fold(log(spark, *writes, *writes[:5]), CATALOG["posts"]).orderBy("key").collect() == want


def test_accepted(spark):
    stored = log(spark, ("posts", {"id": "1", "likes": 1.0}, "b"))
    got = accepted(stored, log(spark, ("posts", {"id": "1", "likes": 2.0}, "a", 1), ("posts", {"id": "1", "likes": 3.0}, "b", 2), ("posts", {"id": "1", "likes": 4.0}, None, 3)))
    assert {r["value"] for r in got.where("field = 'likes'").collect()} == {"3.0", "4.0"}


def test_session_writes_and_transactions(spark, base):
    hooks = Hooks().on("before_insert", "posts", lambda r: {**r, "title": r["title"].strip()}).on("before_update", "posts", lambda r: None)
    db = Session(spark, CATALOG, base, hooks)
    told = []
    db.listeners.append(lambda df: told.append(df.count()))
    made = db.insert("posts", {"title": " Eps ", "authorId": "carol", "likes": 1.0})
    assert db.posts.one(made["id"]).get()["title"] == "Eps"
    with db.transaction():
        db.update("posts", "1", {"likes": 99.0})
        with db.transaction():
            db.update("posts", "2", {"likes": 98.0})
        assert db.posts.where({"likes": {"$gt": 90}}).count() == 2 and not told[1:]
    assert db.posts.where({"likes": {"$gt": 90}}).count() == 2 and len(told) == 2
    with pytest.raises(RuntimeError), db.transaction():
        db.update("posts", "1", {"likes": 0.0})
        assert db.posts.one("1").get()["likes"] == 0.0
        raise RuntimeError
    assert db.posts.one("1").get()["likes"] == 99.0
    with pytest.raises(ValueError):
        db.update("posts", "1", {"nope": 0})


def test_update_hooks_see_the_row(spark, base):
    seen = []
    hooks = Hooks().on("before_update", "posts", lambda r: {**r, "title": f"{r['title']} ({r['likes']:.0f})"}).on("after_update", "posts", lambda r: seen.append(r))
    db = Session(spark, CATALOG, base, hooks)
    db.update("posts", "1", {"likes": 31.0})
    row = db.posts.one("1").get()
    assert (row["title"], row["likes"], row["status"]) == ("Alpha (31)", 31.0, "published") and seen[0]["authorId"] == "alice"
    db = Session(spark, CATALOG, base)
    db.update("posts", "new", {"likes": 2.0})
    assert db.posts.one("new").get()["likes"] == 2.0 and db.posts.one("new").get()["title"] is None


def test_many_writes_keep_the_plan_small(spark, base):
    db = Session(spark, CATALOG, base)
    for n in range(900):
        db.update("posts", str(n), {"likes": float(n), "title": "t"})
    assert db.log._jdf.queryExecution().logical().toString().count("Union") <= 3
    assert db.posts.where({"title": "t"}).count() == 900


def test_overlay_plan(spark, base):
    """Base tables are never joined whole with the log from both sides, and a query of keys reaches the base's scan."""
    laid = Overlaid(CATALOG, base, log(spark, ("posts", {"id": "1", "likes": 31.0}, "t")))["posts"]
    assert "FullOuter" not in laid._jdf.queryExecution().optimizedPlan().toString()


def test_optimistic(spark, base):
    db = Optimistic(spark, CATALOG, base)
    db.propose("a", lambda s: s.update("posts", "1", {"likes": 31.0}, ts="2024-01-01"))
    db.propose("b", lambda s: s.update("posts", "1", {"likes": 32.0}, ts="2024-01-02"))
    assert db.posts.one("1").get()["likes"] == 32.0
    db.reject("b")
    assert db.posts.one("1").get()["likes"] == 31.0
    db.confirm("a")
    assert db.posts.one("1").get()["likes"] == 31.0 and not db.replay()


WINDOWS = {
    "window": lambda s: s.posts.order_by("likes", "desc").limit(2),
    "filtered window": lambda s: s.posts.where({"likes": {"$gte": 8}}).order_by("likes", "desc").limit(2),
    "plain": lambda s: s.posts.where({"status": "published"}),
    "relational": lambda s: s.posts.where({"author": {"org": {"name": "acme"}}}),
    "relational order": lambda s: s.posts.order_by("author.name").limit(2),
    "per parent": lambda s: s.users.include({"posts": {"order_by": [("likes", "desc")], "limit": 1}}),
    "nested": lambda s: s.orgs.include({"users": {"posts": {"where": {"likes": {"$gt": 10}}}}}),
}


def delta_rows(spark, base, query, *writes):
    entries = log(spark, *writes)
    touched = {n: entries.where(f"resource = '{n}'").select("id").distinct() for n in {w[0] for w in writes}}
    got = deltas(CATALOG, query(Session(spark, CATALOG, base)).request, base, Overlaid(CATALOG, base, entries), touched)
    return sorted((r["op"], r["path"], r["parent"], r["id"], tuple(sorted(r["payload"]))) for r in got.collect())


def brief(rows):
    return [(op, id_) for op, _, _, id_, _ in rows]


def test_window_deltas(spark, base):
    window = WINDOWS["window"]
    assert brief(delta_rows(spark, base, window, ("posts", {"id": "5", "likes": 40.0}, "t"))) == [("DELETE", "1"), ("INSERT", "5")]
    assert brief(delta_rows(spark, base, window, ("posts", {"id": "1", "likes": 1.0}, "t"))) == [("DELETE", "1"), ("INSERT", "3")]
    assert delta_rows(spark, base, window, ("posts", {"id": "1", "title": "x"}, "t")) == [("UPDATE", "", None, "1", ("title",))]
    assert brief(delta_rows(spark, base, window, ("posts", {"id": "2", "likes": 6.0}, "t"))) == []
    assert brief(delta_rows(spark, base, WINDOWS["filtered window"], ("posts", {"id": "4", "likes": 1.0}, "t"))) == [("DELETE", "4"), ("INSERT", "3")]


def test_scope_deltas(spark, base):
    assert brief(delta_rows(spark, base, WINDOWS["plain"], ("posts", {"id": "1", "status": "draft"}, "t"), ("posts", {"id": "2", "status": "published"}, "t"))) == [("DELETE", "1"), ("INSERT", "2")]
    assert brief(delta_rows(spark, base, WINDOWS["relational"], ("users", {"id": "bob", "orgId": "acme"}, "t"))) == [("INSERT", "3"), ("INSERT", "4")]
    assert brief(delta_rows(spark, base, WINDOWS["relational order"], ("users", {"id": "alice", "name": "Zoe"}, "t"))) == [("DELETE", "1"), ("DELETE", "2"), ("INSERT", "3"), ("INSERT", "4")]
    assert brief(delta_rows(spark, base, WINDOWS["relational order"], ("users", {"id": "alice", "name": "Al"}, "t"))) == []


def test_per_parent_deltas(spark, base):
    got = delta_rows(spark, base, WINDOWS["per parent"], ("posts", {"id": "4", "authorId": "alice"}, "t"))
    assert [(op, parent, id_) for op, _, parent, id_, _ in got] == [("DELETE", "alice", "1"), ("DELETE", "bob", "4"), ("INSERT", "alice", "4"), ("INSERT", "bob", "3")]
    # Child before parent in one batch.
    got = delta_rows(spark, base, WINDOWS["nested"], ("posts", {"id": "7", "authorId": "eve", "likes": 11.0}, "t"), ("users", {"id": "eve", "orgId": "acme"}, "t"))
    assert [(op, path, parent, id_) for op, path, parent, id_, _ in got] == [("INSERT", "users", "acme", "eve"), ("INSERT", "users.posts", "eve", "7")]


def test_random_writes_replay(spark, base):
    """Old rows with the deltas applied are the new rows, with and without the shortcut over affected roots."""
    rng = random.Random(4)
    users, posts = ["alice", "bob", "carol", "eve"], list("12345678")
    for _ in range(2):
        writes = []
        for _ in range(6):
            if rng.random() < 0.3:
                writes.append(("users", {"id": rng.choice(users), "orgId": rng.choice(["acme", "globex", None]), "name": rng.choice("xyz")}, "t"))
            else:
                writes.append(("posts", {"id": rng.choice(posts), "likes": float(rng.randrange(60)), "authorId": rng.choice(users), "status": rng.choice(["draft", "published"])}, "t"))
        entries = log(spark, *writes)
        after = Frames({n: spark.createDataFrame(df.collect(), df.schema) for n, df in Overlaid(CATALOG, base, entries).items()})
        touched = {n: entries.where(f"resource = '{n}'").select("id").distinct() for n in ("users", "posts")}
        for make in WINDOWS.values():
            request = make(Session(spark, CATALOG, base)).request
            short = deltas(CATALOG, request, base, after, touched)
            key = lambda r: (r["op"], r["path"], r["parent"] or "", r["id"], sorted(r["payload"].items(), key=str))
            assert sorted(map(key, short.collect()), key=str) == sorted(map(key, deltas(CATALOG, request, base, after).collect()), key=str)
            if not request.include:
                want = sorted(map(tuple, planned(spark, after, request).collect()), key=str)
                assert sorted(map(tuple, applied(planned(spark, base, request), short, CATALOG[request.resource]).collect()), key=str) == want


def planned(spark, tables, request):
    from tideframe.plans.planner import plan

    return plan(CATALOG, tables, request)


def test_stream_of_writes(spark, base, tmp_path):
    live = LiveQueries(spark, CATALOG, base, str(tmp_path / "live"))
    seen = []
    db = Session(spark, CATALOG, base)
    stop = db.posts.order_by("likes", "desc").limit(2).subscribe(live, lambda df: seen.extend((r["op"], r["id"]) for r in df.orderBy("op").collect()))
    live.track(db.users.request, lambda df: 1 / 0)
    writes = tmp_path / "writes"
    writes.mkdir()
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    for n, likes in enumerate((40.0, 60.0)):
        rows = log_rows(CATALOG["posts"], {"id": str(5 + n), "likes": likes}, f"2024-01-0{n + 1}", n)
        (writes / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
        live.start(write_stream(spark, str(writes)), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen[:2]) == [("INSERT", "1"), ("INSERT", "4")] and seen[2:] == [("DELETE", "1"), ("INSERT", "5"), ("DELETE", "5"), ("INSERT", "6")]
    key = db.posts.order_by("likes", "desc").limit(2).request.key()
    assert [r["id"] for r in live.result(key).collect()] == ["6", "4"]
    # A batch that runs again gives the same deltas.
    again = spark.createDataFrame(spark.read.parquet(str(tmp_path / "live/log/batch=1")).collect(), LOG_SCHEMA)
    assert sorted((r["op"], r["id"]) for r in live.process(again, 1).collect()) == [("DELETE", "5"), ("INSERT", "6")]
    live.compact(1 << 62, str(tmp_path / "base"))
    assert Files(spark, CATALOG, str(tmp_path / "base"))["posts"].count() == 6
    stop()
    assert key not in live.requests


def test_folded_log(spark, base, tmp_path):
    """Folds of the log change nothing: deltas and results are those of the whole log, also for a batch that runs again."""
    rng, seen = random.Random(8), {}
    batches = [[("posts", {"id": rng.choice("1234567"), "likes": float(rng.randrange(50)), "status": rng.choice(["draft", "published"])}, f"2024-01-{rng.randrange(1, 9):02d}", 10 * n + k) for k in range(3)] for n in range(5)]
    for every in (2, 100):
        live = LiveQueries(spark, CATALOG, base, str(tmp_path / f"live-{every}"), fold_every=every)
        key = live.track(Session(spark, CATALOG, base).posts.where({"status": "published"}).request)
        told = [sorted((r["op"], r["id"], tuple(sorted(r["payload"].items(), key=str))) for r in live.process(log(spark, *batch), n).collect()) for n, batch in enumerate(batches)]
        assert told[-1] == sorted((r["op"], r["id"], tuple(sorted(r["payload"].items(), key=str))) for r in live.process(log(spark, *batches[-1]), 4).collect())
        seen[every] = told, sorted(map(str, live.result(key).collect()))
        assert live._folds() == ([2, 4] if every == 2 else []) or sorted(live._folds()) == [2, 4]
    assert seen[2] == seen[100]


def test_procedures(spark, base):
    db, calls = Session(spark, CATALOG, base), []
    api = Procedures().use(lambda r, then: (calls.append("outer"), then(r))[1]).use(lambda r, then: (calls.append("inner"), then(r))[1])
    api.query("top", fields(n=int))(lambda s, data, ctx: s.posts.order_by("likes", "desc").limit(data["n"]))
    api.query("count")(lambda s, data, ctx: s.posts.count())
    api.mutation("like", fields(id=str))(lambda s, data, ctx: s.update("posts", data["id"], {"likes": 77.0}))
    assert [r["id"] for r in api.call_query(db, "top", {"n": 1}).collect()] == ["4"] and calls == ["outer", "inner"]
    assert api.call_query(db, "count") == 4
    api.call_mutation(db, "like", {"id": "2"})
    assert db.posts.one("2").get()["likes"] == 77.0
    with pytest.raises(InvalidInput, match="n: must be int"):
        api.call_query(db, "top", {"n": "x"})
    with pytest.raises(OneShot):
        api.subscribe(db, None, "count", print)
    with pytest.raises(KeyError):
        api.call_query(db, "nope")


def test_jdbc(spark, base, tmp_path):
    """Tables of a database; what a query asks of fields is asked of the database."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    if not list((pathlib.Path(pyspark.__file__).parent / "jars").glob("derby-*.jar")):
        pytest.skip("no database")
    for name in ("orgs", "users", "posts"):
        base[name].na.fill("").write.format("jdbc").options(url=url, dbtable=name, driver=driver, createTableColumnTypes=", ".join(f"{n} VARCHAR(40)" for n, t in base[name].dtypes if t == "string")).save()
    db = Session(spark, CATALOG, Jdbc(spark, CATALOG, url, driver=driver))
    assert sorted(r["id"] for r in db.posts.where({"author": {"role": "admin"}}).get()) == ["1", "2"]
    plan = db.posts.where({"likes": {"$gt": 10}}).df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(likes" in plan.split("PushedFilters")[1]


def test_checks(spark):
    from tideframe.schema import Catalog, Collection, Field, mismatches, one
    from tideframe.sources.checks import duplicates, invalid, orphans

    catalog = Catalog(
        Collection("a", {"id": Field("id"), "mail": Field("string", unique=True), "kind": Field("enum", values=("x", "y")), "name": Field("string", null=False), "up": Field("reference", references="a")}),
        Collection("b", {"id": Field("id"), "aId": Field("reference")}, relations={"a": one("a", "aId")}),
    )
    rows = [{"id": "1", "mail": "m", "kind": "x", "name": "n", "up": None}, {"id": "2", "mail": "m", "kind": "z", "name": None, "up": "9"}, {"id": "2", "mail": None, "kind": None, "name": "n", "up": "1"}]
    tables = Frames.of_rows(spark, catalog, {"a": rows, "b": [{"id": "1", "aId": "2"}, {"id": "2", "aId": "5"}, {"id": "3", "aId": None}]})
    assert sorted(map(tuple, duplicates(catalog, tables, "a").collect())) == [("id", "2", 2), ("mail", "m", 2)]
    assert [tuple(r) for r in orphans(catalog, tables, "b").collect()] == [("aId", "2", "5")] and [tuple(r) for r in orphans(catalog, tables, "a").collect()] == [("up", "2", "9")]
    assert sorted(map(tuple, invalid(catalog, tables, "a").collect())) == [("kind", "2", "z"), ("name", "2", None)]
    assert invalid(catalog, tables, "b").collect() == []
    assert mismatches(spark.createDataFrame([(1,)], "id long"), catalog["b"]) == ["aId: missing", "id: bigint, declared string"]


def test_sources(spark, base, tmp_path):
    for format in ("parquet", "json", "csv", "orc"):
        for name, df in base.items():
            df.write.format(format).save(f"{tmp_path}/{format}/{name}.{format}", **({"header": True} if format == "csv" else {}))
        files = Files(spark, CATALOG, f"{tmp_path}/{format}", format, **({"header": True} if format == "csv" else {}))
        assert Session(spark, CATALOG, files).posts.where({"author": {"role": "admin"}}).count() == 2
    assert Session(spark, CATALOG, Frames.empty(spark, CATALOG)).users.include({"posts": True}).get() == []
    narrow = Frames.evolve(CATALOG, {"orgs": spark.createDataFrame([("a",)], "id string"), "users": base["users"], "posts": base["posts"]})
    assert narrow["orgs"].first()["name"] is None
