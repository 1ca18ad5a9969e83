"""Query use cases on a small fixture: organisations, users, posts."""

import json
import random

import pytest

from tideframe.builder import QueryBuilder, Session
from tideframe.plans.planner import request_from_json
from tideframe.plans.request import QueryRequest, SortKey, dependencies, merged_where, relations_in, sub_query
from tideframe.schema import Catalog, Collection, Field, many, one
from tideframe.sources.tables import Frames

ID, TEXT, NUMBER = Field("id", null=False), Field("string"), Field("number")
CATALOG = Catalog(
    Collection("orgs", {"id": ID, "name": TEXT}, relations={"users": many("users", "orgId")}),
    Collection("users", {"id": ID, "name": TEXT, "role": TEXT, "age": NUMBER, "bio": TEXT, "orgId": Field("reference")}, relations={"org": one("orgs", "orgId"), "posts": many("posts", "authorId")}),
    Collection("posts", {"id": ID, "title": TEXT, "authorId": Field("reference"), "editorId": Field("reference"), "status": TEXT, "likes": NUMBER, "createdAt": NUMBER}, relations={"author": one("users", "authorId"), "editor": one("users", "editorId")}),
)
ROWS = {
    "orgs": [{"id": "acme", "name": "acme"}, {"id": "globex", "name": "globex"}],
    "users": [
        {"id": "alice", "name": "Alice", "role": "admin", "age": 35.0, "bio": "founder", "orgId": "acme"},
        {"id": "bob", "name": "Bob", "role": "member", "age": 28.0, "bio": None, "orgId": "globex"},
        {"id": "carol", "name": "Carol", "role": "guest", "age": 42.0, "bio": "lurker", "orgId": "globex"},
        {"id": "dan", "name": "Dan", "role": "guest", "age": None, "bio": None, "orgId": "nowhere"},
    ],
    "posts": [
        {"id": "1", "title": "Alpha", "authorId": "alice", "editorId": "bob", "status": "published", "likes": 30.0, "createdAt": 1000.0},
        {"id": "2", "title": "Beta", "authorId": "alice", "editorId": None, "status": "draft", "likes": 5.0, "createdAt": 2000.0},
        {"id": "3", "title": "Gamma", "authorId": "bob", "editorId": "alice", "status": "published", "likes": 15.0, "createdAt": 3000.0},
        {"id": "4", "title": "Delta", "authorId": "bob", "editorId": "bob", "status": "archived", "likes": 50.0, "createdAt": 4000.0},
    ],
}


@pytest.fixture(scope="module")
def db(spark):
    return Session(spark, CATALOG, Frames.of_rows(spark, CATALOG, ROWS))


def ids(query):
    return [r["id"] for r in query.get()]


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"status": "published"}, "13"),
        ({"status": {"$in": ["draft", "archived"]}}, "24"),
        ({"status": {"$in": []}}, ""),
        ({"status": {"$not": "published"}}, "24"),
        ({"status": {"$not": {"$in": ["draft", "archived"]}}}, "13"),
        ({"likes": {"$gt": 15}}, "14"),
        ({"likes": {"$lt": 15}}, "2"),
        ({"likes": {"$gte": 15}}, "134"),
        ({"likes": {"$lte": 15}}, "23"),
        ({"likes": {"$not": {"$gt": 15}}}, "23"),
        ({"likes": {"$gte": 10, "$lte": 40}}, "13"),
        ({"$and": [{"likes": {"$gte": 10}}, {"likes": {"$lte": 40}}]}, "13"),
        ({"$or": [{"status": "draft"}, {"likes": {"$gt": 40}}]}, "24"),
        ({"status": "published", "$or": [{"likes": 15.0}, {"likes": 5.0}]}, "3"),
        ({"author": {"role": "admin"}}, "12"),
        ({"author": {"org": {"name": "acme"}}}, "12"),
        ({"author": {"org": {"name": "globex"}}}, "34"),
        ({"author": {"name": "Bob"}, "editor": {"name": "Alice"}}, "3"),
        ({"$or": [{"author": {"name": "Alice"}}, {"editor": {"name": "Alice"}}]}, "123"),
        ({"editor": {"id": None}}, "2"),
        ({"author": {"posts": {"status": "archived"}}}, "34"),
        ({}, "1234"),
    ],
)
def test_where_posts(db, where, want):
    assert sorted(ids(db.posts.where(where))) == list(want)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"bio": None}, ["bob", "dan"]),
        ({"bio": {"$not": None}}, ["alice", "carol"]),
        ({"posts": {"status": "published"}}, ["alice", "bob"]),
        ({"posts": {}}, ["alice", "bob"]),
        ({"posts": {"$not": {"status": "published"}}}, ["carol", "dan"]),
        ({"$or": [{"posts": {"likes": {"$gt": 40}}}, {"role": "admin"}]}, ["alice", "bob"]),
        ({"$or": [{"posts": {"$not": {"likes": {"$gt": 0}}}}, {"role": "admin"}]}, ["alice", "carol", "dan"]),
        ({"age": {"$gt": 0}}, ["alice", "bob", "carol"]),
        ({"org": {"name": {"$not": "acme"}}}, ["bob", "carol"]),
        ({"name": {"$istartsWith": "c"}}, ["carol"]),
    ],
)
def test_where_users(db, where, want):
    assert sorted(ids(db.users.where(where))) == want


def test_orders_and_limits(db):
    assert ids(db.posts.order_by("likes")) == list("2314")
    assert ids(db.posts.order_by("likes", "desc")) == list("4132")
    assert ids(db.posts.order_by("status").order_by("createdAt", "desc")) == list("4231")
    assert ids(db.posts.order_by("createdAt").limit(2)) == list("12")
    assert ids(db.posts.limit(0)) == []
    assert ids(db.users.order_by("age")) == ["dan", "bob", "alice", "carol"]
    assert ids(db.users.order_by("age", "desc")) == ["carol", "alice", "bob", "dan"]
    assert ids(db.users.order_by("age", nulls="last")) == ["bob", "alice", "carol", "dan"]
    assert ids(db.posts.order_by("editor.name").order_by("id")) == list("2314")
    assert ids(db.posts.order_by("author.org.name", "desc").limit(3)) == list("341")


def test_terminals(db):
    assert db.posts.one("3").get()["title"] == "Gamma"
    assert db.posts.one("9").get() is None
    assert db.posts.where({"status": "draft"}).first({"likes": 50.0}).get()["id"] == "4"
    assert db.posts.where({"likes": 5.0}).where({"likes": 50.0}).count() == 1
    assert db.posts.where({"likes": 5.0}).and_where({"status": "published"}).exists() is False


def test_pages_by_key_meet_every_row_once(db):
    for key, direction in (("age", "asc"), ("age", "desc"), ("role", "asc"), ("bio", "desc")):
        whole = ids(db.users.order_by(key, direction).order_by("id"))
        seen, cursor = [], None
        while True:
            q = db.users.order_by(key, direction)
            rows, cursor = (q if cursor is None else q.after(*cursor)).page(1)
            seen += [r["id"] for r in rows]
            if cursor is None:
                break
        assert seen == whole


def test_pages_by_related_fields(db):
    for key, direction in (("author.name", "asc"), ("editor.name", "desc"), ("author.org.name", "asc")):
        for include in ({}, {"author": True}):
            whole = ids(db.posts.order_by(key, direction).order_by("likes"))
            seen, cursor = [], None
            while True:
                q = db.posts.order_by(key, direction).order_by("likes").include(include)
                rows, cursor = (q if cursor is None else q.after(*cursor)).page(1)
                assert all(("author" in r) == bool(include) and not any(f.startswith("__") for f in r.__fields__) for r in rows)
                seen += [r["id"] for r in rows]
                if cursor is None:
                    break
            assert seen == whole


def test_field_named_key(spark):
    """A field may be called as the engine's own columns once were."""
    catalog = Catalog(Collection("a", {"id": ID, "key": TEXT}, relations={"bs": many("b", "key")}), Collection("b", {"id": ID, "key": TEXT}, relations={"a": one("a", "key")}))
    db = Session(spark, catalog, Frames.of_rows(spark, catalog, {"a": [{"id": "1", "key": "x"}, {"id": "2", "key": "y"}], "b": [{"id": "7", "key": "1"}]}))
    assert ids(db.a.where({"bs": {"id": "7"}})) == ["1"] and ids(db.a.where({"bs": {"$not": {"id": "7"}}})) == ["2"]
    assert sorted(ids(db.a.where({"$or": [{"bs": {"key": "1"}}, {"key": "y"}]}))) == ["1", "2"]
    assert ids(db.b.where({"a": {"bs": {"key": "1"}}})) == ["7"]


def test_requests_read_back(db):
    """Every request, written as JSON text and read back, is the same request."""
    rng = random.Random(2)
    where = lambda: rng.choice([{}, {"likes": {"$gt": 3}}, {"$or": [{"status": "x"}, {"likes": None}]}])
    order = lambda keys: tuple(SortKey(rng.choice(keys), rng.choice(["asc", "desc"]), rng.choice([None, "first", "last"])) for _ in range(rng.randrange(3)))
    for _ in range(100):
        posts = {"where": where(), "order_by": list(order(["likes", "title"])), "limit": rng.choice([None, 2]), "offset": rng.randrange(2), "include": rng.choice([{}, {"author": True}])}
        include = rng.choice([{}, {"posts": True}, {"posts": False}, {"posts": posts}, {"posts": {"author": {"org": True}}}, {"org": True, "posts": posts}])
        q = QueryRequest("users", rng.choice([{}, {"posts": where()}]), include, order(["name", "org.name"]), rng.choice([None, 3]), rng.randrange(3), rng.choice([None, ("a", None)]))
        back = request_from_json(json.loads(json.dumps(q.to_json())))
        assert back.to_json() == q.to_json() and back.key() == q.key()
    q = db.users.where({"role": {"$not": "guest"}}).include({"posts": {"order_by": [("likes", "desc")], "limit": 1}}).order_by("org.name", "desc", nulls="first").after("globex", "b")
    assert QueryBuilder(db, request_from_json(q.to_json())).get() == q.get()


def test_json_numbers(spark):
    catalog = Catalog(Collection("c", {"id": ID, "data": Field("json")}))
    db = Session(spark, catalog, Frames.of_rows(spark, catalog, {"c": [{"id": str(i), "data": f'{{"n": {i}, "on": {"true" if i > 5 else "false"}, "s": "v{i}"}}'} for i in (1, 9, 10, 100)]}))
    assert ids(db.c.where({"data": {"$path": {"$.n": {"$gt": 9}}}})) == ["10", "100"] and ids(db.c.where({"data": {"$path": {"$.n": {"$in": [1, 100]}}}})) == ["1", "100"]
    assert ids(db.c.where({"data": {"$path": {"$.on": False}}})) == ["1"] and ids(db.c.where({"data": {"$path": {"$.s": "v9", "$.n": 9}}})) == ["9"]


def test_includes(db):
    rows = {r["id"]: r for r in db.users.include({"posts": {"order_by": [("likes", "desc")], "limit": 1}, "org": True}).get()}
    assert {k: [p["id"] for p in r["posts"]] for k, r in rows.items()} == {"alice": ["1"], "bob": ["4"], "carol": [], "dan": []}
    assert rows["dan"]["org"] is None and rows["bob"]["org"]["name"] == "globex"
    rows = db.orgs.where({"name": "globex"}).include({"users": {"order_by": "age", "include": {"posts": {"order_by": [("likes", "desc")]}}}}).get()
    assert [(u["id"], [p["id"] for p in u["posts"]]) for u in rows[0]["users"]] == [("bob", ["4", "3"]), ("carol", [])]
    rows = db.orgs.include({"users": {"posts": True}}).order_by("id").get()
    assert [[len(u["posts"]) for u in r["users"]] for r in rows] == [[2], [2, 0]]
    rows = db.users.include({"posts": {"where": {"author": {"role": "admin"}}}}).order_by("id").get()
    assert [len(r["posts"]) for r in rows] == [2, 0, 0, 0]


def test_combined(db):
    q = db.posts.where({"status": "published", "author": {"role": {"$in": ["admin", "member"]}}}).include({"author": True}).order_by("likes", "desc").limit(10)
    assert [(r["id"], r["author"]["name"]) for r in q.get()] == [("1", "Alice"), ("3", "Bob")]


def test_errors(db):
    for bad in ({"nope": 1}, {"likes": {"$near": 1}}, {"author": 3}, {"author": {"nope": 1}}, {"likes": {}}):
        with pytest.raises(ValueError):
            db.posts.where(bad).df()
    with pytest.raises(ValueError):
        db.posts.include({"nope": True})
    with pytest.raises(ValueError):
        db.posts.order_by("author.posts.likes").df()
    for n in (-1, 1.5, True):
        with pytest.raises(ValueError):
            db.posts.limit(n)
    with pytest.raises(ValueError):
        db.posts.order_by("likes", "up")


def test_requests():
    assert merged_where(None, {}, {"a": 1}) == {"a": 1}
    assert merged_where({"a": 1}, {"b": 2}) == {"$and": [{"a": 1}, {"b": 2}]}
    base = QueryRequest("posts", order_by=(SortKey("likes"),))
    keys = {base.key(), QueryRequest("posts").key(), QueryRequest("posts", limit=2).key(), QueryRequest("posts", include={"author": True}).key(), QueryRequest("posts", order_by=(SortKey("likes", "desc"),)).key()}
    assert len(keys) == 5 and base.key() == QueryRequest("posts", order_by=(SortKey("likes"),)).key()
    assert relations_in(CATALOG, "posts", {"$or": [{"author": {"org": {"name": "x"}}}, {"editor": {"id": None}}]}) == {"author": {"org": {}}, "editor": {}}
    assert dependencies(CATALOG, QueryRequest("orgs", include={"users": {"posts": True}})) == {"orgs", "users", "posts"}
    with pytest.raises(ValueError):
        sub_query("posts", {"limit": 1, "colour": 2})


def test_catalog_checks():
    with pytest.raises(ValueError):
        Collection("x", {"a": TEXT})
    with pytest.raises(ValueError):
        Catalog(Collection("x", {"id": ID}, relations={"ys": many("y", "xId")}))
    with pytest.raises(ValueError):
        Collection("x", {"id": ID}, relations={"id": one("x", "id")})


def test_aggregates(db):
    assert {r["status"]: r["n"] for r in db.posts.aggregate(["status"], n="count").collect()} == {"published": 2, "draft": 1, "archived": 1}
    assert [r["status"] for r in db.posts.aggregate(["status"], having={"total": {"$gte": 45}}, total=("sum", "likes")).orderBy("status").collect()] == ["archived", "published"]
    got = {r["id"]: (r["n"], r["top"]) for r in db.users.with_relation("posts", {"status": "published"}, n="count", top=("max", "likes")).collect()}
    assert got == {"alice": (1, 30.0), "bob": (1, 15.0), "carol": (0, None), "dan": (0, None)}


def test_plans(db, spark):
    """Limits reach each parent before the shuffle, and a sort with a limit is one top-k."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(db.users.include({"posts": {"order_by": ["likes"], "limit": 1}}).df())
    assert "TakeOrderedAndProject" in plan(db.posts.order_by("likes").limit(2).df())
    assert plan(db.users.limit(1).include({"posts": {"order_by": ["likes"]}}).df()).index("Window") < plan(db.users.limit(1).include({"posts": {"order_by": ["likes"]}}).df()).index("LeftSemi")
    assert "Window" not in plan(db.users.include({"posts": True}).df())
    assert "LeftSemi" in plan(db.users.where({"posts": {"status": "draft"}}).df())
    assert "LeftAnti" in plan(db.users.where({"posts": {"$not": {"status": "draft"}}}).df())
