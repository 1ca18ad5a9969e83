"""Queries over written, pending and tracked state, requests as data, procedures and checks, with SQL that gives the same rows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.builder import Optimistic, QueryBuilder, Session
from tideframe.functions import values as V
from tideframe.operators.merge import LOG_SCHEMA, log_rows, write_times
from tideframe.plans.planner import request_from_json
from tideframe.procedures import Hooks, Procedures, fields
from tideframe.queries import CATALOG, _gaps, _query
from tideframe.sources.checks import duplicates, invalid, orphans
from tideframe.sources.tables import Files, Frames
from tideframe.streaming.live import LiveQueries, write_stream

_REGION = "SELECT r_regionkey, r_name FROM region"


# Requests as data, pages ------------------------------------------------------------------------------------------
@_query("request_read_back", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'F') ON o_custkey = c_custkey AND r <= 2 WHERE c_acctbal < 0")
def _request_read_back(s: Session):
    """A request written as JSON text and read again."""
    q = s.customer.where({"c_acctbal": {"$lt": 0}}).include({"orders": {"where": {"o_orderstatus": {"$not": "F"}}, "order_by": [("o_totalprice", "desc")], "limit": 2}}).order_by("c_name", "desc", nulls="first")
    back = QueryBuilder(s, request_from_json(json.loads(json.dumps(q.to_json()))))
    return back.df().select("c_custkey", F.explode_outer("orders.o_orderkey").alias("o_orderkey"))


@_query("page_by_related", "SELECT o.* FROM orders o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name DESC, o_totalprice, o_orderkey LIMIT 20 OFFSET 20")
def _page_by_related(s: Session):
    """The second page, by the cursor of the first."""
    q = s.orders.order_by("customer.nation.n_name", "desc").order_by("o_totalprice")
    _, cursor = q.page(20)
    return q.after(*cursor).limit(20).df()


@_query("merged_wheres", "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 AND (o_orderpriority = '1-URGENT' OR o_orderkey < 500)")
def _merged_wheres(s: Session):
    return s.orders.where({"o_orderstatus": "O"}).and_where({"o_totalprice": {"$gt": 300000}}).and_where({"$or": [{"o_orderpriority": "1-URGENT"}, {"o_orderkey": {"$lt": 500}}]})


@_query("json_numbers", "SELECT * FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 9 AND 20")
def _json_numbers(s: Session):
    return s.events.where({"props": {"$path": {"$.k": {"$gte": 9, "$lte": 20}}}})


# Writes, transactions, pending writes -----------------------------------------------------------------------------
@_query("insert_update", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'NEW WORLD' ELSE r_name END AS r_name FROM region UNION ALL SELECT 100, 'ATLANTIS' UNION ALL SELECT 101, NULL")
def _insert_update(s: Session):
    s.insert("region", {"r_regionkey": 100, "r_name": "ATLANTIS"})
    s.update("region", 1, {"r_name": "NEW WORLD"})
    s.update("region", 101, {})
    return s.region


@_query("transaction", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'ONE' WHEN 2 THEN 'TWO' ELSE r_name END AS r_name, 2 AS seen FROM region")
def _transaction(s: Session):
    """Own writes are seen within, an inner transaction joins, a failed one leaves nothing."""
    with s.transaction():
        s.update("region", 1, {"r_name": "ONE"})
        with s.transaction():
            s.update("region", 2, {"r_name": "TWO"})
        seen = s.region.where({"r_name": {"$in": ["ONE", "TWO"]}}).count()
    try:
        with s.transaction():
            s.update("region", 3, {"r_name": "THREE"})
            raise RuntimeError
    except RuntimeError:
        pass
    return s.region.df().withColumn("seen", F.lit(seen).cast("int"))


@_query("hooks_and_defaults", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN r_name || '!' ELSE r_name END AS r_name FROM region UNION ALL SELECT 7, 'SEVEN'")
def _hooks(s: Session):
    """A hook on inserts changes the row, one on updates sees the whole row with the new values in it."""
    hooks = Hooks().on("before_insert", "region", lambda r: {**r, "r_name": r["r_name"].upper()}).on("before_update", "region", lambda r: {**r, "r_name": r["r_name"] + "!"})
    db = Session(s.spark, CATALOG, s.base, hooks)
    db.insert("region", {"r_regionkey": 7, "r_name": "seven"})
    db.update("region", 1, {})
    return db.region


def _pending(s: Session) -> Optimistic:
    db = Optimistic(s.spark, CATALOG, s.base)
    db.propose("a", lambda t: t.update("region", 1, {"r_name": "A"}, ts="2024-01-01"))
    db.propose("b", lambda t: t.update("region", 1, {"r_name": "B"}, ts="2024-01-02"))
    db.propose("c", lambda t: t.insert("region", {"r_regionkey": 9, "r_name": "C"}, ts="2024-01-03"))
    return db


@_query("optimistic_apply", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'B' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'C'")
def _optimistic_apply(s: Session):
    return _pending(s).region


@_query("optimistic_undo", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'A' ELSE r_name END AS r_name FROM region")
def _optimistic_undo(s: Session):
    db = _pending(s)
    db.reject("b")
    db.reject("c")
    return db.region


@_query("optimistic_confirm", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'SERVER' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'C'")
def _optimistic_confirm(s: Session):
    """The server's own rows take the place of a pending write; the rest are confirmed or still pending."""
    db = _pending(s)
    db.reject("b")
    db.confirm("a", s.spark.createDataFrame(log_rows(CATALOG["region"], {"r_regionkey": 1, "r_name": "SERVER"}, "2024-01-04", 50), LOG_SCHEMA))
    db.confirm("c")
    return db.region


@_query("pending_replay", "SELECT * FROM (VALUES ('b', '1', 'r_regionkey', '1'), ('b', '1', 'r_name', 'B'), ('c', '9', 'r_regionkey', '9'), ('c', '9', 'r_name', 'C')) AS t(origin, id, field, value)")
def _pending_replay(s: Session):
    db = _pending(s)
    db.confirm("a")
    return s.spark.createDataFrame(db.replay(), LOG_SCHEMA).select("origin", "id", "field", "value")


@_query("write_times", "SELECT '1' AS key, '2024-01-02' AS r_name, '2024-01-02' AS r_regionkey UNION ALL SELECT '9', '2024-01-03', '2024-01-03'")
def _write_times(s: Session):
    return write_times(_pending(s).log, CATALOG["region"]).select("key", "r_name", "r_regionkey")


# Tracked queries ---------------------------------------------------------------------------------------------------
def _folder(s: Session) -> str:
    shared = s.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="live-")
    return f"{shared.rstrip('/')}/live-{uuid.uuid4().hex}"


def _writes(s: Session, folder: str, number: int, batch) -> None:
    """A batch of (collection, values) as one file of writes, later than those of smaller numbers."""
    rows = [r for i, (name, values) in enumerate(batch) for r in log_rows(CATALOG[name], values, f"2024-01-0{number + 1}", 100 * number + i)]
    s.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.json(folder)


def _followed(s: Session, query: QueryBuilder, *batches, first: bool = False) -> DataFrame:
    """(batch, op, path, id, name) that a listener of a stream of writes gets, and the rows that it starts from as batch -1."""
    folder, told = _folder(s), []
    live = LiveQueries(s.spark, CATALOG, s.base, f"{folder}/state")
    keep = lambda df: told.append(df.select(F.lit(len(told)).alias("batch"), "op", "path", F.col("id").cast("long").alias("id"), F.coalesce(F.col("payload")["n_name"], F.col("payload")["r_name"], F.col("payload")["s_name"]).alias("name")))
    query.subscribe(live, keep, first)
    query.subscribe(live, lambda df: 1 / 0, False)
    for n, batch in enumerate(batches):
        _writes(s, f"{folder}/writes-{n}", n, batch)
        live.start(write_stream(s.spark, f"{folder}/writes-{n}"), f"{folder}/checkpoint-{n}").awaitTermination() if n == 0 else live.process(s.spark.read.schema(LOG_SCHEMA).json(f"{folder}/writes-{n}"), n)
    out = told[0]
    for df in told[1:]:
        out = out.unionByName(df)
    return out


@_query("tracked_stream", "SELECT * FROM (VALUES (0, 'INSERT', '', 30, 'ZZ'), (0, 'DELETE', '', (SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 1 OFFSET 1), NULL), (1, 'UPDATE', '', 30, 'ZZZ'), (2, 'DELETE', '', 30, NULL), (2, 'INSERT', '', (SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 1 OFFSET 1), (SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 1 OFFSET 1))) AS t(batch, op, path, id, name)")
def _tracked_stream(s: Session):
    """A window of two over a stream of writes: a row enters, changes, and leaves again; what it drove out comes back whole."""
    return _followed(s, s.nation.order_by("n_name", "desc").limit(2), [("nation", {"n_nationkey": 30, "n_name": "ZZ", "n_regionkey": 1})], [("nation", {"n_nationkey": 30, "n_name": "ZZZ"})], [("nation", {"n_nationkey": 30, "n_name": "A"})])


@_query("tracked_subtree", "SELECT * FROM (VALUES (0, 'INSERT', '', 50, 'NOWHERE'), (0, 'INSERT', 'nations', 60, 'NOLAND'), (0, 'INSERT', 'nations.suppliers', 900000, 'Nobody')) AS t(batch, op, path, id, name)")
def _tracked_subtree(s: Session):
    """Child before parent in one batch: the whole subtree is told."""
    batch = [("supplier", {"s_suppkey": 900000, "s_name": "Nobody", "s_nationkey": 60}), ("nation", {"n_nationkey": 60, "n_name": "NOLAND", "n_regionkey": 50}), ("region", {"r_regionkey": 50, "r_name": "NOWHERE"})]
    return _followed(s, s.region.include({"nations": {"suppliers": True}}), batch)


@_query("tracked_first", "SELECT 0 AS batch, 'INSERT' AS op, '' AS path, r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 0, 'INSERT', 'nations', n_nationkey, n_name FROM nation UNION ALL SELECT 1, 'UPDATE', '', 1, 'ONE'")
def _tracked_first(s: Session):
    """A listener first gets the present rows, then deltas."""
    return _followed(s, s.region.include({"nations": True}), [("region", {"r_regionkey": 1, "r_name": "ONE"})], first=True)


# Procedures ---------------------------------------------------------------------------------------------------------
@_query("procedures", "SELECT o_orderkey, 2 AS calls, 'n: must be int' AS refused FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def _procedures(s: Session):
    """A named query through validation and middleware."""
    calls = []
    api = Procedures().use(lambda r, then: (calls.append("outer"), then(r))[1]).use(lambda r, then: (calls.append("inner"), then(r))[1])
    api.query("top", fields(n=int))(lambda db, data, context: db.orders.order_by("o_totalprice", "desc").limit(data["n"]))
    rows, refused = api.call_query(s, "top", {"n": 7}), ""
    try:
        api.call_query(s, "top", {"n": "7"})
    except ValueError as e:
        refused = str(e)
    return rows.select("o_orderkey", F.lit(len(calls)).alias("calls"), F.lit(refused).alias("refused"))


@_query("mutation", "SELECT r_regionkey, CASE r_regionkey WHEN 4 THEN 'FOUR' ELSE r_name END AS r_name FROM region")
def _mutation(s: Session):
    api = Procedures()
    api.mutation("rename", fields(key=int, name=str))(lambda db, data, context: db.update("region", data["key"], {"r_name": data["name"]}))
    api.call_mutation(s, "rename", {"key": 4, "name": "FOUR"})
    return s.region


# Sources, checks, helpers -------------------------------------------------------------------------------------------
@_query("formats", " UNION ALL ".join(f"SELECT '{f}' AS format, n_nationkey, n_name FROM nation" for f in ("csv", "json", "orc")))
def _formats(s: Session):
    """Collections written in other formats and read back."""
    out, folder = None, _folder(s)
    for kind, options in (("csv", {"header": True}), ("json", {}), ("orc", {})):
        s.base["nation"].write.format(kind).options(**options).save(f"{folder}/{kind}/nation.{kind}")
        got = Session(s.spark, CATALOG, Files(s.spark, CATALOG, f"{folder}/{kind}", kind, **options)).nation.df().select(F.lit(kind).alias("format"), "n_nationkey", "n_name")
        out = got if out is None else out.unionByName(got)
    return out


@_query("evolved", "SELECT r_regionkey, NULL::VARCHAR AS r_name FROM region")
def _evolved(s: Session):
    """A table without a declared column is read with nulls in its place."""
    return Session(s.spark, CATALOG, Frames.evolve(CATALOG, {"region": s.base["region"].select("r_regionkey")})).region


@_query("check_duplicates", "SELECT 'l_linenumber' AS field, l_linenumber::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY l_linenumber HAVING count(*) > 1")
def _check_duplicates(s: Session):
    return duplicates(CATALOG, s.base, "lineitem")


@_query("check_orphans", "SELECT 'o_custkey' AS field, o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS value FROM orders WHERE o_orderkey % 10 > 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def _check_orphans(s: Session):
    """Orders of customers that are not there; those without a customer are none."""
    tables = {**{n: _gaps(s).base[n] for n in CATALOG}, "customer": s.base["customer"].where("c_custkey % 3 > 0")}
    return orphans(CATALOG, tables, "orders")


@_query("check_invalid", "SELECT 'o_orderstatus' AS field, o_orderkey::VARCHAR AS id, o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'o_orderpriority', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderkey % 9 = 0")
def _check_invalid(s: Session):
    from dataclasses import replace

    from tideframe.schema import Field

    c = CATALOG["orders"]
    strict = replace(c, fields={**c.fields, "o_orderstatus": Field("enum", values=("O", "F")), "o_orderpriority": Field("string", null=False)})
    return invalid({"orders": strict}, _gaps(s).base, "orders")


@_query("helpers", "SELECT event_id, event_type = 'click' AS flag, ts AS moment, event_type = 'click' AS twice FROM events")
def _helpers(s: Session):
    """Truth values and moments from text; lists of columns compared with null equal to null."""
    df = s.events.df().withColumn("text", F.when(F.col("event_type") == "click", "TRUE").otherwise("no")).withColumn("kind", F.lit("click")).withColumn("gap", F.lit(None).cast("string"))
    return df.select("event_id", V.to_boolean(F.col("text")).alias("flag"), V.to_moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("moment"), V.same(["event_type", "gap"], ["kind", "gap"]).alias("twice"))


@_query("structural_hashes", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)")
def _structural_hashes(s: Session):
    return s.events.df().select(V.structural_hash("event_type", "user_id").alias("h")).agg(F.count_distinct("h").alias("n"))
