"""The engine's own queries over the star-schema tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.builder import QueryBuilder, Session
from tideframe.functions import values as V
from tideframe.operators.merge import Overlaid, accepted, exploded_loads, fold, log_of
from tideframe.schema import Catalog, Collection, Field, many, one
from tideframe.sources.tables import Cached, Files, Frames
from tideframe.streaming.scope import applied, deltas

_INT, _LONG, _DOUBLE, _TIME = Field(T.IntegerType()), Field(T.LongType()), Field(T.DoubleType()), Field("timestamp")
_TEXT = Field("string")

CATALOG = Catalog(
    Collection("region", {"r_regionkey": _INT, "r_name": _TEXT}, "r_regionkey", {"nations": many("nation", "n_regionkey")}),
    Collection("nation", {"n_nationkey": _INT, "n_name": _TEXT, "n_regionkey": _INT}, "n_nationkey", {"region": one("region", "n_regionkey"), "customers": many("customer", "c_nationkey"), "suppliers": many("supplier", "s_nationkey")}),
    Collection("customer", {"c_custkey": _LONG, "c_name": _TEXT, "c_nationkey": _INT, "c_acctbal": _DOUBLE, "c_mktsegment": _TEXT}, "c_custkey", {"nation": one("nation", "c_nationkey"), "orders": many("orders", "o_custkey"), "events": many("events", "user_id")}),
    Collection("supplier", {"s_suppkey": _LONG, "s_name": _TEXT, "s_nationkey": _INT, "s_acctbal": _DOUBLE}, "s_suppkey", {"nation": one("nation", "s_nationkey"), "lineitems": many("lineitem", "l_suppkey")}),
    Collection("part", {"p_partkey": _LONG, "p_name": _TEXT, "p_brand": _TEXT, "p_type": _TEXT, "p_size": _INT, "p_retailprice": _DOUBLE}, "p_partkey", {"lineitems": many("lineitem", "l_partkey")}),
    Collection("orders", {"o_orderkey": _LONG, "o_custkey": _LONG, "o_orderstatus": _TEXT, "o_totalprice": _DOUBLE, "o_orderdate": _TIME, "o_orderpriority": _TEXT}, "o_orderkey", {"customer": one("customer", "o_custkey"), "lineitems": many("lineitem", "l_orderkey")}),
    # lineitem has no key of its own; no query here tracks or cuts it by one.
    Collection("lineitem", {"l_orderkey": _LONG, "l_partkey": _LONG, "l_suppkey": _LONG, "l_linenumber": _INT, "l_quantity": _DOUBLE, "l_extendedprice": _DOUBLE, "l_discount": _DOUBLE, "l_tax": _DOUBLE, "l_returnflag": _TEXT, "l_linestatus": _TEXT, "l_shipdate": _TIME}, "l_linenumber", {"order": one("orders", "l_orderkey"), "part": one("part", "l_partkey"), "supplier": one("supplier", "l_suppkey")}),
    Collection("events", {"event_id": _LONG, "ts": _TIME, "user_id": _LONG, "event_type": _TEXT, "value": _DOUBLE, "props": Field("json")}, "event_id", {"user": one("customer", "user_id")}),
)


def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, CATALOG, Cached(Files(spark, CATALOG, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    """Registers a query: a function of a session that gives a builder or a DataFrame."""
    def keep(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = make(session(spark, sf_dir))
            return got.df() if isinstance(got, QueryBuilder) else got

        QUERIES[name], ORACLES[name] = run, sql
        return make

    return keep


# Scans, point reads, filters -------------------------------------------------------------------------------------
_ORDERS = "SELECT * FROM orders WHERE "
for _name, _make, _sql in (
    ("scan_all", lambda s: s.region, "SELECT * FROM region"),
    ("one_by_id", lambda s: s.customer.one(42), "SELECT * FROM customer WHERE c_custkey = 42"),
    ("first_match", lambda s: s.orders.order_by("o_orderkey").first({"o_orderstatus": "F"}), _ORDERS + "o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1"),
    ("where_eq", lambda s: s.orders.where({"o_orderstatus": "P"}), _ORDERS + "o_orderstatus = 'P'"),
    ("where_in", lambda s: s.orders.where({"o_orderstatus": {"$in": ["P", "F"]}}), _ORDERS + "o_orderstatus IN ('P', 'F')"),
    ("where_not", lambda s: s.orders.where({"o_orderstatus": {"$not": "O"}}), _ORDERS + "o_orderstatus <> 'O'"),
    ("where_not_in", lambda s: s.orders.where({"o_orderstatus": {"$not": {"$in": ["O", "F"]}}}), _ORDERS + "o_orderstatus NOT IN ('O', 'F')"),
    ("where_not_gt", lambda s: s.orders.where({"o_totalprice": {"$not": {"$gt": 20000}}}), _ORDERS + "NOT (o_totalprice > 20000)"),
    ("where_gt_gte_lt_lte", lambda s: s.part.where({"p_size": {"$gt": 5, "$lte": 40}, "p_retailprice": {"$gte": 950.0, "$lt": 1500.0}}), "SELECT * FROM part WHERE p_size > 5 AND p_size <= 40 AND p_retailprice >= 950 AND p_retailprice < 1500"),
    ("where_and_range", lambda s: s.orders.where({"$and": [{"o_totalprice": {"$gte": 1000}}, {"o_totalprice": {"$lte": 50000}}]}), _ORDERS + "o_totalprice BETWEEN 1000 AND 50000"),
    ("where_or", lambda s: s.orders.where({"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"$gt": 400000}}]}), _ORDERS + "o_orderstatus = 'P' OR o_totalprice > 400000"),
    ("where_nested_bool", lambda s: s.orders.where({"$or": [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$lt": 20000}}]}, {"$and": [{"o_orderstatus": "P"}, {"$or": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"$gt": 300000}}]}]}]}), _ORDERS + "(o_orderstatus = 'F' AND o_totalprice < 20000) OR (o_orderstatus = 'P' AND (o_orderpriority = '1-URGENT' OR o_totalprice > 300000))"),
    ("where_or_sibling", lambda s: s.orders.where({"o_orderstatus": "O", "$or": [{"o_totalprice": {"$lt": 2000}}, {"o_totalprice": {"$gt": 400000}}]}), _ORDERS + "o_orderstatus = 'O' AND (o_totalprice < 2000 OR o_totalprice > 400000)"),
    ("where_overwritten", lambda s: s.orders.where({"o_orderstatus": "O"}).where({"o_orderstatus": "P"}), _ORDERS + "o_orderstatus = 'P'"),
    ("date_range", lambda s: s.orders.where({"o_orderdate": {"$gte": "1995-01-01", "$lt": "1996-01-01"}}), _ORDERS + "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    ("text_like", lambda s: s.part.where({"p_name": {"$ilike": "%a%e%"}}), "SELECT * FROM part WHERE p_name ILIKE '%a%e%'"),
    ("text_search", lambda s: s.customer.where({"$or": [{"c_name": {"$istartsWith": "CUSTOMER#00000001"}}, {"c_name": {"$iendsWith": "7"}}, {"c_mktsegment": {"$icontains": "hold"}}]}), "SELECT * FROM customer WHERE lower(c_name) LIKE 'customer#00000001%' OR c_name LIKE '%7' OR lower(c_mktsegment) LIKE '%hold%'"),
    ("json_path", lambda s: s.events.where({"props": {"$path": {"$.k": {"$in": ["1", "2", "3"]}}}}), "SELECT * FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3')"),
    ("projection", lambda s: s.part.where({"p_size": {"$lt": 10}}).select("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE p_size < 10"),
    ("raw_sql", lambda s: s.sql("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    # Predicates on relations
    ("rel_one", lambda s: s.orders.where({"customer": {"c_mktsegment": "BUILDING"}}), _ORDERS + "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    ("rel_one_deep", lambda s: s.orders.where({"customer": {"nation": {"region": {"r_name": "EUROPE"}}}}), "SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"),
    ("rel_many_some", lambda s: s.customer.where({"orders": {"o_orderstatus": "P"}}), "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    ("rel_many_deep", lambda s: s.nation.where({"customers": {"orders": {"lineitems": {"l_quantity": {"$gte": 50}, "part": {"p_size": {"$lt": 3}}}}}}), "SELECT * FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE c_nationkey = n_nationkey AND l_quantity >= 50 AND p_size < 3)"),
    ("rel_many_none", lambda s: s.customer.where({"events": {"$not": {"event_type": {"$not": None}}}}), "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type IS NOT NULL)"),
    ("rel_or_exists", lambda s: s.customer.where({"$or": [{"events": {"value": {"$gt": 50}}}, {"c_acctbal": {"$lt": 0}}]}), "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 50) OR c_acctbal < 0"),
    ("rel_one_of_many", lambda s: s.orders.where({"customer": {"events": {"value": {"$gt": 0}}, "c_acctbal": {"$gt": 0}}}), "SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND value > 0)"),
    ("rel_not_one", lambda s: s.orders.where({"customer": {"$not": {"c_mktsegment": "BUILDING"}}}), _ORDERS + "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    # Sorting, limits, pages
    ("order_multi", lambda s: s.orders.order_by("o_orderstatus").order_by("o_totalprice", "desc").limit(50), "SELECT * FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50"),
    ("limit_topk", lambda s: s.orders.order_by("o_totalprice", "desc").limit(25), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    ("order_relational", lambda s: s.orders.order_by("customer.nation.n_name").order_by("customer.c_acctbal", "desc").limit(20), "SELECT o.* FROM orders o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY n_name, c_acctbal DESC, o_orderkey LIMIT 20"),
    ("cursor_page", lambda s: s.orders.order_by("o_orderstatus", "desc").order_by("o_totalprice").after("O", 100000.0, 0).limit(30), _ORDERS + "o_orderstatus < 'O' OR (o_orderstatus = 'O' AND (o_totalprice > 100000 OR (o_totalprice = 100000 AND o_orderkey > 0))) ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 30"),
    ("offset_page", lambda s: s.orders.order_by("o_orderdate").offset(40).limit(20), "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40"),
    # Aggregates
    ("agg_count", lambda s: s.orders.where({"o_orderstatus": "F"}).aggregate(n="count", customers=("count_distinct", "o_custkey")), "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'F'"),
    ("agg_group", lambda s: s.orders.aggregate(["o_orderpriority"], n="count", least=("min", "o_totalprice"), most=("max", "o_totalprice")), "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority"),
    ("agg_having", lambda s: s.customer.aggregate(["c_nationkey"], having={"n": {"$gte": 60}}, n="count"), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 60"),
    ("relation_agg", lambda s: s.customer.with_relation("events", n_events="count", top=("max", "value")), "SELECT c.*, coalesce(n, 0) AS n_events, top FROM customer c LEFT JOIN (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id) ON user_id = c_custkey"),
    ("order_by_agg", lambda s: s.customer.limit(15).with_relation("orders", {"o_orderstatus": "F"}, order_by=[("n_orders", "desc")], n_orders="count"), "SELECT c.*, coalesce(n, 0) AS n_orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY n_orders DESC, c_custkey LIMIT 15"),
):
    _query(_name, _sql)(_make)


def _gaps(s: Session) -> Session:
    """The same collections with nulls: every 9th order has no priority, every 10th no customer."""
    orders = s.base["orders"].withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderpriority"))).withColumn("o_custkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey")))
    return Session(s.spark, CATALOG, Frames({**{n: s.base[n] for n in CATALOG}, "orders": orders}))


_GAPS = "WITH orders2 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 9 > 0 THEN o_orderpriority END AS o_orderpriority FROM orders) SELECT orders2.* FROM orders2 "
for _name, _make, _sql in (
    ("where_is_null", lambda s: _gaps(s).orders.where({"o_orderpriority": None}), "WHERE o_orderpriority IS NULL"),
    ("where_not_is_null", lambda s: _gaps(s).orders.where({"o_orderpriority": {"$not": None}, "o_custkey": {"$lt": 50}}), "WHERE o_orderpriority IS NOT NULL AND o_custkey < 50"),
    ("where_explicit_eq", lambda s: _gaps(s).orders.where({"o_orderpriority": {"$eq": "1-URGENT"}}), "WHERE o_orderpriority = '1-URGENT'"),
    ("where_eq_null", lambda s: _gaps(s).orders.where({"$and": [{"o_custkey": {"$eq": None}}, {"o_orderstatus": {"$eq": "F"}}]}), "WHERE o_custkey IS NULL AND o_orderstatus = 'F'"),
    ("where_not_explicit_eq", lambda s: _gaps(s).orders.where({"o_orderpriority": {"$not": {"$eq": "1-URGENT"}}}), "WHERE NOT (o_orderpriority = '1-URGENT')"),
    ("rel_of_null_key", lambda s: _gaps(s).orders.where({"customer": {"$not": {"c_mktsegment": "BUILDING"}}}), "LEFT JOIN customer ON o_custkey = c_custkey WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)"),
    ("order_nulls_last", lambda s: _gaps(s).orders.order_by("o_orderpriority", nulls="last").limit(4000), "ORDER BY o_orderpriority ASC NULLS LAST, o_orderkey LIMIT 4000"),
    ("order_nulls_first", lambda s: _gaps(s).orders.order_by("o_orderpriority", "desc", nulls="first").limit(2500), "ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey LIMIT 2500"),
    ("order_nulls_default", lambda s: _gaps(s).orders.order_by("customer.c_acctbal", "desc").limit(50).offset(3), "LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 3"),
):
    _query(_name, _GAPS + _sql)(_make)


@_query("where_not_null", "SELECT * FROM events WHERE props IS NOT NULL AND value IS NOT NULL")
def _where_not_null(s: Session):
    return s.events.where({"props": {"$not": None}, "value": {"$not": None}})


# Includes, flattened for the comparison ---------------------------------------------------------------------------
@_query("include_one", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def _include_one(s: Session):
    return s.orders.where({"o_orderstatus": "P"}).include({"customer": {"nation": True}}).df().select("o_orderkey", "customer.c_name", "customer.nation.n_name")


@_query("include_many", "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def _include_many(s: Session):
    return s.nation.include({"suppliers": True}).df().select("n_nationkey", F.explode("suppliers.s_suppkey").alias("s_suppkey"))


@_query("include_empty", "SELECT c_custkey, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer")
def _include_empty(s: Session):
    return s.customer.include({"events": True}).df().select("c_custkey", F.size("events").cast("long").alias("n_events"))


@_query("include_siblings", "SELECT n_nationkey, (SELECT string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _include_siblings(s: Session):
    df = s.nation.include({"customers": True, "suppliers": True, "region": True}).df()
    text = lambda c: F.nullif(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return df.select("n_nationkey", text("customers.c_custkey").alias("customers"), text("suppliers.s_name").alias("suppliers"), "region.r_name")


@_query("include_filtered", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING'")
def _include_filtered(s: Session):
    return s.customer.where({"c_mktsegment": "BUILDING"}).include({"orders": {"where": {"o_orderstatus": "P"}}}).df().select("c_custkey", F.explode_outer("orders.o_orderkey").alias("o_orderkey"))


@_query("include_sorted", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS place, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def _include_sorted(s: Session):
    df = s.customer.include({"orders": {"order_by": [("o_totalprice", "desc")]}}).df()
    return df.select("c_custkey", F.posexplode("orders.o_orderkey").alias("place", "o_orderkey"))


@_query("include_topn", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey WHERE r <= 3 AND c_mktsegment = 'BUILDING'")
def _include_topn(s: Session):
    df = s.customer.where({"c_mktsegment": "BUILDING"}).include({"orders": {"order_by": [("o_totalprice", "desc")], "limit": 3}}).df()
    return df.select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@_query("include_relation_page", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey WHERE r BETWEEN 3 AND 4")
def _include_relation_page(s: Session):
    df = s.customer.include({"orders": {"order_by": ["o_orderdate"], "limit": 2, "offset": 2}}).df()
    return df.select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@_query("include_nested", "SELECT n_name, c_custkey, o_orderkey, n_lines FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rc FROM customer) ON c_nationkey = n_nationkey JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ro FROM orders WHERE o_orderstatus = 'O') ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE rc <= 5 AND ro <= 2")
def _include_nested(s: Session):
    top = {"order_by": [("o_totalprice", "desc")], "limit": 2, "where": {"o_orderstatus": "O"}, "include": {"lineitems": True}}
    df = s.nation.include({"customers": {"order_by": [("c_acctbal", "desc")], "limit": 5, "include": {"orders": top}}}).df()
    df = df.select("n_name", F.explode("customers").alias("c")).select("n_name", "c.c_custkey", F.explode("c.orders").alias("o"))
    return df.select("n_name", "c_custkey", "o.o_orderkey", F.nullif(F.size("o.lineitems").cast("long"), F.lit(0)).alias("n_lines"))


_COMBINED = "SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


@_query("combined", _COMBINED)
def combined(s: Session):
    """Own filter, filter on a relation, include, sort and limit at once."""
    q = s.orders.where({"o_orderstatus": "O", "customer": {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}}).include({"customer": {"nation": True}}).order_by("o_totalprice", "desc").limit(10)
    return q.df().select("o_orderkey", "o_totalprice", "customer.c_name", "customer.nation.n_name")


@_query("flat_levels", "SELECT 'orders' AS level, c_custkey AS parent, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY c_custkey UNION ALL SELECT 'orders.lineitems', l_orderkey, count(*) FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal < 0 GROUP BY l_orderkey")
def _flat_levels(s: Session):
    levels = s.customer.where({"c_acctbal": {"$lt": 0}}).include({"orders": {"lineitems": True}}).levels()
    count = lambda path: levels[path].groupBy("parent").count().select(F.lit(".".join(path)).alias("level"), "parent", F.col("count").alias("n"))
    return count(("orders",)).unionByName(count(("orders", "lineitems")))


@_query("consolidated_load", "SELECT 'nation' AS resource, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT DISTINCT 'region', r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def _consolidated_load(s: Session):
    include = {"region": True, "suppliers": True}
    loads = exploded_loads(s.nation.include(include).df(), CATALOG, "nation", include)
    parts = [df.select(F.lit(name).alias("resource"), F.col(CATALOG[name].pk).cast("long").alias("id"), F.col(f"{name[0]}_name").alias("name")) for name, df in loads]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Writes: last writer wins ----------------------------------------------------------------------------------------
def _event_log(s: Session, seq="event_id"):
    """Every event as a write of its user's balance and name."""
    rows = s.base["events"].select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), F.col("event_type").alias("c_mktsegment"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), "event_id")
    return log_of(rows, CATALOG["customer"], "at", seq)


@_query("lww_fold", "SELECT user_id AS c_custkey, arg_max(value, (ts, event_id)) AS c_acctbal, arg_max(event_type, (ts, event_id)) AS c_mktsegment FROM events GROUP BY user_id")
def _lww_fold(s: Session):
    got = fold(_event_log(s), CATALOG["customer"])
    return got.select(F.col("key").cast("long").alias("c_custkey"), F.col("c_acctbal.value").cast("double").alias("c_acctbal"), F.col("c_mktsegment.value").alias("c_mktsegment"))


@_query("lww_tie", "SELECT user_id AS c_custkey, arg_max(value, event_id) AS c_acctbal FROM events GROUP BY user_id")
def _lww_tie(s: Session):
    got = fold(_event_log(s).withColumn("ts", F.lit("2024-01-01T00:00:00.000Z")), CATALOG["customer"])
    return got.select(F.col("key").cast("long").alias("c_custkey"), F.col("c_acctbal.value").cast("double").alias("c_acctbal"))


@_query("lww_accepted", "SELECT count(*) AS n FROM events e JOIN (SELECT user_id, max(ts) AS last FROM events WHERE event_id % 2 = 0 GROUP BY user_id) m ON e.user_id = m.user_id WHERE e.event_id % 2 = 1 AND e.ts >= last")
def _lww_accepted(s: Session):
    log = _event_log(s).where("field = 'c_acctbal'")
    stored = log.where("seq % 2 = 0")
    return accepted(stored, log.where("seq % 2 = 1").join(stored.select("id").distinct(), "id", "left_semi").select(*log.columns)).agg(F.count("*").alias("n"))


@_query("overlay_merge", "SELECT c_custkey, c_name, c_nationkey, coalesce(v, c_acctbal) AS c_acctbal, coalesce(t, c_mktsegment) AS c_mktsegment FROM customer FULL JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS v, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id) ON user_id = c_custkey")
def _overlay_merge(s: Session):
    return Overlaid(CATALOG, s.base, _event_log(s))["customer"]


# Live queries: deltas between two states --------------------------------------------------------------------------
#: The same change in SQL: every 7th order's price is cut to a tenth, every 11th moves to the next customer.
_AFTER = "after AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey % 100 + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN floor(o_totalprice / 10) ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"


def _moved(s: Session):
    """(before, after, touched): the session's tables, and those with the change laid over as a log."""
    orders = s.base["orders"]
    cut = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.floor(F.col("o_totalprice") / 10).cast("double").alias("o_totalprice"))
    moved = orders.where("o_orderkey % 11 = 0").select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("o_custkey"))
    log = log_of(cut, CATALOG["orders"], F.lit("1"), F.lit(1)).unionByName(log_of(moved, CATALOG["orders"], F.lit("1"), F.lit(2)))
    return Cached(s.base), Cached(Overlaid(CATALOG, s.base, log, {"orders"})), {"orders": log.select("id").distinct()}


def _brief(df: DataFrame) -> DataFrame:
    """Deltas of orders with the names of the fields that they carry, and the values that the change touches."""
    value = lambda name, kind: F.col("payload")[name].cast(kind)
    return df.select(
        "op", "path", F.col("parent").cast("long").alias("parent"), F.col("id").cast("long").alias("id"), F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("fields"),
        value("o_totalprice", "double").alias("price"), value("o_custkey", "long").alias("customer"), value("o_orderstatus", "string").alias("status"),
    )


_ALL_FIELDS = "'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice'"
_CHANGED = "concat_ws(',', CASE WHEN b.o_custkey <> a.o_custkey THEN 'o_custkey' END, CASE WHEN b.o_totalprice <> a.o_totalprice THEN 'o_totalprice' END)"
_OP = "CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END"
_CARRIES = "CASE WHEN a.o_orderkey IS NULL THEN false WHEN b.o_orderkey IS NULL THEN true ELSE b.{0} <> a.{0} END"
_VALUES = ", ".join(f"CASE WHEN {_CARRIES.format(f)} THEN a.{f} END AS {n}" for f, n in (("o_totalprice", "price"), ("o_custkey", "customer"), ("o_orderstatus", "status")))
_FIELDS = f"CASE WHEN b.o_orderkey IS NULL THEN {_ALL_FIELDS} WHEN a.o_orderkey IS NULL THEN '' ELSE {_CHANGED} END"


def _diff_sql(condition: str, parent: str = "NULL::BIGINT", path: str = "", on: str = "b.o_orderkey = a.o_orderkey") -> str:
    return f"WITH {_AFTER}, b AS ({condition.format('orders')}), a AS ({condition.format('after')}) SELECT {_OP} AS op, '{path}' AS path, {parent} AS parent, coalesce(b.o_orderkey, a.o_orderkey) AS id, {_FIELDS} AS fields, {_VALUES} FROM b FULL JOIN a ON {on} WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR b.o_custkey <> a.o_custkey OR b.o_totalprice <> a.o_totalprice"


@_query("scope_insert_delete", _diff_sql("SELECT * FROM {} WHERE o_totalprice > 100000"))
def _scope_insert_delete(s: Session):
    before, after, touched = _moved(s)
    return _brief(deltas(CATALOG, s.orders.where({"o_totalprice": {"$gt": 100000}}).request, before, after, touched))


@_query("scope_update", _diff_sql("SELECT * FROM {}"))
def _scope_update(s: Session):
    before, after, touched = _moved(s)
    return _brief(deltas(CATALOG, s.orders.request, before, after, touched))


@_query("window_root_diff", _diff_sql("SELECT * FROM {} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"))
def _window_root_diff(s: Session):
    before, after, touched = _moved(s)
    return _brief(deltas(CATALOG, s.orders.order_by("o_totalprice", "desc").limit(100).request, before, after, touched))


@_query("window_per_parent_diff", _diff_sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {}) WHERE r <= 3", "coalesce(b.o_custkey, a.o_custkey)", "orders", "b.o_orderkey = a.o_orderkey AND b.o_custkey = a.o_custkey"))
def _window_per_parent_diff(s: Session):
    before, after, touched = _moved(s)
    return _brief(deltas(CATALOG, s.customer.include({"orders": {"order_by": [("o_totalprice", "desc")], "limit": 3}}).request, before, after, touched))


@_query("reparent_diff", _diff_sql("SELECT * FROM {} WHERE o_orderstatus = 'F'", "coalesce(b.o_custkey, a.o_custkey)", "orders", "b.o_orderkey = a.o_orderkey AND b.o_custkey = a.o_custkey"))
def _reparent_diff(s: Session):
    before, after, touched = _moved(s)
    return _brief(deltas(CATALOG, s.customer.include({"orders": {"where": {"o_orderstatus": "F"}}}).request, before, after, touched))


_BALANCE = "WITH c2 AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -c_acctbal ELSE c_acctbal END AS bal FROM customer), b AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey {0}), a AS (SELECT o_orderkey FROM orders JOIN c2 ON o_custkey = c_custkey {1}) SELECT CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' ELSE 'DELETE' END AS op, coalesce(b.o_orderkey, a.o_orderkey) AS id FROM b FULL JOIN a ON b.o_orderkey = a.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL"


def _balances(s: Session):
    rows = s.base["customer"].where("c_custkey % 5 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"))
    log = log_of(rows, CATALOG["customer"], F.lit("1"), F.lit(1))
    return Cached(s.base), Cached(Overlaid(CATALOG, s.base, log, {"customer"})), {"customer": log.select("id").distinct()}


@_query("relational_reorder_diff", _BALANCE.format("ORDER BY c_acctbal DESC, o_orderkey LIMIT 200", "ORDER BY bal DESC, o_orderkey LIMIT 200"))
def _relational_reorder_diff(s: Session):
    before, after, touched = _balances(s)
    return deltas(CATALOG, s.orders.order_by("customer.c_acctbal", "desc").limit(200).request, before, after, touched).select("op", F.col("id").cast("long").alias("id"))


@_query("related_change_diff", _BALANCE.format("WHERE c_acctbal < 0", "WHERE bal < 0"))
def _related_change_diff(s: Session):
    """A change of related rows moves rows in and out of a filter on the relation."""
    before, after, touched = _balances(s)
    return deltas(CATALOG, s.orders.where({"customer": {"c_acctbal": {"$lt": 0}}}).request, before, after, touched).select("op", F.col("id").cast("long").alias("id"))


@_query("delta_replay", f"WITH {_AFTER} SELECT * FROM after WHERE o_totalprice > 50000 AND o_orderstatus <> 'P'")
def _delta_replay(s: Session):
    """The old result with its deltas applied is the new result."""
    before, after, touched = _moved(s)
    q = s.orders.where({"o_totalprice": {"$gt": 50000}, "o_orderstatus": {"$not": "P"}})
    return applied(q.df(), deltas(CATALOG, q.request, before, after, touched), CATALOG["orders"])


@_query("coercions", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, lower(event_type) LIKE 'cl%' AS starts, lower(event_type) LIKE '%e%' AS has, lower(event_type) LIKE '%k' AS ends FROM events")
def _coercions(s: Session):
    kind = F.col("event_type")
    return s.events.df().select("event_id", V.to_number(V.json_field(F.col("props"), "$.k")).alias("number"), V.starts_with(kind, "CL").alias("starts"), V.contains(kind, "E").alias("has"), V.ends_with(kind, "K").alias("ends"))


def event_windows(s: Session) -> DataFrame:
    """Event-time windows with a watermark; the same expression runs over a stream."""
    return s.events.df().withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


_query("event_time_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(event_windows)
