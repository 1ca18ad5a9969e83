"""What changes in a query's result between two states of the tables, as deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.plans.planner import resource_at, steps
from tideframe.plans.request import QueryRequest, relation_tree
from tideframe.schema import Catalog, Collection

DELTA_SCHEMA = "query string, path string, resource string, op string, parent string, id string, payload map<string,string>"


def payload(collection: Collection) -> Column:
    """A row as a map of strings."""
    return F.create_map(*(x for n in collection.fields for x in (F.lit(n), F.col(n).cast("string"))))


def changes(before: DataFrame, after: DataFrame, collection: Collection, nested: bool) -> DataFrame:
    """(op, parent, id, payload): INSERT with the whole row, UPDATE with the changed fields, DELETE with none.

    A row is known by its parent and primary key, so a child that moves leaves one parent and enters another. Order within a result is not compared.
    """
    def side(df, name):
        parent = F.col("parent").cast("string") if nested else F.lit(None).cast("string")
        return df.select(parent.alias("parent"), F.col(collection.pk).cast("string").alias("id"), payload(collection).alias(name))

    old, new = side(before, "old"), side(after, "new")
    both = old.join(new.withColumnsRenamed({"parent": "p", "id": "i"}), old["parent"].eqNullSafe(F.col("p")) & (old["id"] == F.col("i")), "full")
    changed = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.col("old")[k]))
    nothing = F.create_map().cast("map<string,string>")
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    body = F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), nothing).otherwise(changed)
    out = both.select(op.alias("op"), F.coalesce("parent", "p").alias("parent"), F.coalesce("id", "i").alias("id"), body.alias("payload"))
    return out.where((F.col("op") != "UPDATE") | (F.size("payload") > 0))


def affected(catalog: Catalog, request: QueryRequest, before, after, touched: dict[str, DataFrame]) -> DataFrame | None:
    """(id): root rows whose place in a request's scope writes may have changed. touched: collection → (id) of written rows.

    Written rows are followed up the relations that the request reads, over both states, since a write may move a row from one parent to another.
    None: no collection of the request was written.
    """
    def walk(resource: str, tree: dict) -> DataFrame | None:
        c = catalog[resource]
        found = [touched[resource].select(F.col("id").cast(c.fields[c.pk].spark_type).alias("id"))] if resource in touched else []
        for name, below in tree.items():
            relation = c.relation(name)
            rows = walk(relation.target, below)
            if rows is None:
                continue
            t = catalog[relation.target]
            source, key, want = (resource, relation.key, c.pk) if relation.kind == "one" else (relation.target, t.pk, relation.key)
            for state in (before, after):
                found.append(state[source].join(rows.select(F.col("id").alias("__id")), F.col(key) == F.col("__id"), "left_semi").select(F.col(want).alias("id")).where("id is not null"))
        return reduce(DataFrame.unionByName, found).distinct() if found else None

    return walk(request.resource, relation_tree(catalog, request))


def deltas(catalog: Catalog, request: QueryRequest, before, after, touched: dict[str, DataFrame] | None = None, name: str | None = None) -> DataFrame:
    """All changes of a request's scope, root and includes, between two sources: rows of DELTA_SCHEMA.

    With touched, and no limit at the root, only the affected roots are resolved in both states; a limited root is resolved whole, as a top-k.
    Windows (limits at the root or per parent) need no special cases: who is evicted, promoted or moved follows from the two states.
    """
    roots = None
    if touched is not None:
        roots = affected(catalog, request, before, after, touched)
        if roots is None:
            return catalog_frame(before, request).sparkSession.createDataFrame([], DELTA_SCHEMA)
        if request.limit is not None or request.offset or request.after is not None:
            roots = None
    old, new = (steps(catalog, state, request, roots) for state in (before, after))
    out = []
    for path in old:
        resource = resource_at(catalog, request, path)
        found = changes(old[path], new[path], catalog[resource], bool(path))
        out.append(found.select(F.lit(name or request.key()).alias("query"), F.lit(".".join(path)).alias("path"), F.lit(resource).alias("resource"), "op", "parent", "id", "payload"))
    return reduce(DataFrame.unionByName, out)


def inserts(catalog: Catalog, request: QueryRequest, state, name: str | None = None) -> DataFrame:
    """A request's whole scope in one state as rows of DELTA_SCHEMA: what a client starts from."""
    out = []
    for path, df in steps(catalog, state, request).items():
        resource = resource_at(catalog, request, path)
        c = catalog[resource]
        parent = F.col("parent").cast("string") if path else F.lit(None).cast("string")
        out.append(df.select(F.lit(name or request.key()).alias("query"), F.lit(".".join(path)).alias("path"), F.lit(resource).alias("resource"), F.lit("INSERT").alias("op"), parent.alias("parent"), F.col(c.pk).cast("string").alias("id"), payload(c).alias("payload")))
    return reduce(DataFrame.unionByName, out)


def catalog_frame(source, request: QueryRequest) -> DataFrame:
    return source[request.resource]


def applied(result: DataFrame, delta: DataFrame, collection: Collection) -> DataFrame:
    """A root result with its deltas applied: what a client that follows the stream holds."""
    mine = delta.where("path = ''").select(F.col("id").alias("__id"), F.col("op").alias("__op"), F.col("payload").alias("__new"))
    both = result.join(mine, F.col(collection.pk).cast("string") == F.col("__id"), "full").where("__op is null or __op <> 'DELETE'")
    cells = []
    for n, f in collection.fields.items():
        written = F.col("__new").isNotNull() & F.array_contains(F.map_keys("__new"), n)
        cells.append(F.when(written, F.col("__new")[n].try_cast(f.spark_type)).otherwise(F.col(n)).alias(n))
    return both.select(*cells)
