"""The registered queries of the relation engine, by name, with their SQL. Each reads its tables whole.

Every id-producing query names the column whose order gives the ids. Where a query needs what a layer already holds and what
comes later, orders are dealt by their keys: both parts grow with the table.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals
from ..functions.lists import is_canonical
from ..functions.render import flatten_structs
from ..functions.values import ColumnType, canonical_float, encode_checked, encode_column, values_text
from ..operators.builder import RelationBuilder
from ..operators.interning import intern, rows_view, with_created
from ..operators.layers import Layer, canonical_rows
from ..operators.rows import with_objects
from ..sources.dictionaries import Dictionaries, dictionary_refs
from ..sources.jsonio import member


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _early() -> Column:
    """Orders of even keys: what a layer, a pool or a set holds before the rest comes."""
    return F.col("o_orderkey") % 2 == 0


def _customers_of_orders(spark: SparkSession, d: str) -> Layer:
    """A layer with a pool of the customers of even orders."""
    layer = Layer(spark)
    layer.declare("customers", [ColumnType.INT64])
    layer.insert_rows("customers", _t(spark, d, "orders").where(_early()), ["o_custkey"], "o_orderkey")
    return layer


def intern_dense(spark: SparkSession, d: str) -> DataFrame:
    return intern(_t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey").drop("first_seen")


def created_flag(spark: SparkSession, d: str) -> DataFrame:
    return with_created(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


def layered_insert(spark: SparkSession, d: str) -> DataFrame:
    """Customers of orders in three layers: of keys 0, 1, and 2 or 3 modulo 4."""
    orders, layer = _t(spark, d, "orders"), None
    for part in ((0,), (1,), (2, 3)):
        layer = Layer(spark, layer)
        if layer.depth == 0:
            layer.declare("customers", [ColumnType.INT64])
        layer.insert_rows("customers", orders.where((F.col("o_orderkey") % 4).isin(*part)), ["o_custkey"], "o_orderkey")
    return layer.rows("customers").select(F.col("c0").alias("v"), F.col("id").alias("row_id"), "layer")


def owner_layer(spark: SparkSession, d: str) -> DataFrame:
    """Nations of keys below 10 in one layer, of the other even keys in the next: who owns the index that is a nation's key."""
    nations, root = _t(spark, d, "nation"), Layer(spark)
    root.insert("nation", nations.where("n_nationkey < 10"), ["n_name"], "n_nationkey")
    layer = Layer(spark, root)
    layer.insert("nation", nations.where("n_nationkey >= 10 and n_nationkey % 2 = 0"), ["n_name"], "n_nationkey")
    return layer.owner("nation", nations.select(F.col("n_nationkey").cast("long").alias("id")))


def insert_again(spark: SparkSession, d: str) -> DataFrame:
    """All customers of orders inserted into a child of the layer that has those of even orders: what was held keeps its id and layer."""
    child = Layer(spark, _customers_of_orders(spark, d))
    return child.insert_rows("customers", _t(spark, d, "orders"), ["o_custkey"], "o_orderkey").select(F.col("c0").alias("v"), F.col("id").alias("row_id"), "layer", "created")


def find_row(spark: SparkSession, d: str) -> DataFrame:
    return _customers_of_orders(spark, d).find_rows("customers", _t(spark, d, "customer").select("c_custkey"), ["c_custkey"]).withColumnRenamed("id", "row_id")


def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Nation and hundreds of the balance, of customers of even keys, looked up for all."""
    key, layer = ["c_nationkey", "hundreds"], Layer(spark)
    customers = _t(spark, d, "customer").withColumn("hundreds", F.floor(F.col("c_acctbal") / 100))
    layer.insert("account", customers.where("c_custkey % 2 = 0"), key, "c_custkey")
    return layer.find("account", customers.select("c_custkey", *key)).select("c_custkey", F.col("id").alias("row_id"))


def pool_size(spark: SparkSession, d: str) -> DataFrame:
    """A pool of customers for each status of orders; a status keys its pool."""
    orders, layer = _t(spark, d, "orders"), Layer(spark)
    kinds = layer.insert("status", orders, ["o_orderstatus"], "o_orderkey", key_types=[ColumnType.INT64]).select("o_orderstatus", "id").collect()
    for status, i in kinds:
        layer.insert_rows(f"status/{i}", orders.where(F.col("o_orderstatus") == status), ["o_custkey"], "o_orderkey")
    return spark.createDataFrame([(status, layer.pool_size(f"status/{i}")) for status, i in kinds], "o_orderstatus string, n long")


def schema_intern(spark: SparkSession, d: str) -> DataFrame:
    """Lists of column types by the sizes of parts."""
    lists = [F.array(*[F.lit(int(t)) for t in x]) for x in ((0, 2), (7, 7, 5), (6,), (0, 2, 7))]
    types = F.when(F.col("p_size") <= 10, lists[0]).when(F.col("p_size") <= 20, lists[1]).when(F.col("p_size") <= 30, lists[2]).otherwise(lists[3])
    schemas = intern(_t(spark, d, "part").withColumn("types", types), ["types"], "p_partkey", id_name="schema_id")
    return schemas.select(F.concat_ws(",", F.transform("types", lambda t: t.cast("string"))).alias("types"), "schema_id")


def encode_i32(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", encode_column(F.col("s_nationkey") - 12, ColumnType.INT32).alias("bits"))


def encode_f64(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", encode_column(F.col("s_acctbal"), ColumnType.FLOAT64).alias("bits"))


def encode_checked_i32(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_orderkey") * 1_000_000
    return _t(spark, d, "orders").select("o_orderkey", encode_checked(v, ColumnType.INT32).alias("bits"))


def float_canon(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", canonical_float(F.col("s_acctbal") / 7e9).alias("x"))


def row_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", values_text(F.col("s_suppkey"), F.col("s_nationkey")).alias("text"))


def get_objects(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as rows of a number and an object, each with its object's record."""
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("c0"), F.col("s_nationkey").cast("long").alias("c1"))
    nations = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    return with_objects(rows, [ColumnType.INT64, ColumnType.OBJECT], nations).select(F.col("c0").alias("s_suppkey"), "o1.n_name")


def _builder(rows: DataFrame, label: str, order: str) -> RelationBuilder:
    """The distinct values of a column as a set of rows, in the order of another."""
    own = RelationBuilder(rows.sparkSession, [(label, ColumnType.INT64)])
    own.insert(rows.select(F.col(label), F.col(order).alias("__order")), "__order")
    return own


def builder_insert(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").withColumnRenamed("o_custkey", "v")
    own = _builder(orders.where(_early()), "v", "o_orderkey")
    own.insert(orders.select("v", F.col("o_orderkey").alias("o")), "o")
    return own.rows()


def contains_semi(spark: SparkSession, d: str) -> DataFrame:
    held = _builder(_t(spark, d, "orders").where(_early()).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey")
    return held.contains(_t(spark, d, "customer").select("c_custkey"))


def swap_erase(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers without the rows at 7, then at 0, then the last."""
    own = _builder(_t(spark, d, "supplier").withColumn("o", F.col("s_suppkey")), "s_suppkey", "o")
    for position in (7, 0, own.size - 3):
        own.erase(position)
    return own.rows()


def rename_columns(spark: SparkSession, d: str) -> DataFrame:
    own = RelationBuilder(spark, [("s_suppkey", ColumnType.INT64), ("s_nationkey", ColumnType.INT64)])
    own.insert(_t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("s_suppkey").alias("o")), "o")
    own.rename([("a", ColumnType.INT64), ("b", ColumnType.INT64)])
    return own.rows().select("a", "b")


def nullary_truth(spark: SparkSession, d: str) -> DataFrame:
    """Relations of no columns: whether there are orders below 0, above 0, and of each after a row was erased."""
    orders, out = _t(spark, d, "orders"), []
    for name, where in (("below", "o_totalprice < 0"), ("above", "o_totalprice > 0")):
        own = RelationBuilder(spark)
        own.insert(orders.where(where).select("o_orderkey"), "o_orderkey")
        before = own.size
        if before:
            own.erase(0)
        out.append((name, before, own.size, own.empty))
    return spark.createDataFrame(out, "name string, size int, after int, empty boolean")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return canonical_rows(_t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


def canonical_relation(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("l_orderkey", F.concat_ws(",", F.transform("row_ids", lambda x: x.cast("string"))).alias("row_ids"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, relation, created): the lines of every order as a relation of a pool of line numbers, all at once."""
    layer, lines = Layer(spark), _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    layer.declare("lines", [ColumnType.INT64])
    layer.insert_rows("lines", lines.withColumn("o", F.col("line")), ["line"], "o")
    rows = layer.find_rows("lines", lines, ["line"])
    return layer.insert_relations("lines", [("line", ColumnType.INT64)], rows, "l_orderkey")


def relation_intern(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("l_orderkey", F.col("relation").alias("relation_id"), "created")


def relation_eq(spark: SparkSession, d: str) -> DataFrame:
    """Whether each order's lines are those of the order of the next key: equal relations have one index."""
    own = _relations(spark, d)
    a, b = own.select(F.col("l_orderkey").alias("a"), F.col("relation").alias("ra")), own.select((F.col("l_orderkey") - 1).alias("a"), F.col("relation").alias("rb"))
    return a.join(b, "a").select("a", (F.col("ra") == F.col("rb")).alias("equal"))


def _statuses(spark: SparkSession, d: str) -> tuple[Layer, list[tuple[str, int]]]:
    """A pool of all customers of orders, and for each status the relation of its orders' customers."""
    orders, layer = _t(spark, d, "orders"), Layer(spark)
    layer.declare("customers", [ColumnType.INT64])
    layer.insert_rows("customers", orders, ["o_custkey"], "o_orderkey")
    rows = layer.find_rows("customers", orders.select("o_orderstatus", "o_custkey"), ["o_custkey"])
    made = layer.insert_relations("customers", [("customer", ColumnType.INT64)], rows, "o_orderstatus")
    return layer, sorted((r["o_orderstatus"], r["relation"]) for r in made.collect())


def _of_each(spark: SparkSession, d: str, f) -> DataFrame:
    layer, made = _statuses(spark, d)
    out = None
    for status, i in made:
        own = f(layer.relation(i)).withColumn("o_orderstatus", F.lit(status))
        out = own if out is None else out.unionByName(own)
    return out


def relation_contains(spark: SparkSession, d: str) -> DataFrame:
    """Whether each status's relation holds each customer."""
    asked = _t(spark, d, "customer").select("c_custkey")
    return _of_each(spark, d, lambda r: r.contains(asked, ["c_custkey"]))


def relation_row_at(spark: SparkSession, d: str) -> DataFrame:
    """The fourth row, by id, of each status's relation."""
    return _of_each(spark, d, lambda r: r.row(3).select(F.col("id").alias("row_id"), "customer"))


def rows_of_ids(spark: SparkSession, d: str) -> DataFrame:
    """The customer's row for every order: customers are named again and again, in no order."""
    ids = _t(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("c_custkey"))
    return rows_view(ids, _t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")


def is_canonical_list(spark: SparkSession, d: str) -> DataFrame:
    order = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_linenumber"])
    lists = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(order.alias("a"))
    return lists.select("l_orderkey", is_canonical(F.col("a")).alias("is_set"), is_canonical(F.col("a"), dedup=False).alias("is_sorted"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return (
        _t(spark, d, "lineitem").groupBy("l_orderkey")
        .agg(F.min("l_discount").alias("a0"), F.max("l_discount").alias("a1"), F.min("l_tax").alias("b0"), F.max("l_tax").alias("b1"))
        .select("l_orderkey", intervals.interval(F.col("a0"), F.col("a1")).alias("a"), intervals.interval(F.col("b0"), F.col("b1")).alias("b"))
    )


def interval_ops(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    both, hull = intervals.intersect(a, b), intervals.hull(a, b)
    return _ranges(spark, d).select("l_orderkey", both["lo"].alias("meet_lo"), both["hi"].alias("meet_hi"), hull["lo"].alias("hull_lo"), hull["hi"].alias("hull_hi"), intervals.subset(a, b).alias("inside"))


def interval_contains(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d).select("l_orderkey", intervals.contains(F.col("a"), F.lit(0.05)).alias("held"))


def interval_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Every bound of sum, difference, product, quotient (by the second range moved up by 1) and negation."""
    a, b = F.col("a"), F.col("b")
    above = intervals.interval(b["lo"] + 1.0, b["hi"] + 1.0)
    results = {"sum": intervals.add(a, b), "diff": intervals.subtract(a, b), "prod": intervals.multiply(a, b), "quot": intervals.divide(a, above), "neg": intervals.negate(a)}
    return _ranges(spark, d).select("l_orderkey", *[i.alias(n) for n, i in results.items()]).select("l_orderkey", *[F.col(n)[x].alias(f"{n}_{x}") for n in results for x in ("lo", "hi")])


def dict_refs(spark: SparkSession, d: str) -> DataFrame:
    nations = _t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    _, refs = dictionary_refs(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), nations.withColumn("__k", F.col("c_nationkey").cast("long")), ["c_nationkey"], "__k", "n")
    return refs.select("c_custkey", "ref")


@dataclasses.dataclass(frozen=True)
class _Region:
    name: str


@dataclasses.dataclass(frozen=True)
class _Nation:
    name: str
    region: _Region


def dict_tables(spark: SparkSession, d: str) -> DataFrame:
    """Nations (25 of them, by the table's definition) as objects with their regions: the rows of the nations' table."""
    pairs = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").select("n_name", "r_name").collect()
    tables = Dictionaries()
    tables.register_table(_Region, "regions", "r")
    tables.register_table(_Nation, "nations", "n")
    refs = tables.serialize([_Nation(n, _Region(r)) for n, r in pairs])
    return spark.createDataFrame([(ref, row["name"], row["region"]) for ref, row in zip(refs, tables.table(_Nation), strict=True)], "ref string, name string, region string")


def flatten_struct(spark: SparkSession, d: str) -> DataFrame:
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    nested = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("region"))
    return flatten_structs(nested)


def json_member(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", member(F.col("props"), "k").alias("k"))


QUERIES = {
    "intern_dense": intern_dense, "created_flag": created_flag, "layered_insert": layered_insert, "owner_layer": owner_layer, "insert_again": insert_again, "find_row": find_row,
    "find_symbol": find_symbol, "pool_size": pool_size, "schema_intern": schema_intern, "encode_i32": encode_i32, "encode_f64": encode_f64, "encode_checked": encode_checked_i32,
    "float_canon": float_canon, "values_text": row_text, "get_objects": get_objects, "builder_insert": builder_insert, "contains_semi": contains_semi, "swap_erase": swap_erase,
    "rename_columns": rename_columns, "nullary_truth": nullary_truth, "canonical_relation": canonical_relation, "relation_intern": relation_intern, "relation_eq": relation_eq,
    "relation_contains": relation_contains, "relation_row_at": relation_row_at, "rows_view": rows_of_ids, "is_canonical": is_canonical_list, "interval_ops": interval_ops,
    "interval_contains": interval_contains, "interval_arithmetic": interval_arithmetic, "dict_refs": dict_refs, "dict_tables": dict_tables, "flatten_struct": flatten_struct,
    "json_member": json_member,
}

_POOL = "select o_custkey as v, row_number() over (order by min(o_orderkey)) - 1 as id from orders where o_orderkey % 2 = 0 group by o_custkey"
_ALL = "select o_custkey as v, row_number() over (order by min(o_orderkey)) - 1 as id from orders group by o_custkey"
_LISTS = "select l_orderkey, list_sort(list_distinct(list(l_linenumber))) as a from lineitem group by l_orderkey"
_RANGES = "select l_orderkey, min(l_discount) as a0, max(l_discount) as a1, min(l_tax) as b0, max(l_tax) as b1 from lineitem group by l_orderkey"
#: Bounds of ranges above or at 0: a sum's rest by two-sum, a product's and a quotient's by splitting factors into halves of 26 bits.
_ARITHMETIC = f"""
    with r as (select *, b0 + 1 as c0, b1 + 1 as c1 from ({_RANGES})),
    rounded as (
      select *, a0 + b0 as s0, a1 + b1 as s1, a0 - b1 as d0, a1 - b0 as d1, a0 * b0 as p0, a1 * b1 as p1, a0 / c1 as q0, a1 / c0 as q1 from r
    ),
    split as (
      select *, 134217729.0::double * a0 - (134217729.0::double * a0 - a0) as a0h, 134217729.0::double * a1 - (134217729.0::double * a1 - a1) as a1h,
        134217729.0::double * b0 - (134217729.0::double * b0 - b0) as b0h, 134217729.0::double * b1 - (134217729.0::double * b1 - b1) as b1h,
        134217729.0::double * c0 - (134217729.0::double * c0 - c0) as c0h, 134217729.0::double * c1 - (134217729.0::double * c1 - c1) as c1h,
        134217729.0::double * q0 - (134217729.0::double * q0 - q0) as q0h, 134217729.0::double * q1 - (134217729.0::double * q1 - q1) as q1h from rounded
    ),
    rests as (
      select *, (a0 - (s0 - (s0 - a0))) + (b0 - (s0 - a0)) as s0e, (a1 - (s1 - (s1 - a1))) + (b1 - (s1 - a1)) as s1e,
        (a0 - (d0 - (d0 - a0))) + (-b1 - (d0 - a0)) as d0e, (a1 - (d1 - (d1 - a1))) + (-b0 - (d1 - a1)) as d1e,
        (((a0h * b0h - p0) + a0h * (b0 - b0h)) + (a0 - a0h) * b0h) + (a0 - a0h) * (b0 - b0h) as p0e,
        (((a1h * b1h - p1) + a1h * (b1 - b1h)) + (a1 - a1h) * b1h) + (a1 - a1h) * (b1 - b1h) as p1e,
        (a0 - q0 * c1) - ((((q0h * c1h - q0 * c1) + q0h * (c1 - c1h)) + (q0 - q0h) * c1h) + (q0 - q0h) * (c1 - c1h)) as q0e,
        (a1 - q1 * c0) - ((((q1h * c0h - q1 * c0) + q1h * (c0 - c0h)) + (q1 - q1h) * c0h) + (q1 - q1h) * (c0 - c0h)) as q1e from split
    )
    select l_orderkey, case when s0e < 0 then nextafter(s0, '-inf'::double) else s0 end as sum_lo, case when s1e > 0 then nextafter(s1, 'inf'::double) else s1 end as sum_hi,
      case when d0e < 0 then nextafter(d0, '-inf'::double) else d0 end as diff_lo, case when d1e > 0 then nextafter(d1, 'inf'::double) else d1 end as diff_hi,
      case when p0e < 0 then nextafter(p0, '-inf'::double) else p0 end as prod_lo, case when p1e > 0 then nextafter(p1, 'inf'::double) else p1 end as prod_hi,
      case when q0e < 0 then nextafter(q0, '-inf'::double) else q0 end as quot_lo, case when q1e > 0 then nextafter(q1, 'inf'::double) else q1 end as quot_hi,
      0.0 - a1 as neg_lo, 0.0 - a0 as neg_hi from rests"""

ORACLE_SQL = {
    "intern_dense": "select c_mktsegment, c_nationkey, cast(row_number() over (order by first_seen) - 1 as bigint) as row_id from (select c_mktsegment, c_nationkey, min(c_custkey) as first_seen from customer group by 1, 2) t",
    "created_flag": "select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) = 1 as created from orders",
    "layered_insert": """
        with held as (select o_custkey as v, min(least(o_orderkey % 4, 2)) as layer from orders group by 1),
        firsts as (select v, layer, min(o_orderkey) as o from held join orders on v = o_custkey and least(o_orderkey % 4, 2) = layer group by 1, 2)
        select v, cast(row_number() over (order by layer, o) - 1 as bigint) as row_id, cast(layer as integer) as layer from firsts""",
    "owner_layer": "select cast(n_nationkey as bigint) as id, case when n_nationkey < 10 then 0 when n_nationkey < 10 + (select count(*) from nation where n_nationkey >= 10 and n_nationkey % 2 = 0) then 1 end as owner from nation",
    "insert_again": f"""
        with parent as ({_POOL}), child as (
          select o_custkey as v, row_number() over (order by min(o_orderkey)) - 1 + (select count(*) from parent) as id from orders where o_custkey not in (select v from parent) group by 1)
        select v, cast(id as bigint) as row_id, 0 as layer, false as created from parent union all select v, cast(id as bigint), 1, true from child""",
    "find_row": f"select c_custkey, cast(p.id as bigint) as row_id from customer left join ({_POOL}) p on c_custkey = p.v",
    "find_symbol": """
        with c as (select c_custkey, c_nationkey as k, cast(floor(c_acctbal / 100) as bigint) as h from customer)
        select c_custkey, cast(s.id as bigint) as row_id from c left join (select k, h, row_number() over (order by min(c_custkey)) - 1 as id from c where c_custkey % 2 = 0 group by 1, 2) s using (k, h)""",
    "pool_size": "select o_orderstatus, count(distinct o_custkey) as n from orders group by 1",
    "schema_intern": """
        select types, cast(row_number() over (order by min(p_partkey)) - 1 as bigint) as schema_id from (
          select p_partkey, case when p_size <= 10 then '0,2' when p_size <= 20 then '7,7,5' when p_size <= 30 then '6' else '0,2,7' end as types from part
        ) group by types""",
    "encode_i32": "select s_suppkey, cast(s_nationkey - 12 as bigint) & 4294967295 as bits from supplier",
    "encode_f64": "select s_suppkey, (s_acctbal + 0.0)::bit::bigint as bits from supplier",
    "encode_checked": """
        select o_orderkey, case when v between -2147483648 and 2147483647 then v & 4294967295 end as bits
        from (select o_orderkey, cast(o_orderkey as bigint) * 1000000 as v from orders)""",
    "float_canon": "select s_suppkey, case when isinf(x) or isnan(x) then x else round(x / 1e-12::double) * 1e-12::double end as x from (select s_suppkey, s_acctbal / 7e9::double as x from supplier)",
    "values_text": "select s_suppkey, concat_ws(' ', cast(s_suppkey as varchar), cast(s_nationkey as varchar)) as text from supplier",
    "get_objects": "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey",
    "builder_insert": f"""
        with early as ({_POOL}) select v, cast(id as bigint) as pos from early union all
        select o_custkey, cast(row_number() over (order by min(o_orderkey)) - 1 + (select count(*) from early) as bigint) from orders where o_custkey not in (select v from early) group by 1""",
    "contains_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderkey % 2 = 0)",
    "swap_erase": """
        with p as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as pos, count(*) over () as n from supplier),
        a as (select s_suppkey, case when pos = n - 1 then 7 else pos end as pos, n - 1 as n from p where pos <> 7),
        b as (select s_suppkey, case when pos = n - 1 then 0 else pos end as pos, n - 1 as n from a where pos <> 0)
        select s_suppkey, cast(pos as bigint) as pos from b where pos <> n - 1""",
    "rename_columns": "select s_suppkey as a, cast(s_nationkey as bigint) as b from supplier",
    "nullary_truth": """
        select name, size, 0 as after, true as empty from (
          select 'below' as name, cast(exists (select 1 from orders where o_totalprice < 0) as integer) as size
          union all select 'above', cast(exists (select 1 from orders where o_totalprice > 0) as integer))""",
    "canonical_relation": f"select l_orderkey, array_to_string(a, ',') as row_ids from ({_LISTS})",
    "relation_intern": f"""
        with l as ({_LISTS}), r as (select a, min(l_orderkey) as first, row_number() over (order by min(l_orderkey)) - 1 as id from l group by a)
        select l_orderkey, cast(r.id as bigint) as relation_id, l_orderkey = first as created from l join r on l.a = r.a""",
    "relation_eq": f"with l as ({_LISTS}) select x.l_orderkey as a, x.a = y.a as equal from l x join l y on y.l_orderkey = x.l_orderkey + 1",
    "relation_contains": """
        with r as (select distinct o_orderstatus, o_custkey from orders)
        select s.o_orderstatus, c_custkey, exists (select 1 from r where r.o_orderstatus = s.o_orderstatus and r.o_custkey = c_custkey) as held
        from customer cross join (select distinct o_orderstatus from r) s""",
    "relation_row_at": f"""
        with p as ({_ALL}), r as (select distinct o_orderstatus, id, v from orders join p on o_custkey = p.v),
        n as (select *, row_number() over (partition by o_orderstatus order by id) as k from r)
        select o_orderstatus, cast(id as bigint) as row_id, v as customer from n where k = 4""",
    "rows_view": "select o_orderkey as pos, c_custkey, c_name from orders join customer on o_custkey = c_custkey",
    "is_canonical": """
        select l_orderkey, a = list_sort(list_distinct(a)) as is_set, a = list_sort(a) as is_sorted
        from (select l_orderkey, list(l_linenumber order by l_partkey, l_linenumber) as a from lineitem group by 1)""",
    "interval_ops": f"""
        select l_orderkey, case when greatest(a0, b0) <= least(a1, b1) then greatest(a0, b0) end as meet_lo, case when greatest(a0, b0) <= least(a1, b1) then least(a1, b1) end as meet_hi,
          least(a0, b0) as hull_lo, greatest(a1, b1) as hull_hi, b0 <= a0 and a1 <= b1 as inside from ({_RANGES})""",
    "interval_contains": f"select l_orderkey, cast(0.05 as double) between a0 and a1 as held from ({_RANGES})",
    "interval_arithmetic": _ARITHMETIC,
    "dict_refs": "select c_custkey, 'n' || cast(id as varchar) as ref from customer join (select n_nationkey, row_number() over (order by n_nationkey) - 1 as id from nation) n on c_nationkey = n_nationkey",
    "dict_tables": """
        with p as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey),
        r as (select r_name, row_number() over (order by min(n_nationkey)) - 1 as id from p group by 1)
        select 'n' || (row_number() over (order by n_nationkey) - 1) as ref, n_name as name, 'r' || r.id as region from p join r using (r_name)""",
    "flatten_struct": 'select n_nationkey, r_regionkey as "region.key", r_name as "region.name" from nation join region on n_regionkey = r_regionkey',
    "json_member": "select event_id, props->>'$.k' as k from events",
}
