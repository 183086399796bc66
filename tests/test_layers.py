import pytest
from pyspark.sql import functions as F

from millrace.functions.values import ColumnType as T
from millrace.operators.builder import RelationBuilder
from millrace.operators.interning import dense_ids, intern, owner_of, rows_view, with_created
from millrace.operators.layers import Layer


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, i) if isinstance(r, tuple) else (r, i) for i, r in enumerate(rows)], schema + ", o long")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ids_are_dense_in_first_seen_order(spark):
    df = frame(spark, ["b", "a", "b", "c", "a"], "v string")
    assert got(intern(df, ["v"], "o"), "row_id", "v") == [(0, "b"), (1, "a"), (2, "c")]
    assert got(with_created(df, ["v"], ["o"]), "o", "created") == [(0, True), (1, True), (2, False), (3, True), (4, False)]
    assert intern(df.limit(0), ["v"], "o").count() == 0


def test_ranges_number_like_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 10007).alias("k"))
    one = got(dense_ids(df, "k", 5), "k", "row_id")
    assert one == got(dense_ids(df, "k", 5, one_task=300), "k", "row_id")
    assert [r[1] for r in one] == list(range(5, 5005))


def test_owner_and_rows_view(spark):
    ids = spark.createDataFrame([(-1,), (0,), (4,), (5,), (9,), (10,)], "id long")
    assert [r[0] for r in ids.select(owner_of(F.col("id"), [5, 10])).collect()] == [None, 0, 0, 1, 1, None]
    table = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, v string")
    view = rows_view(spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "pos long, row_id long"), table)
    assert got(view, "pos", "v") == [(0, "b"), (1, "a"), (2, "b")]
    with pytest.raises(Exception, match="no row with the id 7"):
        rows_view(spark.createDataFrame([(0, 7)], "pos long, row_id long"), table).collect()


def test_three_layers_share_ids(spark):
    root = Layer(spark)
    child = Layer(spark, root)
    grand = Layer(spark, child)
    assert got(root.insert("e", frame(spark, [7], "v int"), ["v"], "o"), "v", "id", "layer", "created") == [(7, 0, 0, True)]
    assert got(child.insert("e", frame(spark, [11, 7], "v int"), ["v"], "o"), "v", "id", "layer", "created") == [(7, 0, 0, False), (11, 1, 1, True)]
    assert got(grand.insert("e", frame(spark, [13], "v int"), ["v"], "o"), "v", "id", "layer", "created") == [(13, 2, 2, True)]
    assert (root.size("e"), child.size("e"), grand.size("e")) == (1, 2, 3)
    assert got(grand.find("e", spark.createDataFrame([(7,), (11,), (99,)], "v int")), "v", "id") == [(7, 0), (11, 1), (99, None)]
    assert got(grand.owner("e", spark.range(4)), "id", "owner") == [(0, 0), (1, 1), (2, 2), (3, None)]
    assert grand.owner_layer("e", 1) is child and grand.owner_layer("e", 3) is None
    assert grand.holds("e", 0, root) and not grand.holds("e", 0, child) and not Layer(spark).holds("e", 0, root)
    assert grand.contains("e", spark.range(5)).count() == 3
    grand.clear()
    assert grand.size("e") == 2
    assert got(grand.insert("e", frame(spark, [21, 7], "v int"), ["v"], "o"), "v", "id") == [(7, 0), (21, 2)]
    assert grand.number > child.number > root.number and grand.depth == 2 and grand.memory_usage("e") > 0


def test_prepare_runs_once_before_interning(spark):
    calls = []
    layer = Layer(spark)
    layer.prepare["e"] = lambda df: calls.append(1) or df.withColumn("v", F.abs("v"))
    assert got(layer.insert("e", frame(spark, [-3, 3, 4], "v int"), ["v"], "o"), "v", "id") == [(3, 0), (4, 1)]
    assert calls == [1]


def test_pools_check_before_they_store(spark):
    layer = Layer(spark, num_objects=4)
    assert layer.schema([T.OBJECT, T.OBJECT]) == (0, True) and layer.schema([7, 7]) == (0, False) and layer.schema([T.FLOAT64]) == (1, True)
    assert got(layer.insert_rows("schema/0", frame(spark, [(0, 3), (1, 1), (0, 3)], "a long, b long"), ["a", "b"], "o"), "c0", "c1", "id") == [(0, 3, 0), (1, 1, 1)]
    for rows, names, error in (([(4, 0)], ["a", "b"], IndexError), ([(0, 0)], ["a"], ValueError)):
        with pytest.raises(error):
            layer.insert_rows("schema/0", frame(spark, rows, "a long, b long"), names, "o")
    with pytest.raises(IndexError):
        layer.insert_rows("schema/9", frame(spark, [(0, 0)], "a long, b long"), ["a", "b"], "o")
    assert layer.pool_size("schema/0") == 2
    child = Layer(spark, layer, num_objects=5)
    assert child.object_bits == 3 and layer.object_bits == 2
    assert got(child.insert_rows("schema/0", frame(spark, [(4, 0), (1, 1)], "a long, b long"), ["a", "b"], "o"), "c0", "c1", "id", "layer") == [(1, 1, 1, 0), (4, 0, 2, 1)]
    assert got(child.find_rows("schema/0", spark.createDataFrame([(4, 0), (9, 9)], "a long, b long"), ["a", "b"]), "a", "id") == [(4, 2), (9, None)]
    assert got(child.find_rows("schema/0", spark.createDataFrame([(4,)], "a long"), ["a"]), "id") == [(None,)]
    floats = layer.insert_rows("schema/1", frame(spark, [0.0, -0.0, float("nan"), float("nan"), 1.0], "x double"), ["x"], "o")
    assert floats.count() == 3
    with pytest.raises(ValueError):
        layer.declare("schema/0", [T.INT32])
    with pytest.raises(ValueError):
        Layer(spark, num_objects=2**32)
    layer.clear_all()
    with pytest.raises(IndexError):
        layer.types("schema/0")
    assert layer.schema([("x", T.INT32)]) == (0, True) and layer.types("schema/0") == (T.INT32,)


def test_symbols_that_key_pools(spark):
    layer = Layer(spark)
    layer.insert("f", frame(spark, [1], "v int"), ["v"], "o", key_types=[T.OBJECT])
    assert layer.types("f/0") == (T.OBJECT,)
    layer.insert_rows("f/0", frame(spark, [5], "a long"), ["a"], "o")
    layer.clear()
    assert layer.size("f") == 1 and layer.pool_size("f/0") == 0


def test_nullary_rows(spark):
    layer = Layer(spark)
    layer.declare("p", [])
    rows = spark.range(2).select(F.col("id").alias("o"))
    assert layer.insert_rows("p", rows, [], "o").count() == 1 and layer.pool_size("p") == 1


def test_relations(spark):
    layer = Layer(spark)
    layer.schema([T.INT64])
    layer.insert_rows("schema/0", frame(spark, [10, 20, 30, 40], "a long"), ["a"], "o")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert layer.insert_relation("schema/0", [("x", T.INT64)], ids(2, 0, 2)) == (0, True)
    assert layer.insert_relation("schema/0", [("x", T.INT64)], ids(0, 2)) == (0, False)
    assert layer.insert_relation("schema/0", [("y", T.INT64)], ids(0, 2)) == (1, True)
    assert len(layer) == 2
    r = layer.relation(0)
    assert got(r.rows(), "id", "x") == [(0, 10), (2, 30)] and r.size() == 2 and r.arity == 1
    assert got(r.row(1), "x") == [(30,)]
    with pytest.raises(IndexError, match="no row 2"):
        r.row(2)
    assert got(r.contains(spark.createDataFrame([(10,), (20,), (99,)], "a long"), ["a"]), "a", "held") == [(10, True), (20, False), (99, False)]
    assert r == layer.relation(0) and r != layer.relation(1)
    for args, error in (((("schema/0", [("x", T.INT64)], ids(9))), IndexError), ((("schema/0", [("x", T.INT32)], ids(0))), ValueError), ((("none", [("x", T.INT64)], ids(0))), IndexError)):
        with pytest.raises(error):
            layer.insert_relation(*args)
    with pytest.raises(IndexError):
        layer.relation(5)


def test_builder(spark):
    b = RelationBuilder(spark, [("a", T.INT64), ("b", T.INT64)])
    assert b.empty and b.arity == 2
    assert got(b.insert(frame(spark, [(1, 1), (2, 2), (1, 1), (3, 3)], "a long, b long"), "o"), "a", "pos") == [(1, 0), (2, 1), (3, 2)]
    assert got(b.insert(frame(spark, [(3, 3), (4, 4)], "x long, y long"), "o"), "a", "pos") == [(3, 2), (4, 3)]
    b.erase(1)
    assert got(b.rows(), "pos", "a") == [(0, 1), (1, 4), (2, 3)]
    b.erase(2)
    b.erase(0)
    assert got(b.rows(), "pos", "a") == [(0, 4)] and b.size == 1
    with pytest.raises(IndexError):
        b.erase(1)
    assert got(b.find(spark.createDataFrame([(4, 4), (5, 5)], "a long, b long")), "a", "pos") == [(4, 0), (5, None)]
    assert b.contains(spark.createDataFrame([(4, 4), (5, 5)], "a long, b long")).count() == 1
    assert got(b.find(spark.createDataFrame([(4,)], "a long")), "pos") == [(None,)]
    b.rename([("p", T.INT64), ("q", T.INT64)])
    assert got(b.at(0), "p", "q") == [(4, 4)]
    for bad in ([("p", T.INT64)], [("p", T.INT64), ("q", T.INT32)], [("p", T.INT64), ("p", T.INT64)]):
        with pytest.raises(ValueError):
            b.rename(bad)
    with pytest.raises(ValueError):
        b.insert(frame(spark, [1], "a long"), "o")
    with pytest.raises(ValueError):
        RelationBuilder(spark, [("a", 8)])
    b.clear()
    assert b.empty and b.labels == ["p", "q"]
    none = RelationBuilder(spark)
    assert none.empty
    none.insert(spark.range(1).select(F.col("id").alias("o")), "o")
    assert none.size == 1
    none.erase(0)
    assert none.empty


def test_rows_are_read_by_position(spark):
    from millrace.operators import rows as R

    types = [T.OBJECT, T.INT32, T.INT32]
    df = spark.createDataFrame([(1, -1, 5), (9, 2, 3)], "c0 long, c1 int, c2 int")
    assert R.typed(types, T.INT32, 1) == ["c1", "c2"] and R.value_column(types, 0) == "c0"
    for bad, error in ((lambda: R.value_column(types, 3), IndexError), (lambda: R.typed(types, T.INT32), ValueError), (lambda: R.typed(types, T.INT32, 2, 9), IndexError)):
        with pytest.raises(error):
            bad()
    assert df.select(R.all_bits(types)).first()[0] == [1, 2**32 - 1, 5]
    objects = spark.createDataFrame([(1, "one"), (9, "nine")], "id long, name string")
    assert [r["o0"]["name"] for r in R.with_objects(df, types, objects).orderBy("c0").collect()] == ["one", "nine"]
    with pytest.raises(Exception, match="no object has the index 9"):
        R.with_objects(df, types, objects.where("id = 1")).collect()


def test_nulls_are_values(spark):
    layer = Layer(spark)
    rows = spark.createDataFrame([(None, "a", 0), (None, "a", 1), (None, None, 2)], "x int, y string, o long")
    assert layer.insert("e", rows, ["x", "y"], "o").count() == 2
    assert got(layer.insert("e", rows, ["x", "y"], "o"), "id", "created") == [(0, False), (1, False)] and layer.size("e") == 2
    assert got(layer.find("e", rows.select("x", "y", "o")), "o", "id") == [(0, 0), (1, 0), (2, 1)]


def test_ties_go_by_the_identity(spark):
    df = spark.createDataFrame([(x, 1) for x in ("d", "b", "a", "c")], "v string, o long")
    for parts in (1, 3):
        assert got(intern(df.repartition(parts), ["v"], "o"), "row_id", "v") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert [r[1] for r in got(dense_ids(df, "o", ties=["v"], one_task=2), "row_id", "v")] == ["a", "b", "c", "d"]


def test_other_key_types_are_refused_before_anything_is_stored(spark):
    layer = Layer(spark)
    layer.insert("f", frame(spark, [1], "v int"), ["v"], "o", key_types=[T.OBJECT])
    for identity, kinds in ((["v"], [T.INT32]), (["v", "o"], None)):
        with pytest.raises(ValueError):
            layer.insert("f", frame(spark, [2], "v int"), identity, "o", key_types=kinds)
    assert layer.size("f") == 1
    layer.insert("e", frame(spark, [1], "v int"), ["v"], "o")
    with pytest.raises(ValueError):
        layer.insert("e", frame(spark, [2], "v int"), ["v"], "o", key_types=[T.OBJECT])


def test_a_record_says_what_columns_its_pool_has(spark):
    layer = Layer(spark, num_objects=4)
    arity = lambda record: [T.OBJECT] * record["v"]
    layer.insert("f", frame(spark, [2, 0, 1], "v int"), ["v"], "o", key_types=arity)
    child = Layer(spark, layer)
    assert [child.types(f"f/{i}") for i in range(3)] == [(T.OBJECT, T.OBJECT), (), (T.OBJECT,)]
    for bad in ("f/3", "f/x", "g/0"):
        with pytest.raises(IndexError):
            child.types(bad)
    child.insert_rows("f/0", frame(spark, [(0, 3)], "a long, b long"), ["a", "b"], "o")
    child.insert_rows("f/2", frame(spark, [3], "a long"), ["a"], "o")
    with pytest.raises(ValueError):
        child.insert_rows("f/2", frame(spark, [(0, 3)], "a long, b long"), ["a", "b"], "o")
    with pytest.raises(IndexError):
        child.insert_rows("f/2", frame(spark, [4], "a long"), ["a"], "o")
    assert [child.pool_size(f"f/{i}") for i in range(3)] == [1, 0, 1] and layer.pool_size("f/0") == 0
    for name in ("f/9", "schema/4"):
        with pytest.raises(ValueError):
            child.declare(name, [T.INT32])
    child.clear_rows()
    assert child.pool_size("f/0") == 0


def test_schemas_are_read_by_index(spark):
    root = Layer(spark)
    root.schema([T.INT32])
    layer = Layer(spark, root)
    assert layer.schema([("a", T.BOOL), ("b", T.FLOAT32)]) == (1, True) and layer.schema([T.INT32]) == (0, False)
    assert layer.schema_types(1) == (T.BOOL, T.FLOAT32) and layer.contains_schema(1) and not root.contains_schema(1) and not layer.contains_schema(-1)
    layer.declare("free", [T.INT32])
    layer.declare("other", [T.INT64])
    assert (layer.schema_of("schema/1"), layer.schema_of("free"), layer.schema_of("other"), layer.schema_of("none")) == (1, 0, None, None)
    with pytest.raises(IndexError):
        root.schema_types(1)


def test_threads_insert_side_by_side(spark):
    from concurrent.futures import ThreadPoolExecutor

    layer = Layer(spark)
    layer.declare("p", [T.INT64])
    with ThreadPoolExecutor(6) as pool:
        tasks = [pool.submit(lambda n=n: layer.insert("e", frame(spark, list(range(n % 3, n % 3 + 5)), "v int"), ["v"], "o").collect()) for n in range(6)]
        more = [pool.submit(lambda: layer.insert_rows("p", frame(spark, [1, 2, 3], "a long"), ["a"], "o").collect()) for _ in range(3)]
        wrong = pool.submit(lambda: layer.insert_rows("p", frame(spark, [(1, 2)], "a long, b long"), ["a", "b"], "o"))
        results, rows = [t.result() for t in tasks], [t.result() for t in more]
        assert isinstance(wrong.exception(), ValueError)
    ids = {}
    for r in (r for out in results for r in out):
        assert ids.setdefault(r["v"], r["id"]) == r["id"]
    assert sorted(ids) == list(range(7)) and sorted(ids.values()) == list(range(7)) and layer.size("e") == 7
    assert sum(r["created"] for out in results for r in out) == 7 and got(layer.records("e"), "v", "id") == sorted(ids.items())
    assert layer.pool_size("p") == 3 and sum(r["created"] for out in rows for r in out) == 3


def test_relations_in_bulk(spark):
    root = Layer(spark)
    root.declare("p", [T.INT64])
    root.insert_rows("p", frame(spark, [10, 20, 30], "a long"), ["a"], "o")
    rows = spark.createDataFrame([("k1", 2), ("k1", 0), ("k2", 1), ("k3", 0), ("k3", 2), ("k3", 2), ("k0", None)], "k string, id long")
    made = lambda layer: got(layer.insert_relations("p", [("x", T.INT64)], rows, "k"), "k", "relation", "created")
    assert made(root) == [("k0", 0, True), ("k1", 1, True), ("k2", 2, True), ("k3", 1, False)]
    child = Layer(spark, root)
    assert made(child) == [("k0", 0, False), ("k1", 1, False), ("k2", 2, False), ("k3", 1, False)] and len(child) == 3
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert child.insert_relation("p", [("x", T.INT64)], ids(1, 2)) == (3, True) and child.insert_relation("p", [("x", T.INT64)], ids()) == (0, False)
    assert (len(root), len(child)) == (3, 4) and child.relation(1) == root.relation(1) and child.relation(0).size() == 0
    other = Layer(spark)
    other.declare("q", [T.INT64])
    other.insert_rows("q", frame(spark, [99, 30], "a long"), ["a"], "o")
    assert got(child.relation(3).contains_rows(other, "q", spark.createDataFrame([(0, 0), (1, 1)], "pos long, id long")), "c0", "held") == [(30, True), (99, False)]
    with pytest.raises(IndexError):
        child.insert_relations("p", [("x", T.INT64)], spark.createDataFrame([("k", 3)], "k string, id long"), "k")


def test_equal_digests_are_compared_id_by_id(spark, monkeypatch):
    layer = Layer(spark)
    layer.declare("p", [T.INT64])
    layer.insert_rows("p", frame(spark, list(range(6)), "a long"), ["a"], "o")
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    rows = spark.createDataFrame([(1, 0), (1, 3), (2, 1), (2, 2), (3, 0), (3, 3), (4, 1), (4, 2)], "k long, id long")  # sums and numbers are equal
    for created in (True, False):
        assert got(layer.insert_relations("p", [("x", T.INT64)], rows, "k"), "k", "relation", "created") == [(1, 0, created), (2, 1, created), (3, 0, False), (4, 1, False)]


def test_outside_views_and_row_keys(spark):
    layer = Layer(spark)
    layer.declare("p", [T.INT64])
    layer.insert_rows("p", frame(spark, [10, 20], "a long"), ["a"], "o")
    layer.insert("e", frame(spark, [7], "v int"), ["v"], "o")
    assert got(layer.view(spark.createDataFrame([(7,), (8,)], "v int")).find("e"), "v", "id") == [(7, 0), (8, None)] and layer.size("e") == 1
    b = layer.builder([("x", T.INT64)])
    b.insert(frame(spark, [20, 5], "x long"), "o")
    assert got(layer.view(b).find_rows("p"), "x", "id") == [(5, None), (20, 1)] and b.widths() == [64] and b.memory_usage() > 0
    held = spark.createDataFrame([("a", 1), ("b", None)], "k string, row long")
    assert sorted((r["k"], r["row_row"] and r["row_row"]["c0"]) for r in layer.resolve_rows(held, "p", "row").collect()) == [("a", 20), ("b", None)]
    with pytest.raises(Exception, match="no row with the id 5"):
        layer.resolve_rows(spark.createDataFrame([("a", 5)], "k string, row long"), "p", "row").collect()


def test_streams_are_interned(spark, tmp_path):
    from millrace.streaming.inserts import insert_row_stream, insert_stream

    path, layer, seen = str(tmp_path / "in"), Layer(spark), []
    layer.declare("p", [T.INT32])
    frame(spark, [3, 1], "v int").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("v int, o long").parquet(path)
    run = lambda: insert_stream(stream(), layer, "e", ["v"], "o", str(tmp_path / "c"), lambda df, n: seen.append((n, df.where("created").count()))).awaitTermination(60)
    assert run()
    frame(spark, [1, 9], "v int").coalesce(1).write.mode("append").parquet(path)
    assert run() and seen == [(0, 2), (1, 1)] and got(layer.records("e"), "v", "id") == [(1, 1), (3, 0), (9, 2)]
    insert_row_stream(stream(), layer, "p", ["v"], "o", str(tmp_path / "d")).awaitTermination(60)
    assert layer.pool_size("p") == 3
