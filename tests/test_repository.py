import math

import pytest

from millrace.functions.values import ColumnType as T
from millrace.operators.repository import ColumnsData, ColumnsIndex, RelationData, RelationIndex, RelationRepository, RowData, RowIndex, SchemaData, SchemaIndex


def test_one_at_a_time(spark):
    r = RelationRepository(spark, num_objects=8)
    schema, new = r.schema([T.OBJECT, T.FLOAT64])
    assert new and schema.arity == 2 and r.insert(SchemaData((T.OBJECT, T.FLOAT64))) == (schema, False) and r.schema([("a", T.BOOL)])[0].index == 1
    columns, new = r.insert(ColumnsData([("who", T.OBJECT), ("how", T.FLOAT64)]))
    assert new and columns.index == 0 and r.insert(ColumnsData(columns.columns)) == (columns, False)
    first, new = r.insert(RowData(0, (3, -0.0)))
    assert new and first.index == RowIndex(0, 0) and first.get_values() == [3, 0] and first.get(1, T.FLOAT64) == 0 and math.copysign(1, first.get(1)) == 1
    again, new = r.insert(RowData(0, (3, 0)))
    assert not new and again == first and r.insert(RowData(0, (7, math.inf)))[0].index == (0, 1)
    assert first.type(0) == T.OBJECT and r.view(RowData(0, (5, 2.5))).get_values()[0] == 5 and r.view(RowData(0, (5, 2.5))).index is None
    with pytest.raises(ValueError):
        first.get(0, T.INT32)
    for bad, error in ((RowData(0, (8, 1.0)), IndexError), (RowData(0, (1,)), ValueError), (RowData(5, (1, 1.0)), IndexError), (RowData(1, (1,)), TypeError)):
        with pytest.raises(error):
            r.insert(bad)
    with pytest.raises(IndexError):
        first.value(2)
    relation, new = r.insert(RelationData(0, 0, (1, 0, 1)))
    assert new and relation.size() == 2 and relation.arity == 2 and r.insert(RelationData(0, 0, (0, 1)))[1] is False and len(r) == 1
    assert r.view(RelationIndex(0)) == relation
    there = [SchemaIndex(1), ColumnsIndex(0), RowIndex(0, 1), RelationIndex(0)]
    assert all(map(r.contains, there)) and not any(map(r.contains, [SchemaIndex(2), ColumnsIndex(1), RowIndex(0, 2), RowIndex(9, 0), RelationIndex(1)]))
    r.clear()
    assert len(r) == 0 and r.contains(SchemaIndex(1)) and not r.contains(RowIndex(0, 0))


def test_builders_become_relations(spark):
    r = RelationRepository(spark)
    b = r.get_relation_builder([("x", T.INT64)])
    b.insert(spark.createDataFrame([(5, 0), (9, 1), (5, 2)], "x long, o long"), "o")
    relation, new = r.insert_builder(b)
    assert new and sorted(row["x"] for row in relation.rows().collect()) == [5, 9] and r.insert_builder(b)[1] is False and len(r) == 1
    none = r.get_relation_builder([])
    assert r.insert_builder(none)[0].size() == 0
    none.insert(spark.range(1), "id")
    full, new = r.insert_builder(none)
    assert new and full.size() == 1 and len(r) == 3
