from gleanspark.operators.store import latest, put, remove


def test_store(spark):
    kind = "name string, version int, health string"
    store = spark.createDataFrame([("a", 1, "ok"), ("b", 1, None), (None, 1, "x")], kind)
    new = spark.createDataFrame([("a", 2, "broken", 5), ("c", 1, "ok", 6), ("a", 0, "old", 7)], kind + ", extra int")
    got = put(store, new, "name", "version")
    assert {tuple(r) for r in got.collect()} == {("a", 2, "broken", 5), ("b", 1, None, None), (None, 1, "x", None), ("c", 1, "ok", 6)}
    left = remove(store, spark.createDataFrame([("a",), (None,)], "name string"))
    assert [r.name for r in left.collect()] == ["b"]
    assert latest(store.limit(0), ["name"], "version").count() == 0 and latest(store.union(store), "name", "version").count() == 3
