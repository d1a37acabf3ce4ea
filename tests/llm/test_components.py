from gleanspark.llm.components import components


def test_components(spark):
    rows = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(rows, "a bigint, b bigint")).collect())
    assert set(got[k] for k in range(61)) == {0} and set(got[k] for k in range(100, 140)) == {100} and got[201] == 200 and len(got) == 103
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
