import pytest

from lumenmatch.llm.common import join_skewed


@pytest.mark.parametrize("share", [0.001, 0.2, 1.0])
def test_join_skewed_is_a_left_join(spark, share):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(60)] + [(100, None), (101, "alone")], "id int, key string").repartition(4)
    names = spark.createDataFrame([("hot", 1), *[(f"k{k}", k) for k in range(0, 60, 3)], ("other", 9)], "key string, n int")
    got = join_skewed(rows, names, "key", share)
    assert set(got.columns) == {"id", "key", "n"}
    want = rows.join(names, "key", "left")
    assert sorted(map(tuple, got.select("id", "key", "n").collect()), key=repr) == sorted(map(tuple, want.select("id", "key", "n").collect()), key=repr)
    assert join_skewed(rows.limit(0), names, "key", share).count() == 0
