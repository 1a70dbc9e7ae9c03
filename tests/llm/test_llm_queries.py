import pytest

from tests.test_structure import compare_with_sql


@pytest.mark.parametrize("name", ["p2_found", "p2_split", "p2_balance", "p5_found", "p7_found", "p7_codes", "p7_sequences", "p8_found", "p9_kept"])
def test_query_equals_sql(spark, data, name):
    compare_with_sql(spark, data, name)


def test_split_keeps_patients_whole(spark, data):
    import __spark_entry__ as e

    out = e.queries()["p2_split"](spark, data)
    assert out.groupBy("grupo").agg({"conjunto": "min"}).count() == out.select("grupo", "conjunto").distinct().count()
    assert out.where("conjunto IS NULL").count() == 0
