import __spark_entry__
from graphlens.llm import queries


def test_oracles_are_sql_of_queries():
    sql = __spark_entry__.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values()) and set(sql) <= set(__spark_entry__.queries())


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
