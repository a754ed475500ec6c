from gridlens.llm import queries


def test_every_query_has_its_kind():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert all(callable(f) for f in queries.QUERIES.values())
    assert all(isinstance(s, str) for s in queries.ORACLE_SQL.values())
    assert set(queries.ORACLE_SQL) < set(queries.QUERIES)
