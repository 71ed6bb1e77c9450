import __spark_entry__ as entry


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(entry.queries())
