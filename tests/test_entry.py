import __spark_entry__ as entry


def test_registry(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    df = entry.entry(spark)
    assert df.columns == ["lang", "n_docs", "avg_lz76", "avg_density"] and df.count() > 0


def test_small_queries_run(spark):
    for name, query in entry.queries().items():
        if name.endswith(("parts", "customers", "urls", "nations", "benchmark", "l10", "overflow", "report", "pairs", "ensemble")):
            assert query(spark, "/root/testdata/sf0.001").count() > 0, name
