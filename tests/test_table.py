from palimpsest.functions import table


def test_trigrams_and_search_in_sql(spark):
    table.register(spark)
    spark.createDataFrame([(1, "häuser"), (2, "ab"), (3, ""), (4, None)], "id long, line string").createOrReplaceTempView("some_lines")
    rows = spark.sql("select id, position, token from some_lines, lateral trigrams(line) order by id, position").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "häu"), (1, 1, "äus"), (1, 2, "use"), (1, 3, "ser"), (2, 0, "ab")]
    find = lambda q, mode: [tuple(r) for r in spark.sql("select line_no, term, char_column from search_text(:t, :q, :m)", {"t": "one\ntwo ones\nthree\n", "q": q, "m": mode}).collect()]
    assert find("two one", "plain") == [(0, "one", 0), (1, "two", 0)]
    assert find("two four", "plain") == [] and find("", "regex") == []
    assert find("o?ne", "regex") == [(0, "one", 0), (1, "one", 4)]
