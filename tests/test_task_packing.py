"""A packet holds a file for each term that a candidate matches."""

from marlstone.operators import tasks


def test_uncovered_terms_come_before_the_rest(spark):
    rows = [("q", i, f"f{i}", [0], 10, 100) for i in range(1, 8)] + [("q", 8, "f8", [1], 10, 100)]
    df = spark.createDataFrame(rows, "key string, rank int, path string, covers array<int>, tokens long, budget long")
    got = tasks.pack(df.select("key", "rank", "path", "covers"), df.select("path", "tokens"), df.select("key", "budget").distinct())
    assert [(r.path, r.used) for r in got.orderBy("used").collect()] == [("f1", 10), ("f8", 20), ("f2", 30), ("f3", 40), ("f4", 50), ("f5", 60)]
