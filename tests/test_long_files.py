"""Lines beyond 20,000 are scanned."""

from pyspark.sql import functions as F

from marlstone.operators import declarations
from marlstone.sources import adapters


def test_declarations_and_uses_behind_line_20000(spark):
    body = "\n" * 20_000 + "func late() {\n}\n"
    files = spark.createDataFrame([("a.go", "r", "go", "source", body)], "path string, repo string, language string, class string, content string")
    lines = adapters.source_lines(files)
    assert lines.agg(F.max("number")).first()[0] == 20_003
    assert [(r.name, r.line) for r in declarations.symbols(lines).collect()] == [("late", 20_001)]
    assert adapters.source_lines(files, 10).count() == 10
