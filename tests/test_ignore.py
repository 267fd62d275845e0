import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ignore


def test_parents():
    order, up = ignore.parents(["/b/a", "/a/c", "/", "/a/c/b", "/a", "/a/b", "/b"])
    assert order == ["/", "/a", "/a/b", "/a/c", "/a/c/b", "/b", "/b/a"] and up == [None, 0, 1, 1, 3, 0, 5]


@pytest.mark.parametrize(
    "path, want",
    [("a.log", True), ("x/y/a.log", True), ("keep.log", False), ("build/x/y.txt", True), ("x/build/y", True), ("build", False), ("top.txt", True), ("x/top.txt", False), ("docs/a/b/c.md", True), ("docs/c.md", True),
     ("sub/a.tmp", True), ("a.tmp", False), ("sub/keep.log", False), ("sub/b.log", False), ("sub/deep/x1.bin", True), ("sub/deep/xa.bin", False), ("other/file", False)],
)
def test_rules(path, want):
    files = {"": "# all\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/**/c.md\n", "sub": "*.tmp\n!b.log\n/deep/x[0-9].*\n"}
    assert ignore.Ignored(files)(path) is want


def test_column(spark):
    rows = spark.createDataFrame([("a.log",), ("b",), (None,)], "p string")
    assert [r[0] for r in rows.select(ignore.is_ignored(F.col("p"), {"": "*.log"})).collect()] == [True, False, False]
    assert ignore.Ignored({})("a") is False
