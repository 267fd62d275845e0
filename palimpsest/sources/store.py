"""The stored index: versions, postings and commits as Parquet, in batches that become visible one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import index

#: Directories by hash of the token; a query reads only those of its tokens.
BUCKETS = 64
#: Numbers of commits go to all executors as bits, if that takes at most so many rows of 64.
MOST_WORDS = 1 << 20
TABLES = {
    "commits": "commit_index long, commit_id string, commit_time timestamp, summary string",
    "versions": "path string, commit_index long, content string",
    "postings": "token string, path string, bucket int",
    "ignored": "path string",
}


def bucket(token) -> F.Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def of_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """The changes whose commit_index is among those of commits.

    Commits are numbered one after another, so 64 of them are the bits of one row, and these rows are few
    enough to be sent to the texts; texts are shuffled only if there are more than MOST_WORDS such rows.
    """
    number = F.col("commit_index").cast("long")
    word = F.shiftright(number, 6)
    words = commits.groupBy(word.alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(commit_index & 63 as int)))").alias("__bits"))
    few = words.count() <= MOST_WORDS
    both = changes.withColumn("__word", word).join(F.broadcast(words) if few else words, "__word")
    return both.where(F.expr("shiftright(__bits, cast(cast(commit_index as bigint) & 63 as int)) & 1 = 1")).select(*changes.columns)


class Store:
    """An index in a folder that all executors share.

    Each append is one directory ``batch=n`` of every table; the row in ``done`` that names it is
    written last, and readers take only the batches named there. So a job that dies half-way leaves
    the index as it was, and its batch is written anew. Appends come from one writer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def batches(self) -> list[int]:
        """The numbers of the visible batches: those from the last compacted one on."""
        if not self._exists("done"):
            return []
        rows = self.spark.read.schema("batch long, whole boolean").parquet(f"{self.folder}/done").collect()
        first = max((r["batch"] for r in rows if r["whole"]), default=0)
        return sorted({r["batch"] for r in rows if r["batch"] >= first})

    def _next(self) -> int:
        return (self.batches() or [-1])[-1] + 1

    def _seal(self, n: int, whole: bool = False) -> None:
        self.spark.createDataFrame([(n, whole)], "batch long, whole boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/done")

    def _write_postings(self, pairs: DataFrame, at: str) -> None:
        """Distinct (token, path) pairs in ranges of one size, so that a token in most files is many tasks' work, and sorted, so that a reader skips what is not its token."""
        pairs.withColumn("bucket", bucket(F.col("token"))).repartitionByRange("bucket", "token", "path").sortWithinPartitions("bucket", "token", "path").write.mode("overwrite").partitionBy("bucket").parquet(at)

    def compact(self) -> int | None:
        """Writes all visible batches as one, which replaces them; the batch, or None if there is at most one.

        Many small appends leave many small files; readers see either the old batches or the new one.
        """
        if len(self.batches()) < 2:
            return None
        n = self._next()
        for name in ("commits", "versions", "ignored"):
            self.table(name).select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={n}")
        self._write_postings(self.table("postings").select("token", "path").distinct(), f"{self.folder}/postings/batch={n}")
        self._seal(n, True)
        return n

    def table(self, name: str) -> DataFrame:
        """All visible rows of a table; without any batch an empty one."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [f"{self.folder}/{name}/batch={n}" for n in done]
        return self.spark.read.schema(TABLES[name]).option("basePath", f"{self.folder}/{name}").parquet(*paths).drop("batch")

    def head(self) -> int | None:
        return self.table("commits").agg(F.max("commit_index")).first()[0]

    def append(self, commits: DataFrame, changes: DataFrame, ignored: DataFrame | None = None) -> int | None:
        """Add the commits that aren't known yet and their changes (path, commit_index, content; a null content deletes); the batch, or None if all are known.

        Paths in ``ignored`` are ignored for good: neither this append nor any later one takes a change of theirs.

        Only the texts of new versions are tokenised; postings hold pairs that are new to the batch
        and may repeat in others, as readers take distinct paths anyway.
        """
        known = self.table("commits").select("commit_id")
        new = commits.select(*[F.col(c) for c in ("commit_index", "commit_id", "commit_time", "summary")]).dropDuplicates(["commit_id"]).join(known, "commit_id", "left_anti").select("commit_index", "commit_id", "commit_time", "summary")
        n = self._next()
        at = lambda name: f"{self.folder}/{name}/batch={n}"
        new.write.mode("overwrite").parquet(at("commits"))
        wanted = self.spark.read.schema(TABLES["commits"]).parquet(at("commits")).select("commit_index")
        if not wanted.take(1):
            return None  # the batch stays unnamed, and the next append writes it anew
        past = self.table("ignored")
        (past if ignored is None else past.unionByName(ignored.select("path").distinct())).distinct().write.mode("overwrite").parquet(at("ignored"))
        out = self.spark.read.schema(TABLES["ignored"]).parquet(at("ignored"))
        of_commits(changes.where("path is not null").select("path", "commit_index", "content"), wanted).join(out, "path", "left_anti").select("path", "commit_index", "content").write.mode("overwrite").parquet(at("versions"))
        rows = self.spark.read.schema(TABLES["versions"]).parquet(at("versions"))
        self._write_postings(index.postings(rows), at("postings"))
        self._seal(n)
        return n

    def changes(self) -> DataFrame:
        """(path, commit_index, content) of all commits."""
        return self.table("versions")

    def head_row(self) -> DataFrame:
        """One row (head), which may be a commit that changed no file."""
        return self.table("commits").agg(F.max("commit_index").alias("head"))

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, path); with tokens only those, read from the directories of their buckets."""
        rows = self.table("postings")
        if tokens is not None:
            numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket(F.col("t"))).distinct().collect()] if tokens else []
            rows = rows.where(F.col("bucket").isin(numbers) & F.col("token").isin(tokens))
        return rows.select("token", "path")

    def candidates(self, alternatives) -> DataFrame | None:
        """index.candidate_files() over the stored postings; if all needs are exact tokens, only their directories are read."""
        needs = [n for a in alternatives for n in a]
        exact = all(n.kind == "is" for n in needs) and needs
        rows = self.postings(sorted({n.text for n in needs}) if exact else None)
        return index.candidate_files(rows, [list(a) for a in alternatives])
