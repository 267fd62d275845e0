"""Live re-indexing: a stream of file changes is appended to a stored index, each commit once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import encoding
from palimpsest.sources import gitlog
from palimpsest.sources.store import Store


def reindex(changes: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, after=None) -> StreamingQuery:
    """Starts a query that appends a stream of rows (the columns of the Git source; binary contents that are no texts are left out) to the index in ``folder``.

    Each micro-batch is one append; commits that the index knows are skipped, so a batch that is
    replayed after a failure changes nothing. ``after`` is called with the store after an append,
    to clear caches.
    """

    def take(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        store = Store(batch.sparkSession, folder)
        kept, ignored = encoding.split_texts(batch) if dict(batch.dtypes)["content"] == "binary" else (batch, None)
        if store.append(batch.select("commit_index", "commit_id", "commit_time", "summary"), kept, ignored) is not None and after:
            after(store)
        batch.unpersist()

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: What a new commit touches in a repository's own folder, by the beginning of its path there.
WATCHED = ("/HEAD", "/refs/heads", "/packed-refs", "/logs/HEAD", "/logs/refs/heads")
KINDS = ("create", "remove", "modify_data", "modify_name")


def changed_paths(events: DataFrame) -> DataFrame:
    """Of file events (kind, path in the repository's own folder) those that may tell of a new commit."""
    told = F.lit(False)
    for p in WATCHED:
        told = told | F.startswith("path", F.lit(p))
    return events.where(F.col("kind").isin(*KINDS) & told)


def reindex_from(spark: SparkSession, repo: str, folder: str, branch: str = "HEAD") -> int | None:
    """One incremental step in batch: the commits of a repository after the head of the index; the batch, or None."""
    gitlog.register(spark)
    store = Store(spark, folder)
    head = store.head()
    rows = spark.read.format("git_history").options(path=repo, branch=branch, since=-1 if head is None else head).load()
    kept, ignored = encoding.split_texts(rows)
    return store.append(rows, kept, ignored)


def watch(spark: SparkSession, repo: str, folder: str, branch: str, every_ms: int, after=None) -> StreamingQuery:
    """Follows a branch: at most every ``every_ms`` milliseconds its new commits are appended, so a burst of commits is one step."""
    gitlog.register(spark)
    rows = spark.readStream.format("git_history").options(path=repo, branch=branch).load()
    return reindex(rows, folder, f"{folder.rstrip('/')}/live", {"processingTime": f"{every_ms} milliseconds"}, after)
