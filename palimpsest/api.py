"""The search service: queries with pages and a cache, answers as JSON, an HTTP server and a command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections import OrderedDict
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import search
from palimpsest.plans.regex import PatternError
from palimpsest.sources.shared import written
from palimpsest.sources.store import Store
from palimpsest.streaming.reindex import reindex_from, watch

CACHED_QUERIES, CLI_FILES = 1024, 100


class BadRequest(ValueError):
    """The query can't be answered as it is; status 400."""


@dataclass
class Config:
    """repo_path and saved_index_path are folders that all executors see; live is None, 'watch' or 'webhook'."""

    repo_path: str
    branch_name: str
    saved_index_path: str
    live: str | None = None
    debounce_milliseconds: int = 0

    @classmethod
    def read(cls, path: str) -> "Config":
        """From JSON, or YAML where a parser is installed."""
        raw = open(path, encoding="utf-8").read()
        try:
            got = json.loads(raw)
        except ValueError:
            import yaml

            got = yaml.safe_load(raw)
        live = got.get("live_index_config")
        if live is None:
            return cls(got["repo_path"], got["branch_name"], got["saved_index_path"])
        if live == "OnWebhookNotify" or "OnWebhookNotify" in live:
            return cls(got["repo_path"], got["branch_name"], got["saved_index_path"], "webhook")
        return cls(got["repo_path"], got["branch_name"], got["saved_index_path"], "watch", int(live["WatchLiveUpdate"]["debounce_milliseconds"]))


def query_for(mode: str, query: str) -> search.Query:
    query = query.strip()
    if not query:
        raise BadRequest("query must not be empty")
    if mode == "plain":
        return search.plain(query)
    if mode != "regex":
        raise BadRequest(f"unknown mode {mode}")
    try:
        return search.pattern(query)
    except PatternError as wrong:
        raise BadRequest(str(wrong)) from wrong


class _Answer:
    """The hits of one query, as a written table, and the pages read from it so far; its lock is held while they are made."""

    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.found: DataFrame | None = None
        self.pages: dict[tuple[int, int], list] = {}


class Engine:
    """Answers queries from a stored index. A query's hits are found once, written to the shared folder, and read page by page.

    The lock of the cache is held for its own upkeep only, so different queries run side by side; equal ones wait for the first.
    """

    def __init__(self, store: Store, cached: int = CACHED_QUERIES):
        self.store, self.most = store, cached
        self.cache: OrderedDict[tuple[str, str], _Answer] = OrderedDict()
        self.lock = threading.Lock()

    def clear(self, *_) -> None:
        """Forgets all answers, as after an append."""
        with self.lock:
            self.cache.clear()

    def hits(self, mode: str, query: str) -> DataFrame:
        """(path, first_match, last_match) as search.hits() gives them, found through the postings."""
        q = query_for(mode, query)
        changes = self.store.changes()
        pruned = self.store.candidates(q.alternatives)
        candidates = changes if pruned is None else changes.join(pruned, "path", "left_semi")
        return search.hits(search.matching(candidates, q), q, changes, self.store.head_row())

    def detailed(self, found: DataFrame) -> DataFrame:
        """Hits with the id, date and summary of their commits, and file_path for path."""
        meta = self.store.table("commits").select("commit_index", F.struct(F.col("commit_id").alias("commit_sha"), F.date_format("commit_time", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("commit_date"), F.col("summary").alias("commit_summary")).alias("m"))
        out = found
        for side in ("first_match", "last_match"):
            c = meta.select(F.col("commit_index").alias(f"{side}_c"), F.col("m").alias(f"{side}_m"))
            out = out.join(c, out[side]["commit_index"] == c[f"{side}_c"], "left")
        detail = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}_m.commit_sha"), F.col(f"{s}_m.commit_date"), F.col(f"{s}_m.commit_summary"), F.col(f"{s}.is_head"), F.col(f"{s}.lines")))
        return out.select(F.col("path").alias("file_path"), detail("first_match").alias("first_match"), detail("last_match").alias("last_match"))

    def search(self, query: str, mode: str = "plain", page: int = 0, page_size: int = 0) -> dict:
        """{'results': [...]} of one page in the order of paths; a page size of 0 gives none."""
        key = (mode, query.strip())
        with self.lock:
            mine = self.cache.setdefault(key, _Answer())
            self.cache.move_to_end(key)
            while len(self.cache) > self.most:
                self.cache.popitem(last=False)
        with mine.lock:
            if mine.found is None:
                try:
                    mine.found = written(self.hits(*key), "hits")
                except Exception:
                    with self.lock:
                        if self.cache.get(key) is mine:
                            del self.cache[key]
                    raise
            if (page, page_size) not in mine.pages:
                rows = self.detailed(search.page(mine.found, page, page_size)).orderBy("file_path")
                mine.pages[page, page_size] = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
            return {"results": mine.pages[page, page_size]}

    def index(self, repo: str, branch: str = "HEAD") -> int | None:
        """Appends the new commits of a repository; answers are forgotten if there are any."""
        batch = reindex_from(self.store.spark, repo, self.store.folder, branch)
        if batch is not None:
            self.clear()
        return batch


def openapi(webhook: bool = False) -> dict:
    """The description of the routes."""
    line = {"type": "object", "properties": {"line_number": {"type": "integer"}, "content": {"type": "string"}, "highlights": {"type": "array", "items": {"type": "object", "properties": {"term": {"type": "string"}, "column": {"type": "integer"}}}}}}
    match = {"type": "object", "properties": {"commit_sha": {"type": "string"}, "commit_date": {"type": "string"}, "commit_summary": {"type": "string"}, "is_head": {"type": "boolean"}, "lines": {"type": "array", "items": line}}}
    hit = {"type": "object", "properties": {"file_path": {"type": "string"}, "first_match": match, "last_match": {**match, "nullable": True}}}
    ask = {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "mode": {"type": "string", "enum": ["plain", "regex"], "default": "plain"}, "page": {"type": "integer", "default": 0}, "page_size": {"type": "integer", "default": 0}}}
    body = lambda schema: {"content": {"application/json": {"schema": schema}}}
    wrong = {"description": "error", **body({"type": "object", "properties": {"message": {"type": "string"}}})}
    paths = {
        "/api/health": {"get": {"responses": {"200": {"description": "ok", **body({"type": "object", "properties": {"status": {"type": "string"}}})}}}},
        "/api/search": {"post": {"requestBody": body(ask), "responses": {"200": {"description": "a page of files", **body({"type": "object", "properties": {"results": {"type": "array", "items": hit}}})}, "400": wrong, "500": wrong}}},
        "/docs.json": {"get": {"responses": {"200": {"description": "this description"}}}},
    }
    if webhook:
        paths["/webhook/reindex"] = {"post": {"requestBody": body({"type": "object", "properties": {"commit_id": {"type": "string"}}}), "responses": {"200": {"description": "noted"}}}}
    return {"openapi": "3.1.0", "info": {"title": "history search", "version": "1"}, "paths": paths}


def answer(engine: Engine, method: str, path: str, body: bytes, on_reindex=None) -> tuple[int, dict]:
    """(status, JSON) of a request; on_reindex, if there is one, opens the webhook route."""
    try:
        if (method, path) == ("GET", "/api/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/docs.json"):
            return 200, openapi(on_reindex is not None)
        if (method, path) == ("POST", "/api/search"):
            ask = json.loads(body or b"{}")
            if not isinstance(ask.get("query"), str):
                raise BadRequest("query is missing")
            return 200, engine.search(ask["query"], ask.get("mode", "plain"), int(ask.get("page", 0)), int(ask.get("page_size", 0)))
        if (method, path) == ("POST", "/webhook/reindex") and on_reindex is not None:
            on_reindex(json.loads(body or b"{}").get("commit_id"))
            return 200, {}
        return 404, {"message": "not found"}
    except (BadRequest, json.JSONDecodeError) as wrong:
        return 400, {"message": str(wrong)}
    except Exception as broken:  # an answer in place of a dropped connection
        return 500, {"message": f"search failed: {broken}"}


def serve(engine: Engine, config: Config, bind: str | None = None) -> ThreadingHTTPServer:
    """A server bound to BIND_ADDR, not yet started."""
    host, _, port = (bind or os.environ.get("BIND_ADDR", "127.0.0.1:8080")).rpartition(":")
    hook = (lambda commit: engine.index(config.repo_path, config.branch_name)) if config.live == "webhook" else None

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            status, said = answer(engine, method, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)), hook)
            raw = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._reply("GET")

        def do_POST(self):
            self._reply("POST")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, int(port)), Handler)


def label(match: dict) -> str:
    """'HEAD (at …)' or the commit's first eight digits and date."""
    return f"{'HEAD' if match['is_head'] else match['commit_sha'][:8]} (at {match['commit_date'][:16].replace('T', ' ')})"


def rendered(hit: dict) -> str:
    """A hit as text: where it was seen, and its lines with numbers from 1, marks, and a line of dots between parts."""
    last = hit.get("last_match")
    seen = f"First seen at {label(hit['first_match'])}, " + (f"last seen at {label(last)}" if last else "never seen afterwards")
    out, before = [f"{hit['file_path']}: {seen}"], None
    for line in (last or hit["first_match"])["lines"]:
        if before is not None and line["line_number"] != before + 1:
            out.append(text.GAP)
        before = line["line_number"]
        out.append(f"{before + 1:>6}| " + text.marked(line["content"], [(h["term"], h["column"]) for h in line["highlights"]], shorten=True))
    return "\n".join(out)


def main(args: list[str] | None = None) -> int:
    """Indexes a repository, and answers the queries of the standard input line by line ('q:' plain, 'r:' regex)."""
    p = argparse.ArgumentParser(prog="palimpsest", description=main.__doc__)
    p.add_argument("--path", help="repository to index")
    p.add_argument("--main-branch", default="HEAD")
    p.add_argument("--index", help="folder of the stored index")
    p.add_argument("--load", action="store_true", help="use the stored index as it is")
    p.add_argument("-c", "--continue", dest="more", action="store_true", help="add new commits to the stored index")
    p.add_argument("--save-only", action="store_true", help="index and end")
    p.add_argument("--config", help="configuration of the server; starts it")
    p.add_argument("--openapi", action="store_true", help="print the description of the routes and end")
    p.add_argument("--debug-level", default="ERROR")
    a = p.parse_args(args)
    if a.openapi:
        print(json.dumps(openapi(True), indent=2))
        return 0
    config = Config.read(a.config) if a.config else None
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    spark.sparkContext.setLogLevel(a.debug_level)
    engine = Engine(Store(spark, config.saved_index_path if config else a.index))
    if config:
        if not engine.store.batches():
            engine.index(config.repo_path, config.branch_name)
        if config.live == "watch":
            watch(spark, config.repo_path, config.saved_index_path, config.branch_name, config.debounce_milliseconds, engine.clear)
        serve(engine, config).serve_forever()
        return 0
    if not a.load or a.more:
        engine.index(a.path, a.main_branch)
    if a.save_only:
        return 0
    for line in sys.stdin:
        mode, query = text.query_of(line.rstrip("\n"))
        if not query:
            continue
        try:
            for hit in engine.search(query, mode, 0, CLI_FILES)["results"]:
                print(rendered(hit))
        except BadRequest as wrong:
            print(wrong, file=sys.stderr)
    return 0
