"""The registered queries of the history search engine over the test tables, and SQL that gives the same rows.

``documents`` is a history: a file is lang/source, a commit is doc_id, and each commit replaces one
file. ``conversations`` is a second one: a file is a conversation, a commit a turn. ``labels`` says
which versions are deletions (toxic) in the history with deletions. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import encoding, text
from palimpsest.operators import index, lineage, search
from palimpsest.plans.regex import Need
from palimpsest.sources import history
from palimpsest.sources.shared import new_folder
from palimpsest.sources.store import Store
from palimpsest.streaming.debounce import debounced

WORDS, PATTERN, CLASS = ["und", "der"], "(?:re|un)d+|ü[a-m]s", "[a-c]nd"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes(read(spark, sf_dir, "documents"), F.concat_ws("/", "lang", "source"), "doc_id", "text")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.changes(read(spark, sf_dir, "conversations"), F.col("conv_id").cast("string"), "turn", "text")


def with_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = read(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") > 0).alias("gone"))
    docs = read(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    return history.changes(docs, F.concat_ws("/", "lang", "source"), "doc_id", "text", F.col("gone"))




QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The SQL of a history: versions with until and head, lines without line ends, tokens of a line.
_V = """
src as (select concat_ws('/', lang, source) as path, doc_id as commit_index, text as content from documents),
v as (select path, commit_index, content, coalesce(lead(commit_index) over (partition by path order by commit_index), (select max(commit_index) from src) + 1) as until, (select max(commit_index) from src) as head from src)
"""
_C = _V.replace("concat_ws('/', lang, source) as path, doc_id as commit_index, text as content from documents", "cast(conv_id as varchar) as path, turn as commit_index, text as content from conversations")
_D = _V.replace("text as content from documents", "case when exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic > 0) then null else text end as content from documents d").replace("doc_id as commit_index", "d.doc_id as commit_index")


def _lines(v: str = "v", n: str = "ls") -> str:
    bare = "case when right(content, 1) = chr(10) then left(content, length(content) - 1) else content end"
    return f"{n} as (select path, commit_index, until, head, string_split({bare}, chr(10)) as ll from (select path, commit_index, until, head, replace(content, chr(13) || chr(10), chr(10)) as content from {v} where content is not null and content <> ''))"


_EACH = "each_line as (select path, commit_index, until, head, unnest(ll) as line, unnest(range(0, len(ll))) as line_no from ls)"
_TOK = "tok as (select path, commit_index, until, head, line_no, unnest(case when length(line) = 0 then [] when length(line) < 3 then [line] else list_transform(range(1, length(line) - 1), lambda i: substring(line, i, 3)) end) as token from each_line)"


_stores: dict[tuple[str, str, str], Store] = {}


def stored(spark: SparkSession, sf_dir: str, base=documents) -> Store:
    """The stored index of a history, built once in a session and read by all queries that go through an index."""
    key = (spark.sparkContext.applicationId, sf_dir, base.__name__)
    if key not in _stores:
        h = base(spark, sf_dir)
        number = F.col("commit_index")
        commits = h.select("commit_index").distinct().select("commit_index", number.cast("string").alias("commit_id"), F.timestamp_seconds(number).alias("commit_time"), number.cast("string").alias("summary"))
        store = Store(spark, new_folder(spark, "index"))
        store.append(commits, h)
        _stores[key] = store
    return _stores[key]


def by_index(spark: SparkSession, sf_dir: str, base, q: search.Query) -> DataFrame:
    """First and last commits of the files that match, found through the stored postings."""
    store = stored(spark, sf_dir, base)
    found, pruned = store.changes(), store.candidates(q.alternatives)
    return search.first_last(search.matching(found if pruned is None else found.join(pruned, "path", "left_semi"), q), store.changes(), store.head_row())


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


_TOKENS = (_V, _lines(), _EACH, _TOK)


# ---- tokens and dictionary -------------------------------------------------------------------


@query("token_counts", _with(*_TOKENS) + "select token, count(*) as n_lines, count(distinct path) as n_files from (select distinct path, commit_index, line_no, token from tok) group by token")
def token_counts(spark, sf_dir):
    return index.token_stats(documents(spark, sf_dir))


@query("token_dictionary", _with(*_TOKENS) + "select distinct token from tok")
def token_dictionary(spark, sf_dir):
    return index.dictionary(index.postings(documents(spark, sf_dir)))


@query("postings", _with(*_TOKENS) + "select distinct token, path from tok")
def postings(spark, sf_dir):
    return index.postings(documents(spark, sf_dir))


@query("index_build", _with(*_TOKENS) + "select path, count(distinct token) as n_tokens from tok group by path")
def index_build(spark, sf_dir):
    """Builds the stored index anew and counts what it holds."""
    _stores.pop((spark.sparkContext.applicationId, sf_dir, documents.__name__), None)
    return stored(spark, sf_dir).postings().groupBy("path").agg(F.count_distinct("token").alias("n_tokens"))


@query("version_tokens", _with(*_TOKENS) + "select path, commit_index, count(distinct token) as n_tokens from tok group by path, commit_index")
def version_tokens(spark, sf_dir):
    return index.version_tokens(documents(spark, sf_dir)).groupBy("path", "commit_index").agg(F.count("*").alias("n_tokens"))


@query("token_line_numbers", _with(_C, _lines(), _EACH, _TOK) + "select path, commit_index, token, array_to_string(list_sort(list(distinct line_no)), ',') as line_numbers from tok group by path, commit_index, token")
def token_line_numbers(spark, sf_dir):
    return index.token_lines(conversations(spark, sf_dir)).withColumn("line_numbers", F.array_join(F.col("line_numbers").cast("array<string>"), ","))


@query("short_line_tokens", _with(_V, _lines(), _EACH) + "select distinct line as token, path from each_line where length(line) in (1, 2)")
def short_line_tokens(spark, sf_dir):
    return index.postings(documents(spark, sf_dir)).where("length(token) < 3")


@query("dictionary_substring", _with(*_TOKENS) + "select distinct token from tok where contains(token, 'en')")
def dictionary_substring(spark, sf_dir):
    words = index.dictionary(index.postings(documents(spark, sf_dir)))
    return index.with_needs(words, [Need("holds", "en")]).select("token")


@query("dictionary_class", _with(*_TOKENS) + "select distinct token from tok where regexp_matches(token, '^[a-c]n[d-t]$')")
def dictionary_class(spark, sf_dir):
    words = index.dictionary(index.postings(documents(spark, sf_dir)))
    return index.with_needs(words, [Need("matches", "^[a-c]n[d-t]$")]).select("token")


@query("files_all_tokens", _with(*_TOKENS) + "select path from (select distinct path, token from tok where token in ('und', 'der')) group by path having count(*) = 2")
def files_all_tokens(spark, sf_dir):
    return index.candidate_files(index.postings(documents(spark, sf_dir)), [[Need("is", w) for w in WORDS]])


@query("files_any_token", _with(*_TOKENS) + "select distinct path from tok where token in ('ßes', 'ños')")
def files_any_token(spark, sf_dir):
    return index.candidate_files(index.postings(documents(spark, sf_dir)), [[Need("is", "ßes")], [Need("is", "ños")]])


@query("presence_intervals", _with(_C, _lines(), _EACH, _TOK, """
nth as (select path, commit_index, until, row_number() over (partition by path order by commit_index) as n from v),
held as (select distinct t.path, t.token, n.n, n.commit_index, n.until from tok t join nth n on t.path = n.path and t.commit_index = n.commit_index),
runs as (select *, n - row_number() over (partition by path, token order by n) as run from held)
""") + "select path, token, min(commit_index) as from_commit, max(until) as to_commit from runs group by path, token, run")  # fmt: skip
def presence_intervals(spark, sf_dir):
    return index.presence(history.versions(conversations(spark, sf_dir)))


@query("modified_or_head_commits", _with(_D) + """
select path, commit_index, commit_index as since from v where content is not null
union all select path, head, commit_index from v where content is not null and until > head and commit_index < head""")  # fmt: skip
def modified_or_head_commits(spark, sf_dir):
    return index.modified_or_head(history.versions(with_deletions(spark, sf_dir)))


@query("changes", _with(_D) + "select path, commit_index, case when content is null then 'D' when lag(content) over (partition by path order by commit_index) is null then 'A' else 'M' end as change from v")
def changes(spark, sf_dir):
    v = with_deletions(spark, sf_dir)
    return v.withColumn("change", history.change(v)).select("path", "commit_index", "change")


@query("as_of_content", _with(_D, "w as (select distinct path, head - 100 as at from v)") + "select w.path, w.at as commit_index, v.content from w join v on v.path = w.path and v.commit_index <= w.at and w.at < v.until where v.content is not null")
def as_of_content(spark, sf_dir):
    v = history.versions(with_deletions(spark, sf_dir))
    return history.at_commit(v, v.select("path", (F.col("head") - 100).alias("commit_index")).distinct())


# ---- plain search ----------------------------------------------------------------------------

_SEEN = "select path, min(commit_index) as first_commit, nullif(max(case when until > head then head else commit_index end), min(commit_index)) as last_commit from v where {} group by path"


def _both(*words: str) -> str:
    return " and ".join("contains(content, '{}')".format(w.replace("'", "''")) for w in words)


def _plain(name: str, words: str, base=documents, v: str = _V):
    @query(name, _with(v) + _SEEN.format(_both(*words.split())))
    def run(spark, sf_dir):
        h = base(spark, sf_dir)
        return search.first_last(search.matching(h, search.plain(words)), h)

    @query(f"{name}_by_index", _with(v) + _SEEN.format(_both(*words.split())))
    def run_by_index(spark, sf_dir):
        return by_index(spark, sf_dir, base, search.plain(words))


_plain("plain_one_word", "und")
_plain("plain_two_words", "und der")
_plain("plain_short_word", "x")
_plain("plain_multibyte_word", "für ß")
_plain("plain_missing_word", "zzzzqqqq")
_plain("deleted_file_history", "und", with_deletions, _D)


@query("plain_by_presence", _with(_C) + _SEEN.format(_both("the", "and")))
def plain_by_presence(spark, sf_dir):
    h = conversations(spark, sf_dir)
    return search.first_last(search.matching(h, search.plain("the and"), presence=index.presence(history.versions(h))), h)


# ---- regular expressions ---------------------------------------------------------------------


def _regex(name: str, pattern: str, base=documents, v: str = _V):
    sql = _with(v, _lines(), _EACH, f"hit as (select distinct path, commit_index, until, head from each_line where regexp_matches(line, '{pattern}'))") + _SEEN.format("true").replace("from v", "from hit")

    @query(name, sql)
    def run(spark, sf_dir):
        h = base(spark, sf_dir)
        return search.first_last(search.matching(h, search.pattern(pattern)), h)

    @query(f"{name}_by_index", sql)
    def run_by_index(spark, sf_dir):
        return by_index(spark, sf_dir, base, search.pattern(pattern))


_regex("regex_literal", "er un")
_regex("regex_class", CLASS)
_regex("regex_alternation", "(?:é|ü)r+|qu[ae]nt")
_regex("regex_repeat", "(?:an|en){2,4}d?")
_regex("regex_case_insensitive", "(?i)license")
_regex("regex_anchored", "^[A-Z]h.*and[^b]", conversations, _C)


# ---- places, context, highlights -------------------------------------------------------------


@query("line_matches", _with(_V, _lines(), _EACH, f"hit as (select path, commit_index, line_no, line, row_number() over (partition by path, commit_index order by line_no) as k, regexp_extract(line, '{CLASS}') as term from each_line where regexp_matches(line, '{CLASS}'))") + "select path, commit_index, line_no, term, strlen(substring(line, 1, strpos(line, term) - 1)) as byte_column from hit where k <= 11")
def line_matches(spark, sf_dir):
    q = search.pattern(CLASS)
    found = search.matching(documents(spark, sf_dir), q)
    return found.select("path", "commit_index", F.explode(search.places(F.col("content"), q)).alias("p")).select("path", "commit_index", "p.line_no", "p.term", "p.byte_column")


@query("first_word_position", _with(_V, _lines(), _EACH, "w as (select * from (values ('und'), ('der')) as t(term))", f"ok as (select path, commit_index from v where {_both('und', 'der')})", "spot as (select e.path, e.commit_index, w.term, e.line_no, e.line, row_number() over (partition by e.path, e.commit_index, w.term order by e.line_no) as k from each_line e join ok on e.path = ok.path and e.commit_index = ok.commit_index join w on contains(e.line, w.term))") + "select path, commit_index, term, line_no, strlen(substring(line, 1, strpos(line, term) - 1)) as byte_column from spot where k = 1")
def first_word_position(spark, sf_dir):
    q = search.plain(" ".join(WORDS))
    found = search.matching(documents(spark, sf_dir), q)
    return found.select("path", "commit_index", F.explode(search.places(F.col("content"), q)).alias("p")).select("path", "commit_index", "p.term", "p.line_no", "p.byte_column")


_AROUND = (
    _V, _lines(), _EACH,
    f"hit as (select path, commit_index, line_no, row_number() over (partition by path, commit_index order by line_no) as k from each_line where regexp_matches(line, '{PATTERN}'))",
    "near as (select distinct path, commit_index, line_no + d as line_no from (select *, unnest(range(-2, 2)) as d from hit where k <= 11))",
    "around as (select e.path, e.commit_index, e.line_no, e.line from each_line e join near n on e.path = n.path and e.commit_index = n.commit_index and e.line_no = n.line_no)",
)


def _shown(spark, sf_dir) -> DataFrame:
    q = search.pattern(PATTERN)
    found = search.matching(documents(spark, sf_dir), q)
    return found.select("path", "commit_index", F.explode(search.shown(F.col("content"), q)).alias("s")).select("path", "commit_index", F.col("s.line_number").alias("line_no"), F.col("s.content").alias("line"), F.size("s.highlights").alias("n_highlights"))


@query("context_window", _with(*_AROUND) + "select path, commit_index, line_no, line from around")
def context_window(spark, sf_dir):
    return _shown(spark, sf_dir).drop("n_highlights")


@query("context_gaps", _with(*_AROUND) + "select path, commit_index, line_no from (select *, lag(line_no) over (partition by path, commit_index order by line_no) as p from around) where p is not null and p <> line_no - 1")
def context_gaps(spark, sf_dir):
    rows = _shown(spark, sf_dir)
    before = F.lag("line_no").over(Window.partitionBy("path", "commit_index").orderBy("line_no"))
    return rows.withColumn("p", before).where("p <> line_no - 1").select("path", "commit_index", "line_no")


@query("highlighted_lines", _with(_V, _lines(), _EACH) + "select path, commit_index, line_no, regexp_replace(line, '(und|der)', '<\\1>', 'g') as marked from each_line where contains(line, 'und') and contains(line, 'der')")
def highlighted_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("path", "commit_index", F.posexplode(text.lines("content")).alias("line_no", "line"))
    both = rows.where(F.contains("line", F.lit("und")) & F.contains("line", F.lit("der")))
    return both.select("path", "commit_index", "line_no", text.highlighted("line", WORDS, "<", ">").alias("marked"))


@query("shortened_lines", _with(_V, _lines(), _EACH) + "select path, commit_index, lpad(cast(line_no as varchar), 6, ' ') || '| ' as label, case when strlen(line) < 80 then line else left(line, 40) || ' ... ' || right(line, 40) end as line from each_line")
def shortened_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("path", "commit_index", F.posexplode(text.lines("content")).alias("line_no", "line"))
    return rows.select("path", "commit_index", text.numbered("line_no").alias("label"), text.shortened("line").alias("line"))


@query("leftmost_first_words", _with(_V) + "select path, commit_index, array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'und|under|der'))), ',') as words from v")
def leftmost_first_words(spark, sf_dir):
    return documents(spark, sf_dir).select("path", "commit_index", F.array_join(text.found_words("content", ["und", "under", "der"]), ",").alias("words"))


@query("search_hits", _with(*_AROUND, """
ends as (select n.path, min(n.commit_index) as first, max(n.commit_index) as newest, max(v.head) as head, max(case when v.until > v.head then v.head else v.commit_index end) as last from (select distinct path, commit_index from hit) n join v on v.path = n.path and v.commit_index = n.commit_index group by n.path),
sides as (select path, 'first' as side, first as at, first as commit_index, first = head as is_head from ends union all select path, 'last', newest, last, last = head from ends where last > first)
""") + f"select s.path, s.side, s.commit_index, s.is_head, a.line_no, a.line, coalesce(case when h.k <= 11 then regexp_extract(a.line, '{PATTERN}') end, '') as term from sides s join around a on a.path = s.path and a.commit_index = s.at left join hit h on h.path = a.path and h.commit_index = a.commit_index and h.line_no = a.line_no")  # fmt: skip
def search_hits(spark, sf_dir):
    """Every line of the first and the last match of each file, with what is marked in it."""
    q = search.pattern(PATTERN)
    h = documents(spark, sf_dir)
    found = search.hits(search.matching(h, q), q, h)
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"{k}_match").alias("m")) for k in ("first", "last")])
    lines = found.select("path", F.explode(sides).alias("s")).where("s.m is not null").select("path", "s.side", "s.m.commit_index", "s.m.is_head", F.explode("s.m.lines").alias("x"))
    return lines.select("path", "side", "commit_index", "is_head", F.col("x.line_number").alias("line_no"), F.col("x.content").alias("line"), F.array_join(F.transform("x.highlights", lambda m: m["term"]), ",").alias("term"))


@query("seen_labels", _with(_V, "s as (" + _SEEN.format(_both("und", "der")) + ")") + """, l as (select path, first_commit, last_commit, (select max(doc_id) from documents) as head from s)
select path, 'First seen at ' || case when first_commit = head then 'HEAD' else left(md5(cast(first_commit as varchar)), 8) end || strftime(make_timestamp(first_commit * 1000000), ' (at %Y-%m-%d %H:%M)')
|| case when last_commit is null then ', never seen afterwards' else ', last seen at ' || case when last_commit = head then 'HEAD' else left(md5(cast(last_commit as varchar)), 8) end || strftime(make_timestamp(last_commit * 1000000), ' (at %Y-%m-%d %H:%M)') end as seen from l""")  # fmt: skip
def seen_labels(spark, sf_dir):
    h = documents(spark, sf_dir)
    found = search.first_last(search.matching(h, search.plain("und der")), h).crossJoin(F.broadcast(history.head_of(h)))
    label = lambda c: text.commit_label(F.md5(F.col(c).cast("string")), F.timestamp_seconds(c), F.col(c) == F.col("head"))
    return found.select("path", text.seen_text(label("first_commit"), label("last_commit")).alias("seen"))


@query("search_page", _with(_V) + _SEEN.format(_both("und", "der")) + " order by path limit 10 offset 10")
def search_page(spark, sf_dir):
    h = documents(spark, sf_dir)
    return search.page(search.first_last(search.matching(h, search.plain("und der")), h), 1, 10)


@query("top_files", _with(_V) + _SEEN.format(_both("und")) + " order by path limit 10")
def top_files(spark, sf_dir):
    h = documents(spark, sf_dir)
    return search.page(search.first_last(search.matching(h, search.plain("und")), h), 0, 10)


@query("debounced_signals", """
with recursive ev as materialized (select cast(user_id as varchar) as key, epoch_us(ts) as t from events where user_id is not null and ts is not null),
fired as (
  select key, min(t) + 3600000000 as due, min(t) as armed from ev group by key
  union all
  select f.key, min(e.t) + 3600000000, min(e.t) from fired f join ev e on e.key = f.key and e.t >= f.due group by f.key
)
select f.key, make_timestamp(f.due) as signal_at, count(*) - 1 as dropped from fired f join ev e on e.key = f.key and e.t >= f.armed and e.t < f.due group by f.key, f.due""")
def debounced_signals(spark, sf_dir):
    return debounced(read(spark, sf_dir, "events"), "user_id", "ts", 3600.0)


# ---- lines, commits and provenance -----------------------------------------------------------


@query("numbered_commits", "select cast(doc_id as varchar) as commit_id, row_number() over (order by source, cast(doc_id as varchar)) - 1 as commit_index from documents")
def numbered_commits(spark, sf_dir):
    commits = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("commit_id"), "source")
    return history.numbered_commits(commits, "source").select("commit_id", "commit_index")


@query("line_counts", _with(_V, _lines()) + "select path, commit_index, len(ll) as n_lines from ls")
def line_counts(spark, sf_dir):
    return documents(spark, sf_dir).where("content <> ''").select("path", "commit_index", F.size(text.lines("content")).alias("n_lines"))


@query("modified_commits", _with(_D) + "select path, count(*) as n_commits, min(commit_index) as first_commit, max(commit_index) as last_commit, array_to_string(list_sort(list(commit_index)), ',') as commits from v group by path")
def modified_commits(spark, sf_dir):
    per = with_deletions(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n_commits"), F.min("commit_index").alias("first_commit"), F.max("commit_index").alias("last_commit"), F.array_sort(F.collect_set("commit_index")).alias("commits"))
    return per.withColumn("commits", F.array_join(F.col("commits").cast("array<string>"), ","))


@query("matched_terms", _with(_V, _lines(), _EACH, f"hit as (select path, regexp_extract(line, '{PATTERN}') as term, row_number() over (partition by path, commit_index order by line_no) as k from each_line where regexp_matches(line, '{PATTERN}'))") + "select path, array_to_string(list_sort(list(distinct term)), ',') as terms from hit where k <= 11 group by path")
def matched_terms(spark, sf_dir):
    q = search.pattern(PATTERN)
    terms = search.matching(documents(spark, sf_dir), q).select("path", F.explode(F.transform(search.places(F.col("content"), q), lambda p: p["term"])).alias("term"))
    return terms.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@query("commit_details", _with(_V, "s as (" + _SEEN.format(_both("und", "der")) + ")") + "select s.path, s.first_commit, s.last_commit, s.last_commit is not null and s.last_commit = (select max(doc_id) from documents) as is_head, d.lang, d.n_chars from s join documents d on d.doc_id = s.first_commit")
def commit_details(spark, sf_dir):
    h = documents(spark, sf_dir)
    found = search.first_last(search.matching(h, search.plain("und der")), h)
    meta = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("first_commit"), "lang", "n_chars")
    head = F.broadcast(meta.agg(F.max("first_commit").alias("head")))
    return found.join(meta, "first_commit").crossJoin(head).select("path", "first_commit", "last_commit", F.coalesce(F.col("last_commit") == F.col("head"), F.lit(False)).alias("is_head"), "lang", "n_chars")


@query("removed_tokens", _with(_C, _lines(), _EACH, _TOK, """
t as materialized (select path, commit_index, list(distinct token) as held from tok group by path, commit_index),
n as materialized (select path, commit_index, lag(commit_index) over (partition by path order by commit_index) as before from v),
gone as (select n.path, n.commit_index, list_filter(had.held, lambda x: not list_contains(coalesce(now.held, []), x)) as tokens
from n join t had on had.path = n.path and had.commit_index = n.before left join t now on now.path = n.path and now.commit_index = n.commit_index)
""") + "select path, commit_index, unnest(tokens) as token from gone")  # fmt: skip
def removed_tokens(spark, sf_dir):
    h = conversations(spark, sf_dir)
    before = F.lag(text.tokens("content")).over(Window.partitionBy("path").orderBy("commit_index"))
    return h.withColumn("had", before).where("had is not null").select("path", "commit_index", F.explode(F.array_except("had", text.tokens("content"))).alias("token"))


_HEAD = "left(hex({}), 2 * 8192)"
_MARK = "regexp_matches(" + _HEAD + ", '^(?:..)*?(?:EFBBBF|FEFF|FFFE)')"
_FILES = """files as (
  select page_id, 'plain' as kind, encode(html) as b, true as valid, '' as magic from pages where html is not null
  union all select page_id, 'marked', '\\xEF\\xBB\\xBF'::blob || encode(html), true, '' from pages where html is not null
  union all select page_id, 'marked late', encode(html) || encode(repeat('x', 9000)) || '\\xEF\\xBB\\xBF'::blob, true, '' from pages where html is not null
  union all select page_id, 'broken', encode(html) || '\\xFF'::blob, false, '' from pages where html is not null
  union all select page_id, 'signed', '\\x25\\x50\\x44\\x46\\xFE\\xFF'::blob || encode(html), false, '25504446' from pages where html is not null
  union all select page_id, 'signed text', '\\x25\\x50\\x44\\x46\\xEF\\xBB\\xBF'::blob || encode(html), true, '25504446' from pages where html is not null)"""


@query("text_pages", _with(_FILES) + f"select page_id, kind, magic <> '' and left(hex(b), 8) = magic as signed, (magic <> '' and left(hex(b), 8) = magic or not {_MARK.format('b')}) as first_test, (magic <> '' and left(hex(b), 8) = magic or not {_MARK.format('b')}) and valid as is_text from files")
def text_pages(spark, sf_dir):
    """Pages as files, as they are and with byte order marks, broken ends and signatures."""
    html = F.col("html").cast("binary")
    raw = lambda x: F.unhex(F.lit(x))
    kinds = {
        "plain": (html, "page.html"), "marked": (F.concat(raw("EFBBBF"), html), "page.html"), "marked late": (F.concat(html, F.repeat(F.lit("x"), F.lit(9000)).cast("binary"), raw("EFBBBF")), "page.html"),
        "broken": (F.concat(html, raw("FF")), "page.html"), "signed": (F.concat(raw("25504446FEFF"), html), "dir.d/page.pdf"), "signed text": (F.concat(raw("25504446EFBBBF"), html), "page.pdf"),
    }
    files = F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("b"), F.lit(p).alias("path")) for k, (b, p) in kinds.items()])
    rows = read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.explode(files).alias("f")).select("page_id", "f.*")
    ext = encoding.extension(F.col("path"))
    return rows.select("page_id", "kind", encoding.has_signature(F.col("b"), ext).alias("signed"), encoding.looks_like_text(F.col("b"), ext).alias("first_test"), encoding.is_text(F.col("b"), F.col("path")).alias("is_text"))


@query("stored_index_search", _with(_V) + _SEEN.format(_both("und", "der")))
def stored_index_search(spark, sf_dir):
    """Indexes the older half of the commits, then the newer, and searches the stored index."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("commit_index"), F.concat_ws("/", "lang", "source").alias("path"), F.col("text").alias("content"))
    commits = docs.select("commit_index", F.col("commit_index").cast("string").alias("commit_id"), F.timestamp_seconds("commit_index").alias("commit_time"), F.col("path").alias("summary"))
    middle = docs.agg(F.max("commit_index")).first()[0] // 2
    store = Store(spark, new_folder(spark, "index"))
    for part in (F.col("commit_index") <= middle, F.col("commit_index") > middle):
        store.append(commits.where(part), docs.where(part))
    q = search.plain("und der")
    found = store.changes().join(store.candidates(q.alternatives), "path", "left_semi")
    return search.first_last(search.matching(found, q), store.changes(), store.head_row())


@query("blame_lines")
def blame_lines(spark, sf_dir):
    return lineage.blame(documents(spark, sf_dir))


@query("compat_presence")
def compat_presence(spark, sf_dir):
    """The commits are written as text once for all tokens of a file that are in the same ones."""
    groups = lineage.compat_groups(history.versions(conversations(spark, sf_dir)))
    commits = F.array_join(lineage.commits_of("firsts", "lasts").cast("array<string>"), ",")
    # a select of its own: beside explode() it would be computed for each token
    told = groups.select("path", commits.alias("commits"), "is_deleted", F.arrays_zip("tokens", "n_live").alias("each"))
    rows = told.select("path", "commits", "is_deleted", F.explode("each").alias("t"))
    return rows.select("path", F.col("t.tokens").alias("token"), "t.n_live", "commits", "is_deleted")


@query("edit_stats")
def edit_stats(spark, sf_dir):
    return lineage.edit_stats(documents(spark, sf_dir))
