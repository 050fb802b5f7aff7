"""Requests, matching, ranking, merging, paging and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import index as index_ops
from pagelake.operators import requests as req
from pagelake.operators import search as ops
from pagelake.plans.reuse import materialize, scratch_path
from pagelake.sources.pages import load_documents

# Asked of every document: single words, pairs, quoted phrases, and one without hits.
ASKED = [
    (1, "the"),
    (2, "of the"),
    (3, "und"),
    (4, "der sch"),
    (5, "le des"),
    (6, "que en"),
    (7, '"of the"'),
    (8, '"de la" les'),
    (9, '"Elle un la"'),
    (10, "nosuchword"),
    (11, 'the "nosuch phrase"'),
]
ASKED_SQL = ", ".join("({}, '{}')".format(*row) for row in ASKED)
# Each benchmark passage also asks for its first three words as a phrase.
OPENING = "regexp_extract(text, '^([^ ]+ +[^ ]+ +[^ ]+)', 1)"
QUERY_CTE = f"""queries AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES {ASKED_SQL}) AS t(query_id, query)
  UNION ALL SELECT item_id + 1000, '"' || {OPENING} || '"' FROM benchmark)"""


def documents(spark, sf):
    return load_documents(spark, f"{sf}/documents.parquet")


def asked(spark, sf):
    fixed = spark.createDataFrame(ASKED, "query_id BIGINT, query STRING")
    derived = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        (F.col("item_id") + 1000).alias("query_id"), F.expr(f"""'"' || {OPENING} || '"'""").alias("query")
    )
    return fixed.unionByName(derived)


def scored(spark, sf):
    return ops.rank_bm25(documents(spark, sf).select("doc_id", "text"), asked(spark, sf))


def described(spark, sf, hits):
    """Hits with the fields of a search result; the source stands for the engine."""
    docs = documents(spark, sf).select(
        "doc_id",
        F.split("text", "\n")[0].alias("title"),
        F.concat(F.lit("https://docs.example.org/"), (F.col("doc_id") % 100).cast("string")).alias("url"),
        F.col("text").alias("content"),
        F.col("source").alias("engine"),
        F.col("lang").alias("language"),
    )
    return hits.join(docs, "doc_id")


def match_documents(spark, sf):
    return ops.match_documents(documents(spark, sf).select("doc_id", "text"), asked(spark, sf))


# Quoted parts of words, of several words, with signs between, and together with bare words.
QUOTED = [(1, '"ion"'), (2, '"E TH"'), (3, 'the "ing of"'), (4, '"a "'), (5, 'und "SCH"'), (6, '". "'), (7, '"nosuch" the'), (8, 'le "on" "es d"')]


def quoted(spark, sf):
    """Fixed queries, and letters from inside each benchmark passage."""
    derived = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        (F.col("item_id") + 1000).alias("query_id"), F.concat(F.lit('"'), F.regexp_replace(F.substring("text", 4, 25), '"', " "), F.lit('"')).alias("query")
    )
    return spark.createDataFrame(QUOTED, "query_id BIGINT, query STRING").unionByName(derived)


def match_substrings(spark, sf):
    return ops.match_substrings(documents(spark, sf).select("doc_id", "text"), quoted(spark, sf))


def rank_bm25(spark, sf):
    return scored(spark, sf).withColumn("score", F.round("score", 5))


def search_index(spark, sf):
    """The documents as an index in three segments, of which the first two were merged."""
    index = index_ops.SearchIndex(spark, scratch_path(spark, "index"))
    docs = documents(spark, sf)
    index.append(docs.where("doc_id % 3 = 0"))
    index.append(docs.where("doc_id % 3 = 1"))
    index.merge()
    index.append(docs.where("doc_id % 3 = 2"))
    return index


def rank_bm25_index(spark, sf):
    return index_ops.rank_index(search_index(spark, sf), asked(spark, sf)).withColumn("score", F.round("score", 5))


def page_results_index(spark, sf):
    """The first hundred hits per query by block limits."""
    return index_ops.page_index(search_index(spark, sf), asked(spark, sf), 1, 100, places=5).select("query_id", "doc_id", "rank")


def page_results(spark, sf):
    hits = scored(spark, sf).withColumn("score", F.round("score", 5))
    paged = ops.page_results(hits, pageno=(F.col("query_id") % 3 + 1).cast("int"), page_size=20, max_results=15)
    return paged.select("query_id", "doc_id", "score", "rank")


def page_results_first(spark, sf):
    hits = scored(spark, sf).withColumn("score", F.round("score", 5))
    return ops.page_results(hits, pageno=1, max_results=100).select("query_id", "doc_id", "rank")


def top_hit(spark, sf):
    first = ops.top_hit(scored(spark, sf).withColumn("score", F.round("score", 5)))
    return described(spark, sf, first).select("query_id", "doc_id", "title")


def engine_hits(spark, sf):
    """Per engine and query, hits in document order; several documents share a url."""
    matched = described(spark, sf, ops.match_documents(documents(spark, sf).select("doc_id", "text"), asked(spark, sf)))
    return matched.withColumn("position", (F.floor(F.col("doc_id") / 20) + 1).cast("int"))


def merge_engines(spark, sf):
    merged = ops.merge_engines(engine_hits(spark, sf))
    return merged.select(
        "query_id", "url", "title", "engine", F.md5("content").alias("content_hash"),
        F.array_join("engines", ",").alias("engines"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        F.round("score", 6).alias("score"),
    )


def result_counts(spark, sf):
    return ops.result_counts(asked(spark, sf), ops.match_documents(documents(spark, sf).select("doc_id", "text"), asked(spark, sf)))


def unresponsive_engines(spark, sf):
    """Every query asks the engines src0 to src24; the documents know twenty of them."""
    names = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda n: F.concat(F.lit("src"), n.cast("string")))
    requested = asked(spark, sf).select("query_id", F.explode(names).alias("engine"))
    return ops.unresponsive_engines(requested, engine_hits(spark, sf))


SEARCH_OPTIONS = """CASE query_id WHEN 3 THEN 'de' WHEN 4 THEN 'de' WHEN 5 THEN 'fr' WHEN 6 THEN 'fr' WHEN 8 THEN 'fr' WHEN 9 THEN 'fr' END AS language,
  CASE WHEN query_id % 3 = 0 THEN 'src1,src2,src3,src5,src7,src11' ELSE '' END AS engines,
  CASE WHEN query_id % 5 < 2 THEN 'long' END AS categories,
  CASE query_id % 7 WHEN 0 THEN 'week' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN '' END AS time_range,
  CAST(query_id % 2 + 1 AS INT) AS pageno,
  CAST(CASE WHEN query_id % 4 < 3 THEN 3 END AS INT) AS max_results"""


def full_search(spark, sf):
    """Whole requests against documents with engine, language, categories and time."""
    requests = asked(spark, sf).selectExpr("query_id", "query", *split_columns(SEARCH_OPTIONS))
    docs = documents(spark, sf).select(
        "doc_id", "text", F.col("source").alias("engine"), F.col("lang").alias("language"),
        F.array(F.when(F.col("n_chars") > 1000, "long").otherwise("short"), F.col("lang")).alias("categories"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 1000).cast("int"))).alias("ts"),
    )
    return ops.search(requests, docs, 5, F.lit("2024-02-11 00:00:00").cast("timestamp_ntz"))


def search_hits(spark, sf):
    return full_search(spark, sf).hits.select("query_id", "doc_id", "engine", "rank")


def search_counts(spark, sf):
    found = full_search(spark, sf)
    rejected = found.rejected.select("query_id", "query", F.col("error").alias("message"))
    return found.counts.unionByName(rejected, allowMissingColumns=True)


def snippets(spark, sf):
    from pagelake.functions.text import snippet

    text = F.col("text")
    return documents(spark, sf).select(
        "doc_id", snippet(text, 200).alias("simple"), snippet(text, 300).alias("pretty"), snippet(text, 10000).alias("numbered")
    )


def render(mode):
    def query(spark, sf):
        hits = materialize(scored(spark, sf).withColumn("score", F.round("score", 5)), "hits")
        counts = ops.result_counts(asked(spark, sf), hits)
        # Only ids are ranked and cut; the shown ones get their text.
        paged = described(spark, sf, ops.page_results(hits, max_results=10))
        return ops.render_results(counts, paged.drop("score"), mode)

    return query


def project_hits(spark, sf):
    """Hits with gaps, as engines send them."""
    hits = documents(spark, sf).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n")[0]).alias("title"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("engine"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string"))).alias("url"),
        F.when(F.col("doc_id") % 2 != 0, F.col("lang")).alias("content"),
    )
    return req.project_hits(hits)


def filter_results(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        "ts",
        F.array(F.col("event_type"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string"))).alias("categories"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("engine"),
        F.when(F.col("event_id") % 3 == 0, "de").otherwise("en").alias("language"),
    )
    now = F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")
    by_category = req.filter_results(events, categories=["click", "c2"], language="en", time_range="month", now=now)
    by_engine = req.filter_results(events, categories=["click"], engines=["src3", "src7"], time_range="year", now=now)
    return (
        by_category.select("event_id", F.lit("category").alias("request"))
        .unionByName(by_engine.select("event_id", F.lit("engine").alias("request")))
    )


REQUEST_COLUMNS = """event_id AS request_id,
  CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'query ' || event_id END AS query,
  CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://example.org/' || event_id END AS url,
  CAST(event_id % 5 - 1 AS INT) AS pageno,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 150 AS INT) END AS max_results,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 15 AS INT) END AS subpage_limit,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 1000 AS BIGINT) END AS max_content_length,
  CASE event_id % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'week' ELSE '' END AS time_range,
  CASE event_id % 3 WHEN 0 THEN 'a, b,' WHEN 1 THEN '' ELSE NULL END AS categories,
  CASE event_id % 4 WHEN 0 THEN 'bing,google' WHEN 1 THEN '' ELSE NULL END AS engines,
  CASE WHEN event_id % 2 = 0 THEN 'de' END AS language,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TXT' WHEN 2 THEN 'markdown' WHEN 3 THEN 'pdf' ELSE 'Html' END AS content_format,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' COERCE ' WHEN 2 THEN 'strict' WHEN 3 THEN 'sanitize' WHEN 4 THEN '  ' ELSE 'Strict' END AS validation_mode,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '[1]' WHEN 3 THEN '"x"' ELSE props END AS json_schema"""


def requests(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(*split_columns(REQUEST_COLUMNS))


def split_columns(columns: str) -> list[str]:
    """The select items of a fragment, one per line."""
    return [item.strip().rstrip(",") for item in columns.split("\n")]


def normalise_requests(spark, sf):
    rows = req.normalise_requests(requests(spark, sf))
    return rows.select(
        "request_id", "language", "pageno", "max_results", "subpage_limit", "max_content_length",
        F.array_join("categories", "|").alias("categories"), F.array_join("engines", "|").alias("engines"),
    )


def validate_requests(spark, sf):
    rows = requests(spark, sf)
    return (
        req.validate_requests(rows, "search").select("request_id", F.lit("search").alias("kind"), "status", "error")
        .unionByName(req.validate_requests(rows, "fetch").select("request_id", F.lit("fetch").alias("kind"), "status", "error"))
        .unionByName(req.validate_requests(rows, "extract").select("request_id", F.lit("extract").alias("kind"), "status", "error"))
    )


def quarantine(spark, sf):
    good, bad = req.split_valid(req.validate_requests(requests(spark, sf), "crawl"))
    count = F.count(F.lit(1)).alias("requests")
    return (
        good.groupBy("status", "error").agg(count).withColumn("part", F.lit("good"))
        .unionByName(bad.groupBy("status", "error").agg(count).withColumn("part", F.lit("quarantine")))
    )


def request_options(spark, sf):
    return req.request_options(requests(spark, sf)).select("request_id", "status", "error", "content_format", "validation_mode")


GUARD_LIMIT, GUARD_BODY = 2000, 4000


def guard_content(spark, sf):
    contents = documents(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, " \n\t").otherwise(F.col("text")).alias("content")
    )
    return req.guard_content(contents, GUARD_LIMIT, GUARD_BODY).select("doc_id", "status", "error")


QUERIES = {
    "normalise_requests": normalise_requests,
    "validate_requests": validate_requests,
    "quarantine": quarantine,
    "request_options": request_options,
    "guard_content": guard_content,
    "filter_results": filter_results,
    "project_hits": project_hits,
    "match_documents": match_documents,
    "match_substrings": match_substrings,
    "rank_bm25": rank_bm25,
    "rank_bm25_index": rank_bm25_index,
    "page_results_index": page_results_index,
    "merge_engines": merge_engines,
    "page_results": page_results,
    "page_results_first": page_results_first,
    "top_hit": top_hit,
    "result_counts": result_counts,
    "unresponsive_engines": unresponsive_engines,
    "search_hits": search_hits,
    "search_counts": search_counts,
    "snippet": snippets,
    "render_results_simple": render("simple"),
    "render_results_pretty": render("pretty"),
    "render_results_numbered": render("numbered"),
    "render_results_json": render("json"),
}

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
# matched(query_id, doc_id, score): every query against every document.
MATCH_CTES = f"""{QUERY_CTE},
docs AS (SELECT *, {WORDS.format("text")} AS tokens FROM documents),
parsed AS (SELECT query_id, query, list_distinct({WORDS.format("query")}) AS terms,
  list_filter(list_transform(regexp_extract_all(query, '"([^"]*)"', 1), lambda p: array_to_string({WORDS.format("p")}, ' ')),
    lambda p: p LIKE '% %') AS phrases FROM queries),
pairs AS (SELECT query_id, doc_id, terms, tokens FROM parsed, docs
  WHERE list_has_all(tokens, terms) AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || p || ' '))) = 0),
sizes AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_len FROM docs),
tfs AS (SELECT doc_id, len(tokens) AS doc_len, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM docs)
  WHERE term IN (SELECT unnest(terms) FROM parsed) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
matched AS (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean_len))), 5) AS score
  FROM (SELECT query_id, doc_id, unnest(terms) AS term FROM pairs) p JOIN tfs ON p.doc_id = tfs.doc_id AND p.term = tfs.term
  JOIN dfs ON dfs.term = p.term, sizes GROUP BY query_id, p.doc_id),
described AS (SELECT m.*, split_part(text, chr(10), 1) AS title, 'https://docs.example.org/' || (m.doc_id % 100) AS url,
  text AS content, source AS engine FROM matched m JOIN documents d ON m.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nr FROM described)
"""
ENGINE_CTES = f"""{MATCH_CTES},
hits AS (SELECT *, CAST(floor(doc_id / 20) + 1 AS INT) AS position FROM described),
best AS (SELECT query_id, url, engine, min(position) AS position,
  min({{'p': position, 't': title, 'c': content}}) AS first FROM hits GROUP BY query_id, url, engine)"""


SEARCH_CTES = f"""{MATCH_CTES},
options AS (SELECT query_id, query, coalesce(language, 'en') AS language, engines, categories, time_range, pageno, coalesce(max_results, 20) AS max_results
  FROM (SELECT query_id, query, {SEARCH_OPTIONS} FROM queries)),
fitting AS (SELECT m.query_id, m.doc_id, source AS engine, pageno, max_results,
    row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, m.doc_id) - (pageno - 1) * 5 AS rank
  FROM matched m JOIN options o ON m.query_id = o.query_id JOIN documents d ON m.doc_id = d.doc_id
  WHERE coalesce(time_range, '') <> 'week' AND d.lang = o.language
    AND CASE WHEN engines <> '' THEN list_contains(string_split(engines, ','), source) WHEN categories = 'long' THEN n_chars > 1000 ELSE true END
    AND (coalesce(time_range, '') <> 'month' OR m.doc_id % 1000 >= 24 * 10)),
shown AS (SELECT * FROM fitting WHERE rank BETWEEN 1 AND least(5, max_results))"""


def cut(column, n):
    return f"CASE WHEN length({column}) > {n} THEN substr({column}, 1, {n}) || '...' ELSE {column} END"


ENTRY_SQL = {
    "simple": f"'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' || {cut('content', 200)} || chr(10) || repeat('-', 50)",
    "pretty": f"""chr(10) || nr || '. ' || title || chr(10) || '   URL: ' || url || chr(10) || '   Engine: ' || engine || chr(10)
       || CASE WHEN content <> '' THEN '   Content: ' || {cut('content', 300)} || chr(10) ELSE '' END || repeat('-', 40)""",
    "numbered": f"""nr || '. ' || title || chr(10) || '   URL: ' || url || chr(10) || '   Engine: ' || engine || chr(10)
       || '   Content: ' || {cut('content', 10000)} || chr(10)""",
    "json": """'{"url":' || to_json(url) || ',"title":' || to_json(title) || ',"content":' || to_json(content) || ',"engine":' || to_json(engine) || '}'""",
}
REPORT_SQL = {
    "simple": "coalesce(entries, '')",
    "pretty": """'Query: ' || query || chr(10) || 'Number of results: ' || shown || chr(10) || 'Search time: ' || total || ' results'
       || chr(10) || repeat('=', 60) || coalesce(chr(10) || entries, '')""",
    "numbered": """CASE WHEN entries IS NULL THEN 'No results found' ELSE 'Search results for ''' || query || ''' (showing ' || shown
       || ' of ' || total || ' results):' || chr(10) || chr(10) || entries END""",
    "json": """'{"query":' || to_json(query) || ',"number_of_results":' || total || ',"results":[' || coalesce(entries, '') || ']}'""",
}


def render_sql(mode):
    joiner = "','" if mode == "json" else "chr(10)"
    return f"""WITH {MATCH_CTES},
      grouped AS (SELECT query_id, string_agg({ENTRY_SQL[mode]}, {joiner} ORDER BY nr) FILTER (nr <= 10) AS entries,
        count(*) FILTER (nr <= 10) AS shown, count(*) AS total FROM ranked GROUP BY query_id),
      rows AS (SELECT q.query_id, q.query, entries, coalesce(shown, 0) AS shown, coalesce(total, 0) AS total
        FROM queries q LEFT JOIN grouped USING (query_id))
      SELECT query_id, {REPORT_SQL[mode]} AS report FROM rows"""


JSON_TEXT_SIZE = """(length(regexp_replace(content, '[^ -~]', '', 'g')) + length(regexp_replace(content, '[^"\\\\]', '', 'g'))
  + 2 * length(regexp_replace(content, '[^\\n\\r\\t]', '', 'g'))
  + 6 * length(regexp_replace(regexp_replace(content, '[ -~]', '', 'g'), '[\\n\\r\\t]', '', 'g')))"""

ORACLES = {
    "normalise_requests": f"""WITH r AS (SELECT {REQUEST_COLUMNS} FROM events)
      SELECT request_id, coalesce(language, 'en') AS language, greatest(pageno, 1) AS pageno,
        CASE WHEN max_results IS NULL THEN 20 WHEN max_results > 100 THEN 100 ELSE max_results END AS max_results,
        CASE WHEN subpage_limit IS NULL THEN 5 WHEN subpage_limit > 10 THEN 10 ELSE subpage_limit END AS subpage_limit,
        CASE WHEN max_content_length > 1048576 THEN 1048576 ELSE max_content_length END AS max_content_length,
        replace(nullif(categories, ''), ',', '|') AS categories, replace(nullif(engines, ''), ',', '|') AS engines FROM r""",
    "validate_requests": f"""WITH r AS (SELECT {REQUEST_COLUMNS} FROM events),
      e AS (
        SELECT request_id, 'search' AS kind, CASE WHEN coalesce(query, '') = '' THEN 'Query is required'
          WHEN time_range = 'week' THEN 'time_range must be one of: day, month, year' END AS error FROM r
        UNION ALL SELECT request_id, 'fetch', CASE WHEN coalesce(url, '') = '' THEN 'URL is required' END FROM r
        UNION ALL SELECT request_id, 'extract', CASE WHEN coalesce(url, '') = '' THEN 'Error: URL is required'
          WHEN json_schema IS NULL OR json_schema = 'null' THEN 'Error: json_schema is required'
          WHEN json_schema IN ('[1]', '"x"') THEN 'Error: json_schema must be an object'
          WHEN content_format = 'pdf' THEN 'content_format must be one of: "txt", "markdown", "html"'
          WHEN validation_mode = 'sanitize' THEN 'validation_mode must be "strict" or "coerce"' END FROM r)
      SELECT request_id, kind, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error FROM e""",
    "quarantine": f"""WITH r AS (SELECT {REQUEST_COLUMNS} FROM events)
      SELECT CASE WHEN bad THEN 400 ELSE 200 END AS status, CASE WHEN bad THEN 'URL is required' END AS error,
        count(*) AS requests, CASE WHEN bad THEN 'quarantine' ELSE 'good' END AS part
      FROM (SELECT coalesce(url, '') = '' AS bad FROM r) GROUP BY bad""",
    "request_options": f"""WITH r AS (SELECT {REQUEST_COLUMNS} FROM events),
      o AS (SELECT request_id, lower(coalesce(content_format, 'txt')) AS content_format,
        CASE WHEN trim(coalesce(validation_mode, '')) = '' THEN 'coerce' ELSE lower(trim(validation_mode)) END AS validation_mode FROM r),
      e AS (SELECT *, CASE WHEN content_format = 'pdf' THEN 'content_format must be one of: "txt", "markdown", "html"'
        WHEN validation_mode = 'sanitize' THEN 'validation_mode must be "strict" or "coerce"' END AS error FROM o)
      SELECT request_id, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status, error, content_format, validation_mode FROM e""",
    "guard_content": f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS content FROM documents),
      e AS (SELECT doc_id, CASE WHEN content !~ '\\S' THEN 'Error: fetched content is empty or whitespace-only after cleaning'
        WHEN length(content) > {GUARD_LIMIT} THEN 'Error: content exceeds EXTRACT_MAX_LENGTH ({GUARD_LIMIT} Unicode code units)'
        WHEN {JSON_TEXT_SIZE} + 59 > {GUARD_BODY} THEN 'request body exceeds EXTRACT_MAX_JSON_BODY_BYTES ({GUARD_BODY})' END AS error FROM c)
      SELECT doc_id, CASE WHEN error IS NULL THEN 200 WHEN error LIKE '%whitespace%' THEN 400 ELSE 413 END AS status, error FROM e""",
    "filter_results": """SELECT event_id, 'category' AS request FROM events
      WHERE (event_type = 'click' OR user_id % 4 = 2) AND event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-01-10 00:00:00'
      UNION ALL SELECT event_id, 'engine' FROM events WHERE user_id % 20 IN (3, 7) AND ts >= TIMESTAMP '2023-02-10 00:00:00'""",
    "project_hits": """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN split_part(text, chr(10), 1) ELSE 'N/A' END AS title,
      CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'N/A' END AS engine,
      CASE WHEN doc_id % 7 <> 0 THEN 'https://docs.example.org/' || doc_id ELSE 'N/A' END AS url,
      CASE WHEN doc_id % 2 <> 0 THEN lang ELSE '' END AS content FROM documents""",
    "match_documents": f"WITH {MATCH_CTES} SELECT query_id, doc_id FROM matched",
    "rank_bm25": f"WITH {MATCH_CTES} SELECT query_id, doc_id, score FROM matched",
    "merge_engines": f"""WITH {ENGINE_CTES}
      SELECT query_id, url, min({{'p': position, 'e': engine, 't': first.t, 'c': first.c}}).t AS title,
        min({{'p': position, 'e': engine}}).e AS engine, md5(min({{'p': position, 'e': engine, 't': first.t, 'c': first.c}}).c) AS content_hash,
        string_agg(engine, ',' ORDER BY engine) AS engines, string_agg(position, ',' ORDER BY position, engine) AS positions,
        round(sum(1.0::DOUBLE / (60 + position)), 6) AS score FROM best GROUP BY query_id, url""",
    "page_results": f"""WITH {MATCH_CTES} SELECT query_id, doc_id, score, CAST(nr - query_id % 3 * 20 AS INT) AS rank FROM ranked
      WHERE nr > query_id % 3 * 20 AND nr <= query_id % 3 * 20 + 15""",
    "page_results_first": f"WITH {MATCH_CTES} SELECT query_id, doc_id, CAST(nr AS INT) AS rank FROM ranked WHERE nr <= 100",
    "top_hit": f"WITH {MATCH_CTES} SELECT query_id, doc_id, title FROM ranked WHERE nr = 1",
    "result_counts": f"""WITH {MATCH_CTES}, c AS (SELECT query_id, count(*) AS total FROM matched GROUP BY query_id)
      SELECT q.query_id, query, coalesce(total, 0) AS total, least(coalesce(total, 0), 20) AS shown,
        CASE WHEN total IS NULL THEN 'No results found' END AS message FROM queries q LEFT JOIN c USING (query_id)""",
    "unresponsive_engines": f"""WITH {MATCH_CTES} SELECT query_id, 'src' || n AS engine FROM queries, range(25) AS r(n)
      EXCEPT SELECT query_id, engine FROM described""",
    "search_hits": f"WITH {SEARCH_CTES} SELECT query_id, doc_id, engine, CAST(rank AS INT) AS rank FROM shown",
    "search_counts": f"""WITH {SEARCH_CTES}, t AS (SELECT query_id, count(*) AS total FROM fitting GROUP BY query_id),
        s AS (SELECT query_id, count(*) AS shown FROM shown GROUP BY query_id)
      SELECT o.query_id, query, CASE WHEN time_range = 'week' THEN NULL ELSE coalesce(total, 0) END AS total,
        CASE WHEN time_range = 'week' THEN NULL ELSE coalesce(shown, 0) END AS shown,
        CASE WHEN time_range = 'week' THEN 'time_range must be one of: day, month, year' WHEN shown IS NULL THEN 'No results found' END AS message
      FROM options o LEFT JOIN t ON o.query_id = t.query_id LEFT JOIN s ON o.query_id = s.query_id""",
    "snippet": f"""SELECT doc_id, {cut('text', 200)} AS simple, {cut('text', 300)} AS pretty, {cut('text', 10000)} AS numbered FROM documents""",
    **{f"render_results_{mode}": render_sql(mode) for mode in ENTRY_SQL},
}
ORACLES["rank_bm25_index"] = ORACLES["rank_bm25"]
ORACLES["page_results_index"] = ORACLES["page_results_first"]
QUOTED_SQL = ", ".join("({}, '{}')".format(*row) for row in QUOTED)
ORACLES["match_substrings"] = f"""WITH q AS (SELECT query_id, query FROM (VALUES {QUOTED_SQL}) AS t(query_id, query)
    UNION ALL SELECT item_id + 1000, '"' || replace(substr(text, 4, 25), '"', ' ') || '"' FROM benchmark),
  parsed AS (SELECT query_id, {WORDS.format("regexp_replace(query, '\"[^\"]*\"', ' ', 'g')")} AS terms, regexp_extract_all(query, '"([^"]+)"', 1) AS phrases FROM q),
  docs AS (SELECT doc_id, lower(text) AS text, {WORDS.format("text")} AS tokens FROM documents)
  SELECT query_id, doc_id FROM parsed, docs WHERE list_has_all(tokens, terms) AND len(list_filter(phrases, lambda p: NOT contains(text, lower(p)))) = 0"""
