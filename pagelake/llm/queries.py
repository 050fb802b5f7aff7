"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.llm import alignment, decontaminate, exact_dedup, html_text, jaccard_join, licenses, near_dedup, packing, pii, sharding, spelling, toxicity, url_filter
from pagelake.llm.shared import LOWER, UPPER, table

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# Parts of host names whose pages make up the list in op5; a real list is a table of its own.
LISTED_PARTS = r"(^|[.-])(adult|bets|casino|pills|poker|porn|xxx)([.-]|$)"


def document_path(doc_id="doc_id") -> Column:
    """A place in a tree for each document, since the table has none: source, language, thousand, hundred;
    files lie at all four depths."""
    block = lambda n: F.coalesce(F.floor(F.col(doc_id) / n).cast("string"), F.lit("none"))
    parts = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), block(1000), block(100))
    depth = (F.pmod(F.xxhash64(doc_id), F.lit(4)) + 1).cast("int")
    return F.concat_ws("/", F.slice(parts, 1, depth), F.col(doc_id).cast("string"))


def op2_licenses(spark, sf_dir):
    """A directory's first document with a notice stands for its licence file."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), document_path())
    place = licenses.directory(F.col("path"))
    first = found.where("license IS NOT NULL").groupBy(place.alias("folder")).agg(F.min("doc_id").alias("first"))
    marked = found.withColumn("folder", place).join(first, "folder", "left")
    return licenses.inherited(marked, F.col("doc_id") == F.col("first")).drop("folder", "first")


def vocabulary() -> dict:
    """Where the installed byte-level vocabulary lies: as tokenizer file and as byte ranks."""
    import public_tokenizers

    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": ranks}


def op1_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2, **vocabulary())


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host, _ = url_filter.url_host_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_PARTS)).select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    return url_filter.judge_urls(pages, listed, RULES)


def op6_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        "doc_id", *[number(kind) for kind in pii.BASE_KINDS], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans")
    )


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op8_sharding(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    import public_tokenizers

    known = vocabulary()
    second = public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents"), known["tokenizer_path"], second, ranks=known["ranks"])


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_alignment": op13_alignment,
}

def rules_sql(says: bool) -> str:
    """The longest fitting rule, or its verdict, as SQL over host and path."""
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{verdict if says else rule}'")
    return "CASE " + " ".join(cases) + " END"


ORACLES = {
    "op5_url_filter": f"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(split_part(url, '#', 1), '\\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}'))) AS params
  FROM p
), c AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM h
), l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_PARTS}'))
SELECT page_id, host, path, {rules_sql(False)} AS rule, l.canonical IS NOT NULL AS listed,
  coalesce({rules_sql(True)}, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN l ON c.canonical = l.canonical""",
    "op12_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n)
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reached WHERE a = doc_id), doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id)""",
    "op7_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
