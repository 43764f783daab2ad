"""Sources and sinks as queries: tables written to files of a folder of the run's own, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..sources import readers as R
from ..sources import writers as W
from ..sources.storage import fresh
from .registry import query, read

_POST = "text string, label string, category string, source string"
_SH = "(SELECT DISTINCT * FROM self_harm_generated)"


def _posts(spark, d):
    return read(spark, d, "self_harm_generated", "record_id", "text", "label", "category", "source", "split").distinct()


@query(f"SELECT text, label, category, source FROM {_SH}")
def jsonl_scan(spark, d):
    path = fresh(spark, "jsonl")
    W.jsonl(_posts(spark, d).select("text", "label", "category", "source"), path)
    return R.jsonl(spark, path, _POST)


@query("SELECT json_extract_string(body, '$.text') AS text, json_extract_string(body, '$.label') AS label FROM (SELECT DISTINCT raw_id, body FROM raw_records) WHERE json_valid(body) AND NOT contains(body, chr(10))")
def jsonl_lines(spark, d):
    """Lines as they were delivered; cut-off ones are dropped by the reader. Bodies over several lines are no lines."""
    path = fresh(spark, "lines")
    rows = read(spark, d, "raw_records", "raw_id", "body").distinct().where(~F.contains("body", F.lit("\n")))
    rows.select("body").write.text(path)
    return R.jsonl(spark, path, _POST).select("text", "label")


@query(f"SELECT count(*) AS n FROM {_SH}")
def jsonl_optional_scan(spark, d):
    """One path that is there and one that is not."""
    path = fresh(spark, "jsonl")
    W.jsonl(_posts(spark, d).select("text", "label"), path)
    return R.jsonl_optional(spark, path, _POST).unionByName(R.jsonl_optional(spark, path + "-none", _POST)).agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(category, 'none') AS category, count(*) AS n, count(text) AS texts FROM {_SH} GROUP BY 1")
def folder_scan(spark, d):
    """One file per category, its name the category; the router file is left out."""
    path = fresh(spark, "folder")
    rows = _posts(spark, d).withColumn("category", F.coalesce("category", F.lit("none")))
    W.named_jsonl(rows.select("text", "label", "category"), path)
    W.named_jsonl(W.router(rows).withColumn("category", F.lit("router")), path)
    return R.jsonl_dir(spark, path, _POST).groupBy("category").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query(f"SELECT coalesce(category, 'none') AS category, count(*) AS n FROM {_SH} GROUP BY 1")
def category_sink(spark, d):
    path = fresh(spark, "categories")
    W.by_category(_posts(spark, d).select("text", F.coalesce("category", F.lit("none")).alias("category")), path)
    return spark.read.schema("text string, category string").json(path).groupBy("category").agg(F.count("*").alias("n"))


@query(f"SELECT text, category AS label FROM {_SH}")
def router_sink(spark, d):
    path = fresh(spark, "router")
    W.jsonl(W.router(_posts(spark, d)), path)
    return spark.read.schema("text string, label string").json(path)


@query(f"SELECT coalesce(lower(trim(split)), 'none') AS part, count(*) AS n FROM {_SH} GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM {_SH}")
def split_sink(spark, d):
    """A folder per split, and one of all rows."""
    path = fresh(spark, "splits")
    W.by_split(_posts(spark, d).withColumn("split", F.coalesce(F.lower(F.trim("split")), F.lit("none"))), path)
    parts = spark.read.schema("record_id string, split string").json(path + "/splits").select(F.col("split").alias("part"))
    return parts.unionByName(spark.read.schema("record_id string").json(path + "/all").select(F.lit("all").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT text FROM {_SH} WHERE text IS NOT NULL")
def append_without_repeats(spark, d):
    """Appended twice, and part of it before."""
    path, rows = fresh(spark, "append"), _posts(spark, d).where("text is not null").select("text", "category")
    for part in (rows.where("category is not null"), rows, rows):
        W.append_new(part, path)
    return spark.read.schema("text string").json(path).select("text")


@query("SELECT 'learned' AS kind, CAST(count(*) AS INT) AS total_patterns, count(*) AS patterns, '2025-01-01' AS last_updated FROM nation")
def json_document_sink(spark, d):
    """One document over several lines, its counts refreshed as it is written."""
    path = fresh(spark, "document")
    rules = read(spark, d, "nation", F.col("n_name").alias("pattern"), F.lower("n_name").alias("name"), F.lit("x").alias("category"))
    W.json_document(rules, path, "2025-01-01")
    doc = R.json_document(spark, path)
    return doc.select(F.lit("learned").alias("kind"), "metadata.total_patterns", F.size("patterns").cast("long").alias("patterns"), "metadata.last_updated")


@query("SELECT row_id, text, task1 FROM (SELECT DISTINCT row_id, text, task1 FROM hasoc_hindi_raw) WHERE text IS NOT NULL")
def tsv_scan(spark, d):
    """Tab-separated with a header; texts may hold tabs, quotes and line breaks."""
    path = fresh(spark, "tsv")
    rows = read(spark, d, "hasoc_hindi_raw", "row_id", "text", "task1").distinct().where("text is not null")
    rows.write.option("sep", "\t").option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.delimited(spark, path).select("row_id", "text", "task1")


@query("SELECT text, label FROM (SELECT text, task1 AS label FROM (SELECT DISTINCT row_id, text, task1 FROM hasoc_hindi_raw) WHERE text IS NOT NULL UNION ALL SELECT text, label FROM (SELECT DISTINCT record_id, text, label FROM self_harm_generated) WHERE text IS NOT NULL)")
def csv_headers(spark, d):
    """Files of other headers brought to one."""
    a, b = fresh(spark, "csv"), fresh(spark, "csv")
    put = lambda df, path: df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    put(read(spark, d, "hasoc_hindi_raw", "row_id", F.col("text").alias("Tweet"), F.col("task1").alias("class")).distinct().where("Tweet is not null").drop("row_id"), a)
    put(read(spark, d, "self_harm_generated", "record_id", "text", "label").distinct().where("text is not null").drop("record_id"), b)
    return R.heterogeneous(spark, [a, b])


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def slice_scan(spark, d):
    """The first rows of a data set (the slice is the feature)."""
    return read(spark, d, "documents", "doc_id").orderBy("doc_id").limit(100)


@query("""WITH h AS (SELECT DISTINCT row_id, text, task1, task2 FROM hasoc_hindi_raw WHERE text IS NOT NULL)
SELECT row_id AS post_id, annotator, label FROM (SELECT row_id, 0 AS annotator, task1 AS label FROM h UNION ALL SELECT row_id, 1, task2 FROM h)""")
def annotator_scan(spark, d):
    """A JSON map of posts with the labels of two annotators each."""
    h = read(spark, d, "hasoc_hindi_raw", "row_id", "text", "task1", "task2").distinct().where("text is not null")
    one = lambda c: F.struct(F.col(c).alias("label"), F.array(F.lit("x")).alias("target"))
    body = F.to_json(F.create_map("row_id", F.struct(F.split("text", " ").alias("post_tokens"), F.array(one("task1"), one("task2")).alias("annotators"))))
    return R.annotations(h.select(body.alias("body"))).select("post_id", "annotator", "label")


@query("""WITH v AS (SELECT post_id, label, count(*) AS c, min(annotator) AS f FROM (SELECT row_id AS post_id, 0 AS annotator, lower(task1) AS label FROM h UNION ALL SELECT row_id, 1, lower(task2) FROM h UNION ALL SELECT row_id, 2, lower(task1) FROM h) WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT post_id, label, c / votes AS agreement FROM (SELECT *, sum(c) OVER (PARTITION BY post_id) AS votes, row_number() OVER (PARTITION BY post_id ORDER BY c DESC, f, label) AS rn FROM v) WHERE rn = 1 AND c = votes""".replace("WITH v", "WITH h AS (SELECT DISTINCT row_id, text, task1, task2 FROM hasoc_hindi_raw WHERE text IS NOT NULL), v"))
def annotator_majority(spark, d):
    """Majority of three annotators, where all agree."""
    h = read(spark, d, "hasoc_hindi_raw", "row_id", "text", "task1", "task2").distinct().where("text is not null")
    one = lambda c: F.struct(F.lower(c).alias("label"), F.array(F.lit("x")).alias("target"))
    body = F.to_json(F.create_map("row_id", F.struct(F.split("text", " ").alias("post_tokens"), F.array(one("task1"), one("task2"), one("task1")).alias("annotators"))))
    m = C.majority(R.annotations(h.select(body.alias("body"))), "post_id", "label", "annotator")
    return m.where("agreement = 1").select("post_id", F.col("winner").alias("label"), "agreement")


@query("SELECT doc_id, left(text, 1000) AS text FROM documents WHERE text NOT IN ('[deleted]', '[removed]') AND length(text) > 20")
def comment_scan(spark, d):
    return R.comments(read(spark, d, "documents", "doc_id", "text"))


@query("SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier")
def reply_tree(spark, d):
    """Regions, nations and suppliers as a tree of replies; customers would be the third level and are left out."""
    tree = read(spark, d, "region", F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(read(spark, d, "nation", F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    tree = tree.unionByName(read(spark, d, "supplier", F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent")))
    tree = tree.unionByName(read(spark, d, "supplier", F.concat(F.lit("c"), "s_suppkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("parent")))
    return R.replies(spark, tree).select("id", "depth")


@query("SELECT r_name AS query, n_name AS video, s_name AS text FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def search_scan(spark, d):
    """Queries with their videos and comments, nested in one JSON document per query."""
    s = read(spark, d, "supplier", "s_nationkey", "s_name").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("text"))).alias("comments"))
    n = read(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("title"), "comments")).alias("videos"))
    body = read(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.to_json(F.struct(F.col("r_name").alias("query"), "videos")).alias("body"))
    return R.searches(body)


@query("SELECT p_name AS key, round(p_size / 1048576, 6) AS mb FROM part")
def catalogue_listing(spark, d):
    """Files of a catalogue record and their size in megabytes."""
    rec = read(spark, d, "part", "p_partkey", "p_name", "p_size").select(F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("key"), F.col("p_size").alias("size"))).alias("files"))).alias("body"))
    return R.catalogue(rec).select("key", F.round("mb", 6).alias("mb"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE starts_with(CAST(CAST(ts AS DATE) AS VARCHAR), '2024-01-1') GROUP BY 1")
def prefix_scan(spark, d):
    """Keys of one prefix: only the folders of the matching days are read."""
    path = fresh(spark, "days")
    read(spark, d, "events", F.to_date("ts").cast("string").alias("day"), "event_id").write.partitionBy("day").parquet(path)
    return R.prefix(spark.read.schema("event_id long, day string").parquet(path), "day", "2024-01-1").groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT k, max(v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) GROUP BY 1")
def upsert_rows(spark, d):
    """Nations by key, replaced by suppliers of the same key where those are newer."""
    a = read(spark, d, "nation", F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).withColumn("t", F.lit(1))
    b = read(spark, d, "supplier", F.col("s_suppkey").alias("k")).withColumn("v", F.lit("supplier")).withColumn("t", F.lit(2))
    return W.upsert(a, b, "k", "t").select("k", "v")


@query("SELECT DISTINCT request_id FROM api_request WHERE floor(epoch(TIMESTAMP '2025-03-01 00:00:00')) - floor(epoch(event_ts)) <= 2592000")
def live_rows(spark, d):
    """What is not older than thirty days on a given day."""
    r = read(spark, d, "api_request", "request_id", "event_ts")
    at = F.to_timestamp(F.lit("2025-03-01 00:00:00"))
    return W.live(r.withColumn("event_ts", F.col("event_ts").cast("timestamp")), "event_ts", at, 2_592_000).select("request_id").distinct()


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT * FROM api_request) GROUP BY 1")
def audit_sink(spark, d):
    path = fresh(spark, "audit")
    W.audit(read(spark, d, "api_request").distinct(), path)
    return spark.read.schema("request_id string, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT 'requests_total' AS metric, tenant_id AS tenant, action, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT ON (request_id) request_id, tenant_id, lower(action) AS action FROM api_request ORDER BY request_id) WHERE tenant_id IS NOT NULL AND action IS NOT NULL GROUP BY 2, 3")
def exposition_scrape(spark, d):
    """Metrics text through a file, with comment lines and lines that are none."""
    path = fresh(spark, "metrics")
    r = read(spark, d, "api_request", "request_id", "tenant_id", "action").withColumn("action", F.lower("action")).dropDuplicates(["request_id"]).where("tenant_id is not null and action is not null")
    lines = W.exposition(r.groupBy("tenant_id", "action").agg(F.count("*").alias("n")).withColumnRenamed("tenant_id", "tenant"), "requests_total", "n", "tenant", "action")
    other = spark.createDataFrame([("# HELP requests_total Requests.",), ("# TYPE requests_total counter",), ("not a metric",), ("",)], "line string")
    lines.unionByName(other).write.text(path)
    got = R.metrics_text(spark.read.text(path)).where("value is not null")
    return got.select("metric", F.col("labels")["tenant"].alias("tenant"), F.col("labels")["action"].alias("action"), "value")

