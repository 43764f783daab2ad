"""Sources: JSON lines, JSON documents, delimited text, nested annotations, metrics text, key lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on whatever file system it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def jsonl(spark: SparkSession, path: str, schema: str = S.EXAMPLE) -> DataFrame:
    """One object per line; fields that a line lacks are null, broken and blank lines are dropped."""
    return _objects(spark.read.text(path), schema).select("j.*").drop("_broken")


def _objects(lines: DataFrame, schema: str, *more: Column) -> DataFrame:
    """j: the object of each line that holds one. Parsed as a column: a reader of JSON files cannot count what it drops once columns are pruned."""
    j = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return lines.where(F.trim("value") != "").select(j.alias("j"), *more).where("j is not null and j._broken is null")


def jsonl_optional(spark: SparkSession, path: str, schema: str = S.EXAMPLE) -> DataFrame:
    """As jsonl; a missing path is an empty table of the same schema."""
    return jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def jsonl_dir(spark: SparkSession, path: str, schema: str = S.EXAMPLE, exclude: Sequence[str] = ("router",)) -> DataFrame:
    """A folder of JSON lines, the file's name as category; files of the excluded names left out."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl?$", 1)
    df = _objects(spark.read.option("pathGlobFilter", "*.jsonl").text(path), schema, name.alias("_file")).where(~F.col("_file").isin(*exclude))
    return df.select("j.*", "_file").drop("_broken", "category").withColumnRenamed("_file", "category")


def json_document(spark: SparkSession, path: str, schema: str = S.LEARNED) -> DataFrame:
    """One JSON document over several lines; an empty table where it is missing."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_column(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several possible column names that is there and not null; all of them may be missing."""
    have = [F.col(f"`{c}`") for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def heterogeneous(spark: SparkSession, paths: Sequence[str], text: Sequence[str] = ("text", "Text", "tweet", "Tweet"), label: Sequence[str] = ("label", "Label", "class")) -> DataFrame:
    """CSV files whose headers differ, brought to (text, label)."""
    parts = [delimited(spark, p, ",") for p in paths]
    parts = [df.select(first_column(df, text).cast("string").alias("text"), first_column(df, label).cast("string").alias("label")) for df in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def annotations(df: DataFrame, body: str = "body") -> DataFrame:
    """post_id, text, annotator, label of a JSON map {post id: {post_tokens, annotators: [{label, target}]}}."""
    kind = "map<string,struct<post_tokens:array<string>,annotators:array<struct<label:string,target:array<string>>>>>"
    posts = df.select(F.explode(F.from_json(body, kind)).alias("post_id", "p"))
    return posts.select("post_id", F.array_join("p.post_tokens", " ").alias("text"), F.posexplode("p.annotators").alias("annotator", "a")).select("post_id", "text", "annotator", "a.label", "a.target")


def replies(spark: SparkSession, tree: DataFrame, id_: str = "id", parent: str = "parent", depth: int = 2) -> DataFrame:
    """Comments with their depth, from the top ones (null parent) down to ``depth`` levels of replies."""
    level = tree.where(F.col(parent).isNull()).withColumn("depth", F.lit(0))
    out = level
    for d in range(1, depth + 1):
        level = tree.join(level.select(F.col(id_).alias("_up")), tree[parent] == F.col("_up")).drop("_up").withColumn("depth", F.lit(d))
        out = out.unionByName(level)
    return out


def comments(df: DataFrame, text: str = "text", shortest: int = 20, most: int = 1000) -> DataFrame:
    """Without deleted, removed and short comments; the rest cut to ``most`` characters."""
    t = F.col(text)
    return df.where(t.isNotNull() & ~t.isin("[deleted]", "[removed]") & (F.length(t) > shortest)).withColumn(text, F.substring(t, 1, most))


def metrics_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """metric, labels (map), value of exposition text; comments and other lines are dropped."""
    line = F.col(value)
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)"
    labels = F.regexp_extract(line, pattern, 2)
    pairs = F.arrays_zip(F.regexp_extract_all(labels, F.lit(r'(\w+)="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(labels, F.lit(r'(\w+)="([^"]*)"'), F.lit(2)).alias("v"))
    return lines.where(line.rlike(pattern) & ~line.startswith("#")).select(F.regexp_extract(line, pattern, 1).alias("metric"), F.map_from_entries(pairs).alias("labels"), F.regexp_extract(line, pattern, 3).try_cast("double").alias("value"))


def api_keys(spec: Column) -> Column:
    """array<struct<key, tenant, tier>> of "key:tenant:tier,..."; keys shorter than 16 are left out, the tier is free by default."""
    parts = F.transform(F.split(spec, ","), lambda x: F.split(F.trim(x), ":"))
    rows = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.coalesce(F.get(p, F.lit(1)), F.lit("default")).alias("tenant"), F.coalesce(F.get(p, F.lit(2)), F.lit("free")).alias("tier")))
    return F.filter(rows, lambda r: F.length(r["key"]) >= 16)


def searches(df: DataFrame, body: str = "body") -> DataFrame:
    """query, video, text of JSON documents {query, videos: [{title, comments: [{text}]}]}."""
    kind = "query string, videos array<struct<title:string,comments:array<struct<text:string>>>>"
    x = df.select(F.from_json(body, kind).alias("x")).select("x.query", F.explode("x.videos").alias("v"))
    return x.select("query", F.col("v.title").alias("video"), F.explode("v.comments").alias("c")).select("query", "video", "c.text")


def catalogue(df: DataFrame, body: str = "body") -> DataFrame:
    """key and megabytes of the files of a catalogue record {files: [{key, size}]}."""
    x = df.select(F.explode(F.from_json(body, "files array<struct<key:string,size:long>>")["files"]).alias("f"))
    return x.select("f.key", (F.coalesce("f.size", F.lit(0)) / 1048576).alias("mb"))


def prefix(df: DataFrame, key: str, start: str) -> DataFrame:
    """Rows whose key begins so; on a partition column no other folder is read."""
    return df.where(F.col(key).startswith(start))
