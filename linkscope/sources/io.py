"""Readers and writers of node, edge, document and query tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.plans.iterate import shared_dir


@dataclass
class Graph:
    """Nodes first, so that isolates stay; by are key columns carried through all measures."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    by: list[str] = field(default_factory=list)


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, names: list[str], header: bool = False, quote: str | None = '"') -> DataFrame:
    """A TSV file of strings; lines that begin with # are comments, the header's too where
    it stands in one, so names are passed in. quote=None reads quotes as text."""
    r = spark.read.schema(strings(*names)).option("sep", "\t").option("comment", "#").option("header", header)
    return r.option("quote", quote or "").csv(path)


def load_graph(nodes: DataFrame, edges: DataFrame, key: str = "node_id") -> Graph:
    """Edges without self-loops and repeats, between known nodes; all nodes stay."""
    n = nodes.withColumnRenamed(key, "node")
    e = edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst")).filter("src <> dst").distinct()
    e = e.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return Graph(n, e)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document per text file, its id decoded from the file's name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.url_decode(name)).alias("doc_id"), F.col("value").alias("text"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, style, target, text): comments and blank rows dropped, fields trimmed, an empty target null."""
    q = read_tsv(spark, path, ["qid", "style", "target", "text"], quote=None)
    q = q.select(*[F.trim(c).alias(c) for c in q.columns]).filter("qid <> '' and text is not null and text <> ''")
    return q.withColumn("target", F.nullif("target", F.lit("")))


def load_labels(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A hand-labelled table; rows without a label in its last column are dropped."""
    return read_tsv(spark, path, names, quote=None).filter(F.trim(F.col(names[-1])) != "")


def write_result(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def write_table(df: DataFrame, path: str, key: str) -> None:
    """TSV with a header, sorted by key."""
    df.orderBy(key).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_postings(weights: DataFrame, kinds: DataFrame, path: str, least_df: int = 2) -> None:
    """(token, doc_id, w, df, kind) clustered by term, so that a query reads few row groups."""
    k = kinds.filter(F.col("df") >= least_df)
    weights.join(k, "token").repartitionByRange("token").sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(path)


def content_key(df: DataFrame, params: str = "") -> str:
    """A key of df's rows, whatever their order, and of parameters."""
    h = F.xxhash64(*df.columns)
    s = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)).alias("a"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("b")).first()
    import hashlib

    return hashlib.sha256(f"{s['n']}:{s['a']}:{s['b']}:{','.join(df.columns)}:{params}".encode()).hexdigest()[:32]


def cached_table(source: DataFrame, make, params: str = "") -> DataFrame:
    """make(source), stored under a key of source's content and params in the shared
    folder, and read from there if it has been made before."""
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/cached/{content_key(source, params)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
