"""What the operators share: the shared work folder, row keys, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import session
from sluice.sources.session import new_path

#: White space of the word contract: a word is a longest run of other characters.
SPACES = " \t\n\x0b\f\r"
#: Stands for a null doc_id in row keys.
NO_ID = -(2**63)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors
    without computing it again.

    Nothing reads the shuffles behind a written table any more, but Spark deletes their files only once the driver
    collects garbage, which a driver with little to do does rarely. So that disks don't fill, it is asked to.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more: what came of them has been written too."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._sluice_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key (kid, kh) equal only for rows with the same doc_id and text.

    Null ids and repeated rows get keys as well, so joins on the key lose or multiply nothing
    as long as their other side is unique by key.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("kid"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("kh"),
    )


def packed(docs: DataFrame) -> F.Column:
    """All columns of docs as one struct, out of the way of an operator's own names, whatever theirs are."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def held_out(modulus: int, remainder: int) -> F.Column:
    """crc32 of doc_id as text leaves this remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def local_path(path: str) -> str | None:
    """The plain path of a file: URI, or None for other stores."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return "/" + path[len(prefix):].lstrip("/")
    return path if path.startswith("/") else None


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable, for every node of undirected ``edges`` (a, b: long).

    Large-star and small-star rounds (Kiveris et al. 2014): each links neighbours to the smallest
    one, until nothing changes; the number of edges never grows. Grouping is a minimum with map-side
    combine and the joins are plain equi-joins that adaptive execution can split, so a hub with a
    third of all nodes is no single task's work. Returns (node, root) for nodes of some edge.
    """
    spark = edges.sparkSession
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
            .where("a <> b").distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        last, now = now, cut(small, "edges")
        release(last)
        # A forest of stars no longer changes; counts and sums of it tell.
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b"), F.col("b")).distinct()
            )
        before = after


def ship(spark: SparkSession) -> None:
    """Prepare a session: executors can import this package, and Arrow batches of texts, which are long, have a quarter
    of the usual rows."""
    session.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
