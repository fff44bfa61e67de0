"""Session helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch between the JVM and Python. Texts are long, so Spark's defaults would hold tens of MB at both ends.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: The keys that most rows have are heavy: at most so many, of more rows than these.
HEAVY, MANY = 256, 1000
#: Links under which no hub needs a way of its own: any task can take all of them.
SMALL = 200_000


def bounded(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches; a size that its user set stays."""
    given = spark.conf.getAll
    for name, value in BATCH.items():
        if name not in given:
            spark.conf.set(name, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine (tests) may lack it; it gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sievebook-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder: lineage ends here, and a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """After a step that shuffled whole texts: a collection on the driver, in Python (which may hold the JVM's plans) and in the JVM, after which Spark's cleaner drops the files of finished shuffles."""
    gc.collect()
    spark._jvm.System.gc()


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined with a table of unique keys, whose column ``weight`` says how many rows have each key.

    The HEAVY keys that most rows have are broadcast, so that no task gets all
    rows of one of them; any other key has less than one in HEAVY of the rows.
    They meet by a shuffle. Rows whose key is null are for the caller to keep
    apart. ``table`` is read several times: cut it first.
    """
    hot = table.where(F.col(weight) > MANY).orderBy(F.desc(weight)).limit(HEAVY).collect()
    table = table.drop(weight)
    if not hot:
        return rows.join(table, keys, how)
    top = F.broadcast(rows.sparkSession.createDataFrame([tuple(r[c] for c in table.columns) for r in hot], table.schema))
    cold = rows.join(top.select(*keys), keys, "left_anti").join(table, keys, how)
    return rows.join(top, keys).unionByName(cold)


def heavy_keys(counts: DataFrame, key: str, weight: str) -> list:
    """The HEAVY values of ``key`` with the greatest weights above MANY; a value has one row."""
    return [r[key] for r in counts.where(F.col(weight) > MANY).orderBy(F.desc(weight)).limit(HEAVY).collect()]


#: Tasks over which the rows of a heavy key are dealt.
SPLIT = 32


def salted(key: Column, by: Column, heavy: list) -> Column:
    """The share of its key's rows that a row goes to; 0 where the key is not heavy."""
    return F.when(key.isin(heavy), F.pmod(F.xxhash64(by), F.lit(SPLIT))).otherwise(0).cast("int") if heavy else F.lit(0)


def all_salts(key: Column, heavy: list) -> Column:
    """Every share of a key: to be exploded on the side that has few rows of it."""
    return F.when(key.isin(heavy), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))


#: Rows of a slim table for each task.
ROWS = 50_000


#: A row that carries a text or a set counts like so many slim ones.
WIDE = 100


def few(df: DataFrame, n: int) -> DataFrame:
    """df, derived from a slim table of n rows, in no more tasks than these need: many shuffles of small tables follow each other."""
    return df.coalesce(max(1, -(-n // ROWS)))


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """Connected components of (a, b) links, at most ``most`` of them: (node, component), component being the smallest node reached.

    Every node hangs on its smallest smaller neighbour. Those that are no
    node's smaller neighbour are leaves and are set aside, so that the members
    of a star never meet at its hub; what is left, a graph of the other nodes,
    is solved by ``_spanned``.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges if most is None else few(edges, most))
    n = edges.count()
    edges = few(edges, n)
    parents = cut(few(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), n))
    inner = cut(few(edges.select("v").distinct(), n))
    tree = few(parents.join(inner, F.col("u") == F.col("v"), "left_semi").select("u", F.col("m").alias("v")), n)
    cross = few(edges.join(parents.where("m <> most"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
    solved = _spanned(tree.unionByName(cross).distinct(), n)
    hung = cut(few(inner.join(solved, F.col("v") == F.col("node"), "left").select(F.col("v").alias("node"), F.coalesce("component", "v").alias("component")), n))
    leaves = few(parents.join(inner, F.col("u") == F.col("v"), "left_anti").select("u", F.col("m").alias("node")), n)
    if n > SMALL:
        met = lookup(leaves, cut(leaves.groupBy("node").agg(F.count("*").alias("n")).join(hung, "node")), ["node"], "n", how="inner")
    else:
        met = few(leaves.join(hung, "node"), n)
    return hung.unionByName(met.select(F.col("u").alias("node"), "component"))


def _spanned(edges: DataFrame, n: int) -> DataFrame:
    """(node, component) of the nodes of at most n (u, v) edges, u above v: large-star and small-star steps by turns, whose number grows with the logarithm of the component size."""
    edges = cut(few(edges, n))
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), n)
        met = lookup(both, cut(low), ["u"], "n", how="inner") if state[0] > SMALL else both.join(low, "u")
        large = few(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), 2 * n)
        large = few(large.distinct(), n)
        low = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = few(large.join(low, "u"), n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(few(small.where("u <> v").distinct(), n))
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return few(nodes, n).unionByName(few(edges.select(F.col("v").alias("node")).distinct(), n).select("node", F.col("node").alias("component")))
