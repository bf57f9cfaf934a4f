"""Plumbing that the operators of this subpackage share.

Intermediate results that several jobs read are written as Parquet under the shared
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a
re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: U+0020 and U+0009 to U+000D.  ``bytes.split()``
#: without arguments splits at exactly these.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Records in one Arrow batch; long texts make larger batches needlessly heavy.
ARROW_RECORDS = 1000
#: Bins that keys are counted in before hot ones are looked for, and tasks that a label's rows are dealt over.
BINS, SALTS = 1 << 16, 16
#: Bits of the map that says which rows a semi-join need not move; it is broadcast.
MARK_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; our own one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints/vellum"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here.

    The folder is not deleted, as the returned frame reads it lazily; give
    ``spark.checkpoint.dir`` a retention rule.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``staged`` frame that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished jobs now.

    Their owners are unreachable once a phase is staged, but the cleaner acts only when
    the driver collects garbage, which may be half an hour later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the records of an Arrow batch (a session setting) unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_RECORDS:
        spark.conf.set(key, str(ARROW_RECORDS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: str) -> str:
    """SQL for the array of words of a text column (null or blank: empty)."""
    trimmed = f"btrim(coalesce({text}, ''), ' \\t\\n\\u000B\\u000C\\r')"
    return f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\\\x20\\\\x09-\\\\x0D]+'))"


def hot_keys(rows: DataFrame, keys: list[str], limit: int, *more: Column) -> DataFrame:
    """The keys that over ``limit`` rows share, with their number ``n`` and the aggregates ``more``: a staged frame.

    Rows are first counted by a hash of the key into a fixed number of bins, which combines
    before the shuffle; keys are counted only in bins over the limit, as no other can hold a hot one.
    """
    bin_of = F.pmod(F.xxhash64(*keys), F.lit(BINS))
    full = rows.groupBy(bin_of.alias("_bin")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("_bin")
    some = rows.withColumn("_bin", bin_of).join(F.broadcast(full), "_bin", "left_semi").drop("_bin")
    return staged(some.groupBy(*keys).agg(F.count("*").alias("n"), *more).where(F.col("n") > limit), "hot-keys")


def marks(keys: DataFrame, column: str) -> DataFrame:
    """A map of ``MARK_BITS`` bits over a column of longs, as rows (_word, _bits): what has no bit is not among the keys."""
    bit = F.pmod(F.xxhash64(column), F.lit(MARK_BITS))
    bits = keys.select(F.shiftright(bit, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64L) as int))").alias("_bits"))
    return staged(bits.groupBy("_word").agg(F.bit_or("_bits").alias("_bits")), "marks")


def marked(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the bit of ``column`` is set in ``found``, a frame of ``marks``.  No row moves."""
    word = F.shiftright(F.pmod(F.xxhash64(column), F.lit(MARK_BITS)), 6)
    held = rows.withColumn("_word", word).join(F.broadcast(found), "_word", "left")
    return held.withColumn(name, F.expr(f"coalesce(getbit(_bits, cast(pmod(xxhash64({column}), 64L) as int)), 0) = 1")).drop("_word", "_bits")


def on_label(rows: DataFrame, found: DataFrame, label: str, spread: str) -> DataFrame:
    """``rows`` joined to ``found``, which has one row a label; a label's rows are dealt over ``SALTS`` tasks by the hash of ``spread``."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    every = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [label, "_salt"]).drop("_salt")


def pair_components(edges: DataFrame, tag: str, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: rows (node, label), label the least node.

    Alternates the large-star and small-star steps; each round is staged and the one before it
    discarded, nothing but two numbers a round reaches the driver.  The rounds grow with the logarithm of the diameter.
    Hubs are split by adaptive skew joins, and minima are combined before the shuffle.
    """
    spark = edges.sparkSession
    now = staged(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if (mark.n, mark.h) == seen or mark.n == 0:
            break
        seen = (mark.n, mark.h)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u")
        small = moved.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, staged(small, tag)
        discard(before)
        release(spark)
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    out = staged(stars.union(stars.select(F.col("label").alias("node"), "label").distinct()), tag)
    discard(now)
    return out
