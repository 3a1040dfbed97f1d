"""What the operators of this folder share: reading tables, cutting lineage, connected classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside keys, where a null would not join.
NULL_ID = -(2**63)


#: Letters of scripts written without spaces: Thai to Burmese, Khmer, kana, Chinese characters.
UNSPACED = "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])"
#: Their marks.
WIDE = "[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]"


def spaced(text: Column) -> Column:
    """text with each letter of an unspaced script as a word; text must be cheap, as it is read several times."""
    some = (F.octet_length(text) > F.char_length(text)) & text.rlike(UNSPACED)
    return F.when(some, F.regexp_replace(F.regexp_replace(text, WIDE, " "), UNSPACED, " $1 ")).otherwise(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names in spark.checkpoint.dir; set one only where there is none."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tagmill-checkpoint-"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: what it wrote is read from then on, never they."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made inside, for a plan keeps the setting it was made under


def others(docs: DataFrame, *taken: str) -> list[str]:
    """The columns of docs but those named like one of `taken`: an operator's output replaces a column of its name."""
    low = {o.lower() for o in taken}
    return [c for c in docs.columns if c.lower() not in low]


def boxed(docs: DataFrame, *apart: str) -> Column:
    """All columns of docs but `apart` as one, _row, so that no name of theirs meets a name used inside an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in others(docs, *apart)]).alias("_row")


def unboxed(docs: DataFrame, *taken: str, **own: Column) -> list[Column]:
    """The columns of docs out of _row again, in their order; `own` says what stands for those kept apart."""
    return [own.get(c.lower(), F.col("_row").getField(c)).alias(c) for c in others(docs, *taken)]


def row_key(doc_id: str | Column, text: str | Column) -> list[Column]:
    """Identity of a row where doc_id may be null or repeated: the id and a hash of the text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(text) if isinstance(text, str) else text
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_th")]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected classes of an edge list (a, b longs): rows (node, root), root the smallest node of the class.

    Each round moves every node to the smallest root among its neighbours' and then jumps pointers, so that chains
    shrink geometrically and stars end in two rounds. All steps are aggregations with partial sums and joins on
    plain keys; a hub with any number of edges is pre-aggregated before the shuffle. Nothing is collected but one
    count a round. Raises if max_rounds don't suffice, rather than return split classes.
    """
    edges = edges.where("a <> b")
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # the first hop needs no join: each node takes its smallest neighbour
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(max_rounds):
        offers = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        moved = roots.join(offers, "node").select("node", "root", F.least("root", "offer").alias("low"))
        # the old root also learns of the lower one
        told = moved.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        step = moved.join(told, "node", "left").select("node", "root", F.least("low", "told").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = cut(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("next"), (F.least("next", "far") < F.col("root")).alias("changed")))
        roots = new.select("node", F.col("next").alias("root"))
        if not new.where("changed").limit(1).count():
            return roots
    raise RuntimeError(f"classes did not settle in {max_rounds} rounds")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again; for rows too wide for cut(). discard() removes it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder}/tagmill-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what stored() wrote; nothing that is still to be computed may read it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(conf).delete(path, True)
