"""What the training-data operators share: durable intermediate tables, word
caches for tokenizers and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the one named in ``spark.checkpoint.dir``. Where that is unset, one machine
    that runs everything (a ``local`` master, as in tests) takes a temporary folder; a
    cluster is an error, since its machines don't share theirs.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if path is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="logdistill-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: it is computed once, its lineage
    ends there, and losing an executor doesn't lose it.

    Spark removes shuffle files when the driver's collector finds that nothing refers
    to them, which may be never in a driver with little garbage; so it is asked to look.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as an object of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for a table of this run; it is removed when the driver ends, or by ``remove``."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    fs, at = filesystem(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def unused(taken: list[str], name: str) -> str:
    """A column name made from ``name`` that isn't in ``taken``, whatever its case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). Every
    step is a minimum per node (combined before the shuffle) joined back to the
    edges, so a node with very many edges is split by adaptive skew joins. Each
    round is checkpointed. Nothing but two checksums reaches the driver.

    Returns ``(id, component)``, component being the smallest id reachable; ids
    without an edge to another id aren't listed. Null ends are ignored.
    """
    current = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = cut(small)
        now = current.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components didn't settle")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def slices(batches, rows: int = 512):
    """The same rows in Arrow batches of at most ``rows``, so that what a batch unfolds to stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class PieceCache:
    """Encodes pieces of text once and joins the bytes of their token ids.

    ``encode_many`` gives the bytes of each of a list of distinct pieces. When
    ``limit`` pieces are known the cache starts afresh, so memory is bounded
    whatever the vocabulary of the corpus is; results don't depend on it.
    """

    def __init__(self, encode_many, limit: int = 600_000, longest: int = 48):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.known: dict[str, bytes] = {}

    def join_all(self, texts: list[list[str]]) -> list[bytes]:
        """The joined bytes of each list of pieces; pieces that aren't known are encoded together."""
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = {p for t in texts for p in t if p not in known}
        once = {}
        if new:
            order = list(new)
            for p, x in zip(order, self.encode_many(order)):
                (known if len(p) <= self.longest else once)[p] = x
        if once:
            return [b"".join([known[p] if p in known else once[p] for p in t]) for t in texts]
        get = known.__getitem__
        return [b"".join(map(get, t)) for t in texts]
