"""Token counts as delta-maintained rollups.

A store holds totals by source, language and tokenizer version, and a ledger of
what is counted for each (doc_id, tokenizer_version). A batch of changes inserts,
revises or deletes counts. Committing looks up what is counted now, so each change
becomes a signed delta; the deltas are added to the totals of the version before,
which gives the totals of the new version. Reading totals reads that small table
alone, and never the documents or the history.

The ledger of a version is a compacted base and the deltas of at most
``COMPACT_AFTER`` batches since; then a new base is written.

A version is one small file, written under another name first and then put in its
place in one step that fails if the place is taken. So a stop at any time leaves
the version before, a half-written file is never read, and of two writers that
saw the same version one is refused and works out its deltas again. A batch has a
marker once it is committed, and counts once however often it is sent.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logdistill.llm.bpe import TOKENIZER_DIR, bpe
from logdistill.llm.common import cut, filesystem, fresh_path, slices

CHANGES = "doc_id long, tokenizer_version string, op string, source string, lang string, n_tokens long"
ENTRIES = f"{CHANGES}, old_source string, old_lang string, old_tokens long, seq long"
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
OPS = ("insert", "revise", "delete")
FIRST_VERSION, LATER_VERSION = "byte_bpe_50k", "byte_bpe_multi_50k"
COMPACT_AFTER = 8
#: How often a writer that was refused works out its batch again.
TRIES = 10


def count_tokens(docs: DataFrame, version: str, directory: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of each row; whole texts, null has none. Null and repeated ids come back as they are; an empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_tokens", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe(version, directory).ids
        for b in slices(it):
            n = [len(ids(x)) // 4 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source").cast(pa.string()), b.column("lang").cast(pa.string()), pa.array(n, pa.int64())], schema=schema
            )

    picked = docs.select(F.col("doc_id").cast("long"), "source", "lang", "text")
    counted = picked.mapInArrow(batches, "doc_id long, source string, lang string, n_tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens")


class StaleWriter(RuntimeError):
    """Others committed again and again while a batch was worked out."""


@dataclass(frozen=True)
class Prepared:
    """A batch worked out against one version, not committed yet."""

    seq: int
    batch_id: str
    content: dict


class CountStore:
    """Rollups in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._fs, at = filesystem(spark, path.rstrip("/"))
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        qualified = self._fs.makeQualified(at)
        self.path = qualified.toString()
        self._local = qualified.toUri().getPath() if qualified.toUri().getScheme() == "file" else None

    # Small files

    def _at(self, name: str):
        return self._Path(f"{self.path}/{name}")

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_once(self, name: str, content: dict) -> bool:
        """Puts a whole file in its place; False if the place is taken."""
        part = f"parts/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(part), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self._local is not None:
                # Renaming takes an occupied place on a local disk; a link doesn't.
                os.makedirs(os.path.dirname(f"{self._local}/{name}"), exist_ok=True)
                try:
                    os.link(f"{self._local}/{part}", f"{self._local}/{name}")
                except FileExistsError:
                    return False
                return True
            self._fs.mkdirs(self._at(name).getParent())
            return bool(self._fs.rename(self._at(part), self._at(name)))
        finally:
            self._fs.delete(self._at(part), False)

    # Versions

    def head(self) -> tuple[int, dict]:
        """Number and content of the newest version; 0 for an empty store. Names are listed, one file is read."""
        folder = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((n for n in names if n.isdigit()), default=None)
        if last is None:
            return 0, {"base": None, "deltas": [], "totals": None}
        return int(last), self._read(f"versions/{last}")

    @staticmethod
    def _marker(batch_id: str) -> str:
        return f"batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _is_done(self, batch_id: str, seq: int, content: dict) -> bool:
        """Before another version is begun the newest one's marker is set, so markers are never more than one behind."""
        if seq:
            self._write_once(self._marker(content["batch"]), {"seq": seq, "batch": content["batch"]})
        return bool(self._fs.exists(self._at(self._marker(batch_id))))

    def _ledger(self, content: dict) -> DataFrame:
        read = lambda names: self.spark.read.schema(ENTRIES).parquet(*(f"{self.path}/data/{d}" for d in names))
        names = ([content["base"]] if content["base"] else []) + content["deltas"]
        columns = ("op", "source", "lang", "n_tokens")
        if not names:
            last = self.spark.createDataFrame([], ENTRIES)
        elif len(names) == 1:  # a batch has a key once
            last = read(names)
        else:
            newest = read(names).groupBy("doc_id", "tokenizer_version").agg(F.max_by(F.struct(*columns), "seq").alias("x"))
            last = newest.select("doc_id", "tokenizer_version", "x.*")
        return last.where("op <> 'delete'").select("doc_id", "tokenizer_version", *columns[1:])

    def ledger(self) -> DataFrame:
        """doc_id, tokenizer_version, source, lang, n_tokens of what is counted now."""
        return self._ledger(self.head()[1])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of the newest version; groups that count no document any more are left out."""
        return self._totals(self.head()[1])

    def _totals(self, content: dict) -> DataFrame:
        if content["totals"] is None:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/data/{content['totals']}")

    def _checked(self, changes: DataFrame) -> DataFrame:
        rank = F.array_position(F.array(*(F.lit(o) for o in OPS)), F.col("op"))
        known = (rank > 0) & F.col("doc_id").isNotNull() & F.col("tokenizer_version").isNotNull()
        wrong = F.raise_error(F.lit("a change needs doc_id, tokenizer_version and an op of " + ", ".join(OPS)))
        checked = changes.select(
            F.col("doc_id").cast("long"), "tokenizer_version", F.when(known, F.col("op")).otherwise(wrong).alias("op"), "source", "lang",
            F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"),
        )
        one = checked.groupBy("doc_id", "tokenizer_version").agg(F.max(F.struct(rank.alias("rank"), "n_tokens", "source", "lang", "op")).alias("x"))
        return one.select("doc_id", "tokenizer_version", "x.op", "x.source", "x.lang", "x.n_tokens")

    def prepare(self, batch_id: str, changes: DataFrame) -> Prepared | None:
        """Works out a batch's deltas and the totals after it; None if the batch was committed before."""
        if not batch_id:
            raise ValueError("a batch id is a non-empty string")
        seq, before = self.head()
        if self._is_done(batch_id, seq, before):
            return None
        name = uuid.uuid4().hex
        base, deltas = before["base"], before["deltas"]
        if len(deltas) >= COMPACT_AFTER:
            base, deltas = f"{name}-base", []
            none = {c: F.lit(None).cast(k) for c, k in (("old_source", "string"), ("old_lang", "string"), ("old_tokens", "long"))}
            self._ledger(before).withColumns(none | {"op": F.lit("insert"), "seq": F.lit(seq).cast("long")}).write.parquet(f"{self.path}/data/{base}")
        one = self._checked(changes)
        if base or deltas:
            now = self._ledger({"base": base, "deltas": deltas}).select(
                F.col("doc_id").alias("o_id"), F.col("tokenizer_version").alias("o_version"),
                F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("n_tokens").alias("old_tokens"),
            )
            met = one.join(now, (F.col("doc_id") == F.col("o_id")) & (F.col("tokenizer_version") == F.col("o_version")), "left").drop("o_id", "o_version")
        else:
            met = one.withColumns({"old_source": F.lit(None).cast("string"), "old_lang": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")})
        met.withColumn("seq", F.lit(seq + 1).cast("long")).write.parquet(f"{self.path}/data/{name}-delta")
        entries = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/data/{name}-delta")
        signed = entries.select(F.inline(F.array(
            F.struct("source", "lang", "tokenizer_version", F.when(F.col("op") == "delete", 0).otherwise(1).cast("long").alias("n_docs"),
                     F.when(F.col("op") == "delete", 0).otherwise(F.col("n_tokens")).cast("long").alias("n_tokens")),
            F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer_version",
                     F.when(F.col("old_tokens").isNull(), 0).otherwise(-1).cast("long").alias("n_docs"), (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens")),
        )))
        both = self._totals(before).unionByName(signed).groupBy("source", "lang", "tokenizer_version")
        after = both.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")
        after.write.parquet(f"{self.path}/data/{name}-totals")
        return Prepared(seq + 1, batch_id, {"batch": batch_id, "base": base, "deltas": [*deltas, f"{name}-delta"], "totals": f"{name}-totals"})

    def publish(self, prepared: Prepared) -> bool:
        """Makes a prepared batch the next version; False if there is another one by now, and nothing is changed."""
        if not self._write_once(f"versions/{prepared.seq:020d}", prepared.content):
            return False
        self._write_once(self._marker(prepared.batch_id), {"seq": prepared.seq, "batch": prepared.batch_id})
        return True

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (columns of CHANGES; more are ignored) once; False if the batch was committed before.

        Defined results: several changes of one key in a batch: the one with the
        greatest (op in the order of OPS, n_tokens, source, lang) holds; rows with
        a null key or an op not in OPS are errors; an insert or a revision sets the
        count, whatever was counted; a delete of what isn't counted is a zero delta;
        null counts are zero; null sources and languages are groups of their own; an
        empty batch is a version with the same totals.
        """
        for _ in range(TRIES):
            prepared = self.prepare(batch_id, changes)
            if prepared is None:
                return False
            if self.publish(prepared):
                return True
        raise StaleWriter(f"batch {batch_id!r} was refused {TRIES} times")

    def vacuum(self, keep: int = 10) -> None:
        """Removes versions before the newest ``keep`` and the data that no other names. Not beside a writer: what it has prepared would go too."""
        seq, _ = self.head()
        folder = self._at("versions")
        if not seq:
            return
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder))
        contents = [self._read(f"versions/{n}") for n in names[-keep:]]
        used = {d for c in contents for d in (c["base"], *c["deltas"], c["totals"])}
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
        for n in names[:-keep]:
            self._fs.delete(self._at(f"versions/{n}"), False)


def rollup(docs: DataFrame, path: str | None = None, directory: str = TOKENIZER_DIR) -> DataFrame:
    """Three batches over ``docs``: all inserted under the first tokenizer; exact
    copies (all but the smallest doc_id of a text) deleted; what isn't English
    moved to the multilingual tokenizer. The second batch is sent twice.

    Rows with a null id aren't counted; of rows with the same id the last rule of
    ``CountStore.commit`` holds, and such an id is a copy if any of its rows is. An
    empty table gives no totals. The default store goes when the driver ends.
    """
    spark = docs.sparkSession
    store = CountStore(spark, path or fresh_path(spark, "token-counts"))
    docs = docs.where("doc_id is not null")
    store.commit("load", count_tokens(docs, FIRST_VERSION, directory).withColumn("op", F.lit("insert")))
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    copies = cut(texts.join(first, "digest").where("doc_id <> first_id").select("doc_id").distinct())
    none = F.lit(None).cast("string")
    gone = copies.select(
        "doc_id", F.lit(FIRST_VERSION).alias("tokenizer_version"), F.lit("delete").alias("op"),
        none.alias("source"), none.alias("lang"), F.lit(0).cast("long").alias("n_tokens"),
    )
    store.commit("takedown", gone)
    moved = count_tokens(docs.where("lang <> 'en'").join(copies, "doc_id", "left_anti"), LATER_VERSION, directory)
    store.commit("multilingual", cut(moved.withColumn("op", F.lit("insert"))).transform(
        lambda new: new.unionByName(new.withColumn("op", F.lit("delete")).withColumn("tokenizer_version", F.lit(FIRST_VERSION)))
    ))
    store.commit("takedown", gone)
    return store.totals()
