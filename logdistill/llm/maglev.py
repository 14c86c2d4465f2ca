"""Sharding by a permutation-filled lookup table.

As in Maglev hashing (Eisenbud et al., 2016): each shard has its own permutation
of the slots of a table whose size is prime; shards take turns, each claiming
the next slot of its preference that is still free. A document's key hashes to a
slot. Adding or removing a shard moves few keys, and shards differ by at most one
slot. The table's size is a parameter, so it is always small enough to broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import unused

#: Prime; a row of the table is two integers, so the broadcast is about 1 MB whatever the corpus is.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 2_000_003
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _number(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard. Bounded driver work: about size * ln(size) steps."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if size > MAX_TABLE_SIZE or size < len(shards) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime from {len(shards)} to {MAX_TABLE_SIZE}")
    at = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % size
            table[slot], at[i] = i, (slot + skip[i]) % size
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5, modulo the size. A null key hashes as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, by one broadcast join: whole rows stay where they are, no shuffle, any skew.

    Equal keys go to the same shard; null keys all go to one; repeated rows come back
    as often; an empty table gives an empty result. Columns of ``df`` named slot or
    shard are replaced, even if one is the key.
    """
    rows = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))]
    at, place, name = (unused(df.columns, f"place_{x}") for x in ("at", "slot", "shard"))
    table = df.sparkSession.createDataFrame(rows, f"`{place}` int, `{name}` string")
    placed = df.withColumn(at, slot_of(F.col(key), size)).join(F.broadcast(table), F.col(at) == F.col(place))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return placed.select(*kept, F.col(at).alias("slot"), F.col(name).alias("shard"))


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE, parts: int = 4) -> None:
    """Writes a folder for each shard, of up to ``parts`` files.

    Rows are dealt by shard and by a number of their own, so a shard is ``parts`` tasks
    and not one, however many rows share its keys; a file holds one shard's rows.
    """
    placed = assign_shards(df, key, shards, size)
    part = unused(placed.columns, "part")
    # The row's number in its input split: the same when a lost task is run again.
    numbered = placed.withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    numbered.repartition(len(shards) * parts, "shard", part).drop(part).write.partitionBy("shard").mode("overwrite").parquet(path)


def oracle() -> str:
    """DuckDB SQL for placement with the filled table written out; how the table is filled is tested on its own."""
    table = "".join(f"{s:02x}" for s in lookup_table(SHARDS))
    return f"""
    with d as (select *, (('0x' || md5(coalesce(doc_id::varchar, ''))[1:15])::bigint % {TABLE_SIZE})::int as slot from documents)
    select d.*, 'shard-' || lpad(('0x' || substr('{table}', slot * 2 + 1, 2))::int::varchar, 3, '0') as shard from d"""
