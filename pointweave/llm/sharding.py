"""Sharding by a permutation-filled lookup table: constant-time, even placement that moves few rows when shards change."""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.shared import stable_hash

#: Slots of the table: a prime, well over 100 times the number of shards. It is also the size bound of the broadcast.
TABLE_SIZE = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``shards``) of every slot.

    Each shard prefers the slots in the order offset, offset + skip, offset + 2 * skip, ... modulo the prime size,
    which visits every slot once. The shards take turns, in order of name so that the list's order is of no matter,
    each claiming the first slot of its order still free, until all slots are claimed. Their counts differ by at
    most one, and removing a shard changes few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime no less than the number of shards")
    place = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    table, free = [-1] * size, size
    while True:
        for k in turns:
            at = place[k]
            while table[at] >= 0:
                at = (at + skip[k]) % size
            table[at], place[k] = k, (at + skip[k]) % size
            free -= 1
            if not free:
                return table


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df plus slot and shard: the slot is the key's hash modulo the table's size, the shard is the table's entry.

    The table has ``size`` rows whatever the input, so it is broadcast; placement needs no shuffle and no statistics.
    A null key is placed like an empty string, equal keys always together; an empty df gives an empty result. Own
    columns replace columns of the same name.
    """
    rows = [(k, shards[s]) for k, s in enumerate(lookup_table(shards, size))]
    kind = T.StructType([T.StructField("_slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)])
    table = df.sparkSession.createDataFrame(rows, kind)
    out = df.withColumn("slot", F.pmod(stable_hash(F.col(key)), F.lit(size)).cast("long"))
    out = out.drop("shard", "_slot")
    return out.join(F.broadcast(table), F.col("slot") == F.col("_slot")).drop("_slot")
