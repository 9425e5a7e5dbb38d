"""Consistent placement of rows on shards through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size M: it starts at an offset
and walks with a step, both hashed from the shard's name. Shards take turns; at its turn a shard
claims its first slot that is still free. The filled table maps a key's slot to its shard, so that a
key costs one hash and one lookup, shards hold equal shares of the slots (they differ by one), and
adding or removing a shard moves few keys.

Edge cases: a null key is placed as the empty string; equal keys always share a shard; an empty input
gives an empty result; input columns named `slot` or `shard` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash values are the first 15 hex digits of an MD5, so that any SQL engine can repeat them.
HEX = 15
#: The largest table that may be broadcast, in slots (two integers each).
MOST_SLOTS = 1_000_003


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard."""
    from hashlib import md5

    first, second = (int(md5(f"{kind}:{name}".encode()).hexdigest()[:HEX], 16) for kind in ("offset", "step"))
    return first % size, second % (size - 1) + 1


def lookup_table(names: list[str], size: int) -> list[int]:
    """The shard's number for each slot. Its cost depends on parameters only, not on data."""
    if size != next_prime(size) or not 0 < len(names) < size <= MOST_SLOTS:
        raise ValueError(f"the table needs a prime size above {len(names)} and at most {MOST_SLOTS}, not {size}")
    slots = [-1] * size
    walks = [preference(name, size) for name in names]
    at = [offset for offset, _ in walks]
    left = size
    while left:
        for shard, (_, step) in enumerate(walks):
            while slots[at[shard]] >= 0:
                at[shard] = (at[shard] + step) % size
            slots[at[shard]] = shard
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column | str, size: int) -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, names: list[str], size: int) -> DataFrame:
    """The lookup table as rows (slot, shard); `size` rows, which bounds its broadcast."""
    filled = F.split(F.lit(",".join(map(str, lookup_table(names, size)))), ",")
    return spark.range(1).select(F.posexplode(filled).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def place(docs: DataFrame, n_shards: int = 64, size: int = 6529, key: str = "doc_id") -> DataFrame:
    """docs with the columns slot (long) and shard (int)."""
    names = [f"shard-{k}" for k in range(n_shards)]
    keyed = docs.drop("slot", "shard").withColumn("slot", slot_of(key, size))
    return keyed.join(F.broadcast(table_frame(docs.sparkSession, names, size)), "slot").select(*keyed.columns, "shard")


def write_shards(placed: DataFrame, path: str, format: str = "parquet") -> None:
    """One folder per shard; a shard's rows come from all tasks, so that no task holds a shard."""
    placed.write.partitionBy("shard").format(format).save(path)


def oracle(n_shards: int = 64, size: int = 6529) -> str:
    """DuckDB SQL that fills the table by recursion, one claim a step, and places documents."""
    return f"""
WITH RECURSIVE
walk AS (
  SELECT i AS shard,
         ('0x' || substr(md5('offset:shard-' || i), 1, {HEX}))::BIGINT % {size} AS first,
         ('0x' || substr(md5('step:shard-' || i), 1, {HEX}))::BIGINT % ({size} - 1) + 1 AS step
  FROM range({n_shards}) t(i)),
pref AS MATERIALIZED (SELECT shard, list((first + k * step) % {size} ORDER BY k) AS slots FROM walk, range({size}) r(k) GROUP BY shard),
fill(id, turn, slots) USING KEY (id) AS (
  SELECT 0, 0, list_transform(range({size}), lambda x: -1)
  UNION
  SELECT 0, turn + 1, list_concat(list_concat(slots[1 : pick], [shard]), slots[pick + 2 :])
  FROM (SELECT turn, f.slots, p.shard, list_filter(p.slots, lambda s: f.slots[s + 1] < 0)[1] AS pick FROM fill f JOIN pref p ON p.shard = turn % {n_shards} WHERE turn < {size})),
filled AS (SELECT unnest(range({size})) AS slot, unnest(slots) AS shard FROM fill)
SELECT doc_id, d.slot, CAST(shard AS INTEGER) AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}))::BIGINT % {size} AS slot FROM documents) d
JOIN filled USING (slot)"""
