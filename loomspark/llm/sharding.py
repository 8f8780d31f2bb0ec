"""Shards by a permutation-filled lookup table.

Each shard orders the slots of a prime-sized table by its own permutation (offset and skip from its name)
and the shards claim slots in turns. The table has a fixed size and is broadcast; a document's place is one
hash and one lookup. Adding or removing a shard moves few other documents.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2039
SHARDS = 16


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    """As ``slot_of``: the first 8 hexadecimal digits of MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot. ``slots`` is prime and at least the number of shards;
    shard names are distinct. Its size, and so the work here, does not depend on the data."""
    if not _prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("a prime number of slots, no fewer than the distinct shard names, is needed")
    at = [_number(f"{s}|offset") % slots for s in shards]
    skip = [_number(f"{s}|skip") % (slots - 1) + 1 for s in shards]
    owner, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a document key; null counts as an empty key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, key: Column | None = None) -> DataFrame:
    """All columns of ``docs`` and ``slot`` (long), ``shard_id`` (long), ``shard`` (name).

    The key is ``doc_id`` unless given; equal keys go to one shard, a null key goes to the slot of the empty
    key; columns of these names (in any case) that ``docs`` has already are replaced; texts of any length and
    repeated rows are placed by their key alone; an empty table stays empty. Rows are not shuffled: the table
    (``slots`` rows) is broadcast.
    """
    shards = [f"shard-{i:03d}" for i in range(SHARDS)] if shards is None else shards
    table = docs.sparkSession.createDataFrame([(s, i, shards[i]) for s, i in enumerate(lookup_table(shards, slots))], "slot long, shard_id long, shard string")
    key = F.col("doc_id") if key is None else key
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in table.columns]
    return docs.select(*own, slot_of(key, slots).alias("slot")).join(F.broadcast(table), "slot").select(*own, "slot", "shard_id", "shard")


#: The same table and placement in SQL: one claim or one step along a permutation per recursion.
SQL = f"""
WITH RECURSIVE h AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({SHARDS}) t(i)
), p AS (
  SELECT list(('0x' || substr(md5(name || '|offset'), 1, 8))::BIGINT % {SLOTS} ORDER BY i) AS o,
         list(('0x' || substr(md5(name || '|skip'), 1, 8))::BIGINT % {SLOTS - 1} + 1 ORDER BY i) AS s FROM h
), f(turn, owner, pos) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda x: -1::BIGINT), o FROM p
  UNION ALL
  SELECT CASE WHEN owner[pos[turn % {SHARDS} + 1] + 1] < 0 THEN turn + 1 ELSE turn END,
         CASE WHEN owner[pos[turn % {SHARDS} + 1] + 1] < 0
              THEN owner[:pos[turn % {SHARDS} + 1]] || [turn % {SHARDS}] || owner[pos[turn % {SHARDS} + 1] + 2:] ELSE owner END,
         CASE WHEN owner[pos[turn % {SHARDS} + 1] + 1] < 0 THEN pos
              ELSE pos[:turn % {SHARDS}] || [(pos[turn % {SHARDS} + 1] + s[turn % {SHARDS} + 1]) % {SLOTS}] || pos[turn % {SHARDS} + 2:] END
  FROM f, p WHERE turn < {SLOTS}
), t AS (
  SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS shard_id FROM (SELECT owner FROM f WHERE turn = {SLOTS} LIMIT 1)
)
"""
