"""Placement of rows on shards by a permutation-filled lookup table.

Method: each shard has a preference order of all slots of a table of prime size (a start and a step from hashes of its name).
The shards take turns, and each claims its next slot that is still free, until the table is full: shares differ by one slot at
most, and adding or removing a shard moves little else. A row's slot is a hash of its key modulo the size; a
broadcast of the table (bounded by its size, a parameter) places it in constant time, without a shuffle.

Defined cases: a null key is placed like an empty one; equal keys go to the same shard; names are taken once each, in sorted order;
no names is an error. All columns of the input stay; `slot` and `shard` replace columns of these names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (its place in the sorted names) of each slot."""
    names = sorted(set(names))
    if not names or len(names) > slots or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("needs names, no more than slots, and a prime number of slots")
    start = [_number("start " + n) % slots for n in names]
    step = [_number("step " + n) % (slots - 1) + 1 for n in names]
    owner, asked, left = np.full(slots, -1, np.int32), [0] * len(names), slots
    while left:
        for i in range(len(names)):
            while owner[slot := (start[i] + asked[i] * step[i]) % slots] >= 0:
                asked[i] += 1
            owner[slot] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots).cast("int")


def placed(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df with the slot and the shard (name) of each row."""
    owner, order = lookup_table(names, slots), sorted(set(names))
    table = df.sparkSession.createDataFrame(list(zip(range(slots), (order[i] for i in owner), strict=True)), "slot int, shard string")
    rest = df.withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).drop("shard")
    return rest.join(F.broadcast(table), "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")
