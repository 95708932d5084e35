"""A filter of bounded size for which rows a table of keys can concern at all.

Keys are hashed to ``SLOTS`` slots; the slots that are taken are bitmaps of 4 KB, 4 MB in all
whatever the data, which is what is broadcast. Rows whose slot is free are not concerned and
need no shuffle. The others must be joined with the table itself, which decides: when the
slots fill up, more rows take that way and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import materialise

#: Slots of all bitmaps; bits of one (Spark's own width).
SLOTS, BITMAP = 1 << 25, 32_768


def _slot(columns: list) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS))


def possible(df: DataFrame, columns: list, keys: DataFrame, key_columns: list, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false where ``columns`` are surely none of the keys. Nulls are keys like any other."""
    slot = keys.select(_slot(key_columns).alias("members_slot"))
    marks = slot.groupBy(F.expr(f"cast(members_slot div {BITMAP} as int)").alias("members_map")).agg(F.expr(f"bitmap_construct_agg(members_slot % {BITMAP})").alias("members_bits"))
    marks = materialise(marks, "members", share=64)  # SLOTS / BITMAP rows at most
    at = _slot(columns)
    byte = F.conv(F.hex(F.substring(F.col("members_bits"), ((at % BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1
    joined = df.join(F.broadcast(marks), F.floor(at / BITMAP).cast("int") == F.col("members_map"), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(bit, F.lit(False)).alias(flag))
