"""Rows whose id is not on a list of any length, with no text shuffled for a row that surely stays.

A Bloom filter of the list, of bounded size, is broadcast in pieces and looked up in the row: one join by piece,
three bits. What it does not name stays where it is. Of what it names only the ids are compared with the
list itself; the few that it named in error are as a rule few enough to be broadcast, too. Where they are
not, only the named rows are joined with the list. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_name, staged

#: Bits of a piece, bits for each id, and bits in all (64 MB) at most; ids that are broadcast at most (8 MB).
PIECE, PER_ID, MOST, FEW = 1 << 15, 16, 1 << 29, 1 << 20


def without(df: DataFrame, ids: DataFrame, column: str = "doc_id", most_bits: int = MOST, few: int = FEW) -> DataFrame:
    """Rows of ``df`` whose ``column`` (long) is not among ``ids(id)``, distinct longs. Rows with a null there stay. Columns may
    have any names."""
    n = ids.count()
    if not n:
        return df
    pieces = min(most_bits, max(PIECE, 1 << (PER_ID * n - 1).bit_length())) // PIECE
    piece = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(pieces))
    spots = lambda c: [F.shiftright(F.xxhash64(c, F.lit(2)), 15 * i).bitwiseAND(PIECE - 1) for i in range(3)]
    names = [new_name(df, x) for x in ("_piece", "_bits", "_maybe", "_wrong")]
    at, bits, maybe, wrong = names
    table = ids.select(piece(F.col("id")).alias(at), F.explode(F.array(*spots(F.col("id")))).alias("bit")).groupBy(at).agg(F.bitmap_construct_agg("bit").alias(bits))
    table = F.broadcast(staged(table))

    def bit(spot):
        byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, spot.bitwiseAND(7).cast("int")) == 1

    def marked(rows: DataFrame) -> DataFrame:
        key = F.col(f"`{column}`").cast("long")
        a, b, c = (bit(s) for s in spots(key))
        found = rows.join(table, piece(key) == F.col(at), "left")
        return found.withColumn(maybe, F.coalesce(a & b & c & key.isNotNull(), F.lit(False))).drop(at, bits)

    named = marked(df.select(F.col(f"`{column}`"))).where(F.col(maybe)).select(F.col(f"`{column}`").cast("long").alias(wrong)).distinct()
    error = staged(named.join(ids, F.col(wrong) == F.col("id"), "left_anti"))
    rows, same = marked(df), F.col(f"`{column}`") == F.col(wrong)
    if error.count() <= few:
        kept = rows.join(F.broadcast(error), same, "left").where(~F.col(maybe) | F.col(wrong).isNotNull())
        return kept.drop(maybe, wrong)
    unsure = rows.where(F.col(maybe)).join(ids.withColumnRenamed("id", wrong), same, "left_anti")
    return rows.where(~F.col(maybe)).unionByName(unsure).drop(maybe)
