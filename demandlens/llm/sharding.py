"""Sharding by jump consistent hashing, with built-in functions only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import numbered, written

#: Multiplier of the generator (2862933555777941757) in pieces of 16 bits, lowest first.
MULTIPLIER = [2862933555777941757 >> s & 0xFFFF for s in (0, 16, 32, 48)]
LOW32 = (1 << 32) - 1
SIZE_OF_ROW = 16


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state modulo 2**64, in halves of 32 bits so that no product overflows."""
    m = [F.lit(x).cast("long") for x in MULTIPLIER]

    def up(product):
        return F.shiftleft(product.bitwiseAND(F.lit(0xFFFF)), 16)

    second = lo * m[1]
    low = lo * m[0] + up(second) + 1
    high = (
        F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(second, 16) + lo * m[2] + up(lo * m[3]) + hi * m[0] + up(hi * m[1])
    )
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """The shards of ``key`` (a long) among ``shards`` and among ``shards + 1``.

    The jumps of a key do not depend on the number of shards; they only end at it.  So with one shard more the
    key stays, or it moves to the new shard if its next jump lands just there.
    """

    def step(s, _):
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["next"] + 1).cast("double") * (2.0**31 / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["next"].alias("at"), jump.alias("next"))
        return F.when(s["next"] < shards, moved).otherwise(s)

    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW32)).alias("lo"),
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return (
        end["at"].cast("int"),
        F.when(end["next"] == shards, F.lit(shards)).otherwise(end["at"]).cast("int"),
    )


def shard(docs: DataFrame, shards: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows ``id, size, text_crc32, law, shard, slot, grown_shard`` of every document; texts are not moved.

    The id and the number of shards alone decide (law ``key``): no table of shards, no state, and a new shard
    takes rows only into itself.  A null id has the shard of id 0.  A null text has 16 bytes and the checksum
    of an empty one.  Repeated rows share a shard and get slots of their own.  An empty table gives
    an empty one.  Other columns are left out.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col),
        (F.octet_length(text).cast("long") + SIZE_OF_ROW).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("_key"),
    )
    at, grown = jump_hash(F.col("_key"), shards)
    placed = rows.withColumn("_at", F.struct(at.alias("shard"), grown.alias("grown_shard"))).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "_at.shard", "_at.grown_shard"
    )
    return numbered(written(placed, "shards"), "shard", [id_col, "size", "text_crc32"], "slot").select(
        id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
