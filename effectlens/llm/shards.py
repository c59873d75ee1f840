"""Shards of near equal bytes by sampled splitters.

Records are ordered by a hash of their text, then of their id, then by a number of their own, so that equal
texts lie side by side but a text of very many copies, or one row repeated, can still be cut.  In each
round, ranges that are overfull have keys drawn in proportion to size, quantiles of the draw become
splitters, and the records of the range are dealt out between them; the first round splits the whole.
Rounds go on until no range is overfull that has more than one record.  Sums of bytes and rows per range
then place every range in the whole, a window within each range places its records, and a record's shard
follows from the bytes before it.  Shards are contiguous in the order and differ by about one record.

Samples, splitters and sums are tables; the driver sees a count per round.  A range is split in at most
``fan`` at once, so its draw has a bound.  Splitters and sums are broadcast only if their number, counted
before, is under ``most_broadcast``.  Only DataFrame functions are used.

Edge cases: a null text has no bytes, and so size 16 and the checksum of the empty text.  Records
that agree in id and text are interchangeable.  With fewer records than shards some shards stay
empty.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from effectlens.llm.shared import stored

OVERHEAD = 16
LAW = "bytes"
KEY = ["g", "s", "u"]


def leading(hexed: Column) -> Column:
    """The first 60 bits of a hash as a number."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def place(cuts: Column, key: Column) -> Column:
    """How many of the sorted cuts are at most key: looked up in two steps of about sqrt(n) each."""
    step = F.ceil(F.sqrt(F.size(cuts))).cast("int")
    ahead = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / step).cast("int")), lambda k: F.get(cuts, k * step)), lambda c: c <= key))
    return F.when(ahead == 0, 0).otherwise((ahead - 1) * step + F.size(F.filter(F.slice(cuts, (ahead - 1) * step + 1, step), lambda c: c <= key)))


def join_small(big: DataFrame, small: DataFrame, rows: int, most: int) -> DataFrame:
    """Left join by range; small is sent out whole if it has few rows, else Spark splits what is skewed."""
    return big.join(F.broadcast(small) if rows <= most else small, "range", "left")


def split_again(records: DataFrame, overfull: DataFrame, many: int, oversample: int, fan: int, most: int, turn: int) -> DataFrame:
    """records with a finer range where theirs is in overfull (range, n bytes, pieces); ranges keep their order."""
    draw = F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(1 << 30)) / F.lit(1 << 30)
    chance = F.col("size") * F.col("pieces") * oversample / F.col("n")
    drawn = join_small(records, overfull, many, most).filter("pieces IS NOT NULL").filter(draw < chance)
    drawn = drawn.select("range", "pieces", F.struct(*KEY).alias("key"), F.greatest(chance, F.lit(1.0)).alias("w"))
    inside = W.partitionBy("range").orderBy("key")
    share = F.col("pieces") / F.sum("w").over(W.partitionBy("range"))
    seen = F.sum("w").over(inside.rowsBetween(W.unboundedPreceding, 0))
    marked = drawn.withColumn("from", F.floor((seen - F.col("w")) * share + 1e-9)).withColumn("to", F.floor(seen * share + 1e-9))
    cuts = marked.filter("to > from AND to < pieces").groupBy("range").agg(F.sort_array(F.collect_set("key")).alias("cuts"))
    cuts = stored(cuts, "shard-cuts")
    wide = cuts.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    finer = F.when(F.col("cuts").isNotNull(), place(F.col("cuts"), F.struct(*KEY))).otherwise(0)
    dealt = join_small(records, cuts, wide, most)
    return dealt.select("id", "size", "text_crc32", *KEY, (F.col("range") * fan + finer).cast("long").alias("range"))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 8, oversample: int = 12, range_rows: int = 500_000, overfull: float = 1.6, fan: int = 512, most_broadcast: int = 1_000_000) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per record."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        leading(F.md5(text)).alias("g"),
        leading(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("s"),
        F.monotonically_increasing_id().alias("u"),
        F.lit(0).cast("long").alias("range"),
    )
    records = stored(records, "shard-records")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(shards * ranges_per_shard, rows // range_rows)
    full = max(1.0, total / parts)
    turn, depth = 0, 1
    while True:
        sums = stored(records.groupBy("range").agg(F.sum("size").alias("n"), F.count("*").alias("many"), F.max("size").alias("most")), "shard-sums")
        pieces = F.least(F.ceil(F.greatest(F.col("n") / full, F.col("many") / range_rows)), F.lit(fan)).cast("int")
        large = (F.col("many") > 1) & ((F.col("n") > F.greatest(F.lit(overfull * full), 2 * F.col("most"))) | (F.col("many") > 2 * range_rows))
        again = sums.filter(large).select("range", "n", F.greatest(pieces, F.lit(2)).alias("pieces"))
        many = again.count()
        if not many or depth > (1 << 62) // fan // fan:
            break
        turn, depth = turn + 1, depth * fan
        records = stored(split_again(records, again, many, oversample, fan, most_broadcast, turn), "shard-records")
    # One row for each range, half a million records or a like share of the bytes.
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    starts = sums.select("range", (F.sum("n").over(before) - F.col("n")).alias("bytes_before"), (F.sum("many").over(before) - F.col("many")).alias("rows_before"))
    order = W.partitionBy("range").orderBy(*KEY)
    middle = F.col("bytes_before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    put = join_small(records, starts, sums.count(), most_broadcast).select(
        "id",
        "size",
        "text_crc32",
        F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("nth"),
    )
    put = stored(put, "shard-places")
    # One row per shard: its size is bounded by their number.
    firsts = put.groupBy("shard").agg(F.min("nth").alias("first"))
    return put.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


# The checksum goes through the bytes' half-bytes, the lower first; its table is the polynomial's.
ORACLE = r"""
WITH p AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS tab),
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT rid, regexp_extract_all(hex(encode(text)), '[0-9A-F]') AS digits FROM t),
h AS (SELECT rid, list_transform(range(0, len(digits)), lambda i: ('0x' || digits[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])::BIGINT) AS half FROM x),
c AS (SELECT rid, xor(list_reduce(list_prepend(4294967295::BIGINT, half), lambda a, b: xor(a >> 4, tab[(xor(a, b) & 15) + 1]::BIGINT)), 4294967295) AS crc FROM h, p),
s AS (SELECT t.rid, doc_id, octet_length(encode(text)) + 16 AS size, crc, substr(md5(text), 1, 15) AS g, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS s FROM t JOIN c USING (rid)),
o AS (SELECT *, sum(size) OVER (ORDER BY g, s, rid ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle, sum(size) OVER () AS whole, row_number() OVER (ORDER BY g, s, rid) AS nth FROM s),
d AS (SELECT *, least(floor(middle * 40 / whole), 39)::INTEGER AS shard FROM o)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nth) - 1 AS slot, NULL::INTEGER AS grown_shard FROM d
"""
