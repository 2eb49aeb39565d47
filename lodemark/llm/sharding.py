"""Sharding by extendible hashing.

A row's address is a bit string: the first HASH_BITS bits of the md5 of its id
and text. The directory starts as one bucket of no bits; a bucket over the byte
limit splits on the next bit, and only such buckets do, so a shard's name is
the shortest prefix whose rows fit. Which buckets split depends on their sizes
alone, not on the order of rows.

Sizes are counted once, at cells a few bits finer than the shards are expected
to be, and rolled up to every shorter prefix; a cell that is still too large is
counted anew on more bits, together with no other. Rows of one address (exact
repeats) cannot be told apart by hash bits: where they alone exceed the limit,
their rows' ordinals extend the address. A single row over the limit is a shard
of its own.

Defined results: null ids and texts hash as empty; a null text has no bytes;
repeated rows may land in one shard or, if they exceed it, in several; an empty
table has no shards; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: 60 bits are 15 hexadecimal digits, a positive long.
HASH_BITS = 60
#: Bits by which cells are finer than an even split would need, and by which too large cells grow.
SLACK_BITS = 5
#: Most cells of a look-up that is broadcast (a row of some 60 bytes each).
MOST_CELLS = 500_000
SHARD_BYTES = 1 << 20


def _bits(digest: Column) -> Column:
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def address(key: Column, text: Column) -> Column:
    """HASH_BITS characters 0 and 1."""
    return _bits(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))).cast("binary")))


def directory(rows: DataFrame, limit: int, total: int, count: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The shards (prefix, bits, shard_bytes, shard_rows), and for each depth at which prefixes were counted a look-up from a cell of that
    depth to its shard; a cell that was split on has none and is found at the next depth. rows has address and bytes."""
    spark = rows.sparkSession
    depth, done = max(1, (max(1, total // limit) - 1).bit_length() + SLACK_BITS), []
    longest = 2 * HASH_BITS
    pending = rows
    while True:
        depth = min(depth, longest)
        cells = checkpoint(pending.groupBy(F.substring("address", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
        done.append((depth, cells))
        large = cells.filter((F.col("bytes") > limit) & (F.col("n") > 1)).select("cell")
        if depth == longest or large.isEmpty():
            break
        pending = pending.join(large.withColumnRenamed("cell", "_cell"), F.substring("address", 1, depth) == F.col("_cell"), "left_semi")
        depth += 2 * SLACK_BITS
    # sizes of all prefixes: of the first cells down to the root, of later ones down to the cell they refine
    sized, base = None, 0
    for _, cells in done:
        upper = F.explode(F.sequence(F.lit(base), F.length("cell"))).alias("bits")
        part = cells.select("bytes", "n", upper, "cell").groupBy(F.expr("substring(cell, 1, bits)").alias("prefix"), "bits").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        part = part if base == 0 else part.filter(F.col("bits") > base)
        sized = part if sized is None else sized.unionByName(part)
        base = cells.agg(F.max(F.length("cell"))).first()[0] or base
    fits = checkpoint(sized).withColumn("fits", (F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("bits") == longest))
    parent_large = fits.filter(~F.col("fits")).select(F.col("prefix").alias("_p"), (F.col("bits") + 1).alias("_b"))
    leaf = fits.filter("fits").alias("f").join(parent_large, (F.expr("substring(prefix, 1, bits - 1)") == F.col("_p")) & (F.col("bits") == F.col("_b")), "left_semi")
    root = fits.filter((F.col("bits") == 0) & F.col("fits"))
    shards = spark.createDataFrame([], fits.schema).unionByName(leaf).unionByName(root)
    shards = checkpoint(shards.select("prefix", "bits", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")))
    looked_up = []
    for at, cells in done:  # a cell tries its own prefixes, so rows need not
        tries = cells.select("cell", F.explode(F.sequence(F.lit(0), F.length("cell"))).alias("bits")).withColumn("prefix", F.expr("substring(cell, 1, bits)"))
        looked_up.append((at, checkpoint(tries.join(shards, ["prefix", "bits"]))))
    return shards, looked_up


def _addressed(rows: DataFrame, addr: str, size: str, text: str, key: str) -> DataFrame:
    """rows with their address and bytes in the columns named."""
    (ordinal,) = fresh(rows, "ordinal")
    rows = rows.withColumn(ordinal, F.monotonically_increasing_id())
    bits = F.concat(address(F.col(key), F.col(text)), _bits(F.md5(F.col(ordinal).cast("string").cast("binary"))))
    return rows.withColumn(addr, bits).withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).drop(ordinal)


def _placed(rows: DataFrame, addr: str, size: str, limit: int) -> tuple[DataFrame, list[str]]:
    """rows with the name, bits, bytes and number of rows of their shard, in the columns named."""
    sized = rows.select(F.col(addr).alias("address"), F.col(size).alias("bytes"))
    got = sized.agg(F.sum("bytes").alias("total"), F.count("*").alias("count")).first()
    names = fresh(rows, "prefix", "bits", "shard_bytes", "shard_rows")
    _, looked_up = directory(sized, limit, got["total"] or 0, got["count"])
    for i, (depth, cells) in enumerate(looked_up):  # one depth, unless shards were split beyond it
        cell, *found = fresh(rows, "cell", *[f"found_{n}" for n in names])
        cells = cells.select(F.col("cell").alias(cell), *[F.col(c).alias(f) for c, f in zip(("prefix", "bits", "shard_bytes", "shard_rows"), found, strict=True)])
        side = F.broadcast(cells) if cells.count() <= MOST_CELLS else cells.hint("merge")  # addresses are hashes: no cell is hot
        rows = rows.join(side, F.substring(addr, 1, depth) == F.col(cell), "left")
        rows = rows.withColumns({n: F.coalesce(n, f) if i else F.col(f) for n, f in zip(names, found, strict=True)}).drop(cell, *found)
    return rows, names


def assign_shards(documents: DataFrame, limit: int = SHARD_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, bytes, shard (its bits; empty for the only one), shard_bits, shard_bytes, shard_rows."""
    rows = _addressed(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "address", "bytes", "text", "doc_id")
    rows = checkpoint(rows.drop("text"))  # a lost task must not number exact repeats anew
    got, (prefix, bits, total, count) = _placed(rows, "address", "bytes", limit)
    return got.select("doc_id", "bytes", F.col(prefix).alias("shard"), F.col(bits).alias("shard_bits"), F.col(total).alias("shard_bytes"), F.col(count).alias("shard_rows"))


def write_shards(documents: DataFrame, path: str, limit: int = SHARD_BYTES, text: str = "text", key: str = "doc_id") -> None:
    """Write all columns of the documents under path/shard=b<bits>/ (the column is renamed if it would clash), a shard being one
    task's work."""
    addr, size, shard = fresh(documents, "address", "bytes", "shard")
    got, (prefix, *_) = _placed(checkpoint(_addressed(documents, addr, size, text, key)), addr, size, limit)
    got = got.withColumn(shard, F.concat(F.lit("b"), F.col(prefix))).select(*documents.columns, shard)
    got.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)
