"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts mean it: space and \\t \\n \\v \\f \\r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Used only by local sessions that name no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/lodemark"
#: Texts differ in length by thousands of times, so Arrow batches are bounded by bytes.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_top(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may do without naming one."""
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not top and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return top or LOCAL_CHECKPOINTS


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the folder all executors share. Spark removes it with the context where
    spark.cleaner.referenceTracking.cleanCheckpoints is on; otherwise it is left to the folder's owner."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_top(df.sparkSession))
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add_all(array: Column) -> Column:
    """Sum of an array of longs; 0 for an empty one."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)


def words(text: Column) -> Column:
    """Maximal runs of non-space characters; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches. Spark reads the setting when a query runs, so it stays; the number of rows keeps its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of the input's, whatever extra columns it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the place that all executors share."""
    return f"{_shared_top(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of shared_folder() in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one computation in the shared folder. Unlike a checkpoint, a table read back has the size it has: the
    optimizer's estimates do not multiply over the rounds of an iteration."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, shared_folder(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.path)


def anti_join(left: DataFrame, right: DataFrame, keys: dict[str, str], most: int = 100_000) -> DataFrame:
    """Rows of left without a match (nulls equal); right is broadcast only if it has at most `most` rows."""
    renamed = dict(zip(keys.values(), fresh(left, *[f"other_{i}" for i in range(len(keys))]), strict=True))
    right = right.select(*[F.col(k).alias(v) for k, v in renamed.items()])
    on = [F.col(a).eqNullSafe(F.col(renamed[b])) for a, b in keys.items()]
    return left.join(F.broadcast(right) if right.count() <= most else right, on, "left_anti")


def bitmap(listed: DataFrame, bits: int) -> DataFrame:
    """One row: 2**bits bits as an array of longs; those at the hashes h are set."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = listed.groupBy(F.shiftright(slot, 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")
    )
    zero = listed.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("bits"))
    full = words.unionByName(zero).groupBy("i").agg(F.bit_or("bits").alias("bits"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"]).alias("bitmap"))


def bit_at(bits_of: Column, h: Column, bits: int) -> Column:
    """Whether a bitmap's bit at a hash is set."""
    slot = F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")
    return F.getbit(F.get(bits_of, slot), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def split_words(texts: pa.Array, mark: str) -> pa.ListArray:
    """Each text's words with the mark before them, and its line feeds."""
    cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), mark, "\0" + mark)
    return pc.split_pattern(cut, "\0")


class WordCache:
    """The token ids that make gives for words, as little-endian unsigned 32-bit bytes, for about the `size` words used last:
    when a generation is full it becomes the old one, from which words come back when they are met again. Words of more than
    KEPT_LENGTH characters are not kept."""

    KEPT_LENGTH = 64

    def __init__(self, make: Callable[[list[str]], list[bytes]], size: int):
        self.make, self.half = make, size // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        got = self.young.get(word)
        return self.old.get(word) if got is None else got

    def of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; make is called once for all that are not known."""
        got = list(map(self.young.get, words))
        at = [i for i, x in enumerate(got) if x is None]
        for i in at:
            got[i] = self.old.get(words[i])
        made = [i for i in at if got[i] is None]
        for i, x in zip(made, self.make([words[i] for i in made]), strict=True):
            got[i] = x
        if len(self.young) + len(at) > self.half:
            self.old, self.young = self.young, {}
        self.young.update([(words[i], got[i]) for i in at if len(words[i]) <= self.KEPT_LENGTH])
        return got

    def join(self, texts: pa.ListArray) -> list[bytes]:
        """Ids of each text, given as its words. Distinct words are looked up once, and their ids copied to all their places."""
        words = texts.flatten().dictionary_encode()
        given = self.of(words.dictionary.to_pylist())
        sizes, flat = np.fromiter(map(len, given), "i8", len(given)) // 4, np.frombuffer(b"".join(given), dtype="<u4")
        at = words.indices.to_numpy()
        counts = sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        shift = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        ids = flat[np.repeat(shift.astype("i4"), counts) + np.arange(ends[-1], dtype="i4")].tobytes()
        edges = 4 * ends[np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy())])]
        return [ids[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
