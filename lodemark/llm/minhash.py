"""Near-duplicates by improved consistent weighted sampling (ICWS).

Documents are multisets of SHINGLE-word shingles. A shingle weighs its count
times 1/2 + idf/2, where idf falls from 1 for shingles in at most RARE of the
documents to 0 for those in all, so that common passages count less and large
groups of copies still match. Document frequencies cover all documents; they are
kept in a table of fixed size, so a shingle has the frequency of its slot, and a
rare one that shares a slot with a common one weighs less, in every document.

ICWS draws, for each of BANDS * ROWS hash functions, one (shingle, level) pair
per document, equal for two documents with probability of their weighted
Jaccard similarity. Equal bands make a bucket. Buckets of up to SMALL texts are
compared pair by pair, and in larger ones every member with a hub, the member
that shares most buckets with others (an original shares more with its copies
than they do with each other). A second round takes HUBS hubs for the members
that are not yet in their class. Hubs only save work: where a bucket still holds
several classes, all pairs of different classes are compared, block of texts by
block, so no bucket is left unfinished. Only buckets of more than WHOLE texts
are banded anew with longer bands first, which joins most of their classes; then
they are finished like all others. Each comparison computes the exact weighted Jaccard
similarity of whole texts; classes are the connected components of the pairs at
or above THRESHOLD.

Equal texts are one node throughout. Defined results: null texts and texts
without words are classes of their own; a text of fewer than SHINGLE words is
one shingle; rows of equal id and text are copies like any others; a null id
sorts last, so it names a class only if all its ids are null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, anti_join, checkpoint, fresh, small_batches

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
#: The second banding, for what is left in large buckets.
BANDS_2, ROWS_2 = 24, 8
RARE = 0.01
SKETCH_BITS = 18
SMALL = 8
#: Hubs a bucket in the second round, before all pairs of different classes.
HUBS = 4
#: The first bands' buckets above this are banded anew before they are finished.
WHOLE = 4096
#: Texts of one side of a block of pairs, and the features multiplied at once.
SIDE, FEATURES = 1024, 4096
CACHE_WORDS = 500_000
#: Node names of 32 characters: 10 MB at most.
BROADCAST_NODES = 200_000
#: Rows of one key that may meet in a task; a key of more is dealt over several.
HOT = 2048
#: A shingle's hash, which leaves room for a document's number above it.
HASH_BITS, BLOCK = 54, 512
_M = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_words: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    known = _words
    try:
        return np.fromiter(map(known.__getitem__, words), dtype="u8", count=len(words))
    except KeyError:
        new = set(words).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype="u8", count=len(words))


def _mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(30))
    z *= _C1
    z ^= z >> np.uint64(27)
    z *= _C2
    z ^= z >> np.uint64(31)
    return z


def _rolled(w: np.ndarray, size: int) -> np.ndarray:
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h *= _M
        h += w[k : k + n]
    return _mix(h) >> np.uint64(64 - HASH_BITS)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of whole texts, sorted within a text, their counts, and the number of each text."""
    blocks = [_shingles(texts[i : i + BLOCK]) for i in range(0, len(texts), BLOCK)] or [_shingles([])]
    return tuple(map(np.concatenate, zip(*blocks, strict=True)))


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [t.lower().split() if t else [] for t in texts]
    lengths = np.array([len(x) for x in parts], dtype="i8")
    w = _word_hashes(list(chain.from_iterable(parts)))
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(texts), dtype="u8"), lengths)
    keys = []
    if len(w) >= SHINGLE:
        inside = of[: len(w) - SHINGLE + 1] == of[SHINGLE - 1 :]
        keys.append((of[: len(w) - SHINGLE + 1] << np.uint64(HASH_BITS) | _rolled(w, SHINGLE))[inside])
    for i in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)):
        keys.append(np.uint64(i) << np.uint64(HASH_BITS) | _rolled(w[ends[i] - lengths[i] : ends[i]], int(lengths[i])))
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype="u8")
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype="i8")
    counts = np.diff(np.append(first, len(key)))
    key = key[first]
    return key & np.uint64((1 << HASH_BITS) - 1), counts, np.bincount((key >> np.uint64(HASH_BITS)).astype("i8"), minlength=len(texts))


class Weights:
    """A factor for each slot of the frequency table."""

    def __init__(self, slots: np.ndarray, frequency: np.ndarray, total: int):
        self.factors = np.ones(1 << SKETCH_BITS)
        if total and len(slots):
            self.factors[slots] = 0.5 + 0.5 * np.clip(np.log(np.maximum(total / frequency, 1.0)) / np.log(1 / RARE), 0.0, 1.0)

    def of(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.factors[slot(h)]


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - SKETCH_BITS)).astype("i8")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def weights(documents: DataFrame, text: str = "text") -> Weights:
    """Document frequencies over all documents; what reaches the driver is the table of 2**SKETCH_BITS slots at most."""
    small_batches(documents.sparkSession)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, counts = 0, np.zeros(1 << SKETCH_BITS, dtype="i8")
        for batch in batches:
            h, _, lengths = shingles(batch["text"].tolist())
            n += len(lengths)
            counts += np.bincount(slot(h), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": np.append(used, -1), "n": np.append(counts[used], n)})

    counted = documents.select(F.col(text).alias("text")).mapInPandas(sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    slots, n = rows["slot"].to_numpy(dtype="i8"), rows["n"].to_numpy(dtype="i8")
    total = int(n[slots < 0].sum())
    heavy = (slots >= 0) & (n >= max(2, RARE * total))
    return Weights(slots[heavy], n[heavy].astype("f8"), total)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal shares, by bisection."""
    p, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def icws_tables() -> tuple[np.ndarray, np.ndarray]:
    """r for 12 random bits and ln c for 16; made once and shared, so that all workers draw alike."""
    return _gamma_quantiles(1 << 12).astype("f4"), np.log(_gamma_quantiles(1 << 16)).astype("f4")


def icws(h: np.ndarray, w: np.ndarray, lengths: np.ndarray, functions: int, seed: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Samples (documents x functions) of concatenated documents, none of them empty."""
    r_of, lnc_of = tables
    lnw = np.log(w).astype("f4")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = np.empty((len(lengths), functions), dtype="u8")
    with np.errstate(over="ignore"):
        for k in range(functions):
            z = _mix(h ^ _mix(np.array([(seed << 20) + k + 1], dtype="u8") * _M))
            r = r_of[(z & np.uint64(0xFFF)).astype("i4")]
            beta = ((z >> np.uint64(12)) & np.uint64(0xFFFFF)).astype("f4") * np.float32(2**-20)
            t = np.floor(lnw / r + beta)
            a = lnc_of[(z >> np.uint64(48)).astype("i4")] - r * (t - beta + np.float32(1))
            least = np.repeat(np.minimum.reduceat(a, starts), lengths)
            at = np.flatnonzero(a == least)
            at = at[np.searchsorted(at, starts)]
            out[:, k] = _mix(h[at] + t[at].astype("i8").view("u8") * _C1)
    return out


def _signatures(texts: DataFrame, by: Weights, bands: int, rows: int, seed: int) -> DataFrame:
    """texts has id and node besides text; gives id, node and bands (null for texts without words)."""
    spark = texts.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((by, icws_tables()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh, tables = shared.value
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                h, counts, lengths = shingles(part["text"].tolist())
                full = np.flatnonzero(lengths)
                keys: list = [None] * len(lengths)
                if len(full):
                    drawn = icws(h, weigh.of(h, counts), lengths[full], bands * rows, seed, tables)
                    key = np.zeros((len(full), bands), dtype="u8")
                    with np.errstate(over="ignore"):
                        for j in range(rows):
                            key = _mix(key * _M + drawn[:, j::rows])
                        key = _mix(key + np.arange(bands, dtype="u8") * _C2)
                    for i, row in zip(full, key.view("i8"), strict=True):
                        keys[i] = row
                yield pd.DataFrame({"id": part["id"], "node": part["node"], "bands": keys})

    return texts.select(F.col("id").cast("string").alias("id"), "node", "text").mapInPandas(run, "id string, node string, bands array<long>")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most BROADCAST_NODES rows. df is written out already, so counting is cheap and a skewed join can be split."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _salted(rows: DataFrame, of: str, by: str, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows with a column salt, and (_hot, _k): keys of more than HOT rows in the column `of` are dealt by hash of `by` over _k salts."""
    hot = _small(keep(rows.groupBy(F.col(of).alias("_hot")).agg(F.ceil(F.count("*") / HOT).alias("_k")).filter("_k > 1")))
    rows = rows.join(hot, F.col(of) == F.col("_hot"), "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("_k", F.lit(1)))).drop("_hot", "_k")
    return rows, hot


def _for_all_salts(rows: DataFrame, of: str, hot: DataFrame) -> DataFrame:
    """rows with a column salt, each once for every salt of its key."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_k") - 1, F.lit(0))))
    return rows.join(hot, F.col(of) == F.col("_hot"), "left").withColumn("salt", salts).drop("_hot", "_k")


class _Verifier:
    """Exact similarities of pairs of nodes; holds the texts of candidate nodes in the shared folder."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, by: Weights, keep: Scratch):
        self.keep, self.by = keep, texts.sparkSession.sparkContext.broadcast(by)
        nodes = _small(keep(nodes.select(F.col("node").alias("_n"))))
        own = texts.join(nodes, F.col("node") == F.col("_n"), "left_semi")
        self.texts = keep(own.groupBy("node").agg(F.first("text").alias("text")))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) at or above THRESHOLD, written out. A member b of many pairs is dealt over several tasks."""
        shared, keep = self.by, self.keep
        pairs, hot = _salted(keep(pairs.distinct()), "b", "a", keep)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weigh, last, hub = shared.value, None, None

            def vector(t: str) -> tuple[np.ndarray, np.ndarray]:
                h, counts, _ = shingles([t])
                return h, weigh.of(h, counts)

            for batch in batches:
                near = []
                for b, ta, tb in zip(batch["b"], batch["ta"], batch["tb"], strict=True):
                    if b != last:
                        last, hub = b, vector(tb)
                    near.append(similarity(vector(ta), hub) >= THRESHOLD)
                yield batch[["a", "b"]][near]

        left = self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = _for_all_salts(self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b", hot)
        return keep(pairs.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "ta", "tb").mapInPandas(run, "a string, b string"))


def _buckets(signed: DataFrame, keep: Scratch) -> DataFrame:
    """(bucket, node, n, busy) of buckets with n > 1 texts; busy is the sum of n over a node's buckets. A band's key holds its number."""
    rows = signed.filter(F.col("bands").isNotNull()).groupBy("node").agg(F.first("bands").alias("bands"))
    rows = rows.select("node", F.explode("bands").alias("bucket"))
    full = keep(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = keep(rows.join(full, "bucket"))
    busy = keep(rows.groupBy("node").agg(F.sum("n").alias("busy"), F.max("n").alias("most")))
    large = _small(busy.filter(F.col("most") > SMALL).drop("most"))  # only members of large buckets can be hubs
    return keep(rows.join(large, "node", "left"))


def _pairs_of_small(members: DataFrame) -> DataFrame:
    """All pairs within buckets of up to SMALL texts."""
    few = members.filter(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("m"))  # at most SMALL each
    inner = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SMALL)), lambda y: F.struct(y.alias("a"), x.alias("b")))))
    return few.select(F.explode(inner).alias("p")).select("p.a", "p.b")


def _hub_pairs(members: DataFrame, count: int, keep: Scratch) -> DataFrame:
    """(a, b): each member of a bucket with the busiest of each of `count` slices by hash, if it is of another class."""
    part = F.pmod(F.xxhash64("node"), F.lit(count))
    best = members.groupBy("bucket", part.alias("slice")).agg(F.max(F.struct("busy", "node", "label")).alias("t"))
    hubs = keep(best.select(F.col("bucket").alias("_bucket"), F.col("t.node").alias("hub"), F.col("t.label").alias("hub_label")))
    pairs = members.join(_small(hubs), F.col("bucket") == F.col("_bucket")).filter(F.col("label") != F.col("hub_label"))
    return pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _open(members: DataFrame, labels: DataFrame, keep: Scratch) -> DataFrame:
    """members with their classes by labels, of the buckets that hold several classes."""
    moved = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    members = members.join(moved, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("_label", "node")).drop("_node", "_label")
    members = keep(members)
    still = keep(members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("_bucket")))
    return keep(members.join(_small(still), F.col("bucket") == F.col("_bucket"), "left_semi"))


def near_pairs(texts: list[str], labels: list[str], left: np.ndarray, by: Weights) -> list[tuple[int, int]]:
    """Pairs at or above THRESHOLD that join different labels, no more than it takes to join them: of a text of left with one
    of the others, or among all if all are left. A shingle of count c is c features, so that sums of minima are matrix products;
    these only choose the pairs, with some slack, whose similarity is computed."""
    h, counts, lengths = shingles(texts)
    ends = np.cumsum(lengths)
    vectors = [(h[e - n : e], by.of(h[e - n : e], counts[e - n : e])) for e, n in zip(ends, lengths, strict=True)]
    total = np.array([w.sum() for _, w in vectors], dtype="f4")
    at = np.repeat(np.arange(len(h)), counts)
    copy = (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)).astype("u8")
    with np.errstate(over="ignore"):
        _, feature, n = np.unique(_mix(h[at] + copy * _C2), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    at, feature = at[n[feature] > 1], number[feature[n[feature] > 1]]  # what one text alone has adds to no minimum
    order = np.argsort(feature, kind="stable")
    at, feature = at[order], feature[order]
    doc = np.repeat(np.arange(len(texts)), lengths)[at]
    factor = by.of(h[at], np.ones(len(at))).astype("f4")
    rows, cols = np.flatnonzero(left), np.arange(len(texts)) if left.all() else np.flatnonzero(~left)
    low = np.zeros((len(rows), len(cols)), dtype="f4")
    for start in range(0, int(feature[-1]) + 1 if len(feature) else 0, FEATURES):
        i, j = np.searchsorted(feature, [start, start + FEATURES])
        has = np.zeros((len(texts), FEATURES), dtype="f4")
        has[doc[i:j], feature[i:j] - start] = 1
        weight = np.zeros(FEATURES, dtype="f4")
        weight[feature[i:j] - start] = factor[i:j]
        low += (has[rows] * weight) @ has[cols].T
    near = low >= (THRESHOLD - 1e-3) * (total[rows][:, None] + total[cols][None, :] - low)
    code = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
    near &= code[rows][:, None] != code[cols][None, :]
    top, out = list(range(len(texts))), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for r, c in np.argwhere(near):
        a, b = int(rows[r]), int(cols[c])
        x, y = find(int(code[a])), find(int(code[b]))
        if x != y and similarity(vectors[a], vectors[b]) >= THRESHOLD:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _finished(members: DataFrame, verify: _Verifier, keep: Scratch) -> DataFrame:
    """Links (a, b) of all pairs of different classes in the buckets. A bucket's texts are dealt by hash into blocks of about SIDE,
    those of a class of so many into blocks of its own, and each two blocks that are not of one class are a task."""
    same = members.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    once = keep(same.groupBy("c", "h").agg(F.min("bucket").alias("_bucket")).select("_bucket"))  # of buckets of the same texts one
    members = keep(members.join(_small(once), F.col("bucket") == F.col("_bucket"), "left_semi").select("bucket", "node", "label"))
    big = keep(members.groupBy("bucket", "label").agg(F.count("*").alias("c")).filter(F.col("c") >= SIDE).select(F.col("bucket").alias("_bucket"), F.col("label").alias("of")))
    members = members.join(_small(big), (F.col("bucket") == F.col("_bucket")) & (F.col("label") == F.col("of")), "left").drop("_bucket")
    members = keep(members.withColumn("of", F.coalesce("of", F.lit(""))))
    sizes = keep(members.groupBy("bucket", "of").agg(F.ceil(F.count("*") / SIDE).alias("k")))
    renamed = sizes.withColumnsRenamed({"bucket": "_bucket", "of": "_of"})
    members = members.join(_small(renamed), (F.col("bucket") == F.col("_bucket")) & (F.col("of") == F.col("_of"))).drop("_bucket", "_of")
    members = members.withColumn("block", F.struct("of", F.pmod(F.xxhash64(F.lit("block"), "node"), "k").alias("i"))).drop("of", "k")
    blocks = sizes.select("bucket", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.struct("of", i.alias("i")))).alias("x"))
    two = blocks.join(blocks.withColumnRenamed("x", "y"), "bucket").filter((F.col("x") <= F.col("y")) & ((F.col("x.of") != F.col("y.of")) | (F.col("x.of") == "")))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(True).alias("left"))))
    sides = sides.otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(True).alias("left")), F.struct(F.col("y").alias("block"), F.lit(False).alias("left"))))
    tasks = two.select(F.col("bucket").alias("_bucket"), F.md5(F.concat_ws("/", "bucket", "x.of", "x.i", "y.of", "y.i")).alias("task"), F.explode(sides).alias("s"))
    tasks = keep(tasks.select("_bucket", "task", F.col("s.block").alias("_block"), "s.left"))
    dealt = members.join(_small(tasks), (F.col("bucket") == F.col("_bucket")) & (F.col("block") == F.col("_block")))
    dealt = keep(dealt.select(F.col("node").alias("_n"), "label", "task", "left"))
    shared = verify.by

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_n")
        nodes = group["_n"].tolist()
        got = near_pairs(group["text"].tolist(), group["label"].tolist(), group["left"].to_numpy(dtype=bool), shared.value)
        return pd.DataFrame([(nodes[a], nodes[b]) for a, b in got], columns=["a", "b"])

    return keep(dealt.join(verify.texts, F.col("_n") == F.col("node")).drop("node").groupBy("task").applyInPandas(run, "a string, b string"))


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(node, label): the least node of each connected component, by neighbour minima and pointer jumping.
    A step is one aggregation over a union: the optimizer infers no constraints through it, which a chain of joins would pile up.
    The edges of a node of many are dealt over several tasks."""
    edges = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    edges, hot = _salted(edges, "b", "a", keep)
    while True:
        other = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        none = F.lit(None).cast("string").alias("old")
        dealt = _for_all_salts(other, "_n", hot).withColumnRenamed("salt", "_salt")
        seen = edges.join(dealt, (F.col("b") == F.col("_n")) & (F.col("salt") == F.col("_salt"))).select(F.col("a").alias("node"), F.col("_l").alias("label"), none)
        jump = labels.join(other, F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label"), none)
        step = own.unionByName(seen).unionByName(jump).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        step = keep(step)
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def _classes(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(id, node, label): label is null for documents without words."""
    texts = documents.select(F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("node"), F.col(text).alias("text"))
    with Scratch(documents.sparkSession, "near") as keep:
        by = weights(documents, text)
        signed = keep(_signatures(texts, by, BANDS, ROWS, 1))
        members = _buckets(signed, keep)
        verify = _Verifier(texts, members.select("node").distinct(), by, keep)
        large = members.filter(F.col("n") > SMALL).withColumn("label", F.col("node"))
        links = [verify.links(_pairs_of_small(members).unionByName(_hub_pairs(large, 1, keep)))]
        labels = components(links[0], keep)

        def closer(buckets: DataFrame, small: bool) -> DataFrame:
            """What the second round of hubs leaves open of the buckets; its links are added. Small ones are compared whole if asked."""
            nonlocal labels
            left = _open(buckets, labels, keep)
            if not left.isEmpty():
                large = left.filter(F.col("n") > SMALL)
                pairs = _hub_pairs(large, HUBS, keep)
                links.append(verify.links(pairs.unionByName(_pairs_of_small(left)) if small else pairs))
                labels = components(reduce(DataFrame.unionByName, links), keep)
                left = _open(large.drop("label"), labels, keep)
            return left

        left = closer(large.drop("label"), False)
        few, many = left.filter(F.col("n") <= WHOLE), left.filter(F.col("n") > WHOLE)
        if not few.isEmpty():
            links.append(_finished(few, verify, keep))
        if not many.isEmpty():
            again = keep(many.select(F.col("node").alias("_n")).distinct())
            again = verify.texts.join(_small(again), F.col("node") == F.col("_n"), "left_semi")
            anew = _buckets(_signatures(again.select(F.lit(None).alias("id"), "node", "text"), by, BANDS_2, ROWS_2, 2), keep)
            left = closer(anew, True)
            if not left.isEmpty():
                links.append(_finished(left, verify, keep))
            labels = components(reduce(DataFrame.unionByName, links), keep)
            left = _open(many.drop("label"), labels, keep)  # the longer bands miss some pairs, so what is open yet is finished too
            if not left.isEmpty():
                links.append(_finished(left, verify, keep))
        labels = components(reduce(DataFrame.unionByName, links), keep)
        own = F.when(F.col("bands").isNotNull(), F.coalesce("label", "node"))
        return checkpoint(signed.join(labels, "node", "left").select(F.col("id").cast(documents.schema[key].dataType).alias("id"), "node", own.alias("label")))


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, class_id (the least id of its class) and class_size."""
    got = _classes(documents, text, key)
    of = got.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    of = checkpoint(of)  # large classes are dealt over several tasks
    hot = _small(of.filter(F.col("n") > HOT).select(F.col("label").alias("_hot"), F.ceil(F.col("n") / HOT).alias("_k")))
    got = got.join(hot, F.col("label") == F.col("_hot"), "left")
    got = got.withColumn("salt", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("id", "node"), F.coalesce("_k", F.lit(1))))).drop("_hot", "_k")
    of = _for_all_salts(of, "label", hot).withColumnsRenamed({"label": "_l", "salt": "_s"})
    got = got.join(of, (F.col("label") == F.col("_l")) & (F.col("salt") == F.col("_s")), "left")
    one = F.col("label").isNull()
    return got.select(F.col("id").alias(key), F.when(one, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(one, F.lit(1)).otherwise(F.col("n")).alias("class_size"))


def drop_near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each class, that of least id (ties: least text hash), with its columns as they are."""
    got = _classes(documents, text, key)
    order = F.struct(F.col("id").isNull().alias("x"), "id", "node")
    first = got.filter(F.col("label").isNotNull()).groupBy(F.col("label").alias("_l")).agg(F.min(order).alias("first"))
    rest = got.join(first, F.col("label") == F.col("_l")).filter(~order.eqNullSafe(F.col("first"))).select("id", "node").distinct()
    node, other_id, other_node = fresh(documents, "node", "other_id", "other_node")
    docs = documents.withColumn(node, F.md5(F.col(text).cast("binary")))
    docs = anti_join(docs, checkpoint(rest), {key: "id", node: "node"})
    again = checkpoint(got.filter(F.col("label").isNotNull()).groupBy("id", "node").agg(F.count("*").alias("n")).filter("n > 1").select("id", "node"))
    if not again.isEmpty():  # rows equal in id and text
        marks = again.select(F.col("id").alias(other_id), F.col("node").alias(other_node))
        on = F.col(key).eqNullSafe(F.col(other_id)) & (F.col(node) == F.col(other_node))
        copies = docs.join(marks, on, "left_semi").dropDuplicates([key, node])
        docs = anti_join(docs, again, {key: "id", node: "node"}).unionByName(copies)
    return docs.drop(node)
