"""Benchmark decontamination by hashed word windows.

Every window of WINDOW consecutive benchmark words (a shorter item is one
window) is hashed. A document's windows are hashed in place and looked up in a
bitmap of fixed size, which only lets through windows that may be listed; those
few leave the row with their words, meet the listed windows in a hash join and
count only where the words are equal. No text is shuffled: what is regrouped
per document are the verified hits.

The bitmap has about BITS_A_WINDOW bits for each listed window, which are
counted first, and at most 2**MOST_BITS (8 MB): about one window in 16 of those
not listed passes it up to four million listed ones, and beyond that more pass
to the exact join and none is lost. The listed windows are broadcast only if
there are at most BROADCAST_WINDOWS.

Defined results: null and empty texts have no words and no hits; an empty
benchmark contaminates nothing; an item without words has no window; items with
a null id mark words but have no id to report; repeated rows are judged alike,
each for itself; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_at, checkpoint, fresh
from .common import bitmap as _bits

WINDOW = 13
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 16, 18, 26
BROADCAST_WINDOWS = 200_000
#: Rows of an id, a hash and at most a few hit positions.
BROADCAST_ROWS = 100_000


def ascii_lower(word: Column) -> Column:
    """A-Z only; lower() alone would also change other letters."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, ascii_lower)


def _hash(hashes: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(length)])


def listed_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(h, size, gram, items): each distinct window with its word count, its words and the sorted items that have it."""
    got = benchmark.select(F.col(key).cast("string").alias("item"), tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    got = got.withColumn("size", F.least(F.size("w"), F.lit(window)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))
    got = got.select("item", "size", F.explode(grams).alias("gram"))
    got = got.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashes = F.transform("gram", lambda w: F.xxhash64(w))
    pick = F.lit(None).cast("long")
    for n in range(1, window + 1):
        pick = F.when(F.col("size") == n, _hash(hashes, F.lit(0), n)).otherwise(pick)
    return got.select(pick.alias("h"), "size", "gram", "items")


def contamination_report(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), window: int = WINDOW
) -> DataFrame:
    """Per document row: key, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (positions), and the columns in keep."""
    listed = checkpoint(listed_windows(benchmark, window=window))
    sizes = {r["size"]: r["n"] for r in listed.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    count = sum(sizes.values())
    few, n_bits = count <= BROADCAST_WINDOWS, min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * count).bit_length()))
    names = ("rid", "w", "h", "cand", "hit", "bitmap", "n_words", "items", "_h", "_size", "_gram")
    rid, w, h, cand, hit, bitmap, n_words, items, _h, _size, _gram = fresh(documents, *names)
    docs = documents.select(key, *keep, F.monotonically_increasing_id().alias(rid), tokens(F.col(text)).alias(w))
    docs = docs.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    docs = docs.withColumn(bitmap, _bits(listed, n_bits).scalar())

    def candidates(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        hashed = F.transform(at, lambda i: F.struct(_hash(F.col(h), i, n).alias("h"), i.alias("i")))
        passed = F.filter(hashed, lambda x: bit_at(F.col(bitmap), x["h"], n_bits))
        rows = F.transform(passed, lambda x: F.struct(x["h"], F.lit(n).alias("size"), x["i"], F.slice(w, x["i"] + 1, n).alias("gram")))
        return F.when(F.size(w) >= n, rows)

    found = F.lit(None)
    if sizes:
        empty = F.expr("cast(array() as array<struct<h: bigint, size: int, i: int, gram: array<string>>>)")
        found = F.concat(*[F.coalesce(candidates(n), empty) for n in sorted(sizes)])
        docs = docs.select(key, *keep, rid, F.size(w).cast("long").alias(n_words), F.explode_outer(found).alias(cand))
        right = listed.select(F.col("h").alias(_h), F.col("size").alias(_size), F.col("gram").alias(_gram), F.col("items").alias(items))
        right = F.broadcast(right) if few else right
        c = F.col(cand)
        docs = docs.join(right, (c["h"] == F.col(_h)) & (c["size"] == F.col(_size)) & (c["gram"] == F.col(_gram)), "left")
        hits = F.when(F.col(items).isNotNull(), F.struct(F.col(cand)["i"].alias("i"), F.col(cand)["size"].alias("n"), F.col(items).alias("items")))
    else:
        docs = docs.select(key, *keep, rid, F.size(w).cast("long").alias(n_words))
        hits = F.expr("cast(null as struct<i: int, n: int, items: array<string>>)")
    first = [F.first(c).alias(c) for c in (key, *keep, n_words)]
    docs = docs.groupBy(rid).agg(*first, F.array_sort(F.collect_list(hits)).alias(hit)).drop(rid)

    inside = F.flatten(F.transform(hit, lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1)))
    docs = docs.withColumn("hit_words", F.array_sort(F.array_distinct(inside)))
    docs = docs.withColumn("item_ids", F.array_sort(F.array_distinct(F.flatten(F.transform(hit, lambda x: x["items"])))))
    docs = docs.withColumn("n_hit", F.size("hit_words").cast("long"))
    return docs.select(
        key, *keep, F.col(n_words).alias("n_words"), "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col(n_words))).alias("contaminated"), "hit_words",
    )


def _keyed(documents: DataFrame, text: str) -> tuple[DataFrame, str]:
    (th,) = fresh(documents, "text_hash")
    return documents.withColumn(th, F.xxhash64(F.col(text))), th


def _joined(documents: DataFrame, marked: DataFrame, key: str, th: str, how: str) -> DataFrame:
    """Join on id and text hash, nulls equal; broadcast only a counted, bounded side."""
    other_key, other_th = fresh(documents, "other_key", "other_hash")
    right = marked.withColumnsRenamed({key: other_key, th: other_th})
    right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
    return documents.join(right, F.col(key).eqNullSafe(F.col(other_key)) & (F.col(th) == F.col(other_th)), how)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    docs, th = _keyed(documents, text)
    report = contamination_report(docs, benchmark, text, key, (th,))
    marked = checkpoint(report.filter("contaminated").select(key, th).distinct())
    return _joined(docs, marked, key, th, "left_anti").drop(th)


def remove_spans(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All documents; in contaminated ones the hit words go, and what stands between words stays."""
    docs, th = _keyed(documents, text)
    report = contamination_report(docs, benchmark, text, key, (th,))
    (cut_words,) = fresh(docs, "hit_words")
    marked = checkpoint(report.filter("contaminated").select(key, th, F.col("hit_words").alias(cut_words)).dropDuplicates([key, th]))
    got = _joined(docs, marked, key, th, "left")
    raw = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    between = F.split(F.col(text), TOKEN, -1)
    kept = F.transform(raw, lambda w, i: F.concat(F.when(F.array_contains(cut_words, i), F.lit("")).otherwise(w), F.get(between, i + 1)))
    cut = F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    return got.select(*[F.when(F.col(cut_words).isNotNull(), cut).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in documents.columns])
