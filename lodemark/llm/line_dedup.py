"""Line de-duplication by a deletion-neighbourhood join over words.

The edit unit is the word and the bound is one edit: two lines are near if one
word changed, came or went. A line's variants are its words without the i-th.
Lines of equal length are within a substitution at i exactly if their variants
without i are equal, so the key is (length, i, hash) and equal keys form a
clique; a line is one word longer than another exactly if one of its variants
is the other's full text.

Hashing all variants of all lines would multiply the table by the words of a
line. One edit leaves the first or the last part of a line alone, so only lines
that share such a part with a different line can have a partner, and only the
words outside the shared part are deleted. That loses no pair. Variant groups
are reduced to their earliest line before anything is joined back, so no group
is expanded into pairs; the pairs left are verified on the words themselves.

Documents are read twice. The first time a line becomes one narrow row of its
place, hash, length and part keys, written to the shared folder; copies, shared
parts and the places to cut come from those rows. The second time only lines
that share a part are read: a bitmap of their first places lets few others
through, and an exact join drops those, so that no other text is shuffled.

A line goes if an equal or a near line came before it, in the order of doc_id,
text hash and line number. Every line that has a word is compared for equality,
and lines of at least EDIT_WORDS words, of which an edit leaves four in five, for
one edit; both bounds are parameters.

Lines that many documents share are dealt over several tasks by a salt where
their occurrences are marked.

Defined results: null and empty texts have no lines to remove; rows equal in id
and text are one document, so its copies lose the same lines; null ids come
first; texts that lose no line stay byte for byte; an empty table gives an
empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, Scratch, bit_at, bitmap, checkpoint, fresh, let

EXACT_WORDS = 1
EDIT_WORDS = 5
#: A line of more copies is dealt over several tasks.
HOT = 2048
#: So many rows of two longs are broadcast at most.
BROADCAST_ROWS = 200_000
#: Bits of the bitmap for each line that shares a part, and the bounds of their logarithm (8 MB at most).
BITS_A_LINE, LEAST_BITS, MOST_BITS = 16, 18, 26
_BLOCK = 256
_ORDER = ("doc_id", "th", "line_no")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(documents: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, th, line_no, raw) of all lines that have a word."""
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.posexplode(_lines(F.col(text))).alias("line_no", "raw"))
    return docs.filter(F.ltrim("raw", F.lit(SPACES)) != "")


def _spaced(raw: Column) -> Column:
    """A line's words with single spaces."""
    # most lines have single spaces already; a search for other white space is cheaper than a regular expression
    odd = raw.startswith(" ") | raw.endswith(" ")
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | raw.contains(x)
    return F.when(odd, F.array_join(F.regexp_extract_all(raw, F.lit(WORD), F.lit(0)), " ")).otherwise(raw)


def _occurrences(documents: DataFrame, text: str, key: str, exact: int, near_from: int) -> DataFrame:
    """(doc_id, th, line_no, lh, n, keys) of lines long enough; the keys of the shared parts of lines to compare for one edit."""
    got = _places(documents, text, key).select(*_ORDER, _spaced(F.col("raw")).alias("line"))
    got = got.select(*_ORDER, "line", F.xxhash64("line").alias("lh"), (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("n"))
    keys = F.when(F.col("n") >= near_from, _part_keys(F.col("line"), F.col("n")))
    return got.select(*_ORDER, "lh", "n", keys.alias("keys")).filter(F.col("n") >= exact)


def _part_sizes(n: Column) -> tuple[Column, Column]:
    """Words of the shared parts in the length class of n, and in the one before it."""
    eighths = F.floor(n / 8).cast("int")
    size = lambda k: F.when(k > 0, k * 4).otherwise(F.lit(2))  # noqa: E731  lines of 4 to 7 words: 2
    return size(eighths), size(eighths - 1)


def _part_keys(line: Column, n: Column) -> Column:
    """Keys of the shared first and last parts, by turns. Parts of two lines whose lengths
    differ by at most one have the same size in one of the two classes that the longer one emits."""

    def of(size: Column) -> Column:
        part = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
        return F.array(F.xxhash64(F.lit("head"), part(size)), F.xxhash64(F.lit("tail"), part(-size)))

    size, before = _part_sizes(n)
    return F.when(n % 8 == 0, F.concat(of(size), of(before))).otherwise(of(size))


def _xor(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def _running_xor(a: Column) -> Column:
    """n + 1 prefix values of a non-empty array; in blocks, so that long lines cost little more than their length."""
    scan = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))
    zero = F.lit(0).cast("long")
    starts = F.sequence(F.lit(1), F.size(a), F.lit(_BLOCK))

    def blocks(parts: Column) -> Column:
        at = scan(F.transform(parts, _xor), zero)
        inner = let(at, lambda s: F.flatten(F.transform(parts, lambda p, b: F.slice(scan(p, F.get(s, b)), F.lit(2), F.size(p)))))
        return F.concat(F.array(zero), inner)

    return let(F.transform(starts, lambda s: F.slice(a, s, F.lit(_BLOCK))), blocks)


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, lh): S keys of substitutions; F (full) and D (one word deleted) keys where lengths differ."""
    w, n, g = F.col("w"), F.col("n"), F.col("parts")
    got = lines.withColumn("w", F.split("line", " ", -1)).withColumn("n", F.size("w"))
    ranges = F.transform(g, lambda x: F.when(x["part"] == "head", F.sequence(x["size"], n - 1)).otherwise(F.sequence(F.lit(0), n - x["size"] - 1)))
    got = got.withColumn("at", F.array_distinct(F.flatten(ranges)))
    got = got.withColumn("mixed", F.exists(g, lambda x: x["mixed"]))
    got = got.withColumn("m", F.transform(w, lambda x, i: F.xxhash64(i, x))).withColumn("whole", _xor(F.col("m")))
    row = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))
    subs = F.transform("at", lambda i: row(F.xxhash64(F.lit("S"), n, i, F.col("whole").bitwiseXOR(F.get("m", i))), "S"))
    pre = F.when(F.col("mixed"), _running_xor(F.col("m")))
    post = F.when(F.col("mixed"), _running_xor(F.transform(w, lambda x, i: F.xxhash64(i - 1, x))))
    got = got.withColumn("subs", subs).withColumn("pre", pre).withColumn("post", post)
    without = lambda i: F.get("pre", i).bitwiseXOR(F.get("post", n)).bitwiseXOR(F.get("post", i + 1))
    indel = F.concat(
        F.array(row(F.xxhash64(F.lit("I"), n, F.col("whole")), "F")),
        F.transform("at", lambda i: row(F.xxhash64(F.lit("I"), n - 1, without(i)), "D")),
    )
    got = got.select("lh", F.explode(F.when(F.col("mixed"), F.concat("subs", indel)).otherwise(F.col("subs"))).alias("v"))
    return got.select(F.col("v.key").alias("key"), F.col("v.role").alias("role"), "lh")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one substituted, added or removed word."""
    swapped = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)) <= 1

    def added(long: Column, short: Column) -> Column:
        differs = F.transform(short, lambda x, i: x != F.get(long, i))
        j = let(F.array_position(differs, True).cast("int"), lambda p: F.when(p == 0, F.size(short)).otherwise(p - 1))
        return let(j, lambda k: F.slice(long, k + 2, F.size(short) - k) == F.slice(short, k + 1, F.size(short) - k))

    by = F.size(a) - F.size(b)
    return F.when(by == 0, swapped).when(by == 1, added(a, b)).when(by == -1, added(b, a)).otherwise(F.lit(False))


def _texts(near: DataFrame, documents: DataFrame, text: str, key: str) -> DataFrame:
    """near (lh, o) with the line itself, read at its first place."""
    place = F.xxhash64(*_ORDER)
    near = near.withColumn("place", F.xxhash64(*[F.col(f"o.{c}") for c in _ORDER]))
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_LINE * near.count()).bit_length()))
    listed = bitmap(near.select(F.col("place").alias("h")), bits)
    got = _places(documents, text, key).filter(bit_at(listed.scalar(), place, bits))
    got = got.select(place.alias("place"), _spaced(F.col("raw")).alias("line")).withColumn("lh", F.xxhash64("line"))
    # copies of a document have the same places
    return near.join(got.groupBy("place", "lh").agg(F.min("line").alias("line")), ["place", "lh"]).drop("place")


def removed_lines(documents: DataFrame, text: str = "text", key: str = "doc_id", exact: int = EXACT_WORDS, near_from: int = EDIT_WORDS) -> DataFrame:
    """(doc_id, th, line_no, kept_doc_id, kept_line_no): each removed line and the earliest line it repeats.
    Lines of `exact` words and more are compared for equality, of `near_from` (4 at least) and more for one edit."""
    with Scratch(documents.sparkSession, "lines") as keep:
        return checkpoint(_removed(keep(_occurrences(documents, text, key, exact, near_from)), documents, text, key))


def _removed(occ: DataFrame, documents: DataFrame, text: str, key: str) -> DataFrame:
    distinct = occ.groupBy("lh").agg(F.min(F.struct(*_ORDER, "n", "keys")).alias("first"), F.count("*").alias("copies"))
    # naming copies keeps the aggregation as it is below, so that its exchange is reused
    keys = distinct.filter(F.col("first.keys").isNotNull() & (F.col("copies") > 0))
    keys = keys.select("lh", F.col("first.n").alias("n"), F.posexplode("first.keys").alias("at", "hk"))
    shared = keys.groupBy("hk").agg(F.min("lh").alias("a"), F.max("lh").alias("b"), (F.min("n") != F.max("n")).alias("mixed"))
    shared = shared.filter("a <> b").select("hk", "mixed")
    size, before = _part_sizes(F.col("n"))
    part = F.when(F.col("at") % 2 == 0, "head").otherwise("tail").alias("part")
    one = F.struct(part, F.when(F.col("at") < 2, size).otherwise(before).alias("size"), "mixed")
    flagged = keys.join(shared, "hk").groupBy("lh").agg(F.collect_list(one).alias("parts"))
    lines = distinct.join(flagged, "lh", "left").filter(F.col("parts").isNotNull() | (F.col("copies") > 1))
    lines = checkpoint(lines.select("lh", "copies", "parts", F.struct(*[F.col(f"first.{c}") for c in _ORDER]).alias("o")))

    near = checkpoint(_texts(lines.filter(F.col("parts").isNotNull()).drop("copies"), documents, text, key))
    variants = _variants(near.select("lh", "line", "parts"))
    met = variants.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).filter("a <> b").select("key")
    orders = near.select("lh", "o")
    met = checkpoint(variants.join(met, "key").join(orders, "lh").select("key", "role", F.struct("o", "lh").alias("me")))
    firsts = met.groupBy("key").agg(
        F.min(F.when(F.col("role") != "D", F.col("me"))).alias("full"), F.min(F.when(F.col("role") != "F", F.col("me"))).alias("cut")
    )
    partner = F.when(F.col("role") == "F", F.col("cut")).otherwise(F.col("full"))
    pairs = met.join(firsts, "key").select("me", partner.alias("p")).filter(F.col("p.o") < F.col("me.o"))
    pairs = pairs.select(F.col("me.lh").alias("lh"), F.col("p.o").alias("po"), F.col("p.lh").alias("plh")).distinct()
    texts = near.select(F.col("lh").alias("plh"), F.split("line", " ", -1).alias("pw"))
    pairs = pairs.join(near.select("lh", F.split("line", " ", -1).alias("w")), "lh").join(texts, "plh")
    pairs = pairs.filter(within_one_edit(F.col("w"), F.col("pw"))).groupBy("lh").agg(F.min("po").alias("po"))  # verified before the earliest is chosen

    gone = lines.join(pairs, "lh", "left").filter(F.col("po").isNotNull() | (F.col("copies") > 1)).select("lh", "copies", "o", "po")
    gone = checkpoint(gone)
    hot = gone.filter(F.col("copies") > HOT).select(F.col("lh").alias("hot"), F.ceil(F.col("copies") / HOT).alias("salts"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / HOT) - 1))
    gone = gone.select("lh", F.when(F.col("copies") > HOT, F.col("copies")).otherwise(F.lit(1)).alias("copies"), "o", "po").withColumn("salt", salts)
    dealt = occ.select("lh", *_ORDER).join(hot, F.col("lh") == F.col("hot"), "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(*_ORDER), F.coalesce("salts", F.lit(1)))).drop("hot", "salts")
    mine = F.struct(*[F.col(c) for c in _ORDER])
    cut = dealt.join(gone, ["lh", "salt"]).filter(F.col("po").isNotNull() | ~mine.eqNullSafe(F.col("o")))
    to = F.coalesce("po", "o")
    return cut.select(*_ORDER, to["doc_id"].alias("kept_doc_id"), to["line_no"].alias("kept_line_no"))


def _per_document(documents: DataFrame, text: str, key: str, exact: int, near_from: int) -> DataFrame:
    cut = removed_lines(documents, text, key, exact, near_from)
    return cut.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def line_report(documents: DataFrame, text: str = "text", key: str = "doc_id", exact: int = EXACT_WORDS, near_from: int = EDIT_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the removed line numbers (from 0, comma-joined)."""
    docs = documents.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.size(_lines(F.col(text))).cast("long").alias("n_lines"))
    marked = _per_document(documents, text, key, exact, near_from).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    got = docs.join(marked, docs["doc_id"].eqNullSafe(marked["_id"]) & (docs["th"] == marked["_th"]), "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return got.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"))


def dedup_lines(
    documents: DataFrame, text: str = "text", key: str = "doc_id", drop_emptied: bool = True, exact: int = EXACT_WORDS, near_from: int = EDIT_WORDS
) -> DataFrame:
    """The documents without their removed lines; one that had words and has none left goes if drop_emptied."""
    th, other_id, other_th, removed = fresh(documents, "text_hash", "other_id", "other_hash", "removed")
    docs = documents.withColumn(th, F.xxhash64(F.col(text)))
    marked = _per_document(documents, text, key, exact, near_from).withColumnsRenamed({"doc_id": other_id, "th": other_th, "removed": removed})
    got = docs.join(marked, F.col(key).eqNullSafe(F.col(other_id)) & (F.col(th) == F.col(other_th)), "left")
    lines = _lines(F.col(text))
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), removed), lambda i: F.get(x, i)), "\n"))
    cleaned = F.when(F.col(removed).isNull(), F.col(text)).otherwise(left)
    got = got.withColumn(text, cleaned)
    if drop_emptied:
        got = got.filter(F.col(removed).isNull() | F.col(text).rlike(WORD))
    return got.select(*documents.columns)
