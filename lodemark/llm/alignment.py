"""Alignment of two tokenizers' tokens by packed bitsets of their ends.

Every token of either side ends at a byte; a side's ends are the set bits of a
packed bitset over the text's bytes. AND of the two gives the shared cuts.
Popcounts before a cut (rank) say how many tokens of a side lie before it, so
consecutive cuts name the token ranges of one group on both sides, and a
group's links are all pairs of its two ranges.

Both tokenizers always end a token before a space or line feed that stands
alone, so texts without runs of white space are cut there, and each distinct
unit of a batch is encoded and aligned once, all new units of a batch in one
bitset; the results are kept for about CACHE_UNITS units a worker. Texts with
other white space are aligned whole by the unmodified libraries.

The first pass writes, per document, its figures and the id pairs it links with
their multiplicities to a scratch table in the shared folder. A pair's count is
its number of documents, added up with map-side combine; the second pass joins
the counts to the documents' pairs. They are broadcast only if they are
counted to be at most PAIRS rows; otherwise both sides carry a salt, so that a
pair that most documents hold is dealt over SALTS tasks.

Defined results: a text that is null or empty, or whose joined bytes of either
side differ from space+text (U+2581 reads as a space), has no tokens: zeros and
an empty groups_sha256. Repeated rows and equal or null ids each count as one
document and have one row each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordCache, checkpoint, small_batches
from .token_files import BYTE_CHARS, STRANGE_RE2, WordTokenizer

CACHE_UNITS = 400_000
#: Bytes of text that are aligned at a time: what is held besides the cache grows with them.
SLICE_BYTES = 2 << 20
#: Most rows of pair counts that are broadcast (about 64 MB), and over how many tasks a pair is dealt otherwise.
PAIRS, SALTS = 2_000_000, 16
#: Groups of more links than this are counted by their distinct ids on each side.
LARGE_GROUP = 1024
_ODD = rf"^[ \n]|[ \n]$|[ \n][ \n]|{STRANGE_RE2}"
_A_SHIFT = 32


class Bits:
    """A packed bitset of token ends: bit e-1 for an end at byte e."""

    def __init__(self, ends: np.ndarray, n_bytes: int):
        flags = np.zeros((n_bytes + 63) // 64 * 64, dtype=bool)
        flags[ends - 1] = True
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype="i8")])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ends at bytes up to and with each of at."""
        word, bit = (at - 1) >> 6, ((at - 1) & 63).astype("u8")
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def shared(self, other: Bits) -> np.ndarray:
        """Bytes where both end a token, ascending."""
        return np.flatnonzero(np.unpackbits((self.words & other.words).view("u1"), bitorder="little")) + 1


class Groups(NamedTuple):
    """Token ranges [a[g], a[g + 1]) and [b[g], b[g + 1]) of each group, and the byte where it ends."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Groups:
    """Groups of two token sequences over the same bytes, given each token's number of bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    n = int(a_ends[-1]) if len(a_ends) else 0
    if n != (int(b_ends[-1]) if len(b_ends) else 0):
        raise ValueError("the two sides have different bytes")
    a, b = Bits(a_ends, n), Bits(b_ends, n)
    cuts = a.shared(b)
    start = np.zeros(1, dtype="i8")
    return Groups(np.concatenate([start, a.rank(cuts)]), np.concatenate([start, b.rank(cuts)]), cuts)


def links(groups: Groups, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every link's id pair (a << 32 | b), how often it stands for, and its group; a large group's equal pairs are one entry."""
    na, nb = np.diff(groups.a), np.diff(groups.b)
    n = np.where(na * nb > LARGE_GROUP, 0, na * nb)
    g = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    pairs = (a_ids[groups.a[g] + inside // nb[g]] << _A_SHIFT) | b_ids[groups.b[g] + inside % nb[g]]
    out, times, of = [pairs], [np.ones(len(g), dtype="i8")], [g]
    for big in np.flatnonzero(na * nb > LARGE_GROUP).tolist():
        x, nx = np.unique(a_ids[groups.a[big] : groups.a[big + 1]], return_counts=True)
        y, ny = np.unique(b_ids[groups.b[big] : groups.b[big + 1]], return_counts=True)
        out.append(((x[:, None] << _A_SHIFT) | y).ravel())
        times.append((nx[:, None] * ny).ravel())
        of.append(np.full(len(x) * len(y), big))
    return np.concatenate(out), np.concatenate(times), np.concatenate(of)


class Unit(NamedTuple):
    """What one unit of text gives; pairs as bytes of longs, times too where a pair is linked more than once."""

    good: bool
    groups: str
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    pairs: bytes
    times: bytes


_NOTHING = Unit(True, "", 0, 0, 0, 0, b"", b"")
_BAD = _NOTHING._replace(good=False)


class Table:
    """The bytes of every token of one side."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), "i8", len(tokens))
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), dtype="u1")

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[np.repeat(self.starts[ids], sizes) + inside].tobytes()


class Side(NamedTuple):
    """The ids of some units, one after the other, and how many each has."""

    ids: np.ndarray
    counts: np.ndarray

    def bytes_of(self, table: Table) -> np.ndarray:
        """Of each unit."""
        ends = np.concatenate([[0], np.cumsum(table.sizes[self.ids])])[np.concatenate([[0], np.cumsum(self.counts)])]
        return np.diff(ends)


def _side(parts: list[list[int]]) -> Side:
    counts = np.fromiter(map(len, parts), "i8", len(parts))
    return Side(np.fromiter(chain.from_iterable(parts), "i8", int(counts.sum())), counts)


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, bytes_path: str, pieces_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = WordTokenizer(bytes_path, plain=True), SentencePieceProcessor(model_file=pieces_path)
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        byte_of = {chr(c): b for b, c in BYTE_CHARS.items()}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.tables = Table(tokens), Table([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces])
        self.units = WordCache(self.made, CACHE_UNITS)

    def _ids(self, units: list[str], whole: bool) -> tuple[Side, Side]:
        """Of units that begin with a space, or with a line feed that a word follows."""
        if whole:
            a = _side([x.ids for x in self.a.tokenizer.encode_batch_fast(units, add_special_tokens=False)])
            return a, _side(self.b.encode([u[1:] for u in units], num_threads=1))
        feeds = [u[0] == "\n" for u in units]
        raw = self.a.of_words([u[1:] if f else u for u, f in zip(units, feeds, strict=True)])
        if any(feeds):
            feed = self.a.of_words(["\n"])[0]
            raw = [feed + x if f else x for x, f in zip(raw, feeds, strict=True)]
        a = Side(np.frombuffer(b"".join(raw), dtype="<u4").astype("i8"), np.fromiter(map(len, raw), "i8", len(raw)) // 4)
        pieces = self.b.encode([u if f else u[1:] for u, f in zip(units, feeds, strict=True)], num_threads=1)
        return a, _side([x[1:] if f else x for x, f in zip(pieces, feeds, strict=True)])

    def made(self, units: list[str], whole: bool = False) -> list[Unit]:
        """All units that are right on both sides are aligned in one bitset; a unit's end is a shared cut."""
        out = dict.fromkeys(units, _NOTHING)
        full = [u for u in out if u]
        while full:
            sides, sizes = self._ids(full, whole), np.fromiter((len(u.encode()) for u in full), "i8", len(full))
            want = "".join(full).encode()
            if all((x.bytes_of(t) == sizes).all() and t.joined(x.ids) == want for x, t in zip(sides, self.tables, strict=True)):
                out.update(zip(full, self._aligned(*sides), strict=True))
                break
            if len(full) == 1:
                out[full[0]] = _BAD
                break
            single = [self._right(u, whole) for u in full]  # rare: texts that a tokenizer does not keep
            out.update((u, _BAD) for u, right in zip(full, single, strict=True) if not right)
            full = [u for u, right in zip(full, single, strict=True) if right]
        return [out[u] for u in units]

    def _right(self, unit: str, whole: bool) -> bool:
        return all(t.joined(x.ids) == unit.encode() for x, t in zip(self._ids([unit], whole), self.tables, strict=True))

    def _aligned(self, a: Side, b: Side) -> Iterator[Unit]:
        g = align(self.tables[0].sizes[a.ids], self.tables[1].sizes[b.ids])
        pairs, times, of = links(g, a.ids, b.ids)
        rank = np.argsort(of, kind="stable")
        pairs, times, of = pairs[rank], times[rank], of[rank]
        last = np.searchsorted(g.a[1:], np.cumsum(a.counts))  # the group that ends each unit
        first = np.concatenate([[0], last[:-1] + 1])
        sums = np.concatenate([[0], np.cumsum(np.diff(g.a) * np.diff(g.b))])
        at = np.searchsorted(of, np.concatenate([first, [last[-1] + 1]]))
        more = np.add.reduceat(times, at[:-1]) > np.diff(at)
        x, y, ga, gb = list(map(str, a.ids.tolist())), list(map(str, b.ids.tolist())), g.a.tolist(), g.b.tolist()
        parts = [
            f"{x[p] if q == p + 1 else ','.join(x[p:q])}|{y[r] if s == r + 1 else ','.join(y[r:s])}"
            for p, q, r, s in zip(ga, ga[1:], gb, gb[1:], strict=False)
        ]
        raw, often, at = pairs.tobytes(), times.tobytes(), (8 * at).tolist()
        numbers = (x.tolist() for x in (first, last, a.counts, b.counts, sums[last + 1] - sums[first], more))
        for p, q, f, t, n_a, n_b, n, m in zip(at, at[1:], *numbers, strict=False):
            yield Unit(True, parts[f] if f == t else ";".join(parts[f : t + 1]), n_a, n_b, t + 1 - f, n, raw[p:q], often[p:q] if m else b"")

    def documents(self, texts: pa.Array) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """Of each text [n_a, n_b, n_groups, n_links], the groups' hash, the distinct pairs and how often each is linked."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        spaced = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(" ", plain, ""))
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(spaced, "\n", "\0\n"), " ", "\0 "), "\0")
        words = cut.flatten().dictionary_encode()
        known, index = self.units.of(words.dictionary.to_pylist()), words.indices.to_numpy()
        strings, pairs = [u.groups for u in known], [u.pairs for u in known]
        sizes, good = np.fromiter(map(len, pairs), "i8", len(pairs)) // 8, np.fromiter((u.good for u in known), "?", len(known))
        times = {i: np.frombuffer(u.times, dtype="i8") for i, u in enumerate(known) if u.times}
        figures = np.array([u[2:6] for u in known], dtype="i8").reshape(-1, 4)
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        sums = np.concatenate([np.zeros((1, 4), dtype="i8"), np.cumsum(figures[index], axis=0)])[offsets]
        sums = (sums[1:] - sums[:-1]).tolist()
        none = np.empty(0, dtype="i8")
        for i, is_odd in enumerate(odd.tolist()):
            if is_odd:
                unit = self.made([" " + texts[i].as_py()], whole=True)[0]
                found = np.frombuffer(unit.pairs, dtype="i8")
                often = np.frombuffer(unit.times, dtype="i8") if unit.times else np.ones(len(found), dtype="i8")
                yield (list(unit[2:6]), _hash(unit.groups), *_distinct(found, often)) if unit.good else ([0] * 4, "", none, none)
                continue
            at = index[offsets[i] : offsets[i + 1]][1:]  # the first is what stands before the first unit: nothing
            u, n = np.unique(at, return_counts=True)
            if not len(u) or not good[u].all():
                yield [0] * 4, "", none, none
                continue
            chosen = u.tolist()
            often = np.repeat(n, sizes[u])
            if times and not times.keys().isdisjoint(chosen):
                often *= np.concatenate([times.get(k, np.ones(sizes[k], dtype="i8")) for k in chosen])
            found = np.frombuffer(b"".join([pairs[k] for k in chosen]), dtype="i8")
            yield sums[i], _hash(";".join([strings[k] for k in at.tolist()])), *_distinct(found, often)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _distinct(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each is linked."""
    rank = np.argsort(pairs)
    pairs, times = pairs[rank], times[rank]
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[at], np.add.reduceat(times, at)


_BUILT: dict[tuple[str, str], Aligner] = {}


def _of(*paths: str) -> Aligner:
    if paths not in _BUILT:
        _BUILT[paths] = Aligner(*paths)
    return _BUILT[paths]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about SLICE_BYTES of text; a longer text is a slice of its own."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for x, y in zip(edges, edges[1:], strict=False):
        if y > x:
            yield batch.slice(x, y - x)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate([np.empty(0, dtype="i8"), *parts])))


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def linked_pairs(documents: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the key, FIGURES, groups_sha256, and its distinct linked id pairs with how often it links each."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _of(bytes_path, pieces_path)
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            got = list(aligner.documents(batch.column(1)))
            figures = np.array([x[0] for x in got], dtype="i8").reshape(-1, 4)
            columns = [batch.column(0), *[pa.array(figures[:, j]) for j in range(4)], pa.array([x[1] for x in got], pa.string()), _lists([x[2] for x in got]), _lists([x[3] for x in got])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *FIGURES, "groups_sha256", "pairs", "times"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, pairs array<long>, times array<long>")


def align_documents(documents: DataFrame, bytes_path: str, pieces_path: str, text: str = "text", key: str = "doc_id", most: int = PAIRS) -> DataFrame:
    """Per document the key, FIGURES, n_best, count_sum and groups_sha256; most is the bound of the broadcast."""
    with Scratch(documents.sparkSession, "aligned") as keep:
        docs = keep(linked_pairs(documents, bytes_path, pieces_path, text, key).withColumn("rid", F.monotonically_increasing_id()))
        counts = docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
        best = F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", _A_SHIFT)))  # at most the other side's vocabulary a window
        counts = keep(counts.select("pair", "count", best.alias("best")))
        each = docs.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        if counts.count() <= most:
            met = each.join(F.broadcast(counts), "pair")
        else:
            salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = each.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
        sums = met.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return checkpoint(docs.drop("pairs", "times").join(sums, "rid", "left").select(key, *FIGURES, zero("n_best"), zero("count_sum"), "groups_sha256"))
