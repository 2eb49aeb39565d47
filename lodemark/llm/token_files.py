"""Token-id files with shuffled byte planes.

Documents are range-partitioned and sorted by id; each partition becomes one
shard of consecutive chunks, each chunk a row of a Parquet container so that
Spark's committer makes a write atomic and any store that Spark reads will do.
A chunk holds whole documents, about CHUNK_IDS ids. Its ids are cut into blocks
of BLOCK_IDS; a block is transposed into its four byte planes (all first bytes,
then all second bytes, ...) and each plane is compressed with zstandard, which
finds the high planes nearly empty. The chunk index gives each plane's end in
the payload, so a reader can fetch a block without its neighbours; chunks carry
their number, documents and lengths, so they are read back independently.

Text is cut into words with the space before them, where the tokenizer's own
splitter always cuts, and each distinct word of a batch is encoded once and kept
in a cache of CACHE_WORDS entries per worker. Words of ASCII and Latin-1 letters
are cut into the splitter's units and given to the library's merges many at a
time; all other words, and whole texts with white space other than spaces and
line feeds or with the string of an added token, go through the whole tokenizer.

Defined results: a null or empty text is its end id alone; null ids come first;
rows of equal id are ordered by text hash and text; an empty table gives no
chunk; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, small_batches, split_words

END_ID = 2
BLOCK_IDS = 65_536
#: Small enough that a batch of chunks fits a worker.
CHUNK_IDS = 262_144
PLANES = 4
CACHE_WORDS = 800_000
#: A shard is one partition of about so many bytes of text.
SHARD_BYTES = 32 << 20
CHUNKS = "shard int, chunk int, doc_ids array<long>, lengths array<long>, ends array<long>, payload binary"
# Letters, digits and the rest of the characters whose class is beyond doubt, and the splitter's units over them.
_LETTER, _OTHER = "a-zA-ZÀ-ÖØ-öø-ÿ", "!-/:-@\\[-`{-~"
_SAFE = re.compile(f" ?[{_LETTER}0-9{_OTHER}]+")
_UNITS = re.compile(f" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[{_OTHER}]+")
#: Byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the others from U+0100 on in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
#: White space that is cut elsewhere, and characters on which libraries disagree.
_STRANGE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
STRANGE_RE2 = _STRANGE.pattern.replace("\0", r"\x00")
#: Where the splitter cuts around spaces and line feeds: a space goes with the word after it, what is before it in a run is one unit.
_PIECES = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")


class WordTokenizer:
    """Encoder of one worker: ids of texts as little-endian unsigned 32-bit bytes. plain: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.merges = Tokenizer(self.tokenizer.model)  # units, already in byte characters, one a line
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype="i8")
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([r"^[ \n]|[ \n]$|[ \n][ \n]", STRANGE_RE2, *map(re.escape, self.added)])
        self.words = WordCache(self.of_words, CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Units met before are known; the merges of all others come back in a row. A unit is as long as its
        tokens, and a word as its units, which tells whose they are."""
        safe = list(map(bool, map(_SAFE.fullmatch, words)))
        units = _UNITS.findall("\n".join(compress(words, safe)))
        known = {u: self.words.get(u) for u in dict.fromkeys(units)}
        new = [u for u, x in known.items() if x is None]
        # one translation for all: the separator is not a byte character
        lines = "\n".join(new).encode().decode("latin-1").translate(BYTE_CHARS | {10: 10})
        ids = np.array(self.merges.encode_batch_fast([lines], add_special_tokens=False)[0].ids if new else [], dtype="<u4")
        cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u.encode()) for u in new]), side="right")).tolist()
        raw = ids.tobytes()
        known.update((u, raw[x:y]) for u, x, y in zip(new, [0, *cuts], cuts, strict=False))
        given = [known[u] for u in units]
        lengths = [len(w) if s else 0 for w, s in zip(words, safe, strict=True)]
        cuts = np.searchsorted(np.cumsum(list(map(len, units))), np.cumsum(lengths), side="right").tolist()
        cut = zip(words, safe, [0, *cuts], cuts, strict=False)
        return [self._whole(w) if not s else given[x] if y == x + 1 else b"".join(given[x:y]) for w, s, x, y in cut]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. Those with runs of white space are cut by hand, those with strange characters are encoded whole."""
        odd = pc.match_substring_regex(texts, self.odd)
        got = self.words.join(split_words(pc.if_else(pc.fill_null(odd, True), "", texts), " "))
        for i in np.flatnonzero(pc.fill_null(odd, False).to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            whole = _STRANGE.search(text) or any(x in text for x in self.added)
            got[i] = self._whole(text) if whole else self.words.join(pa.array([_PIECES.findall(text)]))[0]
        return got


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Payload and index of a chunk: planes of each block, and where each plane ends."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    out, ends, at = [], [], 0
    for start in range(0, len(ids), BLOCK_IDS):
        block = np.ascontiguousarray(ids[start : start + BLOCK_IDS], dtype="<u4").view("u1").reshape(-1, PLANES)
        for plane in block.T:
            out.append(squeeze(plane.tobytes()))
            at += len(out[-1])
            ends.append(at)
    return b"".join(out), ends


def unpack(payload: bytes, ends: list[int], blocks: range | None = None) -> np.ndarray:
    """Ids of all blocks of a chunk, or of the given ones."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    out = []
    for b in blocks if blocks is not None else range(len(ends) // PLANES):
        edges = [ends[b * PLANES - 1] if b else 0, *ends[b * PLANES : (b + 1) * PLANES]]
        planes = [np.frombuffer(expand(payload[x:y]), dtype="u1") for x, y in zip(edges, edges[1:], strict=False)]
        out.append(np.stack(planes, axis=1).reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.empty(0, dtype="<u4")


_SCHEMA = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("doc_ids", "lengths", "ends")], ("payload", pa.binary())]
)
_BUILT: dict[str, WordTokenizer] = {}


def _of(path: str) -> WordTokenizer:
    if path not in _BUILT:
        _BUILT[path] = WordTokenizer(path)
    return _BUILT[path]


def _chunk(shard: int, number: int, ids: list, parts: list[bytes]) -> pa.RecordBatch:
    payload, ends = pack(np.frombuffer(b"".join(parts), dtype="<u4"))
    row = {"shard": shard, "chunk": number, "doc_ids": ids, "lengths": [len(x) // 4 for x in parts], "ends": ends, "payload": payload}
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def encode_chunks(documents: DataFrame, tokenizer_path: str, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per chunk, in the columns CHUNKS; shards are ranges of the key, a column of whole numbers."""
    small_batches(documents.sparkSession)
    tie = F.xxhash64("text")
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard = _of(tokenizer_path), TaskContext.get().partitionId()
        ids, parts, size, number = [], [], 0, 0
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1)), strict=True):
                ids.append(doc_id)
                parts.append(encoded + end)
                size += len(parts[-1])
                if size >= 4 * CHUNK_IDS:
                    yield _chunk(shard, number, ids, parts)
                    ids, parts, size, number = [], [], 0, number + 1
        if parts:
            yield _chunk(shard, number, ids, parts)

    return docs.mapInArrow(run, CHUNKS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """Of each chunk its shard and number, the ids of its documents, all its token ids and where each document begins."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            at = np.concatenate([[0], np.cumsum(np.array(row["lengths"], dtype="i8"))])
            yield row["shard"], row["chunk"], row["doc_ids"], unpack(row["payload"], row["ends"]), at


def read_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the chunks."""
    small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, chunk, doc_ids, ids, at in _unpacked(batches):
            n = len(doc_ids)
            crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at, at[1:], strict=False)]
            cols = [pa.array([shard] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = chunks.mapInArrow(run, "shard int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = chunks.select("shard", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda *part: Window.partitionBy(*part).orderBy("shard" if not part else "chunk").rowsBetween(Window.unboundedPreceding, -1)
    shard_at = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("shard_at"))
    chunk_at = sizes.select("shard", "chunk", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("chunk_at"))
    starts = chunk_at.join(shard_at, "shard").select("shard", "chunk", (F.col("shard_at") + F.col("chunk_at")).alias("at"))
    return docs.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(chunks: DataFrame) -> DataFrame:
    """doc_id and its ids (array<long>), for readers of single documents."""
    small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, doc_ids, ids, at in _unpacked(batches):
            parts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("i8")))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), parts], names=["doc_id", "ids"])

    return chunks.mapInArrow(run, "doc_id long, ids array<long>")


def write_token_files(documents: DataFrame, tokenizer_path: str, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Encode and write; the number of shards follows the bytes of text."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    encode_chunks(documents, tokenizer_path, max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES)), text, key).write.option("compression", "none").parquet(path)
