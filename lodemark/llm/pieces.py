"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The pieces of a public model are the automaton's keys. One pass over a text
visits, at each position, the pieces that end there by following output links,
and relaxes the best score of that position: a Viterbi search for the
segmentation of highest total piece score. Equal scores prefer the longer last
piece. Characters that no piece covers are spelt in byte pieces.

No piece of the model continues over a new word mark or holds a line feed
(checked on loading), so the best segmentation of a text is made of those of
its words; each distinct word is searched once and kept in a cache of
CACHE_WORDS entries.

Defined results: null and empty texts give no ids and decode to the empty text;
decode(encode(text)) is the text, except that a literal U+2581 becomes a space,
as the model's own format has it; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructType

from .common import WordCache, fresh, small_batches, split_words

MARK = "▁"
_PIECES = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
CACHE_WORDS = 500_000
#: What an uncovered character costs beyond the worst piece, as public unigram encoders have it.
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> dict:
    """The model as plain data: normal pieces (text, id, score), byte pieces and the id of every piece's text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    special = {i for i in range(len(text)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte = {int(text[i][1:-1], 16): i for i in range(len(text)) if sp.is_byte(i)}
    normal = [(text[i], i, sp.get_score(i)) for i in range(len(text)) if i not in special and not sp.is_byte(i)]
    if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, _ in normal) or len(byte) != 256:
        raise ValueError("a piece crosses a word mark or line feed, or byte pieces are missing")
    return {"key": zlib.crc32(repr(normal).encode()), "size": len(text), "normal": normal, "byte": byte}


class Decoder:
    """The bytes of all pieces. Those of a whole batch's ids are taken at once and cut at the texts' ends, so that no id
    becomes a Python object."""

    def __init__(self, model: dict):
        text = [b""] * model["size"]
        for piece, i, _ in model["normal"]:
            text[i] = piece.replace(MARK, " ").encode()
        for b, i in model["byte"].items():
            text[i] = bytes([b])
        self.text = pa.array(text, pa.binary())

    def texts(self, ids: pa.Array, sizes: np.ndarray) -> pa.StringArray:
        """The texts of consecutive runs of ids of these sizes. An id outside of the vocabulary or null raises."""
        if ids.null_count:
            raise ValueError("null among the ids of a text")
        got = self.text.take(ids)
        _, offsets, data = got.buffers()
        ends = np.frombuffer(offsets, "<i4", len(ids) + 1, 4 * got.offset)[np.concatenate([[0], np.cumsum(sizes)])]
        spaced = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")]).cast(pa.string())
        return pc.if_else(pc.starts_with(spaced, " "), pc.utf8_slice_codeunits(spaced, 1), spaced)

    def decode(self, ids: np.ndarray) -> str:
        return self.texts(pa.array(np.asarray(ids, dtype="i8")), np.array([len(ids)]))[0].as_py()


class Pieces(Decoder):
    """Encoder and decoder of one worker."""

    def __init__(self, model: dict):
        import ahocorasick

        super().__init__(model)
        self.automaton = ahocorasick.Automaton()
        for text, i, score in model["normal"]:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in model["normal"] if len(p) == 1}
        self.unknown = min(s for _, _, s in model["normal"]) - UNKNOWN_PENALTY
        self.byte = model["byte"]
        self.words = WordCache(self._words, CACHE_WORDS)

    def best(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of a chunk."""
        n, lowest = len(chunk), float("-inf")
        score, came, piece = [0.0] + [lowest] * n, [0] * (n + 1), [-1] * (n + 1)
        bare = [i for i, c in enumerate(chunk) if c not in self.single]
        k, bare = 0, [*bare, n]
        for end, (size, i, s) in self.automaton.iter(chunk):
            while bare[k] < end:
                self._spell(bare[k], score, came, piece)
                k += 1
            start, end = end + 1 - size, end + 1
            s += score[start]
            if s > score[end] or (s == score[end] and start < came[end]):
                score[end], came[end], piece[end] = s, start, i
        while bare[k] < n:
            self._spell(bare[k], score, came, piece)
            k += 1
        out: list[int] = []
        while n:
            i, start = piece[n], came[n]
            out += [self.byte[b] for b in reversed(chunk[start:n].encode())] if i < 0 else [i]
            n = start
        return out[::-1]

    def _spell(self, at: int, score: list[float], came: list[int], piece: list[int]) -> None:
        s = score[at] + self.unknown
        if s > score[at + 1]:
            score[at + 1], came[at + 1], piece[at + 1] = s, at, -1

    def _words(self, words: list[str]) -> list[bytes]:
        return [np.array(self.best(w), dtype="<u4").tobytes() for w in words]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        marked = pc.replace_substring(pc.binary_join_element_wise(MARK, texts, ""), " ", MARK)
        odd = pc.or_(pc.match_substring_regex(marked, f"{MARK}({MARK}|\n|$)|\\x00"), pc.equal(texts, ""))
        got = self.words.join(split_words(pc.if_else(pc.fill_null(odd, True), "", marked), MARK))
        for i in np.flatnonzero(pc.fill_null(odd, False).to_numpy(zero_copy_only=False)).tolist():
            text = marked[i].as_py()
            if text != MARK:
                got[i] = self.words.join(pa.array([_PIECES.findall(text)]))[0]
        return got


def _schema(source: DataFrame, *added: tuple[str, DataType]) -> StructType:
    """The columns that pass through and the added ones, renamed where they would clash."""
    names = fresh(source, *[name for name, _ in added])
    schema = StructType(source.schema.fields[:-1])
    for name, (_, kind) in zip(names, added, strict=True):
        schema = schema.add(name, kind)
    return schema


def _source(rows: DataFrame, keep: tuple[str, ...], last: str) -> DataFrame:
    """keep, and last under a name that does not clash."""
    kept = rows.select(*keep)
    return rows.select(*keep, F.col(last).alias(*fresh(kept, "value")))


def encode_documents(
    documents: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_decoded: bool = False
) -> DataFrame:
    """keep, n_pieces, ids, ids_crc32 (little-endian 32-bit ids) and round_trip: whether decoding gives the text back;
    with_decoded also decoded: the text that the ids give. It costs no second pass: decode_documents after this would hold
    a second Python worker a task, and workers change roles, so that each would come to hold the encoder and its cache.
    Kept columns pass through as they are; an added one whose name a kept one has gets an underscore before it."""
    spark = documents.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(load_pieces(model_path))  # as large as the vocabulary file
    source = _source(documents, keep, text)
    added = [("n_pieces", LongType()), ("ids", ArrayType(IntegerType())), ("ids_crc32", LongType()), ("round_trip", BooleanType())]
    schema = _schema(source, *added, *[("decoded", StringType())] * with_decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _of(model, Pieces)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw = pieces.encode(texts)
            sizes = np.fromiter(map(len, raw), "i8", len(raw)) // 4
            ids = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
            decoded = pieces.texts(ids, sizes)
            back = pc.equal(decoded, pc.replace_substring(pc.fill_null(texts, ""), MARK, " "))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), ids)
            added = [pa.array(sizes), lists, pa.array([zlib.crc32(x) for x in raw], pa.int64()), back, *[decoded] * with_decoded]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text (null ids: the empty text), renamed like the columns of encode_documents."""
    spark = encoded.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(load_pieces(model_path))
    source = _source(encoded, keep, ids)
    schema = _schema(source, ("text", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _of(model, Decoder)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], decoder.texts(column.flatten(), sizes)], names=schema.names)

    return source.mapInArrow(run, schema)


_BUILT: dict[tuple[type, int], Decoder] = {}


def _of(model, kind: type[Decoder]) -> Decoder:
    """One encoder or decoder per worker process and model, so that its cache outlives a task; a decoder needs no automaton."""
    value = model.value
    if (kind, value["key"]) not in _BUILT:
        _BUILT[kind, value["key"]] = kind(value)
    return _BUILT[kind, value["key"]]
