"""Token-id files: ids as canonical, length-limited Huffman codes.

The ids of all documents are counted, code lengths of at most ``MAX_BITS`` bits follow from
the counts by package-merge, and codes are assigned in the order of (length, id), so
the lengths alone are the code table. A document is a row of blocks of ``interval`` ids, each
padded to whole bytes, with marks: the bit offset of every block. Blocks are decoded independently;
the decoder walks many side by side, one table look-up per id.

A corpus folder holds ``codes`` (id, n, length, interval) and ``documents`` (shard, doc_id, ids_before,
n_tokens, marks, bits). Shards are ranges of doc_id in ascending order; ``ids_before`` counts the ids of
the rows that stand before a row in its shard.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firstdue.session import work_dir

# Ship these functions with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BITS = 16
INTERVAL = 1024
#: Text that a task tokenises at a time; words, parts of words, and bytes of either, whose ids it
#: remembers before it keeps only those that came up again; words in one call of the library.
CHUNK_BYTES, CACHED_WORDS, CACHED_PIECES = 4 << 20, 400_000, 250_000
CACHED_BYTES, CALL_WORDS = 16 << 20, 2048
#: New words that are cut into parts at a time.
CUT_WORDS = 1 << 14
#: Blocks, and bytes of whole rows, that are packed or unpacked at a time.
BLOCKS, ROW_BYTES = 512, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

# The configuration of tokenizers that this module takes apart.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same pattern for lower-cased Latin-1 words, one in a line; line ends are matches of their own.
PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|\n|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\n]+"
)
#: What is not Latin-1, and its white space beyond ASCII.
ODD = re.compile("[^\x00-\x84\x86-\x9f\xa1-\xff]")
#: Stands for a line end among ids; no vocabulary reaches so far.
LINE_END = 0xFFFFFFFF


def _byte_characters() -> dict[int, str]:
    """Latin-1 characters as byte-level BPE writes their UTF-8 bytes.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    written = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
    return {c: "".join(written[b] for b in chr(c).encode()) for c in range(256)}


BYTE_CHARACTERS = _byte_characters()


class _WordIds:
    """The ids of words between ASCII white space, each word encoded by the library once.

    For tokenizers with the NORMALIZER and PRE_TOKENIZER below the ids of a text are those of its words,
    in order: pre-tokens never reach over white space, and normalising does not compose over
    it. A new word of Latin-1 characters is cut into pre-tokens here and these go to the library's
    model, each once; other words, and texts under other tokenizers, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.by_word = (config["normalizer"], config["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in config["added_tokens"]]
        self.pieces: dict[str, bytes] = {}
        self.pieces_again: set[str] = set()
        self.pieces_held = 0
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        #: Ids of all words one after the other, and the first byte of each word's, and of the end.
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int32)

    def _take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``at`` in one array, and the first byte of each word's, and of the end."""
        buffers = [None, pa.py_buffer(self.bounds), pa.py_buffer(self.ids)]
        words = pa.Array.from_buffers(pa.large_binary(), len(self.bounds) - 1, buffers)
        _, bounds, ids = words.take(pa.array(at)).buffers()
        bounds = np.frombuffer(bounds, np.int64, len(at) + 1)
        return np.frombuffer(ids or b"", np.uint32, bounds[-1] // 4), bounds

    def _forget(self) -> None:
        """Keep the words that came up again; all go where that leaves too many."""
        keep = np.flatnonzero(self.seen > 1)
        words = list(self.number)
        words = [words[k] for k in keep.tolist()]
        held = sum(map(len, words))
        if not words or len(words) > CACHED_WORDS // 2 or held > CACHED_BYTES // 2:
            self.clear()
            return
        self.ids, self.bounds = self._take(keep)
        self.seen = np.ones(len(words), np.int32)
        self.number, self.held = dict(zip(words, range(len(words)), strict=True)), held

    def _forget_pieces(self) -> None:
        """The same for pre-tokens."""
        again, self.pieces_again = self.pieces_again, set()
        self.pieces_held = sum(map(len, again))
        if len(again) > CACHED_PIECES // 2 or self.pieces_held > CACHED_BYTES // 2:
            again, self.pieces_held = set(), 0
        self.pieces = {piece: self.pieces[piece] for piece in again}

    def _ids_by_piece(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of at least these pre-tokens, as native unsigned 32-bit numbers."""
        if len(self.pieces) + len(pieces) > CACHED_PIECES or self.pieces_held > CACHED_BYTES:
            self._forget_pieces()
        known, tokenize = self.pieces, self.model.tokenize
        new = pieces.difference(known)
        self.pieces_again |= pieces - new
        for piece in new:
            written = piece if piece.isascii() and piece.isalpha() else piece.translate(BYTE_CHARACTERS)
            known[piece] = array("I", [t.id for t in tokenize(written)]).tobytes()
        self.pieces_held += sum(map(len, new))
        known["\n"] = LINE_END.to_bytes(4, sys.byteorder)
        return known

    def _rest(self, words: list[bytes], text: str) -> list[int]:
        """Which words are not all Latin-1, or have white space or a special token inside."""
        special = [t for t in self.special if t in text]
        if not special and not ODD.search(text):
            return []
        found = (word.decode() for word in words)
        return [k for k, w in enumerate(found) if ODD.search(w) or any(t in w for t in special)]

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), CALL_WORDS):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL_WORDS], add_special_tokens=False):
                yield e.ids

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in one array, and how many each word has."""
        text = b"\n".join([*words, b""]).decode()
        rest = self._rest(words, text)
        if rest:
            simple = [*words, b""]
            for k in rest:
                simple[k] = b""
            text = b"\n".join(simple).decode()
        pieces = PIECE.findall(text.lower())
        known = self._ids_by_piece(set(pieces))
        ids = np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.uint32)
        ends = np.flatnonzero(ids == LINE_END)
        ids = ids[ids != LINE_END]
        sizes = np.diff(ends, prepend=-1) - 1
        if rest:
            others = [np.array(i, np.uint32) for i in self._library([words[k].decode() for k in rest])]
            at = np.cumsum(sizes)[rest]
            sizes[rest] = [len(i) for i in others]
            ids = np.insert(ids, np.repeat(at, sizes[rest]), np.concatenate(others))
        return ids, sizes

    def add(self, words: list[bytes]) -> None:
        cut = [self._cut(words[at : at + CUT_WORDS]) for at in range(0, len(words), CUT_WORDS)]
        sizes = np.concatenate([sizes for _, sizes in cut])
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.held += sum(map(len, words))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in cut)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + 4 * np.cumsum(sizes)])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int32)])

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of ``pieces``, and how many each piece has.

        Arrow splits the pieces and tells equal words, so that each is looked up once.
        """
        if len(self.number) > CACHED_WORDS or self.held > CACHED_BYTES:
            self._forget()
        lists = pc.ascii_split_whitespace(pa.array(pieces, pa.binary()).view(pa.string()))
        coded = lists.flatten().dictionary_encode()
        # By way of NumPy: Arrow's own lists make a scalar of every value first.
        words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            first = len(self.number)
            self.add([words[k] for k in unknown.tolist()])
            at[unknown] = np.arange(first, first + len(unknown))
        self.seen[at] += 1
        ids, bounds = self._take(at[coded.indices.to_numpy()])
        return ids, np.diff(bounds[lists.offsets.to_numpy()]) // 4

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        counts = np.zeros(len(texts), np.int64)
        if not self.by_word:
            found = [np.array(i, np.uint32) for i in self._library([t.decode() for t in texts])]
            counts[:] = [len(i) for i in found]
            return np.concatenate(found) if found else self.ids[:0], counts
        parts: list[np.ndarray] = []
        pieces: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal pieces, owners, size
            ids, per = self._ids_of(pieces)
            np.add.at(counts, owners, per)
            parts.append(ids)
            pieces, owners, size = [], [], 0

        for number, text in enumerate(texts):
            for piece in _pieces(text):
                pieces.append(piece)
                owners.append(number)
                size += len(piece)
                if size >= CHUNK_BYTES:
                    flush()
        if owners:
            flush()
        return np.concatenate(parts) if parts else self.ids[:0], counts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK_BYTES that end at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _word_ids(path: str) -> _WordIds:
    """The worker's encoder of a tokenizer; it lives as long as the worker does."""
    # Tasks are the parallelism; threads inside one would share its core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    # This module's own globals come anew with every task, a registered module stays.
    name = "_firstdue_encoders"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if path not in kept:
        kept[path] = _WordIds(path)
    return kept[path]


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, all alike, of about ``size`` bytes each, or of a row."""
    rows = max(1, -(-len(batch) // max(1, round(batch.nbytes / size))))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def _id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def tokenize(
    documents: DataFrame, path: str, end: int, vocabulary: int, order: str | None = None
) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: little-endian ids with ``end`` appended.

    A missing text counts as empty: it has the end id alone. ``order`` names a column that
    comes along.
    """
    kept = ["doc_id", *([order] if order else [])]
    rows = documents.select(*kept, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = np.dtype(_id_type(vocabulary)).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(path)
        for batch in batches:
            for part in _slices(batch, CHUNK_BYTES):
                ids, counts = encoder.encode(part.column("text").to_pylist())
                ends = np.cumsum(counts)
                with_end = np.insert(ids, ends, end).astype(kind)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(counts + 1),
                     _binary(offsets * kind.itemsize, with_end.tobytes())],
                    [*kept, "n_tokens", "ids"],
                )

    return rows.mapInArrow(run, f"{_types(documents, kept)}, n_tokens long, ids binary")


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)],
    ).cast(pa.binary())


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often every id occurs in all documents; one array of counts leaves each task."""
    kind = np.dtype(_id_type(vocabulary)).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in _slices(batch, ROW_BYTES):
                # Many rows at a time: every count is as long as the vocabulary.
                ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), kind)
                counts += np.bincount(ids, minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n"))
    counts = np.zeros(vocabulary, np.int64)
    for number, n in rows.collect():  # at most one row per id of the vocabulary
        counts[number] = n
    return counts


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order]
    # A level's list is the leaves and the pairs of the list below, by weight. What is
    # chosen of a level is a prefix, so the number of leaves in it is all that is needed.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(weights))
        merged = merged[at]
        half = len(merged) // 2
        packages = merged[0 : 2 * half : 2] + merged[1 : 2 * half : 2]
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the decoder's table from ``max length`` bits to the id they begin with."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = int(lengths.max(initial=1))
    spans = np.int64(1) << (width - lengths[order])
    firsts = np.cumsum(spans) - spans
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (firsts >> (width - lengths[order])).astype(np.uint64)
    table = np.zeros(1 << width, np.int64)
    table[: int(spans.sum())] = np.repeat(order, spans)
    return codes, table


def pack(
    ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray
) -> tuple[bytes, np.ndarray]:
    """Codes of the blocks of ``ids`` between ``bounds``, each from a whole byte on.

    Returns the bytes and the first byte of every block, and of the end. Works through
    BLOCKS blocks at a time, so memory follows from that and not from a document's length.
    """
    pieces, firsts, done = [], [np.zeros(1, np.int64)], 0
    for a in range(0, len(bounds) - 1, BLOCKS):
        cut = bounds[a : a + BLOCKS + 1]
        data, at = _pack(ids[cut[0] : cut[-1]].astype(np.int64), cut - cut[0], codes, lengths)
        pieces.append(data)
        firsts.append(at[1:] + done)
        done += len(data)
    return b"".join(pieces), np.concatenate(firsts)


def _pack(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray):
    sizes = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bits = ends[bounds[1:]] - ends[bounds[:-1]]
    bytes_at = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    # Bit position of every id: within its block, plus the block's first byte.
    shift = bytes_at[:-1] * 8 - ends[bounds[:-1]]
    at = ends[:-1] + np.repeat(shift, np.diff(bounds))
    words = np.zeros(int(bytes_at[-1]) // 8 + 3, np.uint64)
    if len(ids):
        word, offset = at >> 6, at & 63
        room = 64 - offset - sizes
        code = codes[ids]
        high = np.where(
            room >= 0, code << np.maximum(room, 0).astype(np.uint64),
            code >> np.maximum(-room, 0).astype(np.uint64),
        )
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        # At most one code runs over the end of each word.
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(bytes_at[-1])], bytes_at


def block_bounds(counts: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all blocks of documents with so many ids, and of the documents' blocks."""
    per = (counts + interval - 1) // interval
    of_docs = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(of_docs[-1]) - of_docs[doc]
    ends = np.cumsum(counts)
    starts = (ends - counts)[doc] + nth * interval
    return np.concatenate([starts, ends[-1:]]), of_docs


def unpack(
    data: np.ndarray, firsts: np.ndarray, counts: np.ndarray, table: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Decode neighbouring blocks from byte ``firsts`` on, ``counts`` ids each, in order."""
    parts = [np.zeros(0, "<u4")]
    for a in range(0, len(firsts), BLOCKS):
        own = firsts[a : a + BLOCKS]
        end = firsts[a + BLOCKS] if a + BLOCKS < len(firsts) else len(data)
        ids = _unpack(data[own[0] : end], (own - own[0]) * 8, counts[a : a + BLOCKS], table, lengths)
        parts.append(ids.astype("<u4"))
    return np.concatenate(parts)


def _unpack(data, starts, counts, table, lengths) -> np.ndarray:
    """Decode blocks side by side: the n-th id of each, from n = 0 on, the longest block first."""
    width = int(table.size).bit_length() - 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    # Four bytes from any byte on, so that a look-up is one shift of one number.
    quads = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    sizes, mask = lengths[table].astype(np.int64), np.uint32((1 << width) - 1)
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    alive = np.searchsorted(-left, -np.arange(left.max(initial=0)), side="left")
    firsts = np.cumsum(alive) - alive
    peeks = np.zeros(int(counts.sum()), np.uint32)
    for first, n in zip(firsts.tolist(), alive.tolist(), strict=True):
        here = at[:n]
        peek = quads.take(here >> 3)
        peek >>= (32 - width - (here & 7)).astype(np.uint32)
        peek &= mask
        peeks[first : first + n] = peek
        here += sizes.take(peek)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    nth = np.arange(len(peeks)) - np.repeat(np.cumsum(counts) - counts, counts)
    return table[peeks[firsts[nth] + np.repeat(rank, counts)]]


def write_tokens(
    documents: DataFrame, folder: str, path: str, end: int = 1, limit: int = MAX_BITS,
    interval: int = INTERVAL, order: str | None = None,
) -> str:
    """Tokenise ``documents`` (doc_id, text) and write them to ``folder`` by ascending doc_id.

    ``order`` names a further column that comes before doc_id in that order, such as the training
    time of a mix; the files then have it as ``place``.
    ``path`` is the tokenizer's file, on every machine. A missing text is an empty one, a missing
    doc_id comes first, rows with equal ids stand in the order of their contents, and repeated
    rows are written as often as they occur. An empty table gives an empty corpus. Other
    columns are ignored. Ids are stored once on the way, as plain numbers, because the
    code needs the counts of the whole corpus.
    """
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), end + 1)
    plain = f"{folder}/plain"
    place = []
    if order:
        documents = documents.select("doc_id", F.col(order).alias("place"), "text")
        place = ["place"]
    tokenize(documents, path, end, vocabulary, *place).write.option("compression", "zstd").parquet(plain)
    tokens = spark.read.parquet(plain)
    counts = count_ids(tokens, vocabulary)
    lengths = code_lengths(counts, limit)
    codes, _ = canonical_codes(lengths)
    kind = np.dtype(_id_type(vocabulary)).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0  # ids of the shard so far: a task writes one shard, in order
        for batch in batches:
            for part in _slices(batch, ROW_BYTES):
                texts = part.column("ids").to_pylist()
                n = np.array([len(t) // kind.itemsize for t in texts], np.int64)
                bounds, of_docs = block_bounds(n, interval)
                data, firsts = pack(np.frombuffer(b"".join(texts), kind), bounds, codes, lengths)
                cuts = firsts[of_docs]
                marks = (firsts[:-1] - np.repeat(cuts[:-1], np.diff(of_docs))) * 8
                lists = pa.ListArray.from_arrays(
                    pa.array(of_docs.astype(np.int32)), pa.array(marks.astype(np.int64))
                )
                upto = done + np.cumsum(n)
                done += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("shard", *place, "doc_id")), pa.array(upto - n),
                     part.column("n_tokens"), lists, _binary(cuts, data)],
                    ["shard", *place, "doc_id", "ids_before", "n_tokens", "marks", "bits"],
                )

    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64("ids")
    by = [*place, "doc_id", "__key"]
    ordered = tokens.withColumn("__key", key).repartitionByRange(pieces, *by)
    ordered = ordered.sortWithinPartitions(*by).select(
        F.spark_partition_id().alias("shard"), *place, "doc_id", "n_tokens", "ids"
    )
    types = _types(documents, [*place, "doc_id"])
    ordered.mapInArrow(
        run, f"shard int, {types}, ids_before long, n_tokens long, marks array<long>, bits binary"
    ).write.option("compression", "none").parquet(f"{folder}/documents")
    used = np.flatnonzero(counts)
    spark.createDataFrame(
        [(int(i), int(counts[i]), int(lengths[i]), interval) for i in used],
        "id int, n long, length int, interval int",
    ).coalesce(1).write.parquet(f"{folder}/codes")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, doc_id, ids_before, n_tokens, ids`` from the files; ids as little-endian unsigned 32 bits.

    Files that were written by an ``order`` have it as ``place`` after the shard.
    """
    code = spark.read.parquet(f"{folder}/codes").select("id", "length", "interval").collect()
    interval = code[0].interval if code else INTERVAL
    lengths = np.zeros(max((r.id for r in code), default=0) + 1, np.int64)
    for number, length, _ in code:  # one row per id of the vocabulary
        lengths[number] = length
    _, table = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ROW_BYTES):
                texts = part.column("bits").to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                firsts = np.cumsum([0, *map(len, texts)])[:-1]
                n = part.column("n_tokens").to_numpy()
                marks = part.column("marks")
                per = np.diff(marks.offsets.to_numpy())
                doc = np.repeat(np.arange(len(part)), per)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                counts = np.minimum(n[doc] - nth * interval, interval)
                blocks = firsts[doc] + marks.flatten().to_numpy() // 8
                ids = unpack(data, blocks, counts, table, lengths)
                cuts = np.concatenate([[0], np.cumsum(n)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), _binary(cuts, ids.tobytes())],
                    [*kept, "ids"],
                )

    files = spark.read.parquet(f"{folder}/documents")
    kept = [c for c in files.columns if c not in ("marks", "bits")]
    return files.mapInArrow(run, f"{_types(files, kept)}, ids binary")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: those before it in its shard, as the files
    have them, on top of the shards before.
    """
    read = read_tokens(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(ids.as_buffer()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sums, pa.int64())],
                [*kept, "ids_crc32"],
            )

    kept = [c for c in read.columns if c != "ids"]
    rows = read.mapInArrow(run, f"{_types(read, kept)}, ids_crc32 long")
    sizes = spark.read.parquet(f"{folder}/documents").groupBy("shard").agg(
        F.sum("n_tokens").alias("__n")
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    # One row per shard.
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("__base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_corpus(documents: DataFrame, path: str, end: int = 1, **options) -> DataFrame:
    """Write ``documents`` to a new folder and return ``token_index`` of it."""
    spark = documents.sparkSession
    return token_index(spark, write_tokens(documents, work_dir(spark, "tokens"), path, end, **options))
