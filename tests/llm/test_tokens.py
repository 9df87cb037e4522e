"""Token files: codes, round trips, and the tokenizers library on whole texts."""

import heapq
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from firstdue.llm import tokens
from firstdue.session import tune, work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=70))
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    free = tokens.code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_cost(list(counts))
    tight = tokens.code_lengths(counts, 7)
    used = counts > 0
    assert tight.max(initial=0) <= 7 and ((tight > 0) == used).all()
    if used.sum() > 1:
        assert (2.0 ** -tight[used]).sum() == 1.0


def test_limited_lengths_of_a_known_case():
    # Unlimited the lengths are 1 2 3 4 4; with three bits at most, 1 3 3 3 3.
    counts = np.array([16, 8, 4, 2, 1])
    assert tokens.code_lengths(counts, 3).tolist() == [1, 3, 3, 3, 3]
    with pytest.raises(ValueError):
        tokens.code_lengths(np.ones(9, int), 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=60), min_size=1, max_size=12), st.integers(1, 9), st.sampled_from([1, 3, 512]))
def test_pack_and_unpack(docs, interval, blocks):
    before, tokens.BLOCKS = tokens.BLOCKS, blocks
    ids = np.array([i for d in docs for i in d], np.int64)
    counts = np.bincount(ids, minlength=301)
    counts = counts * counts * 50 + (counts > 0)
    lengths = tokens.code_lengths(counts)
    codes, table = tokens.canonical_codes(lengths)
    bounds, of_docs = tokens.block_bounds(np.array([len(d) for d in docs]), interval)
    data, firsts = tokens.pack(ids, bounds, codes, lengths)
    bits = "".join(format(b, "08b") for b in data)
    for a, b, at in zip(bounds, bounds[1:], firsts, strict=False):
        code = "".join(format(int(codes[i]), f"0{lengths[i]}b") for i in ids[a:b])
        assert bits[at * 8 :].startswith(code)
    assert [bounds[k] for k in of_docs] == np.cumsum([0, *map(len, docs)]).tolist()
    got = tokens.unpack(np.frombuffer(data, np.uint8), firsts[:-1], np.diff(bounds), table, lengths)
    tokens.BLOCKS = before
    assert got.tolist() == ids.tolist()


PIECES = [" ", "\n", "\x1c", " ", " ", "é", "é", "́", "Σ", "ΑΣ", "'s", "don't",
          "<|endoftext|>", "<|startoftext|>", "hello", "World", "12", "!?", "İ", "\t\x0b", "字", "😀", "ÄÖ", "ß²", "¼\x85", "\xa0", "×µ", "\xad¡", "\x00\x7f", "'LL", "<|"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=25), st.sampled_from([1, 7, 1 << 20]))
def test_word_by_word_is_the_library_on_the_whole_text(pieces, chunk):
    text = "".join(pieces)
    encoder = tokens._word_ids(PATH)
    before, tokens.CHUNK_BYTES = tokens.CHUNK_BYTES, chunk
    ids, counts = encoder.encode([text.encode(), b"", text.encode()])
    tokens.CHUNK_BYTES = before
    expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected + expected and counts.tolist() == [len(expected), 0, len(expected)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=[chr(i) for i in range(256)], max_size=6), max_size=12))
def test_latin_words_are_cut_like_the_library_does(pieces):
    encoder = tokens._word_ids(PATH)
    assert encoder.by_word
    text = " ".join(pieces)
    assert encoder.encode([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_read_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens._word_ids(path)
    texts = ["Two  words\n\n", "", " x"]
    ids, counts = encoder.encode([t.encode() for t in texts])
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.by_word and ids.tolist() == sum(expected, [])
    assert counts.tolist() == list(map(len, expected))


def expected_index(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_index_of_odd_rows(spark):
    long = "word another " * 5000
    rows = [(4, "b a"), (2, None), (9, long), (3, "x" * 5000), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "bits") for i, t in rows], "doc_id long, text string, bits string")
    got = [tuple(r) for r in tokens.token_corpus(df, PATH, interval=3).orderBy("start", "doc_id").collect()]
    assert got == expected_index(sorted(rows, key=lambda r: r[0]))
    assert tokens.token_corpus(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("ids", [[1, 1, 1, 1], [None, None, 2, 2], ["b", "a", "a", None]])
def test_starts_are_those_of_the_file(spark, ids):
    """Rows with one id: what starts say is where the ids lie in the files."""
    texts = ["a b", "one two three four five six", "c d e f", "seven " * 50]
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)] * 2
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    out = tokens.write_tokens(df, work_dir(spark, "t"), PATH)
    read = tokens.read_tokens(spark, out).collect()
    stream, at = [], {}
    for r in sorted(read, key=lambda r: (r.shard, r.ids_before)):
        at.setdefault((r.doc_id, bytes(r.ids)), []).append(len(stream))
        stream += np.frombuffer(bytes(r.ids), "<u4").tolist()
    index = tokens.token_index(spark, out).collect()
    crc = {(d, zlib.crc32(ids)): places for (d, ids), places in at.items()}
    found = {}
    for r in index:
        found.setdefault((r.doc_id, r.ids_crc32), []).append(r.start)
    assert {k: sorted(v) for k, v in found.items()} == crc
    # One after the other, without gaps, by rising id.
    order = sorted(index, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[r.n_tokens for r in order]]).tolist()[:-1]
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in order][len(order) - len(known) :] == known


def test_words_that_came_up_again_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 40)
    encoder = tokens._WordIds(PATH)
    for k in range(30):
        text = " ".join([f"word{k * 25 + i}" for i in range(25)] + ["often", "again", "é字"])
        ids, counts = encoder.encode([text.encode(), b" often  again\n"])
        expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "often again")]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))
    assert b"often" in encoder.number and len(encoder.number) < 100


def test_new_words_are_cut_many_at_a_time(monkeypatch):
    """Cutting and looking up words one by one was the larger part of op4's CPU time."""
    pattern, calls = tokens.PIECE, []

    class Counting:
        def findall(self, text):
            calls.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(tokens, "PIECE", Counting())
    encoder = tokens._WordIds(PATH)
    text = " ".join(f"Wörd{k},it's" for k in range(3000))
    ids, counts = encoder.encode([text.encode()])
    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) == 1


@pytest.mark.parametrize("cut", [1, 2, 5, 1 << 14])
def test_words_of_the_library_keep_their_places(monkeypatch, cut):
    monkeypatch.setattr(tokens, "CUT_WORDS", cut, raising=False)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 12)
    monkeypatch.setattr(tokens, "CACHED_PIECES", 8)
    encoder = tokens._WordIds(PATH)
    odd = ["\x85", "字", "é", "x\xa0y", "\xa0", "plain", "<|endoftext|>", "<|", "a'll", "12", "Σ", "\x85\x85"]
    for k in range(len(odd)):
        words = odd[k:] + [w + str(k) for w in odd] + odd[:k]
        texts = ["\x85", " ".join(words), "", "\n".join(reversed(words))]
        ids, counts = encoder.encode([t.encode() for t in texts])
        expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(expected, []) and counts.tolist() == list(map(len, expected))


def test_ids_are_counted_in_all_rows(spark):
    rows = [("a b a",), (None,), ("",), ("word another " * 3000,)] + [(f"a n{k}",) for k in range(40)]
    df = spark.createDataFrame(rows, "text string").selectExpr("monotonically_increasing_id() as doc_id", "text")
    tokenizer = Tokenizer.from_file(PATH)
    expected = np.zeros(49408, int)
    for (text,) in rows:
        np.add.at(expected, [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 1)
    ids = tokens.tokenize(df.repartition(3), PATH, 1, 49408)
    assert tokens.count_ids(ids, 49408).tolist() == expected.tolist()
    assert not tokens.count_ids(ids.limit(0), 49408).any()


def test_a_long_block_beside_short_ones():
    """What decoding takes follows from the ids, not from the longest block times their number."""
    docs = np.array([3, 0, 30_000, 1, *[2] * 400])
    ids = np.arange(docs.sum()) * 7 % 50
    lengths = tokens.code_lengths(np.bincount(ids, np.arange(len(ids)) + 1, 50).astype(np.int64))
    codes, table = tokens.canonical_codes(lengths)
    bounds, _ = tokens.block_bounds(docs, 10**6)
    data, firsts = tokens.pack(ids, bounds, codes, lengths)
    given = np.frombuffer(data, np.uint8), firsts[:-1], np.diff(bounds), table, lengths
    tracemalloc.start()
    got = tokens.unpack(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == ids.tolist() and peak < 6 << 20


def test_missing_ids_come_first(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    got = {r.doc_id: r.start for r in tokens.token_corpus(df, PATH).collect()}
    assert got == {None: 0, 1: 2}


def test_files_give_the_ids_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(50)
    out = tokens.write_tokens(docs, work_dir(spark, "t"), PATH)
    tokenizer = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.read_tokens(spark, out).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids


def test_query_equals_the_library(spark, folder):
    from firstdue.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))
    got = sorted(map(tuple, QUERIES["op4_token_files"](spark, folder).collect()))
    assert got == expected_index(rows)


def test_texts_reach_python_in_small_batches(spark):
    """A batch of whole texts stands in memory several times, so it follows from bytes and not from rows."""
    tune(spark)
    df = spark.range(6000, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 300) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], ["rows", "bytes"])

    found = df.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 6000 and max(r.bytes for r in found) < 5 << 20


@pytest.mark.parametrize("size", [1, 700, 1000, 1500, 10**6])
def test_slices_hold_every_row_once(size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(250))], ["n"])  # 2,000 bytes
    parts = list(tokens._slices(batch, size))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(250))
    assert max(map(len, parts)) <= max(1, 1.5 * size / 8) and len({len(p) for p in parts[:-1]}) <= 1
