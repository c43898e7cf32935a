"""BPE, token archives, WARC bundles and media: round trips and the libraries' own results."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import bpe, huffman, media, warc
from knotwork.llm.common import filesystem, scratch
from knotwork.llm.pretokens import Remembered, TextEncoder

ALPHABET = ["a", "b", " ", "\n", "é", "ß", "0", ".", ",", "'s", "'", "\t", "  ", "日", "\x1c", "\xa0", "😀", " the", "<|endoftext|>", "!", "²", "\x85", "word, word.", "\u3000", "\u2003", "\u1680", "à", "×", "Ж", "\r", "\x0b", "-", "'", "'LL", "they'll", "7"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_bpe_as_the_library(library, text):
    codec = bpe.rank_codec(*bpe.default_ranks())
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, " " * 30_000, "é" * 9_000, "\n" * 5_000])
def test_bpe_long_pretokens(library, text):
    assert np.frombuffer(bpe.rank_codec(*bpe.default_ranks()).encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, max_size=6), window=st.integers(1, 40), memory=st.integers(0, 3000))
def test_texts_in_small_windows(library, texts, window, memory):
    import pyarrow as pa

    codec = bpe.rank_codec(*bpe.default_ranks())
    encoder = TextEncoder(codec.encode_pieces, window=window, memory=memory)
    arrays = [pa.array([None, *texts, ""], pa.string()).slice(1), pa.array(texts, pa.large_string())]
    for array in arrays:
        got = [x for _, _, ids in encoder.batches(array) for x in ids.to_pylist()]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(x) for x in array.to_pylist()]
        decoded = [x for at, rows, ids in encoder.batches(array) for x in codec.decode_array(ids).to_pylist()]
        assert decoded == [x.encode() for x in array.to_pylist()]


def test_other_patterns_are_not_cut():
    ranks = {bytes([c]): c for c in range(256)} | {b"a b": 256, b"a ": 257}
    codec = bpe.BytePairCodec(ranks, r".+")
    assert np.frombuffer(codec.encode("xa b"), "<u4").tolist() == [ord("x"), 256]


def test_remembered_stays_within_its_bytes():
    held = Remembered(memory=20_000)
    for k in range(0, 5000, 50):
        found = held.all_of([str(x).encode() for x in range(k, k + 50)], lambda new: [x * 2 for x in new])
        assert found == [str(x).encode() * 2 for x in range(k, k + 50)]
        assert len(held.newer) + len(held.older) <= 20_000 // 190 + 2


def test_bpe_merges_as_brute_force():
    rnd = random.Random(1)
    ranks = {bytes([c]): c for c in range(256)}
    for k in range(60):
        ranks.setdefault(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))), 256 + k)
    codec = bpe.BytePairCodec(ranks, r".+")
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 30)))
        if piece in ranks:
            continue
        parts = [bytes([c]) for c in piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert codec.merge(piece) == [ranks[p] for p in parts]


SOME = [(1, None), (2, ""), (3, "one, two. three\nfour"), (4, " odd  spacing\t"), (5, "x" * 50_000), (None, "no id"), (3, "one, two. three\nfour"), (9, "日本語 text ²"), (0, "zero " * 3000)]
SCHEMA = "doc_id long, text string, token_ids string, decoded string, media string, n_bytes string, part string"


def docs_of(spark, rows=SOME):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


def test_bpe_query(spark, library):
    got = bpe.digests(docs_of(spark)).collect()
    want = []
    for i, t in SOME:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append(repr((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert sorted(map(repr, map(tuple, got))) == sorted(want)
    whole = bpe.encode(docs_of(spark))
    assert whole.columns == ["doc_id", "text", "decoded", "media", "n_bytes", "part", "token_ids"]
    assert bpe.digests(docs_of(spark).limit(0)).count() == 0


# --- token archives -------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(counts=st.lists(st.integers(1, 10**9), min_size=1, max_size=200), limit=st.integers(8, 20))
def test_code_lengths(counts, limit):
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and (len(counts) == 1 or sum(2.0 ** -int(x) for x in lengths) == 1)


def test_lengths_are_optimal():
    import heapq

    rnd = random.Random(4)
    for _ in range(30):
        counts = [rnd.randint(1, 1000) for _ in range(rnd.randint(2, 60))]
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert sum(c * int(x) for c, x in zip(counts, huffman.code_lengths(counts, 40), strict=True)) == cost


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_pack_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.geometric(0.01, n), 3000).astype(np.uint32)
    seen = np.unique(np.append(ids, [7, 50_000]))
    code = huffman.Code(seen, huffman.code_lengths(rnd.integers(1, 10_000, len(seen)), 13))
    words, checkpoints = code.pack(ids)
    assert (code.unpack(words, n, checkpoints) == ids).all()
    again = huffman.Code.from_bytes(code.to_bytes())
    assert (again.table == code.table).all()
    counts = np.array([n], np.uint32)
    back = huffman.read_block(code, huffman.write_block(code, [None], counts, ids))
    assert back[0] == [None] and (back[2] == ids).all()
    damaged = bytearray(huffman.write_block(code, [5], counts, ids))
    damaged[10] ^= 1
    with pytest.raises(ValueError):
        huffman.read_block(code, bytes(damaged))


def test_archive(spark):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(SOME, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t in rows:
        ids = [*made.encode(t or "", add_special_tokens=False).ids, huffman.END_ID]
        want.append(repr((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))))
        start += len(ids)
    assert sorted(map(repr, map(tuple, huffman.archive_digests(docs_of(spark)).collect()))) == sorted(want)
    assert huffman.archive_digests(docs_of(spark).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(TEXTS, max_size=5))
def test_archive_ids_as_the_library_as_loaded(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in huffman.archive_ids(path, texts)] == [made.encode(t, add_special_tokens=False).ids for t in texts]


def test_archive_of_added_tokens(spark):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "x<|endoftext|>"), (2, "one two"), (3, "a <|endoftext|> b\n<|endoftext|><|endoftext|>c"), (4, "<|endoftext"), (5, None)]
    want, start = [], 0
    for i, t in rows:
        ids = [*made.encode(t or "", add_special_tokens=False).ids, huffman.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert made.encode(rows[0][1], add_special_tokens=False).ids == [87, 50256]
    assert sorted(map(tuple, huffman.archive_digests(docs_of(spark, rows)).collect())) == want


# --- WARC -----------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "x\r\ny%", ""), (5, "u", "ü" * 100_000), (6, "v", "other"), (6, "v", "other"), (None, "w", "same")]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "a", 1) for p in PAGES], "page_id long, url string, html string, record_type string, frame int")
    got = {repr((r.page_id, r.record_type, r.refers_to)) for r in warc.archive_query(pages).collect()}
    assert got == {repr(x) for x in [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None)]}
    index = warc.write_bundles(pages, scratch(spark, "warc"), min_bytes=1, frame_bytes=1000)
    back = {r.page_id: r for r in warc.read_records(index).collect()}
    assert back[3].record_type == "response" and back[5].payload.decode() == "ü" * 100_000 and back[4].url == "x\r\ny%"
    assert back[1].payload is None and back[1].payload_bytes == 4
    for i, _, html in PAGES:
        raw = (html or "").encode()
        assert back[i].payload_bytes == len(raw) and back[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(ids) == len(PAGES) and {"urn:page:6", "urn:page:2"} <= set(ids)
    one = warc.read_records(index.filter("page_id = 6")).collect()
    assert [r.payload for r in one] == [b"other"] * 2
    assert warc.archive_query(pages.limit(0)).count() == 0


def test_bundles_are_plain_zstandard(spark):
    import zstandard

    pages = spark.createDataFrame([(k, "u", "text" * k) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    uri = warc.write_bundles(pages, scratch(spark, "warc"), frame_bytes=500).first()["bundle"]
    where, path = filesystem(uri)
    with where.open_input_file(path) as f:
        data = f.read()
        assert len(warc.BundleReader(f).frames) > 5
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as plain:
        assert plain.read().count(b"WARC/1.1\r\n") == 50


# --- media ----------------------------------------------------------------------------------------------------------


def test_media(spark):
    got = sorted(media.fingerprints(docs_of(spark)).collect(), key=repr)
    by = {}
    for r in got:
        raw = next((t or "").encode() for i, t in SOME if i == r.doc_id)
        payload = media.padded(raw)
        assert len(payload) % 576 == 0 and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.from_wav(media.to_wav(payload)) == payload
        assert by.setdefault(raw, r[1:]) == r[1:]
    assert len(got) == len(SOME) and media.fingerprints(docs_of(spark).limit(0)).count() == 0


def test_peaks_find_a_tone():
    n = np.arange(576 * 20)
    samples = (128 + 100 * np.sin(2 * np.pi * 40 * n / 576)).astype(np.uint8).tobytes()
    times, bins = media.spectral_peaks(samples)
    assert (bins == 40).mean() > 0.9
    codes, at = media.peak_pairs(times, bins)
    assert (codes >> 12 == 40).mean() > 0.8 and (np.diff(at) >= 0).all()
    shifted_times, shifted_bins = media.spectral_peaks(samples[576 * 5 :])
    assert set(media.peak_pairs(shifted_times, shifted_bins)[0]) <= set(codes)
