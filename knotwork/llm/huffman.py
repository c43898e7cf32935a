"""Token-ID files: canonical length-limited Huffman codes from global counts, in independent blocks.

Layout of an archive folder (little-endian throughout):

* ``code.bin``: magic KNHC, symbol count, then the symbols (u32) and their code lengths (u8) in canonical order.
* ``part-NNNNN-*.knh``: magic KNHF, CRC of the code, then blocks, then an index and its offset. A block is a header
  (documents, ids, payload words), the documents' ids (i64, with a validity byte each) and counts (u32), the bit offset
  of every CHECKPOINT-th id (u64), and the payload. A block decodes without any other; from a checkpoint on, an id costs
  one look-up in the decoding table. All stretches between checkpoints of a block are decoded side by side.

Documents are in ascending id order across parts. Jobs: the texts are encoded where they are read, into a staged table of
ids that ends each task's rows with a tally of them; the tallies are summed to the code; the ids, not the texts, are
range-partitioned by document id, and one task per part writes its archive file; another reads it back.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import filesystem, map_batches, partitions, publish, scratch
from knotwork.llm.pretokens import TextEncoder

END_ID = 2
#: Longest code; the decoding table has 2**MAX_BITS entries.
MAX_BITS = 18
#: Bytes of text encoded at a time, and those that a worker's remembered pieces may take; see pretokens.
WINDOW, MEMORY = 4 << 20, 160 << 20
#: Ids between two checkpoints, and the ids at which a block is closed (a document is never cut).
CHECKPOINT, BLOCK_IDS = 256, 1 << 19
STAGED, PARTS = "id long, ids binary, tally binary", "part int, file string, n long"


# --- the code -------------------------------------------------------------------------------------------------------


def code_lengths(counts, limit: int = MAX_BITS):
    """The lengths of an optimal prefix code with no length over limit (package-merge); counts are positive."""
    import numpy as np

    n = len(counts)
    if n == 1:
        return np.array([1], np.uint8)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of the longest length")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class Code:
    """A canonical code: symbols by (length, symbol), codes counting up."""

    def __init__(self, symbols, lengths):
        import numpy as np

        by = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.uint32)[by], np.asarray(lengths, np.uint8)[by]
        self.bits = int(self.lengths[-1]) if len(by) else 1
        spans = np.left_shift(np.uint64(1), (self.bits - self.lengths).astype(np.uint64))
        first = np.concatenate([[np.uint64(0)], np.cumsum(spans)[:-1]]).astype(np.uint64) if len(by) else np.zeros(0, np.uint64)
        size = int(self.symbols.max()) + 1 if len(by) else 1
        #: By symbol its length and its code, whose first bit is the highest of the word; by the next bits symbol and length together.
        self.length_of, self.code_of = np.zeros(size, np.uint8), np.zeros(size, np.uint64)
        self.length_of[self.symbols] = self.lengths
        self.code_of[self.symbols] = first << np.uint64(64 - self.bits)
        self.table = np.repeat(self.symbols.astype(np.int64) << 8 | self.lengths, spans.astype(np.int64))

    def to_bytes(self) -> bytes:
        return b"KNHC" + struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.lengths.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Code:
        import numpy as np

        (n,) = struct.unpack_from("<I", data, 4)
        if data[:4] != b"KNHC" or len(data) != 8 + 5 * n:
            raise ValueError("not a code file")
        return Code(np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, np.uint8, n, 8 + 4 * n))

    def pack(self, ids):
        """(payload as uint64 words, most significant bit first; the bit offset of every CHECKPOINT-th id)."""
        import numpy as np

        lengths = self.length_of[ids]
        if len(ids) and not lengths.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(lengths, dtype=np.int64)
        at = ends - lengths
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros((total + 63) // 64 + 2, np.uint64)  # two spare words, so that a reader may look ahead
        if len(ids):
            codes, word, shift = self.code_of[ids], at >> 6, (at & 63).view(np.uint64)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            words[word[starts]] = np.bitwise_or.reduceat(codes >> shift, starts)
            over = np.flatnonzero(word != (ends - 1) >> 6)  # at most one id crosses into each word
            words[word[over] + 1] |= codes[over] << (np.uint64(64) - shift[over])
        return words, at[::CHECKPOINT]

    def unpack(self, words, n: int, checkpoints):
        """The n ids of a payload: the stretches from all checkpoints advance together, one id a step."""
        import numpy as np

        lanes, after = len(checkpoints), words[1:]
        out, at = np.zeros((CHECKPOINT, lanes), np.int64), np.array(checkpoints, np.int64)
        rest = n - (lanes - 1) * CHECKPOINT
        drop, one, top = np.uint64(64 - self.bits), np.uint64(1), np.uint64(63)
        for step in range(CHECKPOINT if lanes > 1 else rest if lanes else 0):
            if step == rest:
                at = at[:-1]  # the last stretch may be shorter
            word, shift = at >> 6, (at & 63).view(np.uint64)
            window = (words[word] << shift) | ((after[word] >> one) >> (top - shift))
            entry = self.table[(window >> drop).view(np.int64)]
            out[step, : len(at)] = entry
            at = at + (entry & 255)
        return (out >> 8).astype(np.uint32).T.reshape(-1)[:n]


# --- blocks and files -----------------------------------------------------------------------------------------------


def write_block(code: Code, doc_ids: list, counts, ids) -> bytes:
    import numpy as np

    words, checkpoints = code.pack(ids)
    valid = bytes(x is not None for x in doc_ids)
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    head = struct.pack("<IQQ", len(doc_ids), len(ids), len(words))
    body = head + valid + keys + np.asarray(counts, "<u4").tobytes() + checkpoints.astype("<u8").tobytes() + words.astype("<u8").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(code: Code, data: bytes):
    """(document ids, counts, ids) of a block; an error if its CRC is wrong."""
    import numpy as np

    docs, n, size = struct.unpack_from("<IQQ", data)
    if struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(data[:-4]):
        raise ValueError("a block is damaged")
    at = 20
    valid = data[at : at + docs]
    keys = np.frombuffer(data, "<i8", docs, at := at + docs).tolist()
    counts = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    lanes = -(-n // CHECKPOINT)
    checkpoints = np.frombuffer(data, "<u8", lanes, at := at + 4 * docs)
    words = np.frombuffer(data, "<u8", size, at + 8 * lanes)
    return [k if v else None for k, v in zip(keys, valid, strict=True)], counts, code.unpack(words, n, checkpoints)


@lru_cache(maxsize=2)
def _code(uri: str) -> Code:
    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        return Code.from_bytes(f.read())


class LoadedTokenizer:
    """A tokenizer file as the library loads it, with an encoder of whole texts that remembers their pieces."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        split = made["pre_tokenizer"] or {}
        # only the byte-level split by the pattern that pretokens knows may be cut
        cut = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.texts, self.tokens = TextEncoder(self.encode_pieces, cut=cut, window=WINDOW, memory=MEMORY), self.library.model.tokenize
        self.added = [t["content"] for t in made["added_tokens"]]
        self.symbols = self.library.get_vocab_size()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: of one word by the library's model alone, which takes it in the byte alphabet, else by the library whole."""
        tokens, alphabet, blank = self.tokens, byte_alphabet(), byte_alphabet()[32]
        flat, ends, rest = [], [], []
        for k, piece in enumerate(pieces):
            spaced = piece[:1] == b" "
            word = piece[1:] if spaced else piece
            if not self.texts.cut:
                rest.append(k)
            elif word.isalpha():  # ASCII letters stand for themselves
                flat += [t.id for t in tokens(blank + word.decode() if spaced else word.decode())]
            elif latin_word(word):
                flat += [t.id for t in tokens(piece.decode("latin-1").translate(alphabet))]
            else:
                rest.append(k)
            ends.append(len(flat))
        data = struct.pack(f"<{len(flat)}I", *flat)
        found = [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for k, e in zip(rest, self.library.encode_batch([pieces[k].decode() for k in rest], add_special_tokens=False), strict=True):
            found[k] = struct.pack(f"<{len(ids)}I", *ids) if (ids := e.ids) else b""
        return found

    def encode_whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def batches(self, texts):
        """TextEncoder.batches(); a text in which the content of an added token occurs goes to the library whole."""
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = None
        for content in self.added:
            mask = pc.fill_null(pc.match_substring(texts, content), False)
            whole = mask if whole is None else pc.or_(whole, mask)
        if whole is None or not pc.any(whole).as_py():
            yield from self.texts.batches(texts)
            return
        for at, rows, ids in self.texts.batches(pc.if_else(whole, pa.scalar(None, texts.type), texts)):
            own = [self.encode_whole(texts[k].as_py()) if w else None for k, w in enumerate(whole.slice(at, rows).to_pylist(), at)]
            yield at, rows, pc.coalesce(pa.array(own, pa.binary()), ids)


def latin_word(word: bytes) -> bool:
    """Whether the split pattern has one match in a word: letters below U+0250, which are letters in every version of Unicode."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250"


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from 256 on in order."""
    rest = iter(range(256, 512))
    return {b: chr(b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else next(rest)) for b in range(256)}


@lru_cache(maxsize=2)
def loaded(path: str) -> LoadedTokenizer:
    return LoadedTokenizer(path)


def archive_ids(path: str, texts: list) -> list[bytes]:
    """The ids (u32) that the tokenizer as loaded gives each whole text, without special tokens of its own adding."""
    import pyarrow as pa

    return [x for _, _, ids in loaded(path).batches(pa.array(texts, pa.string())) for x in ids.to_pylist()]


def _values(ids, kind: str):
    """(numbers, bounds) of a binary array: value k is numbers[bounds[k]:bounds[k + 1]]."""
    import numpy as np

    width = np.dtype(kind).itemsize
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    numbers = np.frombuffer(ids.buffers()[2] or b"", kind, (int(ends[-1]) - int(ends[0])) // width, int(ends[0]))
    return numbers, (ends - ends[0]) // width


def _binary(numbers, bounds):
    """The binary array of which value k is the bytes of numbers[bounds[k]:bounds[k + 1]]."""
    import numpy as np
    import pyarrow as pa

    ends = (bounds * numbers.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(numbers)])


# --- jobs -----------------------------------------------------------------------------------------------------------


def write_archive(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, parts: int | None = None) -> list[tuple[int, str, int]]:
    """Encodes docs into an archive below folder (a URI all executors reach); returns (part, file, first id position).

    Null and empty texts have the end id alone. Rows are in ascending id order, null ids first; rows that share an id are
    ordered by a hash of their ids, so that many of them spread over several parts. An empty table gives a code without
    symbols and no files. Other columns are not read.
    """
    spark = docs.sparkSession
    # ids take two bytes each where the vocabulary allows
    kind = "<u2" if max(loaded(tokenizer).symbols, end_id + 1) <= 1 << 16 else "<u4"

    def stage(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for at, rows, ids in loaded(tokenizer).batches(batch.column(1)):
                numbers, bounds = _values(ids, "<u4")
                more = np.bincount(numbers, minlength=len(sums))
                more[: len(sums)] += sums
                more[end_id] += rows
                sums = more
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), _binary(numbers.astype(kind), bounds), pa.nulls(rows, pa.binary())], names=["id", "ids", "tally"])
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([sums.astype("<i8").tobytes()], pa.binary())], names=["id", "ids", "tally"])

    staged_at = f"{folder}/staged"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    map_batches(texts, stage, STAGED).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(STAGED).parquet(staged_at)

    def unfold(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                sums = np.frombuffer(batch.column(0)[k].as_py(), "<i8")
                found = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["id", "n"])

    # one tally a task, then one row per distinct id: the vocabulary bounds what reaches the driver
    counted = staged.filter("tally is not null").select("tally").mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    code = Code(counted["id"].to_numpy(), code_lengths(counted["n"].to_numpy())) if len(counted) else Code([], [])
    code_at = f"{folder}/code.bin"
    publish(code_at, lambda out: out.write(code.to_bytes()))

    def write(batches):
        import pyarrow as pa

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, uri, written = first.column(2)[0].as_py(), f"{folder}/part-{uuid.uuid4().hex}.knh", []

        def every():
            yield first
            yield from batches

        publish(uri, lambda out: written.append(_write_file(out, every(), kind, end_id, _code(code_at))))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array(written, pa.int64())], names=["part", "file", "n"])

    rows = staged.filter("tally is null").select("id", "ids").withColumn("h", F.xxhash64("ids"))
    rows = rows.repartitionByRange(parts or partitions(spark), F.col("id"), F.col("h")).sortWithinPartitions("id", "h", "ids")
    # one row per part; parts are bounded by the number of partitions
    found = map_batches(rows.select("id", "ids", F.spark_partition_id().alias("part")), write, PARTS).collect()
    starts, position = [], 0
    for part, file, n in sorted(map(tuple, found)):
        starts.append((part, file, position))
        position += n
    return starts


def _write_file(out, batches, kind: str, end_id: int, code: Code) -> int:
    """Writes the blocks, index and footer of one part from batches of (id, ids); returns how many ids it holds."""
    import numpy as np

    out.write(b"KNHF" + struct.pack("<I", zlib.crc32(code.to_bytes())))
    index, at, total = [], 8, 0
    keys, counts, held, size = [], [], [], 0

    def close():
        nonlocal at, total, keys, counts, held, size
        data = write_block(code, keys, counts, np.concatenate(held))
        out.write(data)
        index.append((at, len(data)))
        at, total = at + len(data), total + size
        keys, counts, held, size = [], [], [], 0

    for batch in batches:
        numbers, bounds = _values(batch.column(1), kind)
        numbers = np.insert(numbers, bounds[1:], end_id)  # each document's ids end with end_id
        bounds = bounds + np.arange(len(bounds))
        done, own = 0, batch.column(0).to_pylist()
        while done < len(own):
            upto = int(np.searchsorted(bounds, bounds[done] + BLOCK_IDS - size))
            upto = min(max(upto, done + 1), len(own))
            keys += own[done:upto]
            counts += np.diff(bounds[done : upto + 1]).tolist()
            held.append(numbers[bounds[done] : bounds[upto]])
            size += int(bounds[upto] - bounds[done])
            done = upto
            if size >= BLOCK_IDS:
                close()
    if keys:
        close()
    out.write(b"".join(struct.pack("<QQ", *x) for x in index) + struct.pack("<QI", at, len(index)) + b"KNHF")
    return total


def read_archive(spark: SparkSession, folder: str, files: list[tuple[int, str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from the archive files; ids as little-endian u32."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                code = _code(f"{folder}/code.bin")
                where, path = filesystem(row["file"])
                position = row["start"]
                with where.open_input_file(path) as f:
                    tail = f.read_at(16, f.size() - 16)
                    at, blocks = struct.unpack("<QI", tail[:12])
                    index = np.frombuffer(f.read_at(16 * blocks, at), "<u8").reshape(-1, 2).tolist()
                    if f.read_at(8, 0) != b"KNHF" + struct.pack("<I", zlib.crc32(code.to_bytes())):
                        raise ValueError("the file was written with another code")
                    for offset, size in index:
                        keys, counts, ids = read_block(code, f.read_at(size, offset))
                        ends = np.cumsum(counts, dtype=np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(position + ends - counts), pa.array(counts.astype(np.int64)), _binary(ids.astype("<u4"), np.append(0, ends))], names=["doc_id", "start", "n_tokens", "ids"])
                        position += int(ends[-1])

    return spark.createDataFrame(files, "part int, file string, start long").repartition(len(files)).mapInArrow(read, schema)


def archive_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The registered query: writes an archive to the shared folder, reads it back, and digests each document's ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = scratch(spark, "token-archive")
    back = read_archive(spark, folder, write_archive(docs, folder, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
