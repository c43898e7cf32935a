"""Byte-level BPE encoding and decoding by ranks, with a hierarchical bitmap as the merge queue.

Merging a pre-token: the pairs of neighbouring parts wait in buckets, one per merge rank, as positions of a linked list.
A bitmap of two levels knows which buckets hold anything, so find-first-set gives the lowest rank in two steps whatever
the length; an entry whose pair has changed meanwhile is stale and skipped. The work for a
pre-token of n bytes is n queue operations, with no scan over what remains.

Words repeat, so each distinct piece of a window of texts is merged once (see pretokens) and the ids of short pieces are
kept in a table of bounded bytes in each Python worker.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches
from knotwork.llm.pretokens import PATTERN, TextEncoder

#: The lower level of the bitmap has words of 2**WORD_BITS ranks; the upper level is one word over those.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1


def add_position(buckets: dict, rank: int, position: int) -> None:
    """Adds a position to a bucket that holds one, or a heap of several."""
    held = buckets[rank]
    if held.__class__ is int:
        buckets[rank] = [held, position] if held < position else [position, held]
    else:
        heappush(held, position)


class BytePairCodec:
    """Encodes by a table of ranks {bytes: id} and a split pattern; decodes by the same table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import pyarrow as pa
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        tokens = {v: k for k, v in ranks.items()}
        #: The bytes of each id; null where a number is no id.
        self.tokens = pa.array([tokens.get(k) for k in range(max(tokens) + 1)], pa.binary())
        #: The ranks of pairs of bytes.
        self.pairs = {(k[0], k[1]): v for k, v in ranks.items() if len(k) == 2}
        #: The lower level of the bitmap, a word for WORD ranks; all zero between two pre-tokens.
        self.low = [0] * ((max(ranks.values()) >> WORD_BITS) + 1)
        self.texts = TextEncoder(self.encode_pieces, cut=pattern == PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest-ranked, then leftmost pair merges until none is in the table.

        Bucket r holds the positions whose pair merges to rank r: one position, or a heap of several. A merge only makes
        pairs longer than the token it makes, so a bucket never grows while it is the lowest.
        """
        get, longest, low = self.ranks.get, self.longest, self.low
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, high, buckets = len(piece), 0, {}
        ends = list(range(1, n + 1))  # part i is piece[i:ends[i]]; ends[i] is also the next part's position
        starts = list(range(-1, n))  # starts[i]: the position of the part before i
        waiting = [*map(self.pairs.get, zip(piece, piece[1:])), None, None]  # the rank for which the pair at i waits
        for i, r in enumerate(waiting):
            if r is not None:
                if r in buckets:
                    add_position(buckets, r, i)
                else:
                    buckets[r] = i
                    word = r >> WORD_BITS
                    low[word] |= 1 << (r & WORD_MASK)
                    high |= 1 << word
        while high:
            # find first set in the upper, then in the lower level
            word = (high & -high).bit_length() - 1
            held = low[word]
            r = (word << WORD_BITS) + (held & -held).bit_length() - 1
            i = buckets[r]
            if i.__class__ is int:
                del buckets[r]
                held = low[word] = held & (held - 1)
                if not held:
                    high &= high - 1
            else:
                bucket, i = i, heappop(i)
                if len(bucket) == 1:
                    buckets[r] = bucket[0]
            if waiting[i] != r:
                continue  # stale: the pair has changed
            j = ends[i]
            waiting[j] = None
            end = ends[i] = ends[j]
            if end < n:
                starts[end] = i
                after = ends[end]
                r = waiting[i] = get(piece[i:after]) if after - i <= longest else None
                if r is not None:
                    if r in buckets:
                        add_position(buckets, r, i)
                    else:
                        buckets[r] = i
                        word = r >> WORD_BITS
                        low[word] |= 1 << (r & WORD_MASK)
                        high |= 1 << word
            else:
                waiting[i] = None
            if i:
                i = starts[i]
                r = waiting[i] = get(piece[i:end]) if end - i <= longest else None
                if r is not None:
                    if r in buckets:
                        add_position(buckets, r, i)
                    else:
                        buckets[r] = i
                        word = r >> WORD_BITS
                        low[word] |= 1 << (r & WORD_MASK)
                        high |= 1 << word
        out, i = [], 0
        while i < n:
            end = ends[i]
            out.append(get(piece[i:end]))
            i = end
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, every match of the pattern merged separately."""
        split, merge, whole = self.pattern.findall, self.merge, self.texts.cut
        out = []
        for piece in pieces:
            if whole and (piece.isalpha() or piece[:1] == b" " and piece[1:].isalpha()):  # one run of ASCII letters is one match
                ids = merge(piece)
            else:
                ids = [i for match in split(piece.decode()) for i in merge(match.encode())]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        import pyarrow as pa

        ((_, _, ids),) = self.texts.batches(pa.array([text], pa.string()))
        return ids[0].as_py()

    def decode(self, ids: bytes) -> bytes:
        import pyarrow as pa

        return self.decode_array(pa.array([ids], pa.binary()))[0].as_py()

    def decode_array(self, ids):
        """The bytes that each value of a binary array of ids stands for; null values give none."""
        import numpy as np
        import pyarrow as pa

        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        every = np.frombuffer(ids.buffers()[2] or b"", "<u4", (ends[-1] - ends[0]) // 4, int(ends[0]))
        taken = self.tokens.take(pa.array(every))
        if taken.null_count:
            raise ValueError("an id is not in the table")
        if not len(every):
            return pa.array([b""] * len(ids), pa.binary())
        cut = np.frombuffer(taken.buffers()[1], np.int32)[(ends - ends[0]) // 4]
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cut.astype(np.int32)), taken.buffers()[2]])


@lru_cache(maxsize=2)
def rank_codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, made once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return BytePairCodec(ranks, pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _mapped(df: DataFrame, column: str, made: tuple[str, ...], compute) -> DataFrame:
    """df with binary columns `made` appended: compute(array) yields (first, rows, arrays of these columns) window by window."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([f for f in df.schema.fields if f.name not in made] + [StructField(m, BinaryType()) for m in made])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rest = [k for k, name in enumerate(batch.schema.names) if name not in made]
            for at, rows, arrays in compute(batch.column(batch.schema.get_field_index(column))):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, rows) for k in rest), *arrays], names=[*(batch.schema.names[k] for k in rest), *made])

    return map_batches(df, run, schema)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ids_col, the ids of the whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids (an empty value). Special tokens are not recognised: their strings are ordinary
    text. A column of docs named ids_col is replaced; all others pass through. An empty table stays empty.
    """
    path, pat = ranks or default_ranks()[0], pattern or default_ranks()[1]

    def compute(texts):
        for at, rows, ids in rank_codec(path, pat).texts.batches(texts):
            yield at, rows, (ids,)

    return _mapped(docs, text_col, (ids_col,), compute)


def decode(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with bytes_col, the bytes that the ids stand for; null ids give empty bytes and unknown ids are an error."""
    path, pat = ranks or default_ranks()[0], pattern or default_ranks()[1]

    def compute(ids):
        for at in range(0, len(ids), 1024):
            part = ids.slice(at, 1024)
            yield at, len(part), (rank_codec(path, pat).decode_array(part),)

    return _mapped(df, ids_col, (bytes_col,), compute)


def encode_and_decode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) by one Python worker a task: its tables are held once. See encode() for the cases."""
    path, pat = ranks or default_ranks()[0], pattern or default_ranks()[1]

    def compute(texts):
        codec = rank_codec(path, pat)
        for at, rows, ids in codec.texts.batches(texts):
            yield at, rows, (ids, codec.decode_array(ids))

    return _mapped(docs, text_col, (ids_col, bytes_col), compute)


def digests(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The registered query's columns: encodes, decodes what was encoded, and digests both."""
    done = encode_and_decode(docs.select(id_col, "text")).drop("text")
    return done.select(id_col, F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
