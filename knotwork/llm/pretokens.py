"""Texts to token ids by their distinct pieces, on Arrow buffers.

A text is cut at places that no match of the split pattern PATTERN crosses, so each piece encodes on its own. All pieces
of a window of texts are dictionary-encoded at once, only the distinct ones are looked up or encoded, and the ids of all
texts are taken from theirs in one call. Work per occurrence of a word is done in numpy and Arrow, not in Python.

Which bytes may be cut apart, by class: behind a letter anything but a letter, behind a digit anything but a digit, behind
a mark white space, letters and digits (not behind an apostrophe, which may begin a contraction), before white space that
follows anything else, and around the last line end, tab or carriage return of a run that is not followed by white space.
Spaces stay with what follows, as the pattern keeps one. Bytes of which the class is not known are cut from nothing, but
from white space behind them where they cannot themselves be white space.
"""

from __future__ import annotations

from functools import lru_cache

#: The split pattern whose matches the rules below keep whole; texts are not cut for any other.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at a time; the arrays made meanwhile take about twelve times as much.
WINDOW = 1 << 20
#: Bytes that the remembered pieces of one encoder may take, by estimate, and the longest piece that is remembered.
MEMORY, LONGEST = 64 << 20, 64
#: Estimated bytes of an entry besides its piece and its ids.
ENTRY = 190

UNKNOWN, LETTER, DIGIT, SPACE, BREAK, APOSTROPHE, MARK = range(7)


@lru_cache(maxsize=1)
def _classes():
    """(class of each byte; whether two classes in turn may be cut apart)."""
    import numpy as np

    kind = np.full(256, UNKNOWN, np.uint8)
    kind[33:127] = MARK
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[32], kind[39], kind[[9, 10, 13]] = SPACE, APOSTROPHE, BREAK
    apart = np.zeros((8, 8), bool)
    apart[LETTER, [DIGIT, SPACE, BREAK, APOSTROPHE, MARK]] = True
    apart[DIGIT, [LETTER, SPACE, BREAK, APOSTROPHE, MARK]] = True
    apart[MARK, [LETTER, DIGIT, SPACE, BREAK]] = True
    apart[APOSTROPHE, [DIGIT, SPACE, BREAK]] = True
    apart[BREAK, [LETTER, DIGIT, APOSTROPHE, MARK]] = True
    return kind, apart.ravel()


def cuts(data):
    """The places inside `data` (UTF-8 bytes as uint8, cut at no character) before which it may be cut, as a mask; [0] is false."""
    import numpy as np

    kind, apart = _classes()
    k = kind[data]
    # two-byte letters: U+00C0 to U+017F without the signs of multiplication and division, U+0400 to U+047F
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xD1))
    lead = lead[np.isin(data[lead], (0xC3, 0xC4, 0xC5, 0xD0, 0xD1))]
    lead = lead[(data[lead] != 0xC3) | ~np.isin(data[lead + 1], (0x97, 0xB7))]
    k[lead] = k[lead + 1] = LETTER
    here = np.zeros(len(data), bool)
    here[1:] = apart[k[:-1] << 3 | k[1:]]
    # the last of a run of line ends, tabs and carriage returns is a match of its own
    last = np.flatnonzero(here[1:] & (k[:-1] == BREAK))
    here[last[last > 0]] = True
    # white space behind other characters: these end in a byte above 127 and are no white space themselves
    at = np.flatnonzero((k[:-1] == UNKNOWN) & ((k[1:] == SPACE) | (k[1:] == BREAK)) & (data[:-1] > 127))
    at = at[at > 2]
    one, two, three = data[at], data[at - 1], data[at - 2]
    blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    blank |= (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    here[at[~blank] + 1] = True
    return here


class Remembered:
    """What pieces became, in a table of bounded bytes: when the newer half is full it becomes the older."""

    def __init__(self, memory: int = MEMORY):
        self.most, self.held, self.newer, self.older = memory // 2, 0, {}, {}

    def all_of(self, pieces: list[bytes], compute) -> list[bytes]:
        """The values of distinct pieces; compute(pieces) gives those of the pieces not remembered."""
        newer, older = self.newer, self.older
        found = list(map(newer.get, pieces))
        lacking, keep = [], []
        for k, value in enumerate(found):
            if value is None:
                value = found[k] = older.get(pieces[k])
                (lacking if value is None else keep).append(k)
        if lacking:
            for k, value in zip(lacking, compute([pieces[k] for k in lacking]), strict=True):
                found[k] = value
        held, most = self.held, self.most
        for k in keep + lacking:
            piece = pieces[k]
            if len(piece) <= LONGEST:
                newer[piece] = value = found[k]
                held += ENTRY + len(piece) + len(value)
                if held >= most:
                    self.older, self.newer, held = newer, {}, 0
                    newer = self.newer
        self.held = held
        return found


class TextEncoder:
    """Encodes Arrow string arrays; encode_pieces(list of bytes) gives the ids of each piece as bytes of fixed width an id.

    With cut=False texts are pieces as they are, for patterns other than PATTERN.
    """

    def __init__(self, encode_pieces, cut: bool = True, window: int = WINDOW, memory: int = MEMORY):
        self.encode_pieces, self.cut, self.window, self.table = encode_pieces, cut, window, Remembered(memory)

    def batches(self, texts):
        """Yields (first, rows, ids): ids, a binary array, are those of the rows texts from `first` on; null texts count as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            upto = int(np.searchsorted(ends, ends[at] + self.window, "right")) - 1
            if upto <= at:
                yield at, 1, pa.array([self.encode_long(texts[at].as_buffer())], pa.binary())
                at += 1
                continue
            data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[at] : ends[upto]] if ends[upto] > ends[at] else np.zeros(0, np.uint8)
            yield at, upto - at, self.encode_window(data, ends[at : upto + 1] - ends[at])
            at = upto

    def encode_window(self, data, bounds):
        """The ids of the texts between bounds (positions in data, the first 0, the last its length), as a binary array."""
        import numpy as np
        import pyarrow as pa

        if not len(data):
            return pa.array([b""] * (len(bounds) - 1), pa.binary())
        here = cuts(data) if self.cut else np.zeros(len(data), bool)
        here[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(here), len(data))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        found = self.table.all_of(pieces.dictionary.to_pylist(), self.encode_pieces)
        taken = pa.array(found, pa.binary()).take(pieces.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[np.searchsorted(starts, bounds)]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), taken.buffers()[2]])

    def encode_long(self, data) -> bytes:
        """The ids of one text of any length, by windows that end at cuts; where a window has none it grows."""
        import numpy as np

        data, out, at, size = np.frombuffer(data, np.uint8), [], 0, self.window
        while at < len(data):
            part = data[at : at + size]
            if at + size < len(data) and self.cut:
                # two bytes of the end are left out, where what follows could undo a cut
                found = np.flatnonzero(cuts(part)[:-2])
                if not len(found):
                    size *= 2
                    continue
                part = part[: found[-1]]
            elif at + size < len(data):
                part = data[at:]
            out.append(self.encode_window(part, np.array([0, len(part)]))[0].as_py())
            at, size = at + len(part), self.window
        return b"".join(out)
