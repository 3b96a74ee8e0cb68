"""Texts as seekable compressed frames: cut anywhere, decompress only the frame that is cut.

A unit is a word with the blanks in front of it; blanks that end a text are a
unit of their own.  A text is stored as independent zstandard frames, one behind
the other, each of whole units.  Beside them stand cumulative counts of units, code
points and compressed bytes, so the frame that holds a unit is found by bisection.
The frames of a text joined are an ordinary zstandard file.

Frames hold about ``FRAME_BYTES`` of text each; a single longer word is one frame.
Null and empty texts have no frames.  Malformed bytes are kept as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard

#: Text that a frame aims at.
FRAME_BYTES = 32 << 10
LEVEL = 3

_WORD_END = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def compress(part: bytes) -> bytes:
    return _compressor().compress(part)


def decompress(frame: bytes) -> bytes:
    return _decompressor().decompress(frame)


def n_units(part: bytes) -> int:
    """Units of a text, or of a frame that ends one."""
    return len(part.split()) + bool(part and _BLANK[part[-1]])


def n_chars(part: bytes) -> int:
    """Code points: bytes that do not continue one."""
    if part.isascii():
        return len(part)
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def unit_end(part: bytes, units: int) -> int:
    """Where the first ``units`` units of a frame end."""
    if not units:
        return 0
    blank = _BLANK[np.frombuffer(part, np.uint8)]
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    return int(ends[units - 1]) if units <= len(ends) else len(part)


def split(text: bytes, size: int = FRAME_BYTES) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end where a unit does."""
    start = 0
    while start < len(text):
        found = _WORD_END.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


@dataclass(frozen=True)
class Frames:
    """Compressed frames and what each adds up to; ``units``, ``chars`` and ``ends`` are cumulative."""

    data: bytes
    ends: list[int]
    units: list[int]
    chars: list[int]

    @staticmethod
    def of(text: bytes, size: int = FRAME_BYTES) -> Frames:
        blobs, units, chars = [], [], []
        for piece in split(text, size):
            blobs.append(compress(piece))
            units.append(n_units(piece))
            chars.append(n_chars(piece))
        add_up = lambda values: np.cumsum(values, dtype=np.int64).tolist()
        return Frames(b"".join(blobs), add_up([len(b) for b in blobs]), add_up(units), add_up(chars))

    @property
    def n_units(self) -> int:
        return self.units[-1] if self.units else 0

    def frame(self, at: int) -> bytes:
        """The compressed bytes of a frame."""
        return self.data[self.ends[at - 1] if at else 0 : self.ends[at]]

    def select(self, first: int, last: int) -> tuple[list[bytes], int]:
        """Frames of units ``first .. last`` (end excluded) and their code points.

        Whole frames are passed on as they are; only those that are cut are decompressed.
        """
        parts, chars = [], 0
        if first >= last:
            return parts, chars
        for at in range(bisect_right(self.units, first), bisect_left(self.units, last) + 1):
            before = self.units[at - 1] if at else 0
            if first <= before and self.units[at] <= last:
                parts.append(self.frame(at))
                chars += self.chars[at] - (self.chars[at - 1] if at else 0)
                continue
            text = decompress(self.frame(at))
            piece = text[unit_end(text, max(0, first - before)) : unit_end(text, last - before)]
            parts.append(compress(piece))
            chars += n_chars(piece)
        return parts, chars
