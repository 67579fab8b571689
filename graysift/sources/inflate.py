"""Unpacking piece by piece, with a bound."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

#: Bytes that are unpacked at a time.
PIECE = 1 << 20


class TooMuch(ValueError):
    pass


def inflated(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """pieces of an unpacked stream, until there are more than most bytes of them."""
    for piece in pieces:
        most -= len(piece)
        if most < 0:
            raise TooMuch("pakt uit tot meer dan betrouwbaar te lezen is")
        yield piece


def unzipped(data: bytes) -> Iterator[bytes]:
    """A zlib stream piece by piece; zlib.error if it is none."""
    unpack = zlib.decompressobj()
    piece = unpack.decompress(data, PIECE)
    while piece:
        yield piece
        piece = unpack.decompress(unpack.unconsumed_tail, PIECE)
