"""Words of letters, digits and non-ASCII characters, A-Z lower-cased, taken in pieces of bounded size. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once; a longer word is one piece.
PIECE = 1 << 20
#: Maps A-Z to a-z, leaves digits, a-z and bytes of non-ASCII characters, and turns all others into spaces.
FOLD = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 0x7F else 0x20 for b in bytes(range(256)).lower())


def word_pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, a bounded list at a time."""
    text = (text or b"").translate(FOLD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end
