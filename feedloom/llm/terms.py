"""Terms of whole texts, as bytes of UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

#: Long texts are cut into terms piece by piece; a piece ends where a term ends.
PIECE = 1 << 20


def byte_table(digits: bool) -> bytes:
    """Bytes of terms as they are (A-Z in lower case), all others as spaces.

    Letters of ASCII and all other characters belong to terms, digits if asked for. Bytes of a
    character beyond ASCII are never below 0x80, so a term never ends within a character.
    """
    kept = bytearray(b" " * 256)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or (b < 0x80 and c.isalpha()) or (digits and b < 0x80 and c.isdigit()):
            kept[b] = ord(c.lower()) if b < 0x80 else b
    return bytes(kept)


LETTERS, LETTERS_AND_DIGITS = byte_table(False), byte_table(True)


def term_lists(raw: bytes | None, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in their order, as one list for each piece of the text."""
    if not raw:
        return
    flat = raw.translate(table)
    at = 0
    while len(flat) - at > piece:
        cut = flat.rfind(b" ", at, at + piece)
        if cut <= at:
            cut = flat.find(b" ", at + piece)
            if cut < 0:
                break
        yield flat[at:cut].split()
        at = cut
    yield flat[at:].split()
