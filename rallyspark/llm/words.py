"""Words of UTF-8 texts: runs of digits, letters A-Z in lower case and characters beyond ASCII, read from whole texts in bounded parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def parts_of_words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists for about ``size`` bytes each; only A-Z are lower-cased and no word is cut."""
    at, n = 0, len(text)
    while at < n:
        cut = _GAP.search(text, at + size) if n - at > size else None
        end = cut.start() if cut else n
        yield WORD.findall(text[at:end].lower())
        at = end


def utf8(column: pa.Array) -> list[bytes | None]:
    """Strings of an Arrow column as bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
