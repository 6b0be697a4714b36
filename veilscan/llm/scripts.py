"""Character classes for splitting text as the tokenizer libraries do, for the characters where a plain pattern is exact."""

from __future__ import annotations

import re
import unicodedata

#: White space as Unicode's White_Space property has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Below this code point, and in general punctuation, letters and digits are the same in every Unicode version in use.
_LIMIT = 0x370
#: Texts of only these characters can be split with the plain patterns.
PLAIN = re.compile("[\x00-ͯ‐-‧‰-⁞]*")


def _ranges(kind: str) -> str:
    out, codes = "", [c for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind]
    while codes:
        end = 0
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out += re.escape(chr(codes[0])) + ("-" + re.escape(chr(codes[end])) if end else "")
        codes = codes[end + 1 :]
    return out


LETTERS, NUMBERS = _ranges("L"), _ranges("N")


def is_plain(text: str) -> bool:
    return text.isascii() or PLAIN.fullmatch(text) is not None


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
