"""Pre-tokens of byte-level BPE, split chunk by chunk so that a frequent chunk is split once.

A chunk starts at a space or line feed that stands alone between two characters that are not
white space. No match of the pattern crosses such a place, so chunks can be split by themselves.
Texts with other runs of white space are split whole; the matches are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Unicode's White_Space characters, which \\s stands for in the BPE library.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Chunks:
    """encode(text) joins, chunk by chunk, the bytes that `encode_part` makes of a chunk."""

    def __init__(self, encode_part: Callable[[str], bytes], most: int = 300_000):
        self.encode_part = encode_part
        self.known: dict[str, bytes | None] = {}
        self.most = most

    def _of(self, part: str) -> bytes | None:
        """None where the chunk rule does not hold."""
        line = part[:1] == "\n"
        if part in ("", "\n") or part[-1].isspace() or part[line].isspace():
            return None
        return self.encode_part(part if line else " " + part)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.replace("\n", " \n").split(" ")
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = list(map(known.get, parts))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    part = parts[i]
                    if part not in known:
                        known[part] = self._of(part)
                    out[i] = known[part]
                    if out[i] is None:
                        return self.encode_part(text)
        if not first or first[-1].isspace() or first[0].isspace():
            return self.encode_part(text)
        return self.encode_part(first) + b"".join(out)
