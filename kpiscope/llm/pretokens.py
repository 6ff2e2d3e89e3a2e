"""Pre-tokens of byte-level BPE and a bounded memo of their ids, used by both tokenising operators.

A text is cut at every single space between two other characters. No match of the pattern crosses such a place: what
holds the character before it cannot hold the space, and nothing looks back. So the pieces can be encoded one by one,
and equal pieces once. Texts with other runs of white space are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

ODD_SPACES = re.compile(r" (?:\s|\Z)|[^\S ] ")
#: All white space but the space and the line feed; most texts have none.
RARE_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: White space as the tokenizers' libraries see it (the Unicode property), spelled out.
#: What an entry of the memo takes beside its characters: two objects and a place in a dictionary.
ENTRY_BYTES = 200
WHITE = r"\t-\r \x85\xa0  -     　"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled).findall


def has_odd_spaces(text: str) -> bool:
    """Whether ODD_SPACES is found; searches for fixed strings first, which is much faster."""
    maybe = "  " in text or " \n" in text or "\n " in text or text.endswith(" ") or any(c in text for c in RARE_WHITE)
    return maybe and ODD_SPACES.search(text) is not None


class Memo:
    """Ids (little-endian int32) of texts; encode takes distinct strings and returns the ids of each.

    It gets pre-tokens, or with whole=True the pieces between single spaces and texts with odd white space as they are.
    limit bounds the number of pieces kept between batches and most_bytes their size, not what is encoded.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]], whole: bool = False, limit: int = 300_000, most_bytes: int = 1 << 62):
        self.split = (lambda t: [t]) if whole else splitter(pattern)
        self.encode, self.whole, self.limit, self.most_bytes = encode, whole, limit, most_bytes
        self.held = 0
        self.spaced: dict[str, bytes] = {}  # pieces that follow a space
        self.plain: dict[str, bytes] = {}  # pieces at the start, and pre-tokens

    def _learn(self, new: list[str], to: dict[str, bytes], before: str) -> None:
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.whole:
            to.update(zip(new, self.encode([before + piece for piece in new]), strict=True))
            return
        cut = [self.split(before + piece) for piece in new]
        unknown = list(set().union(*cut).difference(self.plain))
        self.held += sum(map(len, unknown)) + ENTRY_BYTES * len(unknown)
        self.plain.update(zip(unknown, self.encode(unknown), strict=True))
        get = self.plain.__getitem__
        to.update((piece, get(ts[0]) if len(ts) == 1 else b"".join(map(get, ts))) for piece, ts in zip(new, cut, strict=True))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.spaced) + len(self.plain) > self.limit or self.held > self.most_bytes:
            self.spaced.clear()
            self.plain.clear()
            self.held = 0
        plain, rest = [], []
        for t in texts:
            if t and has_odd_spaces(t):
                plain.append(self.split(t))
                rest.append([])
            else:
                head, *tail = (t or "").split(" ")
                plain.append([head] if head else [])
                rest.append(tail)
        self._learn(list(set().union(*plain).difference(self.plain)), self.plain, "")
        self._learn(list(set().union(*rest).difference(self.spaced)), self.spaced, " ")
        a, b = self.plain.__getitem__, self.spaced.__getitem__
        return [b"".join(map(a, x)) + b"".join(map(b, y)) for x, y in zip(plain, rest, strict=True)]
