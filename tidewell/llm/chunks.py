"""Texts cut at places where byte-level pre-tokenizers always cut, and bounded memos of what each part encodes to.

The patterns of byte-level BPE attach one space to the word behind it. So a single space between two characters that
are no white space begins a new pre-token whatever stands around it, and both sides encode independently. A part is
one pre-token or several, which are remembered too: words that stand before a full stop or a line's end are known as
soon as they have stood alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_ODD, _CUT = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """Parts that give the text when joined by single spaces; each space belongs to the part behind it."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Memo:
    """pieces: the pre-tokens of a part, one if it is letters alone; encode: from a pre-token to its ids as bytes; word:
    the same for a space and these ASCII letters; many: from parts whose pre-tokens
    aren't told (pieces gives None) to their ids. About ``limit`` values are kept at most: what is asked for stays in
    the younger half, and when that is full the older one goes."""

    def __init__(self, pieces: Callable[[str], list[str] | None], encode: Callable[[str], bytes], word: Callable[[str], bytes], many: Callable[[list[str]], list[bytes]] | None = None, limit: int = 300_000):
        self.pieces, self.encode, self.word, self.many, self.limit = pieces, encode, word, many, limit
        self.known: dict[str, bytes] = {}  # by part, which a space precedes; by pre-token with a space before it, if none does
        self.old: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        name = piece[1:] if piece[0] == " " and len(piece) > 1 and piece[1] != " " else " " + piece
        value = self.known.get(name)
        if value is None:
            value = self.old.get(name)
            if value is None:
                value = self.encode(piece)
            self.known[name] = value
        return value

    def learn(self, missing: list[str]) -> None:
        """Values of parts that a space precedes."""
        known, old, pieces, encode, word, rest = self.known, self.old, self.pieces, self.encode, self.word, []
        for part in missing:
            if part in known:
                continue
            value = old.get(part)
            if value is None:
                if part.isascii() and part.isalpha():
                    value = word(part)
                elif (found := pieces(" " + part)) is None:
                    rest.append(part)
                    continue
                else:
                    value = encode(found[0]) if len(found) == 1 else b"".join(map(self.piece, found))
            known[part] = value
        if rest:
            known.update(zip(rest, self.many([" " + p for p in rest]), strict=True))

    def values(self, text: str) -> list[bytes]:
        first, *rest = parts(text)
        known = self.known
        found = list(map(known.get, rest))
        if None in found:
            if len(known) > self.limit // 2:
                self.old, self.known = known, {}
                known = self.known
            self.learn([p for p, value in zip(rest, found, strict=True) if value is None])
            found = [known[p] if value is None else value for p, value in zip(rest, found, strict=True)]
        if first:
            told = self.pieces(first)
            found.insert(0, b"".join(map(self.piece, told)) if told is not None else self.many([first])[0])
        return found
