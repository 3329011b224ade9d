"""Splitting texts as the byte-level tokenizer file prescribes, with a bounded per-process memo of pieces."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of these characters only are split by the standard library: there \w, \d and \s agree with the
#: Unicode classes of the byte-level split pattern, which _FAST writes in their terms.  Control characters that only Python calls white space are outside.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xc0-ɏ‐-‧‰-⁞]*\Z")
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def piece_finder(library):
    """A function text -> list of pieces (str).  Unusual characters go through the library's own splitter, which
    ``library()`` makes when it is first needed."""
    made: list = []

    def pieces(text: str) -> list[str]:
        if _PLAIN.match(text):
            return _FAST.findall(text)
        if not made:
            made.append(library())
        return [text[a:b] for _, (a, b) in made[0].pre_tokenize_str(text)]

    return pieces


def split_special(text: str, special: re.Pattern | None) -> list[str]:
    """Odd items are special tokens, as ``re.split`` with one group returns them."""
    return [text] if special is None else special.split(text)


class PieceMemo(dict):
    """piece -> packed ids.  At ``most`` pieces all go that the lists at hand don't need, so its memory stays bounded."""

    def __init__(self, encode_many, most: int = 600_000):
        super().__init__()
        self.encode_many, self.most = encode_many, most

    def learn(self, lists: list[list[str]]) -> None:
        """Make sure that every piece of the lists is known."""
        pieces = set().union(*lists)
        new = pieces.difference(self)
        if len(self) + len(new) > self.most:
            kept = {p: self[p] for p in pieces - new}
            self.clear()
            self.update(kept)
        if new:
            new = list(new)
            self.update(zip(new, self.encode_many(new), strict=True))

    def encode(self, texts: list[str | None], pieces, special: re.Pattern | None, added: dict[str, bytes]) -> list[bytes]:
        """Packed ids of whole texts (null: none); ``special`` finds the tokens that stand for themselves."""
        split = [split_special(t or "", special) for t in texts]
        lists = [[pieces(x) for x in parts[::2]] for parts in split]
        self.learn([x for parts in lists for x in parts])
        get, out = self.__getitem__, []
        for parts, own in zip(split, lists, strict=True):
            ids = b"".join(map(get, own[0]))
            for token, x in zip(parts[1::2], own[1:], strict=True):
                ids += added[token] + b"".join(map(get, x))
            out.append(ids)
        return out


def blocks(column: pa.Array, most: int = 4 << 20):
    """(start, length) of consecutive rows holding about ``most`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes.astype("i8")) // most, prepend=0)) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(sizes)]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(a), int(b - a)
