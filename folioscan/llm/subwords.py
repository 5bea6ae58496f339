"""Hashed character n-grams of texts, as flat numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: A flat array holds about so many characters, of at most so many texts; longer texts are cut at white space.
FLAT, MOST_TEXTS = 250_000, 256
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def cut(text: str, begin: int) -> int:
    """Where a part that begins at `begin` ends: after white space if the part has any, so that no n-gram is lost."""
    end = begin + FLAT
    if len(text) <= end:
        return len(text)
    while end > begin and text[end - 1] not in " \t\n\v\f\r":
        end -= 1
    return end if end > begin else begin + FLAT


def words_before(text: str, end: int, words: int) -> int:
    """Where the last so many words before `end` begin, within the last FLAT // 2 characters; `end` if they don't."""
    low = max(0, end - FLAT // 2)
    starts = [m.end() for m in _SPACES.finditer(text, low, end) if m.end() < end]
    return starts[-words] if words and len(starts) >= words else end


def parts(texts: Sequence[str], overlap: int = 0) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in runs of about FLAT characters: the index of each part's text, and the parts. Parts of one text share `overlap` words."""
    at, run, chars = [], [], 0
    for i, text in enumerate(texts):
        begin = 0
        while True:
            end = cut(text, begin)
            at.append(i)
            run.append(text[begin:end])
            chars += end - begin
            if chars >= FLAT or len(run) >= MOST_TEXTS:
                yield np.array(at), run
                at, run, chars = [], [], 0
            if end >= len(text):
                break
            begin = max(words_before(text, end, overlap), begin + 1) if overlap else end
    if run:
        yield np.array(at), run


def flat(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case parts, each between spaces; which are spaces or signs; where each part begins."""
    low = [t.lower() for t in run]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    # ASCII characters that aren't letters or digits part words like space does, so n-grams are of letters.
    space = (codes < 48) | ((codes > 57) & (codes < 97)) | ((codes > 122) & (codes < 128))
    codes[space] = 32
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])[:-1]]).astype(np.int64)
    return codes, space, starts


def grams(codes: np.ndarray, space: np.ndarray, sizes: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the positions at which an n-gram begins, and their buckets. An n-gram may begin and end with the space around a word and has none inside."""
    hashes, inside = codes.astype(np.uint32), np.ones(len(codes), bool)
    for n in range(2, sizes.stop):
        hashes = hashes[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        inside = inside[:-1]
        if n > 2:
            inside = inside & ~space[n - 2 : len(space) - 1]
        if n in sizes:
            at = np.flatnonzero(inside if n > 2 else inside & ~(space[:-1] & space[1:]))
            yield at, ((hashes[at] ^ np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - bits)
