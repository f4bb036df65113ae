"""Hashes of word shingles, for whole slices of texts at a time.

Words are what ASCII white space separates, in lower case. A shingle is five following words; a text
of one to four words has one shingle of all its words, an empty one has none. The hash of a word is a
polynomial over its bytes, taken from running sums, so the work is a few passes over the bytes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WIDTH = 5
ID_BITS = 48

_BASE = 0x9E3779B97F4A7C15
_ODD = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
        0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
# Texts and words are worked on in pieces of this many bytes and words, so tables do not grow with a text.
_PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, as far as a piece reaches."""
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(_PIECE + 1, base, dtype=np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    return tables[0], tables[1]


def lowered(text: bytes) -> bytes:
    """Lower case of UTF-8 bytes, beyond ASCII too."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the position of each text's first word (one more at the end)."""
    hashes, first, _ = prefix_hashes(texts, _SPACE, ())
    return hashes, first


def prefix_hashes(
    texts: list[bytes], separators: np.ndarray, lengths: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Like ``word_hashes`` for words between any ``separators`` (of all byte values), and the hashes of the
    first so many bytes of every word; where a word is not longer, of the whole word. In lower case."""
    texts = [lowered(text) for text in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    starts, ends = _words(data, separators)
    stops = [ends, *(np.minimum(ends, starts + length) for length in lengths)]
    found = [np.empty(len(starts), dtype=np.uint64) for _ in stops]
    power, inverse = _power_tables()
    for at in range(0, len(data), _PIECE):
        piece = data[at : at + _PIECE]
        i, j = np.searchsorted(starts, [at, at + len(piece)])
        if i == j:
            continue
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
        begin = starts[i:j] - at
        for values, stop in zip(found, stops):
            inside = np.minimum(stop[i:j] - at, len(piece))
            values[i:j] = (sums[inside] - sums[begin]) * inverse[begin]
            # Only the last word can reach beyond the piece.
            if stop[j - 1] > at + len(piece):
                values[j - 1] = _across(data, int(starts[j - 1]), int(stop[j - 1]))
    for values, stop in zip(found, stops):
        values[:] = mix(values ^ ((stop - starts).astype(np.uint64) << np.uint64(56)))
    return found[0], np.searchsorted(starts, text_starts), found[1:]


def _words(data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; the last byte is a separator."""
    starts, ends, before = [], [], True
    for at in range(0, len(data), _PIECE):
        space = separators[data[at : at + _PIECE]]
        earlier = np.concatenate([[before], space[:-1]])
        starts.append(np.flatnonzero(~space & earlier) + at)
        ends.append(np.flatnonzero(space & ~earlier) + at)
        before = bool(space[-1])
    return np.concatenate(starts), np.concatenate(ends)


def _across(data: np.ndarray, start: int, stop: int) -> np.uint64:
    """The sum of a word that reaches over pieces: those of its parts, each times its distance."""
    power, total = _power_tables()[0], 0
    for at in range(start, stop, _PIECE):
        part = data[at : min(at + _PIECE, stop)].astype(np.uint64) + np.uint64(1)
        total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - start, 1 << 64)
    return np.uint64(total % (1 << 64))


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of every shingle, in order; repeats stay."""
    words, first = word_hashes(texts)
    counts = np.diff(first)
    padded = np.concatenate([words, np.zeros(width - 1, dtype=np.uint64)])
    places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for start in range(0, len(words), _PIECE):
        at = np.arange(start, min(start + _PIECE, len(words)))
        text_of = np.searchsorted(first, at, side="right") - 1
        place = at - first[text_of]
        room = counts[text_of] - place
        keep = (room >= width) | (place == 0)
        at, room = at[keep], room[keep]
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(width):
            part = padded[at + j] * np.uint64(_ODD[j % len(_ODD)] + 2 * (j // len(_ODD)))
            total += np.where(room > j, part, np.uint64(0))
        places.append(text_of[keep])
        hashes.append(mix(total))
    return np.concatenate(places), np.concatenate(hashes)


def weighted_sets(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle id (48 bits) and number of occurrences of every distinct shingle of each text."""
    text_of, hashes = shingle_hashes(texts, width)
    if len(texts) >= 1 << (64 - ID_BITS):
        raise ValueError("too many texts in one slice")
    keys = (text_of.astype(np.uint64) << np.uint64(ID_BITS)) | (hashes >> np.uint64(64 - ID_BITS))
    keys, counts = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(ID_BITS)).astype(np.int64), keys & np.uint64((1 << ID_BITS) - 1), counts


def word_shingles(text: str | None, width: int = WIDTH) -> set[tuple[str, ...]]:
    """The shingles themselves, for exact checks: no hashes."""
    words = lowered((text or "").encode()).split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))}
