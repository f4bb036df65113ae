"""Hashes against the words themselves."""

import random

import numpy as np

from gainsay.llm import crc32c, shingles
from gainsay.llm.crc32c import masked


def _texts(seed=1, number=60):
    rng = random.Random(seed)
    words = ["a", "Bb", "ccc", "é", "Über", "x" * 300, "end."]
    return ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t  "]) for _ in range(rng.randrange(12))) for _ in range(number)]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = _texts()
    hashes, first = shingles.word_hashes([t.encode() for t in texts])
    seen = {}
    for i, text in enumerate(texts):
        words = [w.decode() for w in shingles.lowered(text.encode()).split()]
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words)
        for word, value in zip(words, own):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_weighted_sets_are_the_shingles():
    texts = [*_texts(2), "", "  ", "one", "a b c d", "a b c d e", "A b c d E a b c d e a b c d e"]
    of, ids, counts = shingles.weighted_sets([t.encode() for t in texts])
    by_words = {}
    for i, text in enumerate(texts):
        exact = shingles.word_shingles(text)
        own = ids[of == i].tolist()
        assert len(own) == len(exact)
        by_words.setdefault(frozenset(exact), frozenset(own))
        assert by_words[frozenset(exact)] == frozenset(own)
        words = text.split()
        assert counts[of == i].sum() == (max(len(words) - 4, 1) if words else 0)


def test_pieces_of_any_size_give_the_same(monkeypatch):
    texts = [t.encode() for t in [*_texts(4), "", "y" * 3000, "é" * 700 + " z"]]
    separators = shingles._SPACE.copy()
    separators[ord(".")] = True
    expected = shingles.prefix_hashes(texts, separators, (2, 5, 250))
    sets, whole = shingles.shingle_hashes(texts), shingles.weighted_sets(texts, 3)
    for size in (7, 64, 1000):
        monkeypatch.setattr(shingles, "_PIECE", size)
        shingles._power_tables.cache_clear()
        hashes, first, prefixes = shingles.prefix_hashes(texts, separators, (2, 5, 250))
        assert (hashes == expected[0]).all() and (first == expected[1]).all()
        assert all((a == b).all() for a, b in zip(prefixes, expected[2]))
        assert all((a == b).all() for a, b in zip(shingles.shingle_hashes(texts), sets))
        assert all((a == b).all() for a, b in zip(shingles.weighted_sets(texts, 3), whole))
    monkeypatch.undo()
    shingles._power_tables.cache_clear()


def test_a_hash_is_a_polynomial_over_the_bytes():
    hashes, _ = shingles.word_hashes([b"ab c"])
    value = (ord("a") + 1 + (ord("b") + 1) * shingles._BASE) % (1 << 64)
    assert hashes[0] == shingles.mix(np.array([value ^ (2 << 56)], dtype=np.uint64))[0]


def test_crc32c():
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = (crc >> 1) ^ (crc32c.POLYNOMIAL if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = np.random.default_rng(3)
    records = [b"123456789", bytes(4), *(rng.bytes(n) for n in (4, 5, 255, 256, 257, 1000, 3000))]
    assert crc32c.crc32c(records).tolist() == [plain(r) for r in records]
    assert crc32c.crc32c(records)[0] == 0xE3069283
    assert crc32c.crc32c([]).tolist() == []
    value = int(crc32c.crc32c(records)[0])
    rotated = ((value >> 15) | (value << 17)) & 0xFFFFFFFF
    assert int(masked(records)[0]) == (rotated + 0xA282EAD8) & 0xFFFFFFFF
