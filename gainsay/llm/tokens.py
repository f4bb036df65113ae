"""Token ids of whole texts, word by word through a bounded cache.

The tokenizer's pieces never reach across white space, so the ids of a text are those of its words one
after the other. Words repeat far more often than texts do: Arrow splits the texts of a slice and numbers their
distinct words, and only these are looked at one by one. Each worker process keeps the ids of words it has
met and asks the tokenizer only for new ones. A word of letters with marks behind it is kept as its letters
in lower case and its marks, so that one entry serves all its forms. Two generations, bounded in bytes, hold
the cache without losing the frequent words; tasks of other operators free it.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gainsay.llm.common import keeps

GENERATION_BYTES = 32 << 20
# Texts encoded at a time: the more, the fewer times a word is looked up.
SLICE_BYTES = 4 << 20
# What a word and its ids take beside their own bytes.
_ENTRY_BYTES = 160
# Longer words hardly ever come again and are not kept.
_LONGEST = 64

# A mark that is one id of its own between white space; words that hold it are encoded alone.
_MARK = b"~"
_BETWEEN = b" ~ "
_TOGETHER = 32
# Texts given to the tokenizer in one call: its encodings take many times the memory of their ids.
_AT_ONCE = 64

# For words in lower case by Python: its lower case depends on its place in a word.
_FINAL = "Σ"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for every byte: its own, or one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) for byte in printable} | {byte: chr(256 + i) for i, byte in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _plain_letters() -> str:
    """Letters that stay as they are in NFC and whose lower case is one letter wherever they stand."""
    found = [chr(code) for code in range(0x41, 0x500) if chr(code).isalpha()]
    lower = pc.utf8_lower(pa.array(found)).to_pylist()
    return "".join(
        a for a, b in zip(found, lower)
        if b == a.lower() and b.isalpha() and all(unicodedata.normalize("NFC", c) == c for c in (a, b))
    )


_LETTERS = _plain_letters()
# Marks that make one piece behind letters; an apostrophe may begin another.
_MARKS = string.punctuation.replace("'", "")

# Words on which the shorter ways must give the tokenizer's ids, else they are not taken.
_PROBES = [
    word + marks
    for word in (
        "The", "understanding", "straße", "niño", "Слово", "ΣΑΣ", "thndhain", "漢字ｶﾞ", "ÅÉ",
        *(_LETTERS[i : i + 9] for i in range(0, len(_LETTERS), 9)),
    )
    for marks in ("", ".", ",", "!?", "%%%", "-~")
] + [f"Understanding{marks}" for marks in (*_MARKS, _MARKS, _MARKS[::-1])]

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    keeps("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str, generation_bytes: int = GENERATION_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._limit, self._bytes = generation_bytes, 0
        mark = self._tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self.largest_id = max(self._tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._model = self._tokenizer.model
        self._direct = self._agrees()

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = pc.ascii_split_whitespace(_readable(texts))
        coded = words.values.dictionary_encode()
        ids, place = self._distinct(coded.dictionary)
        ids = ids.take(pa.array(place[coded.indices.to_numpy()]))
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, dtype="<i8")[words.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _distinct(self, words: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids, and where among them those of each word are."""
        if not self._direct:
            return self._ids(words, self._made), np.arange(len(words))
        core, marks = pc.ascii_rtrim(words, characters=_MARKS), pc.utf8_ltrim(words, characters=_LETTERS)
        size, core_size, marks_size = (pc.binary_length(a).to_numpy() for a in (words, core, marks))
        plain = (core_size > 0) & (core_size + marks_size == size)
        core, marks = core.filter(pa.array(plain)), marks.filter(pa.array(plain)).dictionary_encode()
        core = pc.utf8_lower(core).dictionary_encode()
        joined = pc.binary_join_element_wise(
            self._ids(core.dictionary, self._pieces).take(core.indices),
            self._ids(marks.dictionary, self._made).take(marks.indices),
            pa.scalar(b"", pa.large_binary()),
        )
        others = self._ids(words.filter(pa.array(~plain)), self._made)
        place = np.where(plain, np.cumsum(plain) - 1, len(joined) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([joined, others]), place

    def _ids(self, words: pa.LargeStringArray, make: Callable[[list[bytes]], list[bytes]]) -> pa.LargeBinaryArray:
        """Ids of distinct words: kept ones, or by ``make``."""
        keys = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._young.get, keys))
        places = [i for i, ids in enumerate(found) if ids is None]
        if places:
            for i, ids in zip(places, self._learn([keys[i] for i in places], make)):
                found[i] = ids
        return pa.array(found, type=pa.large_binary())

    def _learn(self, new: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """Ids of new words, from the last generation or by ``make``."""
        if len(self._young) * _ENTRY_BYTES + self._bytes > self._limit:
            self._old, self._young, self._bytes = self._young, {}, 0
        known = list(map(self._old.get, new))
        rest = make([word for word, ids in zip(new, known) if ids is None])
        made = iter(rest)
        learned = [next(made) if ids is None else ids for ids in known]
        kept = {word: ids for word, ids in zip(new, learned) if len(word) <= _LONGEST}
        self._young.update(kept)
        self._bytes += sum(map(len, kept)) + sum(map(len, kept.values()))
        return learned

    def _made(self, words: list[bytes]) -> list[bytes]:
        """Ids of any words, by the shorter way where there is one."""
        made = {word: self._letters(word) if self._direct else None for word in words}
        rest = [word for word, ids in made.items() if ids is None]
        # Several words at a time with a mark between them are faster than a call for each.
        plain = [word for word in rest if _MARK not in word] if self._mark is not None else []
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        groups += [[word] for word in rest if self._mark is None or _MARK in word]
        for group, ids in zip(groups, self._whole([_BETWEEN.join(group) for group in groups])):
            cuts = (4 * np.flatnonzero(ids == self._mark)).tolist() if len(group) > 1 else []
            flat = ids.tobytes()
            starts, ends = [0, *(cut + 4 for cut in cuts)], [*cuts, len(flat)]
            made.update(zip(group, (flat[a:b] for a, b in zip(starts, ends))))
        return [made[word] for word in words]

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for i in range(0, len(texts), _AT_ONCE):
            plain = [text.decode() for text in texts[i : i + _AT_ONCE]]
            encodings = self._tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            found += [np.array(e.ids, dtype="<u4") for e in encodings]
        return found

    def _pieces(self, cores: list[bytes]) -> list[bytes]:
        """Ids of words that are one piece each for the tokenizer's model: letters only, in lower case."""
        out, tokenize = [], self._model.tokenize
        for core in cores:
            text = core.decode("latin-1")
            found = tokenize(text if core.isascii() else text.translate(_BYTE_LETTERS))
            out.append(struct.pack(f"<{len(found)}I", *[token.id for token in found]))
        return out

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word that is nothing but letters of any script, else None."""
        text = word.decode()
        if not text.isalpha() or _FINAL in text:
            return None
        text = unicodedata.normalize("NFC", text).lower()
        return self._pieces([text.encode()])[0] if text.isalpha() else None

    def _agrees(self) -> bool:
        """Whether the shorter ways give the tokenizer's own ids."""
        added = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        if any(not token.rstrip(_MARKS).lstrip(_LETTERS) for token in added):
            return False
        words = pa.array(_PROBES, type=pa.large_string())
        self._direct = True
        ids, place = self._distinct(words)
        self._young.clear()
        whole = self._whole([word.encode() for word in _PROBES])
        return ids.take(pa.array(place)).to_pylist() == [i.tobytes() for i in whole]


def _readable(texts: Sequence[bytes]) -> pa.LargeStringArray:
    """The texts as strings, with replacement characters for bytes that are no UTF-8."""
    column = pa.array(texts, type=pa.large_binary())
    try:
        return column.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([text.decode("utf-8", "replace") for text in texts], type=pa.large_string())
