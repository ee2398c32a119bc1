"""Ids of whole texts by the tokenizers library, with a bounded cache of pieces in each Python worker.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so that the ids of the
pieces, put together, are the ids of the text. Pieces are known by keys that cost little to make: a
bare word stands for itself (white space dropped) or for itself with a space before it; words that
begin a text or a line, and pieces of texts with other white space, have a mark before them. Arrow
finds the different keys of some texts, so Python looks each of them up once, and puts their ids
together again. Texts with characters on whose class the regex engines disagree (U+001C..U+001F),
and texts in which an added token of the vocabulary stands, are encoded whole; the library decides
what such a token is.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 1_000_000  # per worker and vocabulary: some 150 MB
MAX_PIECE = 64  # longer pieces are not kept
AT_ONCE = 4096  # pieces in a call of the library, whose answers take some KB each

_DOUBTFUL = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE_PREFIXED = re.compile(r"\s+(?!\S)| ?[^\s]+|\s")
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_AS_IS = "\r"  # mark of a piece that is encoded as it stands; no bare word has white space


def _without_space(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The keys of all texts, and where each text's begin and end among them; a text may have empty keys, which have no ids."""
    words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    return words.flatten(), words.offsets.to_numpy()


def _forms(words: pa.Array) -> pa.ListArray:
    """Forms of words that have the same ids, fewer than the words are: in small letters, and apart from the marks that end a sentence.

    Small letters only for ASCII words, which the normalizer changes in no other way. The pattern ``_WORDS`` always cuts between a letter
    and such a mark; only Latin-1 letters count here, as they are normalised to one letter each."""
    small = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
    apart = pc.replace_substring_regex(small, pattern=r"^(.*[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([,.;:!?]+)$", replacement=r"\1 \2")
    return pc.utf8_split_whitespace(apart)


def _byte_level(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    keys, ends = [], [0]
    for text in texts:
        keys += _keys_byte_level(text)
        ends.append(len(keys))
    return pa.array(keys, pa.large_string()), np.array(ends)


def _keys_byte_level(text: str) -> list[str]:
    words = text.split()
    if words and len(text) == len(" ".join(words)) and text.count(" ") + text.count("\n") == len(words) - 1:
        # only single spaces and line ends: a word takes the space before it, a line end stands alone
        keys = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = "\n" + words[0] if keys else _AS_IS + words[0]
            keys += words
        return keys
    return [_AS_IS + x for x in _SPACE_PREFIXED.findall(text)]


def _piece_byte_level(key: str) -> str:
    return key[1:] if key[0] == _AS_IS else key if key[0] == "\n" else " " + key


def _piece_without_space(key: str) -> str:
    return key


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of texts, as the library's own call gives them without special tokens added.

    ``added_as_text``: added tokens in a text are ordinary text."""

    _workers: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, added_as_text: bool = False):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = added_as_text
        vocabulary = json.loads(self._tokenizer.to_str())
        steps, added = vocabulary["pre_tokenizer"], vocabulary["added_tokens"]
        # a normalizer can make such a token of other text; then it is sought in the normalised text too
        self._added = [] if added_as_text else [x["content"] for x in added]
        self._normalised = bool(vocabulary["normalizer"]) and any(x["normalized"] for x in added)
        self._forms = None
        first = steps.get("pretokenizers", [steps])[0]
        if first["type"] == "Split" and first["behavior"] == "Removed":
            self._cut, self._piece = _without_space, _piece_without_space
            steps = [x["type"] for x in (vocabulary["normalizer"] or {}).get("normalizers", [])]
            if first["pattern"] == {"Regex": _WORDS} and first["invert"] and steps == ["NFC", "Replace", "Lowercase"]:
                self._forms = _forms
        elif first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
            self._cut, self._piece = _byte_level, _piece_byte_level
        else:  # where this pre-tokenizer cuts is not known
            self._cut = None
        self._cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """The worker's encoder of a vocabulary file."""
        if path not in cls._workers:
            cls._workers[path] = cls(path)
        return cls._workers[path]

    @classmethod
    def forget(cls) -> None:
        """Let go of the worker's encoders and their caches, where another operator's work begins."""
        cls._workers.clear()

    def _has_added(self, text: str) -> bool:
        if any(x in text for x in self._added):
            return True
        return self._normalised and any(x in self._tokenizer.normalizer.normalize_str(text) for x in self._added)

    def _is_whole(self, text: str) -> bool:
        return self._cut is None or any(x in text for x in _DOUBTFUL) or self._has_added(text)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = []
        for i in range(0, len(pieces), AT_ONCE):
            ids = [array("I", x.ids) for x in self._tokenizer.encode_batch_fast(pieces[i : i + AT_ONCE], add_special_tokens=False)]
            if ids[0].itemsize != 4 or sys.byteorder != "little":
                raise RuntimeError("this platform's integers are not little-endian 32-bit ones")
            found += [x.tobytes() for x in ids]
        return found

    def _ids_of(self, different: pa.Array) -> pa.Array:
        """The ids of different keys."""
        keys, cache = different.to_numpy(zero_copy_only=False).tolist(), self._cache
        values = list(map(cache.get, keys))
        absent = [i for i, x in enumerate(values) if x is None]
        for i, x in zip(absent, self._encode([self._piece(keys[i]) for i in absent]), strict=True):
            values[i] = x
        if len(cache) < CACHE_PIECES:
            cache.update((keys[i], values[i]) for i in absent if len(keys[i]) <= MAX_PIECE)
        return pa.array(values, pa.large_binary())

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        whole = [i for i, x in enumerate(texts) if self._is_whole(x)]
        rest = texts.copy()
        for i in whole:
            rest[i] = ""
        out = self._encode_cut(rest) if len(whole) < len(texts) else rest
        for i, x in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        keys, ends = self._cut(texts)
        if not len(keys):
            return [b""] * len(texts)
        words = keys.dictionary_encode()
        if self._forms is None:
            found = self._ids_of(words.dictionary)
        else:
            parts = self._forms(words.dictionary)
            forms = parts.flatten().dictionary_encode()
            found = pc.binary_join(pa.ListArray.from_arrays(parts.offsets, self._ids_of(forms.dictionary).take(forms.indices)), pa.scalar(b"", pa.large_binary()))
        ids = found.take(words.indices)
        _, places, data = ids.buffers()
        places, data = np.frombuffer(places, "int64")[ends].tolist(), memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(places, places[1:], strict=False)]


def batches_of(texts: list[str | None], characters: int = 1 << 21) -> Iterable[slice]:
    """Slices of about so many characters, so that memory does not follow the size of an Arrow batch."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
