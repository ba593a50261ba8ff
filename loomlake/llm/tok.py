"""Token ids by the ``tokenizers`` library, each distinct word of a worker encoded once.

Where a tokenizer file splits texts at white space, signs and digits and never joins two words (the loader compares
the file's normaliser and splitter with what is assumed here), a text's ids are its words' ids one after the other.
A blank is also put where a letter, a digit and a sign meet: no piece of the splitting pattern spans such a place, and
it makes far fewer words distinct. With any other file whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

#: Words that a worker remembers, twice: those met since the last turn, and those of the turn before.
CACHED_WORDS = 300_000

#: The normaliser and the splitter under which words can be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _table(f) -> bytes:  # noqa: ANN001
    return bytes(f(c) for c in range(256))


def _kind(c: int) -> int:
    """1: ASCII letter, 2: ASCII digit, 4: other visible ASCII sign, 8: last byte of a longer character."""
    if c >= 0x80:
        return 8 if c < 0xC0 else 0
    return 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if 32 < c < 127 else 0


#: White space is a blank, and capitals are small: the normaliser makes them so anyway.
_BLANK = _table(lambda c: 32 if 9 <= c <= 13 else c)
_SMALL = _table(lambda c: 32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c)
_LEFT = _table(_kind)
#: Kinds after which a byte starts a new word.
_RIGHT = _table(lambda c: {1: 2, 2: 15, 4: 11}.get(_kind(c), 0))
#: The same where special tokens may stand, which must stay whole.
_RIGHT_SPECIAL = _table(lambda c: 1 if chr(c) in ".,;:!?" else 0)

#: What the short way does not take: capitals whose lower case is longer, and all beyond Latin letters.
_OTHER = re.compile("[^\x00-ɏ]|İ")


def _byte_names() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def splits_words(said: dict) -> bool:
    """Whether the tokenizer file ``said`` gives a text's ids as those of its words, one after the other."""
    parts = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("invert") and parts[0].get("behavior") == "Removed"
    bytes_ = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    special = all(t["content"].startswith("<|") and t["content"].endswith("|>") and not t["normalized"] for t in said.get("added_tokens") or [])
    return bool(said.get("normalizer") == _NORMALIZER and split and bytes_ and special and said["model"].get("type") == "BPE" and not said["model"].get("dropout"))


class WordEncoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4") if self.wide else np.dtype("<u2")
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_words(json.load(f))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {}, self.known
        known, before, rest, kind = self.known, self.before, [], "I" if self.wide else "H"
        tokenize = self.tokenizer.model.tokenize
        out = [known.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            w = words[i]
            # a run of Latin letters: the normaliser lower-cases it and the splitting pattern keeps it whole, so it
            # goes to the model as its bytes, each named by a character
            if (x := before.get(w)) is not None:
                known[w] = x
            elif not w.isalpha():
                rest.append(w)
            elif w.isascii():
                known[w] = array(kind, [t.id for t in tokenize(w.lower())]).tobytes()
            elif _OTHER.search(w):
                rest.append(w)
            else:
                known[w] = array(kind, [t.id for t in tokenize(w.lower().encode().decode("latin-1").translate(_BYTE_NAMES))]).tobytes()
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                known[w] = array(kind, e.ids).tobytes()
        for i in missing:
            out[i] = known[words[i]]
        return out

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        at = np.cumsum([0, *(len(e.ids) for e in found)])
        return np.array([i for e in found for i in e.ids], self.kind), at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the place at which each text's ids begin (and the last end)."""
        if not self.by_words:
            return self._whole(texts)
        data, off = text_buffer(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        raw = data.tobytes()
        special = b"<|" in raw  # a special token is found before anything else
        left = np.frombuffer(raw.translate(_LEFT), np.uint8)
        right = np.frombuffer(raw.translate(_RIGHT_SPECIAL if special else _RIGHT), np.uint8)
        meet = left[:-1] & right[1:]
        at = np.flatnonzero(meet) + 1
        long = meet[at - 1] == 8
        if long.any():  # of longer characters only Latin letters end a word: two bytes, the first C3 to C9; not the
            # multiplication and division signs, nor the capital whose lower case ends in a combining mark
            i = at[long]
            lead, last = data[np.maximum(i - 2, 0)], data[i - 1]
            other = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7)) | (lead == 0xC4) & (last == 0xB0)
            latin = (i >= 2) & (lead >= 0xC3) & (lead <= 0xC9) & ~other
            at = np.delete(at, np.flatnonzero(long)[~latin])
        spaced = np.insert(np.frombuffer(raw.translate(_BLANK if special else _SMALL), np.uint8), at, 32)
        off = off + np.searchsorted(at, off, "left")
        text = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(spaced))
        words = pc.split_pattern(text, " ")
        ends = np.asarray(words.offsets).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        ids = pa.array(self._words(_strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        total = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) // self.kind.itemsize
        flat = np.frombuffer(ids.buffers()[2] or b"", self.kind, int(total[-1]))
        return flat, total[ends - ends[0]]


def _strings(words: pa.Array) -> list[str]:
    """The words as Python strings (none has a blank); faster than one by one."""
    data, off = text_buffer(words)
    return np.insert(data, off[1:-1], 32).tobytes().decode().split(" ") if len(words) else []


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
