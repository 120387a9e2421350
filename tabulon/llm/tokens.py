"""Fast exact encoders over public tokenizer files.

Both encoders give the ids of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`
of the `tokenizers` library: the string of a special token in a text becomes its id, as
there. The merge loop runs in tiktoken's core; texts with such a string, and those outside
the range where both libraries provably split alike, go through `tokenizers`.
"""

from __future__ import annotations

import json
import re

import numpy as np

LITTLE = np.dtype("<u4")


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in out)}
    return out


class _Base:
    def __init__(self, path: str):
        self.path = path
        self._slow = None
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in self.file["added_tokens"]) or "(?!)")

    def slow(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, LITTLE)


class ByteBpe(_Base):
    """Byte-level BPE file (no normaliser, no word ends)."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        import tiktoken

        model = self.file.pop("model")
        symbol = byte_symbols()
        ranks, ids = {}, []
        for s, b in symbol.items():
            ranks[bytes([b])] = len(ids)
            ids.append(model["vocab"][s])
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            raw = bytes(symbol[c] for c in left + right)
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(model["vocab"][left + right])
        self.ids = np.array(ids, LITTLE)
        self.core = tiktoken.Encoding("byte", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return self.slow(text)
        try:
            return self.ids[np.frombuffer(self.core.encode_to_tiktoken_buffer(text, set()), np.uint32)]
        except ValueError:  # white space so long that the regex engine's stack is full
            return self.slow(text)


class WordBpe(_Base):
    """BPE with word ends `</w>`, lower case, white space dropped.

    A word's last symbol carries the word end, so each word is followed by a byte no text
    has (0), and joining a letter with that byte outranks every other merge. Texts of plain
    ASCII and precomposed Latin letters take this way; others go through `tokenizers`.
    """

    END = "</w>"
    PLAIN = re.compile("[\t\n\r\\x20-\\x7e¡§«»¿À-ÖØ-öø-įı-ňŊ-ž–—‘’“”…€]*")
    WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^\\sa-zß-öø-ž0-9]+")

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        model = self.file.pop("model")
        symbol = byte_symbols()
        zero = next(s for s, b in symbol.items() if b == 0)
        vocab = model["vocab"]
        ranks, ids = {}, []

        def raw(token: str) -> bytes:
            end = token.endswith(self.END)
            return bytes(symbol[c] for c in token.removesuffix(self.END)) + b"\0" * end

        def put(key: bytes, token: str | None) -> None:
            if key not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token] if token else 0)

        for s, b in symbol.items():
            if b:
                put(bytes([b]), s)
        put(b"\0", None)
        for s, b in symbol.items():
            if b:
                put(bytes([b, 0]), s + self.END)
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if zero not in left + right:  # byte 0 never takes the fast way
                put(raw(left + right), left + right)
        self.ids = np.array(ids, LITTLE)
        self.core = tiktoken.Encoding("word", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, text: str) -> np.ndarray:
        if not self.PLAIN.fullmatch(text) or self.special.search(text):
            return self.slow(text)
        words = self.WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, LITTLE)
        words.append("")
        return self.ids[np.frombuffer(self.core.encode_to_tiktoken_buffer("\0".join(words), set()), np.uint32)]


_CACHE: dict[tuple, _Base] = {}


def encoder(kind: type, *args) -> _Base:
    """One encoder for each Python worker."""
    key = (kind, *args)
    if key not in _CACHE:
        _CACHE[key] = kind(*args)
    return _CACHE[key]
