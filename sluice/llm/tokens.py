"""Token ids by a public tokenizer of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from sluice.llm.caches import kept

#: How a byte-level pre-tokenizer splits text (fixed value of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone, which the standard library splits in half the time.
ASCII_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""

#: Pre-tokens whose ids a worker keeps: about 200 bytes each.
KEEP = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(text)`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, as an array.

    Byte-level vocabularies encode each pre-token by itself, so the ids of the first ``keep`` different
    pre-tokens are kept and only others go through the library. Strings of added tokens in a text have their ids,
    and the text between them is split by itself. Other kinds of vocabulary, and added tokens that take spaces or
    words into account, take the library for whole texts.
    """

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.split = None
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer"):
            self.split, self.split_ascii = regex.compile(BYTE_LEVEL), re.compile(ASCII_LEVEL)
        added = kind.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            self.split = None
        self.added = {t["content"]: np.array([t["id"]], self.dtype).tobytes() for t in added}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known = _Known(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I", keep)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; a null text has none."""
        if self.split is None:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype=self.dtype)
        text = text or ""
        if not any(t in text for t in self.added):
            return np.frombuffer(self._joined(text), dtype=self.dtype)
        # Every second part is an added token.
        parts = self.between.split(text)
        ids = [self.added[t] if k % 2 else self._joined(t) for k, t in enumerate(parts)]
        return np.frombuffer(b"".join(ids), dtype=self.dtype)

    def _joined(self, text: str) -> bytes:
        split = self.split_ascii if text.isascii() else self.split
        return b"".join(map(self.known.__getitem__, split.findall(text)))


class _Known(dict):
    """Pre-token to the bytes of its ids; holds the first ``keep`` pre-tokens it is asked for."""

    def __init__(self, tokenizer, code: str, keep: int):
        super().__init__()
        self.tokenizer, self.code, self.keep = tokenizer, code, keep

    def __missing__(self, part: str) -> bytes:
        ids = array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self) < self.keep:
            self[part] = ids
        return ids


def encoder(path: str, keep: int = KEEP) -> Encoder:
    """The worker's encoder for a path."""
    return kept(("encoder", path, keep), lambda: Encoder(path, keep))

