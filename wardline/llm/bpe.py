"""Byte-level BPE of whole texts by their distinct stretches.

A text may be cut before every blank that follows a character other than white
space: the pre-token pattern never matches across such a place. The stretches
repeat a lot, so only those not met before by this worker are encoded, with the
library itself; their ids are then gathered in text order.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from wardline.llm.common import concat_ranges

#: White space beyond ASCII (and 0x1C-0x1F, on which engines differ): texts with any are encoded in one piece.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
#: Stretches a worker remembers; beyond, and at the end of a task, it starts anew. Memory stays at some 40 MB.
REMEMBERED = 100_000


class Encoder:
    """Ids of texts; ``encode`` maps a list of strings to lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.heads = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.uint32)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        got = self.encode([x.decode() for x in new])
        n, first = len(self.known), self.used
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        total = int(sizes.sum())
        while n + len(new) > len(self.sizes):
            self.sizes, self.heads = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.heads, np.zeros_like(self.heads)])
        while first + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[n : n + len(new)] = sizes
        self.heads[n : n + len(new)] = first + np.cumsum(sizes) - sizes
        self.flat[first : first + total] = np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=total)
        self.used += total
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin (one more entry than texts)."""
        parts, which, counts = stretches(texts)
        if len(self.known) > self.remembered:
            self.forget()
        new = [x for x in parts if x not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter((self.known[x] for x in parts), dtype=np.int64, count=len(parts))[which]
        sizes = self.sizes[at]
        ids = self.flat[concat_ranges(self.heads[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


class AddedTokens:
    """An encoder for texts in which the strings of a file's added tokens stand for those; the text between is encoded piece by piece."""

    def __init__(self, encode: Encoder, tokens: dict[bytes, int]):
        self.encode, self.tokens = encode, tokens
        # Of tokens that begin at one place the longest counts.
        self.places = re.compile(b"(" + b"|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + b")")

    def forget(self) -> None:
        self.encode.forget()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.places.split(t) for t in texts]
        if all(len(s) == 1 for s in split):
            return self.encode(texts)
        # Text and tokens take turns; a token's own place holds one id.
        ids, at = self.encode([b"" if k % 2 else x for s in split for k, x in enumerate(s)])
        token = [self.tokens[x] if k % 2 else -1 for s in split for k, x in enumerate(s)]
        is_token = np.array(token) >= 0
        ids = np.insert(ids, at[:-1][is_token], np.array(token)[is_token].astype(ids.dtype))
        at = at + np.concatenate([[0], np.cumsum(is_token)])
        return ids, at[np.concatenate([[0], np.cumsum([len(s) for s in split])])]


def stretches(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct stretches, the number of the stretch at each place of all texts in order, and places per text."""
    raw = b"".join(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    heads = np.concatenate([[0], np.cumsum(sizes)])
    b = np.frombuffer(raw, dtype=np.uint8)
    cut = np.zeros(len(b) + 1, dtype=bool)
    cut[1:-1] = (b[1:] == 32) & ~_SPACE[b[:-1]]
    if _ODD_SPACE.search(raw.decode()):
        for i, t in enumerate(texts):
            if _ODD_SPACE.search(t.decode()):
                cut[heads[i] : heads[i + 1]] = False
    cut[heads] = True
    places = np.flatnonzero(cut)
    counts = np.searchsorted(places, heads[1:]) - np.searchsorted(places, heads[:-1])
    places = places if len(b) else np.zeros(1, dtype=np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)])
    coded = array.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts


_ENCODERS: dict[str, Encoder | AddedTokens] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file of the tokenizers library, without special tokens.

    Ids follow merge order (checked), so they serve as merge ranks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(made) or min(made, default=256) < 256:
        raise ValueError(f"{path}: ids do not follow merge order")
    return {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}


def added_tokens(path: str) -> dict[bytes, int]:
    """Strings and ids of a file's added tokens."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that look at their surroundings")
    return {t["content"].encode(): t["id"] for t in tokens}


def json_encoder(path: str, pattern: str, added: bool = False) -> Encoder | AddedTokens:
    """Encoder of a byte-level BPE file of the tokenizers library, one per worker.

    The strings of added tokens in a text stand for those if ``added``, as in
    the library by default, or else are ordinary text (encode_special_tokens).
    Merges run in the rank library, which takes a fifth of the time for the
    same ids.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(_by_ranks(json_ranks(path), pattern))
    if not added:
        return _ENCODERS[path]
    if f"{path}+" not in _ENCODERS:
        tokens = added_tokens(path)
        _ENCODERS[f"{path}+"] = AddedTokens(_ENCODERS[path], tokens) if tokens else _ENCODERS[path]
    return _ENCODERS[f"{path}+"]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(i) for a, i in map(bytes.split, f)}


def _by_ranks(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[list[int]]]:
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [t.encode_ordinary(x) for x in texts]


def rank_encoder(path: str, pattern: str) -> Encoder:
    """Encoder of a rank file, one per worker; no special tokens."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(_by_ranks(load_ranks(path), pattern))
    return _ENCODERS[path]
