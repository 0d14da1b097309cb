"""Token ids of a public tokenizer file, as the tokenizers library gives them.

Byte-level BPE whose merges come in the order of their ids is the same function
in the tiktoken library, which is three times as fast: its ranks are read from
the same file, and the property is checked when the file is loaded. Any other
file goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: Longer texts are taken in segments of about so many characters.
SEGMENT = 1 << 20
#: Where the pattern parts in every context: white space after anything but white space (rarer kinds are not the same in all Unicode tables).
STABLE = re.compile(r"[^\s\x1c-\x1f\x85](?=[ \t\n\r])")
#: The pattern of byte-level BPE (a fixed value of the file format's pre-tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}
_fast: dict[str, object] = {}


def load(path: str):
    """The tokenizer at path, one for each worker process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level BPE writes for each byte: itself, or the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_fast(path: str):
    """A tiktoken encoding equal to the file's tokenizer, or None where that isn't sure."""
    if path not in _fast:
        _fast[path] = _convert(path)
    return _fast[path]


def _convert(path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or not plain:
        return None
    import tiktoken

    letters, special = _byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)) or len(ranks) != len(merged) + 256:
        return None
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts that end where every encoding of it has a boundary."""
    start = 0
    while len(text) - start > size:
        found = STABLE.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


class Encoder:
    """ids(text): as tokenizers gives them for the whole text, without added special tokens."""

    def __init__(self, path: str):
        self.fast = load_fast(path)
        self.slow = None if self.fast else load(path)

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([self._part(x) for x in segments(text)])

    def count(self, text: str) -> int:
        return sum(len(self._part(x)) for x in segments(text))

    def _part(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
