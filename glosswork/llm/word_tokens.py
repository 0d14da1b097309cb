"""Token ids of a vocabulary of word ends, as the tokenizers library gives them.

Such a vocabulary drops white space and joins nothing across it, so a text's ids
are those of its parts between ASCII white space, one after another; parts come
again and again and are looked up. A new part goes to the library. Where it has
only printable ASCII and Latin-1 letters, and the vocabulary's merges come in the
order of their ids, the tiktoken library does the same merges faster: a word ends
with a line break, which no word holds, in place of its end mark. Both properties
are checked when the file is loaded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

from .tokens import SEGMENT, _byte_letters, load

#: The pre-tokenizer's pattern (a fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Parts of such characters are the same in every Unicode table; a special string needs "<|".
PLAIN = re.compile("(?!.*<[|])[!-~À-ÖØ-öø-ÿ]+")
#: PATTERN on such parts in lower case.
WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_loaded: dict[str, WordEncoder] = {}


def _parts_at_space(spec: dict) -> bool:
    """Whether the file is of the kind described above."""
    before, normal = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [], (spec.get("normalizer") or {}).get("normalizers") or []
    split = before[0] if before else {}
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        and [x["type"] for x in before] == ["Split", "ByteLevel"] and split["pattern"] == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"]
        and not before[1]["add_prefix_space"] and not before[1]["use_regex"] and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )


def _fast(path: str, spec: dict):
    """A tiktoken encoding of words that end with a line break, or None where that isn't sure."""
    model, letters = spec["model"], _byte_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model.get("dropout") or model.get("ignore_merges") or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
        return None
    plain = lambda token: bytes(letters[c] for c in token.removesuffix(END)) + (b"\n" if token.endswith(END) else b"")
    vocab = {t: n for t, n in model["vocab"].items() if t not in special}
    ranks = {plain(t): n for t, n in vocab.items()}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    # Bytes come first, then bytes that end a word, then the merges in their order.
    if len(ranks) != len(vocab) or len(ranks) != 512 + len(merged) or merged != list(range(512, len(ranks))) or any((len(t) > 1 and t[1:] != b"\n") != (n >= 512) for t, n in ranks.items()):
        return None
    import tiktoken

    return tiktoken.Encoding(path, pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})


class WordEncoder(dict):
    """bytes of a part -> its ids, little-endian; forgets all parts when it holds too many."""

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.limit = load(path), limit
        self.splits = _parts_at_space(spec)
        self.fast = _fast(path, spec) if self.splits else None
        self.bits = max(self.library.get_vocab().values()).bit_length()
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")

    def __missing__(self, part: bytes) -> bytes:
        word = part.decode()
        if self.fast and PLAIN.fullmatch(word):
            ids = self.fast.encode_ordinary("\n".join(WORD.findall(word.lower())) + "\n")
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        found = np.array(ids, self.dtype).tobytes()
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[part] = found
        return found

    def parts(self, data: bytes, size: int = SEGMENT) -> Iterator[np.ndarray]:
        """The text's ids, some at a time."""
        if not self.splits:
            yield np.array(self.library.encode(data.decode(), add_special_tokens=False).ids, self.dtype)
            return
        at = 0
        while at < len(data):
            space = _SPACE.search(data, at + size)
            end = space.start() if space else len(data)
            yield np.frombuffer(b"".join(map(self.__getitem__, data[at:end].split())), self.dtype)
            at = end


def word_encoder(path: str) -> WordEncoder:
    """One for each worker process: what it has learned serves later tasks."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
