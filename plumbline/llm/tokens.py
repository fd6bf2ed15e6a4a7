"""Exact token ids of whole texts, by the ``tokenizers`` library, memoised by white-space-free chunk.

The tokenizer's normaliser folds white space to a space, its pre-tokeniser never lets a token hold white space, and
neither composition nor lower-casing looks across ASCII white space. So the ids of a text are the ids of its chunks
between ASCII white space, one after another, and a bounded memo of chunks saves most calls into the library. Two more
identities save most of the rest: a mark of punctuation behind a letter or digit is a token run of its own, and ASCII
letters have the ids of their lower case. A run of composed lower-case letters goes to the library's model at once.

All of this holds for one make of tokenizer, so the file is read for it: whole texts of any other go to the library as they are.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers

from plumbline.llm._common import sole

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks a worker remembers, and the longest of them in bytes.
MEMO_CHUNKS, MEMO_BYTES = 500_000, 48
#: Lower-case letters that are composed already: the pipeline before the model leaves a run of them as it is.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_MARKS = frozenset(b".,;:!?")


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


#: The steps before the model for which the short cuts hold.
_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_at_space(made: dict) -> bool:
    """Whether a tokenizer, by its file, gives a text the ids of its chunks between white space, by the steps above."""
    pattern = lambda x: (x.get("pattern") or {}).get("Regex")
    steps = (made.get("normalizer") or {}).get("normalizers") or []
    if [(x["type"], pattern(x)) for x in steps] != _NORMALIZER or steps[1].get("content") != " ":
        return False
    cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in cut] != ["Split", "ByteLevel"] or pattern(cut[0]) != _WORDS or (cut[0].get("behavior"), cut[0].get("invert")) != ("Removed", True):
        return False
    if cut[1].get("add_prefix_space") or cut[1].get("use_regex") or made["model"].get("type") != "BPE" or made["model"].get("dropout"):
        return False
    return made.get("post_processor") is None and made.get("truncation") is None and all(x["special"] and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["normalized"]) for x in made.get("added_tokens", []))


class _Memo(dict):
    """Ids by chunk, in two generations: of a full one, what is asked for again moves on to the next, the rest is forgotten."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.before = tokenizer, tokenizer.model, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.found(chunk)
        if len(chunk) <= MEMO_BYTES:
            if len(self) >= MEMO_CHUNKS // 2:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def found(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            if not chunk.islower():
                return self[chunk.lower()]
            found = self.model.tokenize(chunk.decode("ascii"))  # ASCII letters stand for themselves
        elif chunk[-1] in _MARKS and _ends_in_letter(chunk[:-1]):
            return self[chunk[:-1]] + self[chunk[-1:]]
        elif _PLAIN.fullmatch(chunk):
            found = self.model.tokenize(chunk.decode("latin-1").translate(_byte_letters()))
        else:
            return np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the others from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def _ends_in_letter(chunk: bytes) -> bool:
    """Whether UTF-8 bytes surely end in a letter or digit: an ASCII one, or a letter of U+00C0 to U+00FF."""
    if chunk[-1:].isalnum():
        return True
    return len(chunk) > 1 and chunk[-2] == 0xC3 and chunk[-1] not in (0x97, 0xB7)


_memos: list[_Memo] = []


def _forget() -> None:
    for memo in _memos:
        memo.clear()
        memo.before = {}


@cache
def encoder(path: str) -> Callable[[bytes], bytes]:
    """A function from UTF-8 text to its ids as little-endian unsigned 32-bit integers, without an end id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not parts_at_space(json.loads(tokenizer.to_str())):
        return lambda text: np.array(tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
    _memos.append(_Memo(tokenizer))
    look_up = _memos[-1].__getitem__
    return lambda text: b"".join(map(look_up, text.split()))


def encoded(texts: list[bytes], path: str, end_id: int = END_ID) -> Iterator[bytes]:
    """Ids of each text, with the end id, as little-endian unsigned 32-bit integers."""
    sole("tokens", _forget)
    encode, end = encoder(path), end_id.to_bytes(4, "little")
    for text in texts:
        yield encode(text) + end
