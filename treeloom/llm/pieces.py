"""Exact tokenization by cached chunks.

A text is cut where a single space or a single newline stands between two characters that are no white
space. The pre-tokenizer of a byte-level BPE always ends a pre-token there, so encoding the chunks one by
one gives what the library gives for the whole text. Chunks recur, so their results are kept in a cache of
bounded size. Texts with other white space are cut only where that rule holds.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker's cache before it starts anew, and the longest chunk that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 800_000, 48
#: White space by any definition but space and newline, and runs of white space.
_ODD = [*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f", "  ", " \n", "\n ", "\n\n"]
_ODD_WIDE = [*map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,]\Z")
#: Characters on whose classes all definitions agree, without those of special tokens.
_PLAIN = re.compile(r"[ \n!-;=-~À-ÖØ-öø-ÿ]*\Z")
#: Fixed value: how byte-level BPE divides a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def fast_encoder(path: str):
    """A faster encoder of plain text, made of the file's own vocabulary; None where it would not give the same ids:
    merges must be ranked by the ids that they make, and special tokens must have a character that isn't plain."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    if any(_PLAIN.match(t["content"]) for t in spec["added_tokens"]) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    hidden = [x for x in range(256) if x not in shown]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"].get(m) for m in made]
    if None in ids or ids != list(range(256, 256 + len(ids))) or any(not all(c in byte for c in w) for w in model["vocab"] if model["vocab"][w] < 256 + len(ids)):
        return None
    ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if i < 256 + len(ids)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def chunks(text: str) -> tuple[str, list[str]]:
    """(first, others): others follow a space, or start with a newline and follow nothing."""
    odd = any(map(text.__contains__, _ODD)) or not text.isascii() and any(map(text.__contains__, _ODD_WIDE))
    if not odd and text[:1] not in (" ", "\n") and text[-1:] not in (" ", "\n"):
        first, *rest = text.replace("\n", " \n").split(" ")
        return first, rest
    if "\u180e" in text:  # definitions of white space differ on it
        return text, []
    first, *rest = _CUT.split(text)
    return first, rest


class Cache(dict):
    """Chunk, as it stands after a space or a newline, -> value(token ids).

    value must map concatenation of ids to +: lengths, or packed bytes.
    """

    def __init__(self, path: str, value, frequent: dict | None = None):
        super().__init__(frequent or {})
        self.encode, self.fast, self.value, self.frequent = tokenizer(path).encode, fast_encoder(path), value, frequent or {}
        self.marks = {m: self.alone(m) for m in ".,"}

    def alone(self, text: str):
        if self.fast and _PLAIN.match(text):
            return self.value(self.fast(text))
        return self.value(self.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str):
        if len(chunk) > CACHE_CHARS:
            return self.alone(chunk if chunk[0] == "\n" else " " + chunk)
        if chunk[-1:] in self.marks and _TAIL.search(chunk):  # a letter and a mark never share a pre-token
            got = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            got = self.alone(chunk if chunk[:1] == "\n" else " " + chunk)
        self[chunk] = got
        return got

    def trim(self) -> None:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
