"""Exact tokenization of whole texts by way of their space-separated chunks.

A pre-tokenizer of the byte-level kind never lets a piece run across a lone
space or newline: the piece before it ends there, the space opens the next one
and the newline is a piece of its own.  Encoding the chunks between them one by
one and joining their ids therefore gives the ids of the whole text.  Texts
repeat chunks, so a bounded table of chunk -> ids serves most of them without
calling the tokenizer.  Runs of white space take a slower, equally exact cut.

A text that may hold the string of an added token goes to the library whole, and so
does every text where the tokenizer file is of a kind for which the cut isn't proven.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np

from millrace.llm.common import worker_cache

#: A space that may be cut at.  Python's \s holds every white space of Unicode.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class ChunkTable(dict):
    """Chunk -> its encoded bytes, in two generations of at most ``limit`` entries each.

    A chunk that starts with a newline is encoded as it is, any other with a space
    before it.  One that touches more white space maps to None, which sends its
    text to the slower cut of ``joined``.  Texts that hold one of ``hints`` aren't
    cut at all: ``whole`` encodes them.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 600_000, hints: tuple[str, ...] = (), whole: Callable[[str], bytes] | None = None):
        super().__init__()
        self.encode, self.limit, self.old, self.hints, self.whole = encode, limit, {}, hints, whole

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if chunk in self.old:
            value = self.old[chunk]
        else:
            core = chunk[1:] if chunk[:1] == "\n" else chunk
            if not core or core[0].isspace() or core[-1].isspace():
                value = None
            else:
                value = self.encode(chunk if chunk[0] == "\n" else " " + chunk)
        if len(chunk) <= 64:  # long ones hardly come back
            self[chunk] = value
        return value

    def joined(self, text: str) -> bytes:
        """encode(text), for an ``encode`` whose values join at lone spaces and newlines."""
        for hint in self.hints:
            if hint in text:
                return self.whole(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.encode(head) + b"".join(map(self.__getitem__, rest))
        except TypeError:
            head, *rest = _SAFE.split(text)
            return self.encode(head) + b"".join([self.encode(" " + c) for c in rest])


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: Fixed value: the pre-tokenizer's built-in pattern of byte-level vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def latin_1_pattern(pattern: str) -> str:
    """The pattern with letters and numbers spelled out for Latin-1, which Python's own regexes then match faster."""
    for name, kinds in (("L", ("Lu", "Ll", "Lt", "Lm", "Lo")), ("N", ("Nd", "Nl", "No"))):
        members = "".join(c for c in map(chr, range(256)) if unicodedata.category(c) in kinds)
        pattern = re.sub(rf"(\[[^\]]*?)\\p\{{{name}\}}", lambda m, x=members: m[1] + x, pattern)
        pattern = re.sub(rf"(\[[^\]]*?)\\p\{{{name}\}}", lambda m, x=members: m[1] + x, pattern)
        pattern = pattern.replace(rf"\p{{{name}}}", f"[{members}]")
    return pattern


def _plain_cut(spec: dict) -> Callable[[str], list[str]] | None:
    """For printable Latin-1 chunks: normalizer and pre-tokenizer as one regex; None for a file of another kind.

    On these characters NFC changes nothing and lower-casing is one to one.
    """
    before, norm = spec["pre_tokenizer"], spec["normalizer"]
    if before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and norm is None:
        return re.compile(latin_1_pattern(BYTE_LEVEL_PATTERN)).findall
    steps = before.get("pretokenizers", [])
    if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1].get("use_regex", True):
        if [s["type"] for s in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["content"] == " ":
            find = re.compile(latin_1_pattern(steps[0]["pattern"]["Regex"])).findall
            return lambda chunk: find(chunk.lower())
    return None


def _hints(added: list[dict]) -> tuple[str, ...]:
    """Strings of which a text holds one wherever it holds an added token; "" is in every text.

    Of each token, the ASCII punctuation at its start, two characters of it at least: no normalizer
    that ``_plain_cut`` knows makes such a string, so it stands in the text itself.
    """
    heads = set()
    for token in added:
        head = re.match(r"[!-/:-@\[-`{-~]{2,}", token["content"])
        heads.add(head[0] if head and not token["lstrip"] else "")
    return ("",) if "" in heads else tuple(sorted(heads))


def tokenizer_table(path: str, limit: int = 600_000, plain_text: bool = False) -> ChunkTable:
    """ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, as little-endian unsigned 32-bit integers.

    Strings of added tokens in a text give those tokens, as in the library; with ``plain_text``
    (the library's ``encode_special_tokens``) they count as ordinary text.  The library's model
    runs on each piece that the table lacks.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    normalizer, cut, model = tokenizer.normalizer, tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
    if hasattr(model, "_resize_cache"):
        model._resize_cache(0)  # the table takes its place
    spec = json.loads(tokenizer.to_str())
    plain = _plain_cut(spec)
    tokenizer.encode_special_tokens = plain_text
    hints = ("",) if plain is None else _hints([t for t in spec["added_tokens"] if not (plain_text and t["special"])])
    to_chars = {b: ord(c) for b, c in byte_characters().items()}
    pieces: dict[str, bytes] = {}

    def ids(piece: str) -> bytes:
        found = [t.id for t in model.tokenize(piece)]
        return struct.pack(f"<{len(found)}I", *found)

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(chunk: str) -> bytes:
        core = chunk[1:] if chunk[:1] in (" ", "\n") else chunk
        if not core.isprintable() or not (core.isascii() or max(core) < "Ā"):
            return b"".join([ids(p) for p, _ in cut(normalizer.normalize_str(chunk) if normalizer else chunk)])
        out = []
        for piece in plain(chunk):
            value = pieces.get(piece)
            if value is None:
                value = ids(piece.encode().decode("latin-1").translate(to_chars))
                if len(pieces) >= limit // 2:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = value
            out.append(value)
        return b"".join(out)

    return ChunkTable(encode, limit, hints, whole)


def worker_table(path: str, limit: int = 600_000, plain_text: bool = False) -> ChunkTable:
    """The table of this Python worker: it lives across the worker's tasks."""
    return worker_cache(f"chunks {path} {limit} {plain_text}", lambda: tokenizer_table(path, limit, plain_text))
