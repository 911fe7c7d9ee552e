"""Pre-tokens of byte-level tokenizer files, and their pieces by the tokenizer library."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable

import regex


class Tokens:
    """A byte-level tokenizer file of the ``tokenizers`` library, read by each worker that uses it.

    ``pattern`` splits text as the file's pre-tokenizer does.  Only the library knows characters by the same Unicode version,
    so texts with characters that this Python does not know are split by the library itself.
    """

    def __init__(self, file: str, pattern: str):
        # Workers are as many as cores; the library's own threads would compete with them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        kind = told["pre_tokenizer"] or {}
        added = told["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)
        if kind.get("type") != "ByteLevel" or not kind["use_regex"] or kind["add_prefix_space"] or told["normalizer"] or not plain:
            raise ValueError("only byte-level tokenizers without normalizer, prefix space or stripping special tokens split by a pattern")
        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True
        self.vocabulary: dict[str, int] = self.library.get_vocab()
        self.findall = regex.compile(pattern).findall
        specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.met: set[str] = set()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, in which strings of special tokens are text."""
        if not text.isascii():
            new = set(text) - self.met
            if new:
                unknown = {c for c in new if unicodedata.category(c) == "Cn"}
                self.met |= new - unknown
                if unknown:
                    return [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.findall(text)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens between the special tokens that the text holds, and how many of these there are."""
        if self.specials is None or not self.specials.search(text):
            return self.split(text), 0
        between = self.specials.split(text)
        return [t for part in between if part for t in self.split(part)], len(between) - 1

    def pieces(self, pre_tokens: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        return [e.ids for e in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]


def byte_level() -> dict[str, int]:
    """Which byte each character of a byte-level vocabulary stands for: itself where it is printable, else the next free character from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bytes_of(entries: Iterable[str]) -> list[bytes]:
    """The bytes of byte-level vocabulary entries; an entry of other characters (a special token) is its UTF-8."""
    known = byte_level()
    return [bytes(map(known.__getitem__, e)) if known.keys() >= set(e) else e.encode() for e in entries]
