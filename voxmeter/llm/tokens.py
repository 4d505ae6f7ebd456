"""Byte-level BPE vocabularies, read from a tokenizer file whose path is a parameter."""

from __future__ import annotations

import functools
import json
import public_tokenizers
from tokenizers import Tokenizer

#: Pre-tokens of the byte-level scheme: a fixed value of the vocabulary.
PATTERN = public_tokenizers.PATTERN


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids, merges in order and special tokens of a byte-level BPE file, or why it isn't one (`plain` is False)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.plain = model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        self.plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.ids = {bytes(symbols[c] for c in t): i for t, i in raw.items()} if self.plain else {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        self.merges = [(raw[a], raw[b], raw[a + b]) for a, b in pairs] if self.plain else []
        self.n = max([*raw.values(), *self.special.values()], default=-1) + 1


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(4)
def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t
