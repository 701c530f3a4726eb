"""Ids of a byte-level tokenizer file, by its ranks where the file allows it."""

from __future__ import annotations

import json
import os
import re

_LONG_RUN = re.compile(r"\s{5000}")


def _byte_signs() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in plain}
    signs.update({chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return signs


class ByteTokens:
    """A byte-level tokenizer file: token bytes by id, and ids of texts.

    If the merges are in the order of their ids, as usual, the ranks alone encode, which is several times faster; texts
    with very long runs of white space, and other files, go to the file's own tokenizer. Special tokens are plain text
    unless ``special`` is set.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        signs = _byte_signs()
        added = {x["content"] for x in held["added_tokens"]}
        self._special = sorted(added) if special else []
        vocabulary = {x: i for x, i in held["model"]["vocab"].items() if x not in added}
        spelled = {bytes(signs[c] for c in x): i for x, i in vocabulary.items()}
        self.bytes = [b""] * (max(spelled.values()) + 1)
        for x, i in spelled.items():
            self.bytes[i] = x
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in held["model"]["merges"]]
        ordered = [vocabulary[x] for x in merged] == sorted(i for x, i in vocabulary.items() if len(x) > 1)
        pre = held["pre_tokenizer"] or {}
        self._ranks = None
        if ordered and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not held["normalizer"]:
            import tiktoken

            # Fixed value: the pattern of byte-level pre-tokenization.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self._ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=spelled, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranks is None:
            return self._whole(texts)
        return [self._whole([x])[0] if self._is_odd(x) else self._ranks.encode_ordinary(x) for x in texts]

    def _is_odd(self, text: str) -> bool:
        return any(map(text.__contains__, self._special)) or len(text) > 5000 and _LONG_RUN.search(text) is not None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = not self._special
        return [x.ids for x in self._slow.encode_batch_fast(texts, add_special_tokens=False)]
