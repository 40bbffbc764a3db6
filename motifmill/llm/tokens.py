"""Token ids of whole texts, with memos in front of the tokenizer's model.

A text of Latin-1 characters is split here by the splitter's own pattern, and only the splits
that a worker has not met go through the tokenizer's BPE model.  Other texts are encoded word by
word, which is exact when neither normaliser nor splitter looks across a space.  `plan_of` tests
both on the file's own description; without them whole texts are encoded.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

from .common import Memo
from .token_counts import byte_alphabet

#: The one splitter pattern that is also written for Latin-1 below (a fixed value of the file).
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers of lower-cased Latin-1 text.
_LETTER, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t\n\x0b\x0c\r \x85\xa0"
LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


#: Entries of one generation of a memo of encoded words.
KEPT = 200_000


class Encoder:
    """Texts to 32-bit ids, little-endian as every host of Spark's Python is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.by_word, self.by_split = plan_of(config)
        self.added = [x["content"] for x in config.get("added_tokens") or []]
        model, stand_in = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self.words = Memo(self.whole, KEPT)
        # printable ASCII stands for itself
        byte_text = lambda s: s if s.isascii() and s.isprintable() else "".join([stand_in[b] for b in s.encode()])
        self.splits = Memo(lambda s: array("I", [t.id for t in model.tokenize(byte_text(s))]).tobytes(), KEPT)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_split and is_latin(text) and not any(x in text for x in self.added):
            memo, parts = self.splits, LATIN_SPLIT.findall(text.lower())
        elif self.by_word:
            memo, parts = self.words, text.split(" ")
        else:
            return self.whole(text)
        out = b"".join(map(memo.__getitem__, parts))
        memo.trim()
        return out


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def plan_of(config: dict) -> tuple[bool, bool]:
    """Whether texts can be encoded word by word, and Latin-1 texts by LATIN_SPLIT."""

    def flat(part, key):
        return [y for x in part[key] for y in flat(x, key)] if part and part["type"] == "Sequence" else [part] if part else []

    normal = flat(config.get("normalizer"), "normalizers")
    split = flat(config.get("pre_tokenizer"), "pretokenizers")
    added = config.get("added_tokens") or []
    known = (
        bool(split)
        and split[0]["type"] == "Split"
        and (split[0]["pattern"].get("Regex"), split[0]["behavior"], split[0]["invert"]) == (KNOWN_SPLIT, "Removed", True)
        and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in split[1:]] == [("ByteLevel", False, False)]
        and not config.get("post_processor")
        and not config.get("truncation")
        and all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
    )
    lowers = [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"] and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
    return known and lowers, known and lowers


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker."""
    return Encoder(path)
