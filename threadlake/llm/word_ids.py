"""Token ids of whole texts by a tokenizer that drops white space."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words whose ids a worker remembers; beyond that it starts anew.
CACHE_WORDS = 1 << 20

#: Bytes of a text split to words at a time, which bounds memory for very long texts.
SLICE = 1 << 20

#: The words that such a vocabulary sees; fixed by the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")

#: A stop behind an ASCII letter or digit and before white space is a token of its own.
_STOP = re.compile(rb"(?<=[0-9A-Za-z])[.,](?=[ \t\n\r\x0b\x0c]|\Z)")


class WordIds:
    """Ids by a ``tokenizers`` file whose tokens never cover white space.

    No token of such a vocabulary depends on what lies beyond white space, so the
    ids of a text are those of its words in order, and a word has to be encoded
    once.  Only ASCII white space cuts here; any other stays inside a word and
    is the tokenizer's own business.  So that fewer words differ, stops at their
    ends are cut off and A-Z are lower-cased, as the vocabulary's rules do next;
    not in a text that may hold a special string, nor the latter beside
    combining marks, which those rules compose before they lower-case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        rules = [r["type"] for r in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if rules != ["NFC", "Replace", "Lowercase"] or split.get("pattern", {}).get("Regex") != PATTERN:
            raise ValueError("a lower-casing vocabulary that drops white space is expected")
        self._known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        order = list(words)
        found = self._tokenizer.encode_batch(
            [w.decode("utf-8", "surrogatepass") for w in order], add_special_tokens=False
        )
        for word, encoding in zip(order, found):
            self._known[word] = np.array(encoding.ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        data, parts, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
        if b"<|" not in data:
            data = _STOP.sub(rb" \g<0>", data)
            # The lead bytes of the combining marks that have compositions with ASCII.
            if b"\xcc" not in data and b"\xcd" not in data:
                data = data.lower()
        while at < len(data):
            cut = _SPACE.search(data, at + SLICE)
            end = cut.start() if cut else len(data)
            words = data[at:end].split()
            new = set(words).difference(self._known)
            if new:
                self._learn(new)
                # The memory may have been emptied of words that this text also has.
                lost = set(words).difference(self._known)
                if lost:
                    self._learn(lost)
            parts.append(b"".join(map(self._known.__getitem__, words)))
            at = end
        return b"".join(parts)


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's encoder for the file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
