"""Token ids of whole texts by a tokenizer file: a rank-based encoder where the file allows one, else a cache of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

#: Words whose ids a Python worker keeps; beyond that it starts anew, so memory stays bounded.
MOST_WORDS = 400_000
#: Fixed value: the pattern by which byte-level BPE cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space for Python's \s, but ordinary characters for the pattern.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters that the rank-based encoder gets at once, up to the next word's end.
LONGEST = 1 << 20
WORD_END = re.compile(r"\S(?=\s)")


def _in_parts(text: str, longest: int = LONGEST) -> Iterator[str]:
    """The text, in parts that end at a word's end once they are long."""
    at = 0
    while len(text) - at > longest:
        end = WORD_END.search(text, at + longest)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


class _Uneven(Exception):
    """A text in which a space follows white space, so that it can't be cut at every space."""


def _byte_of() -> dict[str, int]:
    """The printable character that byte-level BPE writes for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a chunk that stands after a space."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cuttable = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.raw: dict[str, bytes] = {}
        self.fast = None
        if self.cuttable and self._ranked(model):
            import tiktoken

            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _ranked(model: dict) -> bool:
        """Whether ids follow the merges' order, so that a merge's rank is its id."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return not model.get("ignore_merges") and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))

    def _ids(self, text: str) -> bytes:
        import numpy as np

        ids = self.fast.encode_ordinary(text) if self.fast else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[-1].isspace():
            raise _Uneven
        out = b"".join(map(self._chunk, CHUNK.findall(" " + part)))
        if len(part) <= 40:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[part] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        out = self.raw.get(chunk)
        if out is None:
            out = self._ids(chunk)
            if len(chunk) <= 40:
                if len(self.raw) >= MOST_WORDS // 4:
                    self.raw.clear()
                self.raw[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text: those that the tokenizer gives with add_special_tokens=False.

        A cut between a character and white space after it never lies within a token of byte-level BPE, so chunks of
        white space and what follows it have the ids they have in the text. The rank-based encoder gets whole texts, very
        long ones in parts that end there; without one, words are looked up. Texts that hold the string of a special
        token, or odd control characters, go to the tokenizer whole.
        """
        if not text:
            return b""
        if not self.cuttable or any(s in text for s in self.special) or any(c in text for c in ODD):
            import numpy as np

            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.fast:
            return b"".join(map(self._ids, _in_parts(text)))
        parts = text.split(" ")
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise _Uneven
            return b"".join(chain(map(self._chunk, CHUNK.findall(parts[0])), map(self.__getitem__, parts[1:])))
        except _Uneven:
            return b"".join(map(self._chunk, CHUNK.findall(text)))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each Python worker; it lives as long as the worker does."""
    return WordIds(path)
