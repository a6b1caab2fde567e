"""Byte-level BPE ids through the tokenizers library, with a cache of the pieces between spaces."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import regex

from .common import give_back
from .word_bpe import byte_alphabet

#: Parts remembered by each of a Python worker's two cache generations.
CACHE = 500_000
_CUT = re.compile(r"(?<=\S)(?= )")
_PART = re.compile(r" ?\S+|\s")
#: Runs of white space, and characters on which Python and the split pattern disagree about being white space.
_RUN = re.compile(r"\s\s|[\x1c-\x1f]")
#: Runs of the usual white space, and all that is neither usual white space nor surely a word's, with the mark for cuts.
_RUNS, _MARK = ("  ", " \n", "\n ", "\n\n"), "\0"
_UNUSUAL = re.compile(r"[\x00\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A part that is one word of Latin letters and perhaps one of other ASCII characters: the pattern splits it so too.
_SIMPLE = re.compile(r"( ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class _Known(dict[str, bytes]):
    """Ids by part; what is not known is found when it is asked for, so that a known part costs one look."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self._find = find

    def __missing__(self, part: str) -> bytes:
        found = self[part] = self._find(part)
        return found


class ByteBPE:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's split pattern lets a word begin with a space and never run over one that follows a character
    other than white space. So a text may be cut before each such space, and each part encoded (and remembered) alone;
    single white space of other kinds stands alone too. New parts go through the library's pattern and model directly,
    which is twice as fast as whole encodings with their offsets; parts with special tokens go through all of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._young, self._old = _Known(self._find), {}
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        pre = json.loads(self._tokenizer.to_str())["pre_tokenizer"]
        self._direct = pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._tokenize = self._tokenizer.model.tokenize
        self._alphabet = byte_alphabet()
        self._words = regex.compile(public_tokenizers.PATTERN).findall

    def _find(self, part: str) -> bytes:
        if (found := self._old.get(part)) is not None:
            return found
        if not self._direct or self._special(part):
            return array("I", self._tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if not (simple := _SIMPLE(part)):
            return b"".join(map(self._word, self._words(part)))
        word, rest = simple.groups()
        if not rest:
            return self._word(part)
        return (self._young.get(word) or self._old.get(word) or self._word(word)) + self._young[rest]

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            coded = word.replace(" ", self._alphabet[32])
        else:
            coded = "".join([self._alphabet[b] for b in word.encode()])
        return array("I", [t.id for t in self._tokenize(coded)]).tobytes()

    @staticmethod
    def parts(text: str) -> list[str]:
        if not _UNUSUAL.search(text):
            for run in _RUNS:
                if run in text:
                    return _CUT.split(text)
            # the same as below, but faster; an empty part has no ids
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split(_MARK)
        if _RUN.search(text):
            return _CUT.split(text)
        return _PART.findall(text)

    def encode(self, texts: Iterable[Sequence[str | None]]) -> Iterator[bytes]:
        """Ids of each text, from lists of texts of which each is worked on at once."""
        for some in texts:
            if len(self._young) > CACHE:  # what is used again moves to the young generation, the rest goes with the old one
                self._old, self._young = self._young, _Known(self._find)
            ids = self._young.__getitem__
            for t in some:
                yield b"".join(map(ids, self.parts(t))) if t else b""

    def rest(self, remember: bool = True) -> None:
        """At a task's end: a worker that waits holds CACHE parts at most, and without ``remember`` none."""
        if not remember:
            self._young, self._old = _Known(self._find), {}
        elif len(self._young) + len(self._old) > CACHE:
            self._old = {}
        if remember:
            pa.default_memory_pool().release_unused()
        else:
            give_back()


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    """One tokenizer a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
