"""BPE encoding and decoding with a contiguous rank array per short word."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Entries after which the cache of a Python worker starts anew.
CACHE = 250_000
NONE = 1 << 60
#: Parts up to which a word's ranks are scanned.
SHORT = 256
#: White space as Unicode defines it; str.split() also cuts at the four information separators.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACE, _SEPARATORS = regex.compile(SPACE), regex.compile(r"[\x1c-\x1f]")
_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBPE:
    """The vocabulary, merges, split pattern and special tokens of a tokenizer file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.alphabet = byte_alphabet()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: pair of ids -> (rank, id of the merged token)
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.ranks = {p: r for p, (r, _) in self.pairs.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words: dict[str, list[int]] = {}
        self._chunks: dict[str, tuple[int, str, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: parts and the ranks of adjacent parts lie in two arrays; scan for the least rank, join there,
        delete the boundary and refresh the two neighbouring ranks."""
        symbols = [self.alphabet[b] for b in word.encode()]
        symbols[-1] += self.suffix
        parts = [self.vocab[s] for s in symbols if s in self.vocab]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.pairs[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for words whose rank array would be scanned too often: ranks in a heap, boundaries in a linked list. Entries
        whose pair has changed meanwhile are passed over; of equal ranks the leftmost comes first, as in the scan."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        pairs, end = self.pairs, len(parts)
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if parts[i] >= 0 else end
            if j >= end or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = pairs[a, b][1], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (p := (parts[i], parts[k])) in pairs:
                    heappush(heap, (pairs[p][0], i, *p))
            h = before[i]
            if h >= 0 and (p := (parts[h], parts[i])) in pairs:
                heappush(heap, (pairs[p][0], h, *p))
        return [p for p in parts if p >= 0]

    def _segment(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        # lower case goes character by character: no final sigma
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        out: list[int] = []
        for word in self.pattern.findall(text):
            if (ids := self._words.get(word)) is None:
                ids = self._words[word] = self.merge(word)
            out += ids
        return out

    def ids(self, chunk: str) -> list[int]:
        """Ids of a text without white space. Special tokens are found in the raw text first."""
        if self.special_pattern is None or "<" not in chunk:
            return self._segment(chunk)
        out: list[int] = []
        for part in self.special_pattern.split(chunk):
            out += [self.special[part]] if part in self.special else self._segment(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens, special ones too, joined by a space."""
        return " ".join([self.names[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """White space is in no word, so what lies between can be encoded alone."""
        return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) if c for i in self.ids(c)]

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal, decoded text)."""
        if len(self._chunks) > CACHE:
            self._chunks.clear()
            self._words.clear()
        known, n, ids, decoded = self._chunks, 0, [], []
        for c in self.chunks(text):
            if (got := known.get(c)) is None:
                found = self.ids(c)
                got = known[c] = (len(found), " ".join(map(str, found)), self.decode(found))
            if got[0]:
                n += got[0]
                ids.append(got[1])
                decoded.append(got[2])
        return n, " ".join(ids), " ".join(decoded)


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """op7: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text is empty, repeated rows and null ids stay as
    they are, an empty table gives no row. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for b in batches:
            n, ids, decoded = [], [], []
            for text in chain.from_iterable(slices(b.column(1))):
                k, i, d = bpe.digests(text or "")
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                decoded.append(hashlib.sha256(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
