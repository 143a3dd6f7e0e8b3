"""Byte-level BPE encoding and decoding with a published vocabulary file.

A word is merged by a priority queue of merge ranks over a doubly linked list
of symbols. An entry of the queue names a pair by the position of its left
symbol and both symbols as they were when it was pushed; when it is popped and
the list no longer holds them there, it is stale and is skipped. Decoding
concatenates the vocabulary's strings and maps their letters back to bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: The pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A worker keeps the ids of this many words, and of as many before those; longer words are not kept.
WORDS_KEPT, LONGEST_KEPT = 200_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return letters


class _Words(dict):
    """Word to ids; what is missing is merged and, if short, kept."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or self.merge(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """Encoder and decoder for one vocabulary file in the JSON form of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) to (rank, id of the two together)
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.start = [vocab.get(x) for x in letters]
        value = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.numbers = [str(i) for i in range(len(self.strings))]
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = _Words(self.merge)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token; the lowest rank goes first, of equal ones the leftmost."""
        ids = [self.start[b] for b in word.encode()]
        n = len(ids)
        if n == 1:
            return tuple(ids)
        merges, before, after = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, both = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((both, ids[k])):
                    heapq.heappush(queue, (m[0], i, both, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], both))):
                heapq.heappush(queue, (m[0], h, ids[h], both, m[1]))
        return tuple(x for x in ids if x is not None)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens become those tokens."""
        cut, words = self.cut.findall, self.words
        if self.cut_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(words.__getitem__, cut(text))))
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += chain.from_iterable(map(words.__getitem__, cut(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        return out + list(chain.from_iterable(map(words.__getitem__, cut(text[at:]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary of a file, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again; a narrow step without a shuffle.

    A null text counts as empty: no ids, an empty decoded text. Repeated rows
    each give a row; an empty table gives none. Other columns are not read, so
    clashing names among them do no harm. ``with_ids`` adds ``ids``
    (array of int), ``with_text`` adds ``decoded``. The vocabulary file's path
    must exist on every executor; by default each finds its own installed one.
    """
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocabulary or default_vocabulary())
        name = model.numbers.__getitem__
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, text_col):
            out: dict[str, list] = {"n": [], "a": [], "b": [], "ids": [], "decoded": []}
            for text in part.column(text_col).to_pylist():
                ids = model.encode(text or "")
                back = model.decode(ids)
                out["n"].append(len(ids))
                out["a"].append(sha(",".join(map(name, ids)).encode()))
                out["b"].append(sha(back.encode()))
                if with_ids:
                    out["ids"].append(ids)
                if with_text:
                    out["decoded"].append(back)
            columns = [part.column(id_col), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
            if with_text:
                columns, names = [*columns, pa.array(out["decoded"], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
