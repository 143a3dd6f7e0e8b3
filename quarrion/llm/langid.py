"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds the
vectors of its letters, each permuted (rotated) by its place; a document's
profile bundles (adds) its trigrams' vectors; a language's prototype bundles
the unit profiles of its documents. A document goes to the prototype of the
largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DIMENSIONS = 1024
#: Symbols: 0 for whatever is no letter, 1 to 26 for a to z, the others for further letters, by remainder of the code point.
SYMBOLS = 64
SEED = 20


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def symbol_table() -> np.ndarray:
    """Symbol of each code point of all planes: a to z are 1 to 26, further letters share what is left; 0 is no letter."""
    cp = np.arange(0x110000)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.where((cp >= 97) & (cp <= 122), cp - 96, 27 + cp % (SYMBOLS - 27)), 0).astype(np.uint8)


class Encoder:
    """Profiles of texts; keeps the vectors of the trigrams met so far, SYMBOLS**3 at most."""

    #: Vectors kept; with more, the memory starts anew.
    KEPT = 40_000

    def __init__(self, dimensions: int = DIMENSIONS):
        self.letters, self.symbols = letter_vectors(dimensions), symbol_table()
        self.dimensions = dimensions
        self.clear()

    def clear(self) -> None:
        self.place = np.full(SYMBOLS**3, -1, np.int64)
        self.known = np.empty((0, self.dimensions), np.float32)

    def learn(self, grams: np.ndarray) -> None:
        new = np.unique(grams[self.place[grams] < 0])
        if not len(new):
            return
        if len(self.known) and len(self.known) + len(new) > self.KEPT:
            self.clear()
            new = np.unique(grams)
        a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
        bound = np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c]
        self.place[new] = np.arange(len(new)) + len(self.known)
        self.known = np.concatenate([self.known, bound.astype(np.float32)])

    def grams(self, text: str) -> np.ndarray:
        """Trigram codes of the lower-cased letters, runs of anything else as one gap; none if there is no letter."""
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbols[cp].astype(np.int64)
        if not s.any():
            return s[:0]
        s = np.concatenate([[0], s, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """Unit profiles, one row a text; zero where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for start in range(0, len(texts), 64):
            grams = [self.grams(t or "") for t in texts[start : start + 64]]
            every = np.concatenate(grams)
            if not len(every):
                continue
            self.learn(every)
            used, local = np.unique(self.place[every], return_inverse=True)
            rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            counts = np.bincount(rows * len(used) + local, minlength=len(grams) * len(used)).reshape(len(grams), -1)
            out[start : start + len(grams)] = counts.astype(np.float32) @ self.known[used]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


_encoder: list[Encoder] = []


def encoder() -> Encoder:
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language, bundled over all rows with a language.

    Each task adds up its rows, and the sums are added by (language, block of
    dimensions): the driver gets one vector of fixed length for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, text_col):
            unit = encoder().profiles(part.column(text_col).to_pylist())
            langs = np.array(part.column(lang_col).to_pylist(), dtype=object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + unit[langs == lang].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(run, "lang string, v array<double>")
    sums = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect():
        v = np.array([x for _, x in r.v], np.float32)
        n = np.linalg.norm(v)
        if n:
            out[r.lang] = v / n
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score, the cosine (0 at least), of every whole text; ``und`` and 0 where a text is null or has no letter.

    Ties go to the language that comes first by name; repeated rows each give a
    row; without any prototype everything is ``und``.
    """
    langs = sorted(profiles)
    matrix = np.stack([profiles[x] for x in langs], 1) if langs else np.zeros((DIMENSIONS, 0), np.float32)
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            unit = encoder().profiles(part.column(text_col).to_pylist())
            has = unit.any(1) & bool(langs)
            cos = unit @ matrix if langs else np.zeros((len(unit), 1))
            best = cos.argmax(1)
            score = np.clip(cos[np.arange(len(cos)), best], 0, 1) * has
            pred = [langs[b] if h else "und" for b, h in zip(best, has)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(pred, pa.string()), pa.array(score.astype(float))], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows whose CRC-32 of the id is not in the held-out fold; predict all rows.

    Texts that are null or have no letter of any plane are ``und``; repeated
    rows each give a row; an empty table gives none; other columns are not read.
    """
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds
    found = predict(docs, prototypes(docs.where(fold != held), text_col, lang_col), id_col, text_col)
    return found.select(id_col, (fold == held).alias("held_out"), "lang_pred", "score")
