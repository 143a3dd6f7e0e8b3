"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are weighted by TF-IDF, with document frequencies of the
whole corpus, and a distributed randomised SVD gives the latent space of each
block of at most RANK of them: its strongest directions, as few as leave every
passage KEPT of its norm. All passages of all documents are projected into the
spaces and compared by cosine there; near ones are checked by the
longest common subsequence of words and by the presence of the item's answer,
its last part, so paraphrases are found as well as copies.
"""

from __future__ import annotations

import functools
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import materialise

#: Words are kept as hashes of four bytes, whose lowest bits are the terms of the space.
TERMS = 1 << 15
#: Words of the benchmark that are searched for in one pass over the documents; more of them are more passes. Their spaces, at most
#: 0.6 KB for each word of a passage, are sent to the tasks together.
PASS_WORDS = 100_000
#: A passage is PARTS runs of STRIDE words; one begins with each run.
STRIDE, PARTS = 16, 3
#: Words that are compared together: short texts go together, a long one in pieces that overlap by a passage.
PIECE = 500 * STRIDE
#: Passages of the benchmark that share a space, and so its rank at most.
RANK, OVERSAMPLE, POWER = 160, 16, 2
#: Share of its norm that each passage keeps in the space, which has no more directions than that takes.
KEPT = 0.7
#: Cosine from which a passage is checked, for an item's passage that keeps its whole norm in its space.
NEAR = 0.3
#: Share of a passage's own weight from which it is checked as well, whatever words stand around it; a copy has all.
HELD = 0.5
#: Shares of the item's words in common order from which it is a copy, or a paraphrase if the answer is there as well.
COPY, PARAPHRASE, ANSWER = 0.75, 0.55, 0.75
ANSWER_WORDS = 8
#: Words of an item up to which a task keeps their places; they take a bit for each two of them.
KNOWN = 1_000
_PUNCTUATION = ".,;:!?\"'()[]{}<>|#*%$&-_"


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the words of all texts as hashes, the number of words of each); each distinct word is hashed once."""
    low = pc.utf8_trim_whitespace(pa.array([(t or "").lower() for t in texts], pa.string()))
    words = pc.utf8_split_whitespace(low)
    empty = np.asarray(pc.equal(low, ""))
    number = np.where(empty, 0, np.asarray(pc.list_value_length(words)))
    coded = pc.list_flatten(words.filter(pa.array(~empty))).dictionary_encode()
    bare = pc.utf8_trim(coded.dictionary, characters=_PUNCTUATION)
    bare = pc.if_else(pc.equal(bare, ""), coded.dictionary, bare)
    ends = np.cumsum(np.asarray(pc.binary_length(bare))).tolist()
    data = bare.buffers()[2].to_pybytes() if ends else b""
    hashes = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends)), np.uint32, len(ends))
    return hashes[np.asarray(coded.indices)], number


def word_ids(text: str | None) -> np.ndarray:
    """Words as hashes, which the longest common subsequence compares; its terms are ``ids & (TERMS - 1)``."""
    return word_hashes([text])[0]


def term_ids(text: str | None) -> np.ndarray:
    return (word_ids(text) & (TERMS - 1)).astype(np.uint16)


def term_table(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, terms): the hashed words of every whole text, four bytes each."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, number = word_hashes(batch.column(text_col).to_pylist())
            ends = np.append(0, np.cumsum(number)) * ids.itemsize
            data = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), data], [*keys, "terms"])

    return docs.select(*keys, text_col).mapInArrow(run, f"{kinds}, terms binary")


def document_frequencies(terms: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, over all documents, and their number; TERMS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS + 1, np.int64), 0
        last = np.zeros(TERMS, np.int64)  # place of each term's last word in the text
        for batch in batches:
            for data in batch.column("terms"):
                t = np.frombuffer(data.as_buffer(), np.uint32) & (TERMS - 1)
                place = np.arange(len(t))
                last[t] = place
                df[t[last[t] == place]] += 1
                n += 1
        df[TERMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["t", "n"])

    df = np.zeros(TERMS + 1, np.int64)
    for t, n in terms.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        df[t] = n
    return df[:TERMS], int(df[TERMS])


def _tfidf(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit TF-IDF weights of a passage."""
    t, n = np.unique(ids, return_counts=True)
    w = n * idf[t]
    norm = np.linalg.norm(w)
    return t, (w / norm if norm else w)


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their rows in the space): the right singular vectors of the TF-IDF passages, by randomised subspace iteration.

    Each task multiplies its rows with the current block and adds up the
    product with their transpose; sums of tasks are added up by block of terms.
    Only terms of passages count, so a sum has (terms, rank + OVERSAMPLE) numbers.
    """
    used = sorted({int(t) for (b,) in passages.select("terms").distinct().toLocalIterator() for t in np.frombuffer(b, np.uint16)})
    place = np.full(TERMS, -1, np.int64)
    place[used] = np.arange(len(used))
    width = min(rank + OVERSAMPLE, max(1, len(used)))
    block = np.random.default_rng(3).standard_normal((len(used), width))

    def product(block: np.ndarray, small: bool) -> np.ndarray:
        """A'(A block), or the Gram matrix of A block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width) if small else block.shape)
            for batch in batches:
                for data in batch.column("terms"):
                    t, w = _tfidf(np.frombuffer(data.as_buffer(), np.uint16), idf)
                    y = w @ block[place[t]]
                    if small:
                        total += np.outer(y, y)
                    else:
                        total[place[t]] += np.outer(w, y)
            for a in range(0, len(total), 64):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([total[a : a + 64].tobytes()], pa.binary())], ["at", "part"])

        def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("part"))
            return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((width, width) if small else block.shape)
        for at, part in passages.mapInArrow(run, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").collect():
            own = np.frombuffer(bytes(part), np.float64).reshape(-1, out.shape[1])
            out[at : at + len(own)] = own
        return out

    for _ in range(POWER):
        block = np.linalg.qr(product(block, False))[0]
    value, vector = np.linalg.eigh(product(block, True))
    best = np.argsort(-value)[:rank]
    best = best[value[best] > 1e-9]
    return np.array(used, np.int64), block @ vector[:, best]


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    return _common(_places(item), len(item), text.tolist())


def _places(item: np.ndarray) -> dict[int, int]:
    """The places of each of an item's words, as bits."""
    where: dict[int, int] = {}
    for k, t in enumerate(item.tolist()):
        where[t] = where.get(t, 0) | 1 << k
    return where


def _common(where: dict[int, int], size: int, text: list[int], share: float = 0.0) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming over the item's positions; 0 if the text has less than that share of its words in any order."""
    masks = [m for m in map(where.get, text) if m]
    if functools.reduce(operator.or_, masks, 0).bit_count() / size < share:
        return 0
    full = (1 << size) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _block(spark: SparkSession, cuts: list[tuple[int, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block of passages (item's place, terms): each term's row in the space, the rows (weighted, the last one of no term), unit passages, the norms that they kept, their own weights and items."""
    used, space = latent_space(spark.createDataFrame([(bytearray(t.tobytes()),) for _, t in cuts], "terms binary"), idf)
    index = np.stack([w @ space[np.searchsorted(used, t)] for t, w in (_tfidf(t, idf) for _, t in cuts)])
    norms = np.sqrt(np.cumsum(index**2, axis=1))
    rank = min(space.shape[1], 1 + int((norms.min(axis=0) < KEPT).sum()))
    kept, index = norms[:, rank - 1], index[:, :rank]
    row = np.full(TERMS, len(used), np.int32)
    row[used] = np.arange(len(used))
    rows = np.vstack([space[:, :rank] * idf[used][:, None], np.zeros((1, rank))]).astype(np.float32)
    weight = [np.linalg.norm(idf[x] * n) for x, n in (np.unique(t, return_counts=True) for _, t in cuts)]
    return row, rows, (index / np.maximum(kept, 1e-9)[:, None]).astype(np.float32).T, kept, np.array(weight), np.array([k for k, _ in cuts])


def _groups(texts: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Texts with their places, as many together as reach PIECE words."""
    group, size = [], 0
    for i, ids in enumerate(texts):
        group.append((i, ids))
        size += len(ids)
        if size >= PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _runs(group: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """About PIECE words at a time in runs of STRIDE: (terms, a column for each run, TERMS behind a piece's end; the runs' pieces, texts and places)."""
    pieces = [(i, a, (ids[a : a + PIECE + STRIDE * PARTS] & (TERMS - 1))) for i, ids in group for a in range(0, len(ids), PIECE)]
    held, size = [], 0
    for k, own in enumerate(pieces):
        held.append(own)
        size += len(own[2])
        if size < PIECE and k < len(pieces) - 1:
            continue
        number = np.array([-(-len(t) // STRIDE) for _, _, t in held])
        first = np.cumsum(number) - number
        own = np.full(number.sum() * STRIDE, TERMS, np.intp)
        for (_, _, t), f in zip(held, first.tolist()):
            own[f * STRIDE : f * STRIDE + len(t)] = t
        piece = np.repeat(np.arange(len(held)), number)
        place = np.array([a for _, a, _ in held])[piece] + (np.arange(len(piece)) - first[piece]) * STRIDE
        yield np.ascontiguousarray(own.reshape(-1, STRIDE).T), piece, np.array([i for i, _, _ in held])[piece], place
        held, size = [], 0


def _totals(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each column of places."""
    total = table[at[0]]
    own = np.empty_like(total)
    for k in at[1:]:
        total += np.take(table, k, axis=0, out=own, mode="clip")
    return total


def _sums(part: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Sums of PARTS runs of a piece from each on."""
    total = part.copy()
    for k in range(1, PARTS):
        total[:-k] += part[k:] * (piece[k:] == piece[:-k])[:, None]
    return total


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, cosine, common, answer) of each document and benchmark item that it holds, copied or paraphrased.

    common is the share of the item's words found in common order, answer that
    of its last ANSWER_WORDS words, cosine that of the nearest passage. Items
    without a word, null texts and texts without a word match nothing; repeated
    rows of a document each give their rows, equal items are reported for each
    item; empty tables give no rows; other columns are not read. Ids of any type
    will do, and several columns may name a document.

    The benchmark is the query set: it is read and sent to the tasks PASS_WORDS
    words at a time, with one pass over the documents' words for each, and the search
    takes time in proportion to its passages. Documents take one
    narrow pass to word hashes (four bytes a word, in the shared folder), one to
    document frequencies and the passes of the search; nothing of them is shuffled.
    """
    keys = [id_col] if isinstance(id_col, str) else id_col
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    result = f"{kinds}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, cosine double, common double, answer double"
    empty = docs.sparkSession.createDataFrame([], result)
    terms = materialise(term_table(docs, keys, text_col), "terms")
    df, n = document_frequencies(terms)
    if not n:
        return empty
    idf = np.log((n + 1) / (df + 1)) + 0.1
    found, held, size = [], [], 0
    for i, t in benchmark.select(item_col, item_text).orderBy(item_col).toLocalIterator():
        ids = word_ids(t)
        if not len(ids):
            continue
        if size and size + len(ids) > PASS_WORDS:
            found.append(_search(terms, keys, held, item_col, benchmark.schema[item_col].dataType, idf, result))
            held, size = [], 0
        held.append((i, ids))
        size += len(ids)
    if held:
        found.append(_search(terms, keys, held, item_col, benchmark.schema[item_col].dataType, idf, result))
    return functools.reduce(DataFrame.unionByName, found, empty) if len(found) != 1 else found[0]


def _search(terms: DataFrame, keys: list[str], items: list[tuple], item_col: str, item_kind: DataType, idf: np.ndarray, result: str) -> DataFrame:
    length = STRIDE * PARTS
    short = lambda t: (t & (TERMS - 1)).astype(np.uint16)
    cuts = [(k, short(t[a : a + length])) for k, (_, t) in enumerate(items) for a in range(0, max(1, len(t) - length // 2), length // 2)]
    blocks = [_block(terms.sparkSession, cuts[a : a + RANK], idf) for a in range(0, len(cuts), RANK)]
    square = np.append(idf * idf, 0).astype(np.float32)[:, None]

    item_type = to_arrow_type(item_kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each block: the terms' rows, one for no term too, the rows, the passages, their bounds and items
        spaces = [(np.append(row, len(rows) - 1).astype(np.intp), rows, passages, (NEAR * kept).astype(np.float32), (HELD * kept * weight).astype(np.float32), owner) for row, rows, passages, kept, weight, owner in blocks]
        known: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
        for batch in batches:
            texts = [np.frombuffer(data.as_buffer(), np.uint32) for data in batch.column("terms")]
            found = [(i, items[k][0], *rest) for group in _groups(texts) for i, k, *rest in _matches(group, spaces, known)]
            if found:
                cols, at = list(zip(*found)), pa.array([f[0] for f in found])
                held_by = [batch.column(k).take(at) for k in keys]
                yield pa.RecordBatch.from_arrays([*held_by, pa.array(cols[1], item_type), *(pa.array(c, pa.float64()) for c in cols[2:])], [*keys, item_col, "cosine", "common", "answer"])

    def _matches(group: list[tuple[int, np.ndarray]], spaces: list[tuple], known: dict) -> Iterator[tuple[int, int, float, float, float]]:
        best: dict[tuple[int, int], float] = {}
        spans: dict[tuple[int, int], list[int]] = {}
        for own, piece, text, place in _runs(group):
            norm = np.sqrt(np.maximum(_sums(_totals(square, own), piece), 1e-9))
            for row, rows, passages, near, held, owner in spaces:
                part = _sums(_totals(rows, row[own]), piece) @ passages
                bound = norm * near
                at, c = np.divmod(np.flatnonzero(part >= np.minimum(bound, held, out=bound)), len(owner))
                for i, k, a, x in zip(text[at].tolist(), owner[c].tolist(), place[at].tolist(), (part[at, c] / norm[at, 0]).tolist()):
                    best[i, k] = max(best.get((i, k), 0.0), x)
                    spans.setdefault((i, k), []).append(a)
        ids = dict(group)
        for (i, k), places in spans.items():
            item = items[k][1]
            where, where_answer = known.get(k) or (_places(item), _places(item[-ANSWER_WORDS:]))
            if len(item) <= KNOWN:
                known[k] = where, where_answer
            margin, top = len(item), (0.0, 0.0)
            merged: list[list[int]] = []
            for a in sorted(places):
                a, b = max(0, a - margin), a + length + margin
                if merged and a <= merged[-1][1] and b - merged[-1][0] <= 4 * (length + margin):
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            for a, b in merged:
                region = ids[i][a:b].tolist()
                common = _common(where, len(item), region, PARAPHRASE) / len(item)
                if common >= PARAPHRASE:
                    size = min(ANSWER_WORDS, len(item))
                    top = max(top, (common, _common(where_answer, size, region) / size))
            if top[0] >= COPY or top[0] >= PARAPHRASE and top[1] >= ANSWER:
                yield i, k, min(1.0, best[i, k]), top[0], top[1]

    return terms.mapInArrow(search, result)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; rows without an id, and rows of one id with other texts, are judged by their own text."""
    mark = F.xxhash64(F.col(text_col))
    marked = docs.select(F.col(id_col).alias("_id"), mark.alias("_mark"), F.col(text_col).alias("_text"))
    found = contaminated(marked, benchmark, ["_id", "_mark"], "_text")
    found = materialise(found.select("_id", "_mark").distinct(), "leaks")
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (mark == found["_mark"]), "left_anti")
