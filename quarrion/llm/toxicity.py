"""Toxicity by weak supervision.

Many voters look at a text. Lexicon voters differ in what they read (whole
words, word beginnings, beginnings that several words share) and in the third
of the labelled rows that they were mined from, so no row is behind two of a
kind; pattern voters look for shouting and address. A generative label model
finds, from how often the voters fire together over the whole corpus, their
accuracies and their correlations, and gives each pattern of votes a
posterior. A linear classifier over word features learns those posteriors, and
nothing else, and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand, materialise, pack_bytes, slices, squeeze, table, unpack_bytes

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled rows of each label that the classifier is fitted on at most: those of the smallest hashes of the id. All counts cover all rows.
SAMPLE_ROWS = 4_000
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = range(4, 9)
#: Families of features: whole words, beginnings, beginnings that several words of a text share.
WORD, BEGINNING, SHARED = range(3)
FAMILIES = 3
#: Parts of the labelled rows, each with lexicons of its own.
PARTS = 3
LEXICONS = FAMILIES * PARTS
#: A feature counts from this many standard errors between the labels on, in a lexicon from so many rows of label 1.
SIGNIFICANT, LEAST = 4.0, 3
THRESHOLD = 0.7
#: Rows of label 1 that a task counts at least, if there are more tasks than TASKS.
TASK_ROWS, TASKS = 50_000, 16
#: Counters of features of label 1, by which rarer ones are left out before the exact count, and how many of them are a row of its exchange.
COUNTERS, BLOCK = 1 << 22, 1 << 16
_SHOUT = re.compile(r"[!?]{2,}")
_CAPITALS = re.compile(r"\b[A-Z]{4,}\b")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|ton|tes|usted)\b", re.IGNORECASE)
VOTERS = LEXICONS + 3


def word_features(word: str) -> list[tuple[str, int]]:
    """Spelling and family of the whole word and of its beginnings, from the shortest on, the word last."""
    return [*((word[:k], BEGINNING) for k in BEGINNINGS if len(word) >= k), (word, WORD)]


def feature_key(spelling: str, family: int) -> int:
    """64-bit key; the family is in the two lowest bits, so that of a shared beginning follows that of the beginning."""
    return xxhash.xxh64_intdigest(spelling) & 0x7FFFFFFFFFFFFFFC | family


class Words(dict):
    """Keys of the features of the words met in a task, those alone whose counter is set in ``often`` (one byte each)."""

    def __init__(self, often: bytes | None = None):
        super().__init__()
        self.often = often

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 50_000:
            self.clear()
        out = []
        for spelling, family in word_features(word):
            f = feature_key(spelling, family)
            if self.often is None or self.often[(f >> 2) % COUNTERS]:
                out.append(f)
            else:
                break  # what begins so is no more frequent
        out = self[word] = tuple(out)
        return out

    def features(self, text: str | None) -> set[int]:
        """Features of a text's distinct words; a beginning that two or more of them share is one more."""
        met: list[int] = []
        for w in set(LETTERS.findall((text or "").lower())):
            met += self[w]
        out = set(met)
        if len(met) > len(out):
            out.update(f + 1 for f, n in Counter(met).items() if n > 1 and f & 3 == BEGINNING)
        return out


class Entries:
    """The same for a small set of entries (spelling, family), as places in it: most words are passed over by their first letters."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.place = {e: i for i, e in enumerate(entries)}
        least = min(BEGINNINGS)
        self.least, self.starts = least, {s[:least] for s, _ in entries}

    def features(self, text: str | None) -> set[int]:
        met: list[tuple[str, int]] = []
        starts, least = self.starts, self.least
        for w in set(LETTERS.findall((text or "").lower())):
            if w[:least] in starts:
                met += word_features(w)
        out = {self.place[f] for f in met if f in self.place}
        if met:
            shared = ((s, SHARED) for (s, family), n in Counter(met).items() if n > 1 and family == BEGINNING)
            out.update(self.place[f] for f in shared if f in self.place)
        return out


def patterns(text: str | None) -> list[bool]:
    """Votes of the pattern voters: repeated marks, words in capitals, address of the reader."""
    t = text or ""
    return [len(_SHOUT.findall(t)) >= 3, len(_CAPITALS.findall(t)) >= 5, len(_ADDRESS.findall(t)) >= 2]


class Model:
    """What the workers need: lexicon entries with their voters as bits, their weights and the offset."""

    def __init__(self):
        self.entries: list[tuple[str, int]] = []
        self.voters: list[int] = []
        self.weight: list[float] = []
        self.offset = -4.0

    def start(self) -> None:
        """Begin a task."""
        self.words = Entries(self.entries)

    def votes(self, features: set[int], text: str | None) -> int:
        out = 0
        for f in features:
            out |= self.voters[f]
        for k, yes in enumerate(patterns(text), LEXICONS):
            out |= yes << k
        return out

    def score(self, text: str | None) -> float:
        x = self.offset + sum(self.weight[f] for f in sorted(self.words.features(text)))
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def often_toxic(rows: DataFrame) -> bytes:
    """COUNTERS bits: whether a counter that features share was met in LEAST rows of label 1 or more.

    A shared beginning counts with its beginning, in whose rows it is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Words(), np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for data in batch.column("data"):
                own = np.fromiter(words.features(expand(data.as_py())), np.int64) >> 2
                n[np.unique(own % COUNTERS)] += 1
        for k in range(0, COUNTERS, BLOCK):
            own = n[k : k + BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack_bytes(own.tobytes())], pa.binary())], ["at", "n"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(unpack_bytes(x.as_buffer()), np.int32).astype(np.int64) for x in table.column("n"))
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pack_bytes(np.packbits(total >= LEAST).tobytes())], pa.binary())})

    out = np.zeros(COUNTERS // 8, np.uint8)
    for at, n in rows.select("data").mapInArrow(count, "at int, n binary").groupBy("at").applyInArrow(add, "at int, n binary").collect():
        out[at // 8 : (at + BLOCK) // 8] = np.frombuffer(unpack_bytes(bytes(n)), np.uint8)
    return out.tobytes()


def mine(rows: DataFrame, often: bytes, total: list[int]) -> DataFrame:
    """(f, voters, lean) of features that lean to label 1 by SIGNIFICANT standard errors, counted over all rows of (data, _part, _label).

    voters has a bit for each part of the rows that has the feature in its
    lexicon: it leans so in that part alone, and by the lower bound of its
    share there most rows that have it are of label 1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(np.unpackbits(np.frombuffer(often, np.uint8)).tobytes())
        got = [Counter() for _ in range(2 * PARTS)]

        def out() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(got):
                if c:
                    ones = np.full(len(c), k % 2)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(np.full(len(c), k // 2, np.int32)), pa.array(list(c.values()), pa.int64()), pa.array(ones.astype(np.int32))], ["f", "part", "n", "y"])
                    c.clear()

        for batch in batches:
            for data, part, y in zip(batch.column("data"), batch.column("_part").to_pylist(), batch.column("_label").to_pylist()):
                got[2 * part + y].update(words.features(expand(data.as_py())))
                if sum(map(len, got)) > 100_000:
                    yield from out()
        yield from out()

    counts = rows.select("data", "_part", "_label").mapInArrow(count, "f long, part int, n long, y int")
    own = lambda k, y: F.coalesce(F.sum(F.when((F.col("part") == k) & (F.col("y") == y), F.col("n"))), F.lit(0))
    counts = counts.groupBy("f").agg(*(own(k, y).alias(f"n{k}{y}") for k in range(PARTS) for y in (0, 1)))
    base, z = total[1] / sum(total), 1.64

    def lean(one: Column, zero: Column) -> Column:
        n = F.greatest(one + zero, F.lit(1))
        return (one - n * base) / F.sqrt(n * base * (1 - base))

    def sure(k: int) -> Column:
        one, n = F.col(f"n{k}1"), F.greatest(F.col(f"n{k}1") + F.col(f"n{k}0"), F.lit(1))
        p = one / n
        low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return (one >= LEAST) & (lean(one, F.col(f"n{k}0")) >= SIGNIFICANT) & (low > 0.5)

    every = [sum((F.col(f"n{k}{y}") for k in range(PARTS)), F.lit(0)) for y in (0, 1)]
    voters = sum((F.when(sure(k), 1 << k).otherwise(0) for k in range(PARTS)), F.lit(0))
    return counts.select("f", voters.alias("voters"), lean(every[1], every[0]).alias("lean")).where("voters > 0")


def credit(rows: DataFrame, strength: dict[int, float]) -> dict[tuple[str, int], int]:
    """The lexicons of each entry (spelling, family) as bits, once each row speaks only for its strongest entries.

    What merely stands beside a telling word, as in copies of a text, has rows
    of label 1 to its name only where the telling word is. So a row counts for
    entries of half the standard errors of its strongest one or more, and an entry
    stays in a part's lexicon if most of the rows that speak for it there are still of label 1.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, got = Entered(strength), Counter()
        for batch in batches:
            for data, part, y in zip(batch.column("data"), batch.column("_part").to_pylist(), batch.column("_label").to_pylist()):
                own = {f: strength[f] for f in words.features(expand(data.as_py()))}
                if own:
                    top = max(own.values()) / 2
                    got.update((words.spelt[f & ~3 | BEGINNING if f & 3 == SHARED else f], f, part, y) for f, v in own.items() if v >= top)
        cols = list(zip(*got)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:]), pa.array(list(got.values()), pa.int64())], ["s", "f", "part", "y", "n"])

    counts = rows.select("data", "_part", "_label").mapInArrow(count, "s string, f long, part int, y int, n long").groupBy("s", "f", "part", "y").agg(F.sum("n").alias("n"))
    n: dict[tuple[str, int, int], list[int]] = {}
    for spelling, f, part, y, k in counts.collect():  # as many as entries
        n.setdefault((spelling, f & 3, part), [0, 0])[y] = k
    out: dict[tuple[str, int], int] = {}
    for (spelling, family, part), (zero, one) in sorted(n.items()):
        if one >= LEAST and lower_bound(one, one + zero) > 0.5:
            out[spelling, family] = out.get((spelling, family), 0) | 1 << part
    return out


class Entered(Words):
    """Features of the words met in a task that are among the entries, by key, and how these are spelt."""

    def __init__(self, entries: dict[int, float]):
        super().__init__()
        self.entries, self.spelt = entries, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 50_000:
            self.clear()
        out = []
        for spelling, family in word_features(word):
            f = feature_key(spelling, family)
            if f in self.entries or family == BEGINNING and f + 1 in self.entries:
                out.append(f)
                self.spelt[f] = spelling
        out = self[word] = tuple(out)
        return out

    def features(self, text: str | None) -> set[int]:
        return {f for f in super().features(text) if f in self.entries}


def lower_bound(one: int, n: int, z: float = 1.64) -> float:
    """Of a share of which so many were seen, by the score interval."""
    p = one / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def label_model(votes: dict[int, int], cast_by: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 200) -> dict[int, float]:
    """Posterior of label 1 for each vote pattern, from how often the patterns occur.

    Each voter fires with one rate given label 1 and another given label 0
    (both found by expectation maximisation over all patterns, starting from
    the labelled rows' votes); voters whose firing still correlates within a
    class share their evidence, each weighted down by what it correlates with
    others.
    """
    if not votes:
        return {}
    keys = np.array(list(votes), np.int64)
    n = np.array(list(votes.values()), np.float64)
    bits = lambda v: ((v[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)
    x, own = bits(keys), bits(cast_by)
    prior = min(max((y * weights).sum() / weights.sum(), 1e-3), 0.5)
    p1 = np.clip((y @ own + 0.5) / (y.sum() + 1), 1e-4, 0.99)
    p0 = np.clip(((1 - y) @ own + 0.5) / ((1 - y).sum() + 10), 1e-5, 0.99)
    weight = np.ones(VOTERS)

    def posterior() -> np.ndarray:
        odds = np.log(prior / (1 - prior)) + x @ (weight * np.log(p1 / p0)) + (1 - x) @ (weight * np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    for _ in range(rounds):
        q = posterior()
        a, b = n * q, n * (1 - q)
        prior = min(max((a.sum() + 1) / (n.sum() + 10), 1e-4), 0.5)
        p1 = np.clip((a @ x + 0.5) / (a.sum() + 1), 1e-4, 1 - 1e-4)
        p0 = np.clip((b @ x + 0.5) / (b.sum() + 10), 1e-5, 1 - 1e-4)
    # Correlations within the classes, weighted by their share, found last: with shared evidence alone the rates would not be determined.
    tied = np.zeros((VOTERS, VOTERS))
    for w, p in ((a, p1), (b, p0)):
        d = x - p
        cov = (d * w[:, None]).T @ d / max(w.sum(), 1)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        tied += w.sum() / n.sum() * np.abs(cov / np.outer(sd, sd))
    tied[tied < 0.1] = 0
    np.fill_diagonal(tied, 0)
    weight = 1 / (1 + tied.sum(1))
    return dict(zip(keys.tolist(), posterior().tolist()))


def fit_linear(rows: list[list[int]], target: np.ndarray, weights: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch adaptive gradient steps with an L2 penalty."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([f for x in rows for f in x], np.int64)
    weights = weights / weights.sum()
    w, offset = np.zeros(size), -2.0
    g2, b2 = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = offset + np.bincount(r, w[c], minlength=len(rows))
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weights
        g = np.bincount(c, miss[r], minlength=size) + 1e-4 * w
        g2 += g * g
        w -= 0.2 * g / np.sqrt(g2)
        gb = miss.sum()
        b2 += gb * gb
        offset -= 0.2 * gb / np.sqrt(b2)
    return w, float(offset)


def _fold(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1) -> Model:
    """Voters, label model and classifier from the rows outside the held-out fold.

    Lexicons come from all labelled rows and vote patterns from all rows
    outside the fold; the classifier is fitted on at most SAMPLE_ROWS labelled
    rows of each label. Labelled texts cross one exchange, packed.
    """
    model = Model()
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (_fold(id_col, folds) != held))
    known = known.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    known = known.withColumn("_part", (F.xxhash64(id_col).bitwiseAND(F.lit(0xFFFF)) % PARTS).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([squeeze(t.as_py() or "") for t in batch.column(text_col)], pa.binary())], [id_col, "data"])

    fit = docs.where(F.col(id_col).isNotNull() & (_fold(id_col, folds) != held)).select(id_col, text_col)
    rows = materialise(fit.mapInArrow(pack, f"`{id_col}` {kind}, data binary").join(known.hint("merge"), id_col), "toxicity-rows")  # at any size the same join
    share = {(r[0], r[1]): r[2] for r in rows.groupBy("_part", "_label").count().collect()}
    total = [sum(n for (_, y), n in share.items() if y == k) for k in (0, 1)]
    if not all(total):
        return model
    found = mine(rows, often_toxic(rows.where("_label = 1").coalesce(max(TASKS, total[1] // TASK_ROWS))), total).collect()  # what sets toxic rows apart, a matter of vocabulary and not of rows
    strong = credit(rows, {r.f: r.lean for r in found}) if found else {}
    if not strong:
        return model
    model.entries = sorted(strong)
    model.voters = [strong[e] << e[1] * PARTS for e in model.entries]
    model.weight = [0.0] * len(model.entries)
    # Of each label the ids of the smallest hashes, then their rows; a repeated id counts once. At most 2 * SAMPLE_ROWS narrow rows are broadcast.
    ids = rows.select(id_col, "_label").distinct()
    take = lambda y: ids.where(F.col("_label") == y).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(id_col)
    sample = rows.join(F.broadcast(take(0).unionByName(take(1))), id_col).groupBy(id_col).agg(F.min("_label").alias("y"), F.min("data").alias("data"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for batch in batches:
            found = []
            for data in batch.column("data"):
                text = expand(data.as_py())
                fired = model.words.features(text)
                found.append((model.votes(fired, text), sorted(fired)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("y"), pa.array([v for v, _ in found], pa.int32()), pa.array([f for _, f in found], pa.list_(pa.int32()))], [id_col, "y", "votes", "fs"])

    seen = sample.mapInArrow(look, f"`{id_col}` {kind}, y int, votes int, fs array<int>").toArrow().to_pylist()  # bounded like the sample
    seen.sort(key=lambda r: (r[id_col], r["fs"]))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        got: Counter = Counter()
        for batch in batches:
            got.update(model.votes(model.words.features(t), t) for t in (x.as_py() for x in batch.column(text_col)))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array(list(got.values()), pa.int64())], ["votes", "n"])

    pool = docs.where(_fold(id_col, folds) != held).select(text_col)
    votes = dict(tuple(r) for r in pool.mapInArrow(cast, "votes int, n long").groupBy("votes").agg(F.sum("n")).collect())  # 2**VOTERS rows at most
    y = np.array([r["y"] for r in seen], np.float64)
    cast_by = np.array([r["votes"] for r in seen], np.int64)
    ones = max(y.sum(), 1)
    weights = np.where(y > 0, total[1] / ones, total[0] / max(len(y) - ones, 1))
    posterior = label_model(votes, cast_by, y, weights)
    target = np.array([posterior.get(int(v), 0.5) for v in cast_by])  # a row that left the corpus may have votes of its own
    w, model.offset = fit_linear([r["fs"] for r in seen], target, weights, len(model.entries))
    model.weight = w.tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; a null text scores like an empty one."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for part in slices(batches, text_col):
            s = [model.score(t.as_py()) for t in part.column(text_col)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(s, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {key}, score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Null and empty texts get the score of the offset alone; repeated rows each
    give a row; without labels of both kinds every score is that of an
    untrained offset, below the threshold. Only id and text of the documents
    are read.
    """
    model = train(docs, labels, id_col, text_col, folds=folds, held=held)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, (_fold(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, sf_dir: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic."""
    model = train(docs, table(docs.sparkSession, sf_dir, "labels"), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.start()
        for part in slices(batches, text_col):
            yield part.filter(pa.array([model.score(t.as_py()) < THRESHOLD for t in part.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
