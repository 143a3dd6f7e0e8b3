"""Removal of repeated byte strings with suffix arrays over content-defined shards.

A window is ``width`` bytes of one text. Its key is the smallest hash of its
grams, so equal windows have one key wherever they stand. Runs of windows of
one key are segments; only those whose key stands at two places or more can repeat. Equal
segments are one entry with a count. The shard of a key sorts its entries' suffixes by
induction, takes the common prefixes of neighbours, and reports the windows
whose interval of suffixes (common prefixes of ``width`` or more) counts two
or more places. Every removed byte comes from such an interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pack_bytes, unpack_bytes
from .sais import permuted_prefixes, suffix_array

#: Bytes of a gram. A window's key is the smallest hash of one of its grams.
GRAM = 48
#: Bytes hashed at a time; longer texts are cut inside, with a window's overlap.
PIECE = 400_000
#: Windows that a segment has at most: one symbol over and over gives equal segments, not ever longer ones.
RUN = 4_096
#: Bytes of a shard's entries on average, and of a key's entries from which on its windows are dealt out to many shards.
SHARD, HOT = 1_000_000, 1_000_000
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def rolled(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, 64 bits, by doubling."""
    power, have, part = 1, None, _TABLE[data]
    got = 0
    mult = _BASE  # base ** power
    while True:
        if k & power:
            have = part if have is None else have[: len(part) - got] * np.uint64(mult) + part[got:]
            have, got = have[: len(data) - (got + power) + 1], got + power
        power *= 2
        if power > k:
            break
        half = power // 2
        part = part[: len(part) - half] * np.uint64(mult) + part[half:]
        mult = mult * mult % 2**64
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of w neighbours from each place on."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def stretches(texts: list[bytes], width: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts' parts of about PIECE bytes: (their texts' places, where they begin in them, where each begins in the group, the group's bytes). Each window stands in one part."""
    place, at, begin, size, parts = [], [], [], 0, []
    for k, text in enumerate(texts):
        for i in range(0, max(0, len(text) - width + 1), PIECE):
            part = text[i : i + PIECE + width - 1]
            place.append(k), at.append(i), begin.append(size), parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield place, np.array(at), np.array([*begin, size]), np.frombuffer(b"".join(parts), np.uint8)
                place, at, begin, size, parts = [], [], [], 0, []
    if parts:
        yield place, np.array(at), np.array([*begin, size]), np.frombuffer(b"".join(parts), np.uint8)


def segments(data: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, part, places of the key's gram, 2 standing for more) of the runs of windows of one key."""
    gram = min(GRAM, width)
    w = width - gram + 1
    h = mixed(rolled(data, gram))
    key = smallest(h, w)
    part = np.searchsorted(begin, np.arange(len(key)), "right") - 1
    fits = np.arange(len(key)) + width <= begin[part + 1]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | ~fits[:-1]
    a = np.flatnonzero(new & fits)
    stop = np.append(np.flatnonzero(new | ~fits), len(key))
    b = stop[np.searchsorted(stop, a, "right")] - 1
    long = b - a >= RUN
    if long.any():
        n = (b - a) // RUN + 1
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a0, b0 = np.repeat(a, n), np.repeat(b, n)
        a = a0 + each * RUN
        b = np.minimum(a + RUN - 1, b0)
    places = np.ones(len(a), np.int64)
    for i in range(0, len(a), 512):
        first = h[a[i : i + 512, None] + np.arange(w)].argmin(1) + a[i : i + 512]
        last = b[i : i + 512] + w - 1 - h[b[i : i + 512, None] + np.arange(w)[::-1]].argmin(1)
        places[i : i + 512] += last > first
    return key[a].view(np.int64), a, b, part[a], places


def repeated(entries: list[bytes], counts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each entry the ranges of bytes under windows that stand at two places or more, as rows (begin, end), by the suffix array of all entries."""
    sizes = np.array([len(e) for e in entries])
    raw = np.frombuffer(b"\x00".join(entries) + b"\x00", np.uint8).astype(np.int32) + 2
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = 1
    t = np.append(raw, 0).astype(np.int32)
    sa = suffix_array(t, 258)
    common = permuted_prefixes(t, sa)[sa]
    owner = np.minimum(np.searchsorted(ends, sa), len(entries) - 1)
    whole = (sa + width <= ends[owner]) & (sa < len(t) - 1)  # a window of one entry
    group = np.flatnonzero(np.append(True, common[1:] < width))
    total = np.add.reduceat(np.where(whole, counts[owner], 0), group)
    hit = np.repeat(total >= 2, np.diff(np.append(group, len(sa)))) & whole
    starts = np.sort(sa[hit]).astype(np.int64)
    who = np.searchsorted(ends, starts)
    new = np.append(True, (who[1:] != who[:-1]) | (starts[1:] > starts[:-1] + width)) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    base = (ends - sizes)[who[first]] if len(first) else first
    ranges = np.stack([starts[first] - base, starts[last] - base + width], 1) if len(first) else np.zeros((0, 2), np.int64)
    cut = np.searchsorted(who[first], np.arange(len(entries) + 1)) if len(first) else np.zeros(len(entries) + 1, int)
    return [ranges[cut[k] : cut[k + 1]] for k in range(len(entries))]


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): what is left of every text without the bytes of repeated strings of ``width`` bytes.

    A string is repeated if it also starts anywhere else, in another row or
    the same, overlaps included; strings don't reach across rows. So equal
    rows lose all their bytes if they have ``width``, rows that share an id or have none
    are rows like others. Null, empty and short texts keep all. An empty
    table gives no rows; other columns are not read. ``with_text`` adds
    ``kept``, the remaining bytes (their cut may fall inside a character).
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t.as_py() or "").encode() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(t) for t in data], pa.int64()), pa.array([pack_bytes(t) for t in data], pa.binary())], [id_col, "row", "size", "data"])

    numbered = docs.select(id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    packed = materialise(numbered.mapInArrow(pack, f"`{id_col}` {kind}, row long, size long, data binary"), "packed")
    windows = packed.where(F.col("size") >= width)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column("row"))
            texts = [unpack_bytes(x.as_buffer()) for x in batch.column("data")]
            for place, _, begin, data in stretches(texts, width):
                key, _, _, part, places = segments(data, begin, width)
                yield pa.RecordBatch.from_arrays([pa.array(rows[np.array(place)[part]]), pa.array(key), pa.array(places)], ["row", "key", "places"])

    found = materialise(windows.select("row", "data").mapInArrow(keys, "row long, key long, places long"), "keys")
    again = found.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key")
    wanted = found.select("row", "key").join(again, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of repeated keys: where they stand (row, start) and, once a batch, their bytes with the number of places."""
        for batch in batches:
            rows, sets = np.array(batch.column("row")), batch.column("keys")
            texts = [unpack_bytes(x.as_buffer()) for x in batch.column("data")]
            entries: dict[tuple[int, bytes], list] = {}
            stand: list[tuple[int, int, int, bytes]] = []
            for place, at, begin, data in stretches(texts, width):
                key, a, b, part, _ = segments(data, begin, width)
                named = sets.take(pa.array(place)).flatten().to_numpy()
                take = np.isin(key, named)
                raw = data.tobytes()
                start = a - begin[part] + at[part]
                for x, p, q, row, s in zip(key[take].tolist(), a[take].tolist(), b[take].tolist(), rows[np.array(place)[part[take]]].tolist(), start[take].tolist()):
                    own = raw[p : q + width]
                    mark = digest(own)
                    old = entries.get((x, mark))
                    if old is None:
                        entries[x, mark] = [own, 1]
                    else:
                        old[1] += 1
                    stand.append((row, s, x, mark))
            n, m = len(stand), len(entries)
            if n:
                row, s, x, mark = zip(*stand)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.int64()), pa.array(mark, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([k[0] for k in entries], pa.int64()), pa.array([k[1] for k in entries], pa.binary()), pa.array([e[0] for e in entries.values()], pa.binary()), pa.array([e[1] for e in entries.values()], pa.int64())], names)

    names = ["row", "start", "key", "mark", "own", "n"]
    parts = materialise(windows.select("row", "data").join(wanted, "row").mapInArrow(cut, "row long, start long, key long, mark binary, own binary, n long"), "segments")
    entries = materialise(parts.where("own is not null").groupBy("key", "mark").agg(F.first("own").alias("own"), F.sum("n").alias("n")), "entries")
    weights = entries.groupBy("key").agg(F.sum(F.length("own")).alias("bytes"))
    hot = materialise(weights.where(F.col("bytes") > HOT).select("key"), "hot-keys")
    plain = entries.join(hot, "key", "left_anti").select("key", "mark", "own", "n")
    ranges = sorted_ranges(plain, width)
    if not hot.isEmpty():
        ranges = ranges.unionByName(dealt_ranges(entries.join(hot, "key"), width))
    ranges = materialise(ranges, "ranges")
    stand = parts.where("own is null").select("row", "start", "mark")
    gone = shifted(stand.join(ranges, "mark"), "row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, sha, kept = [], [], [], [], []
            for data, ranges in zip(batch.column("data"), batch.column("gone")):
                text, parts, at, n = unpack_bytes(data.as_buffer()), [], 0, 0
                own = sorted((r["begin"], r["end"]) for r in ranges.as_py() or [])
                size.append(len(text))
                joined: list[list[int]] = []
                for a, b in own:
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                for a, b in joined:
                    parts.append(text[at:a])
                    at, n = b, n + b - a
                text = b"".join([*parts, text[at:]])
                removed.append(n), spans.append(len(joined)), sha.append(hashlib.sha256(text).hexdigest()), kept.append(text)
            columns = [batch.column(id_col), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    result = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return packed.select("row", id_col, "data").join(materialise(gone, "gone"), "row", "left").drop("row").mapInArrow(finish, result)


def sorted_ranges(entries: DataFrame, width: int) -> DataFrame:
    """(mark, ranges of repeated bytes) of entries (key, mark, own, n), shard by shard; equal windows must share their key."""
    total = entries.agg(F.sum(F.length("own"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))

    def sort(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own = [x.as_py() for x in rows.column("own")]
        found = repeated(own, np.array(rows.column("n")), width)
        at = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        both = np.concatenate(found)
        ranges = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64))], ["begin", "end"]))
        return pa.table({"mark": rows.column("mark"), "ranges": ranges})

    out = entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).select("shard", "mark", "own", "n").groupBy("shard").applyInArrow(sort, "mark binary, ranges array<struct<begin: long, end: long>>")
    return out.where(F.size("ranges") > 0)


def bands(own: bytes, ranges: list[tuple[int, int]], span: int, width: int) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of the windows of some ranges of an entry, by where their gram stands in them, ``span`` places a band.

    The key is a hash of the bytes that all windows of a band have, and of the
    band's number, so equal windows have equal keys, and windows that differ where the band says so don't.
    """
    data = np.frombuffer(own, np.uint8)
    h = mixed(rolled(data, min(GRAM, width)))
    at = np.flatnonzero(h == h.min())
    core = rolled(data, width + 1 - span)
    s = np.concatenate([np.arange(a, b + 1) for a, b in ranges])
    p = at[np.searchsorted(at, s)]
    band = (p - s) // span
    new = np.flatnonzero(np.append(True, (np.diff(s) != 1) | (np.diff(p) != 0) | (np.diff(band) != 0)))
    last = np.append(new[1:], len(s)) - 1
    key = mixed(core[p[new] - band[new] * span] + band[new].astype(np.uint64) * np.uint64(_BASE)).view(np.int64)
    return zip(key.tolist(), s[new].tolist(), s[last].tolist())


def dealt_ranges(entries: DataFrame, width: int) -> DataFrame:
    """The same for keys of many bytes, whose windows are dealt out by more than their smallest gram.

    In rounds of ever narrower bands, windows of a band that stands at one
    place go; what is left of keys that are small enough is sorted, the others go on to
    the next round. In the last one a band is a single window, and equal windows are one entry. So a round makes
    a few rows of an entry, whatever a key's entries.
    """
    rest = entries.select("mark", "own", "n", F.array(F.struct(F.lit(0).alias("a"), (F.length("own") - width).alias("b"))).alias("ranges"))
    found = []
    for span in (64, 8, 1):
        span = min(span, width - min(GRAM, width) + 1)

        def deal(batches: Iterator[pa.RecordBatch], span: int = span) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(mark, digest(own[a : b + width]), n, key, a, b) for mark, own, n, ranges in zip(*(batch.column(c).to_pylist() for c in ("mark", "own", "n", "ranges"))) for key, a, b in bands(own, [(r["a"], r["b"]) for r in ranges], span, width)]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns[:2]), *(pa.array(c, pa.int64()) for c in columns[2:4]), *(pa.array(c, pa.int32()) for c in columns[4:])], ["parent", "unit", "n", "key", "a", "b"])

        dealt = materialise(rest.mapInArrow(deal, "parent binary, unit binary, n long, key long, a int, b int"), "bands")
        # Equal texts of a band are one entry, so they weigh as one.
        units = dealt.groupBy("key", "unit").agg(F.sum("n").alias("n"), F.max(F.col("b") - F.col("a") + width).alias("bytes"))
        weights = units.groupBy("key").agg(F.sum("n").alias("places"), F.sum("bytes").alias("bytes")).where("places > 1")
        left = materialise(dealt.drop("n", "unit").join(weights.select("key", (F.col("bytes") > (HOT if span > 1 else 1 << 62)).alias("hot")), "key"), "left")
        found.append(left.where("not hot").drop("hot"))
        on = left.where("hot").groupBy("parent").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
        rest = entries.select("mark", "own", "n").join(on, F.col("mark") == F.col("parent")).drop("parent")
        if span == 1 or rest.isEmpty():
            break
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    of_entry = places.groupBy("parent").agg(F.collect_list(F.struct("key", "a", "b")).alias("bands"))

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As in ``cut``: where the bands' texts stand in entries, and once a batch the texts with the number of places."""
        for batch in batches:
            texts: dict[tuple[int, bytes], list] = {}
            stand: list[tuple[bytes, int, bytes]] = []
            for mark, own, n, many in zip(*(batch.column(c).to_pylist() for c in ("mark", "own", "n", "bands"))):
                for band in many:
                    text = own[band["a"] : band["b"] + width]
                    unit = digest(text)
                    texts.setdefault((band["key"], unit), [text, 0])[1] += n
                    stand.append((mark, band["a"], unit))
            k, m = len(stand), len(texts)
            if k:
                parent, start, unit = zip(*stand)
                yield pa.RecordBatch.from_arrays([pa.array(parent, pa.binary()), pa.array(start, pa.int64()), pa.array(unit, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.array([t[1] for t in texts], pa.binary()), pa.array([t[0] for t in texts], pa.int64()), pa.array([v[0] for v in texts.values()], pa.binary()), pa.array([v[1] for v in texts.values()], pa.int64())], names)

    names = ["parent", "start", "mark", "key", "own", "n"]
    parts = materialise(entries.select("mark", "own", "n").join(of_entry, F.col("mark") == F.col("parent")).drop("parent").mapInArrow(carve, "parent binary, start long, mark binary, key long, own binary, n long"), "band-texts")
    units = parts.where("own is not null").groupBy("key", "mark").agg(F.first("own").alias("own"), F.sum("n").alias("n"))
    hits = sorted_ranges(materialise(units, "band-units"), width)
    return shifted(parts.where("own is null").select("parent", "start", "mark").join(hits, "mark"), "parent").select(F.col("parent").alias("mark"), F.col("gone").alias("ranges"))


def shifted(hits: DataFrame, by: str) -> DataFrame:
    """(by, gone): the ranges of each hit, from where it stands, of one row or entry."""
    moved = F.transform("ranges", lambda r: F.struct((r["begin"] + F.col("start")).alias("begin"), (r["end"] + F.col("start")).alias("end")))
    return hits.select(by, moved.alias("r")).groupBy(by).agg(F.flatten(F.collect_list("r")).alias("gone"))
