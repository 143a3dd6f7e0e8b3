"""Removal of repeated word windows with FM-indexes over content-defined shards.

A window's minimizer, the smallest hash of its four-word grams, decides its
shard, so equal windows meet in one shard wherever they stand, and each shard
is searched only with what can match there. Runs of windows whose minimizer
stands at one place are a segment. A shard's segments are indexed, and every
segment is streamed against the index: backward search over the wavelet matrix
gives at each word the matching statistic (up to the window) and the interval
of its occurrences; windows that reach the threshold and whose interval holds
an earlier occurrence are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pack_bytes, unpack_bytes
from .fmindex import FmIndex

GRAM = 4
#: Bytes of text hashed at a time; a longer text is cut inside, with a window's overlap.
PIECE = 512_000
#: Words of a piece of a longer text.
PIECE_WORDS = 50_000
#: Segments and keys that a shard or bucket holds on average; a segment begins at about every 40 bytes of text.
SEGMENTS, KEYS, SEGMENT_BYTES = 15_000, 400_000, 40
#: Keys, and bytes of distinct segments with what each takes beside its text, that a task holds before it sends them.
HELD_KEYS, HELD_BYTES, ENTRY = 500_000, 32_000_000, 400
#: A key that more segments than this have, a third of a shard, deals out its windows one by one.
HOT = 5_000
#: Windows that are streamed against an index at a time.
STREAMED = 200_000
#: Hot keys are sent to all tasks up to this number (eight bytes each), joined beyond it.
HOT_SENT = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def canonical(text: str | None) -> bytes:
    """The words of a text, joined by one space."""
    return _SPACES.sub(b" ", (text or "").encode()).strip(b" ")


def pieces(texts: Iterator[bytes], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of (places of texts, their first words, bytes) of about PIECE bytes, of canonical texts with a window.

    A text beyond PIECE is cut so that each window stands in one piece alone.
    """
    places, first, data, size = [], [], [], 0
    for k, text in enumerate(texts):
        if text.count(b" ") < window - 1:
            continue
        if size and size + len(text) > PIECE:
            yield places, first, data
            places, first, data, size = [], [], [], 0
        if len(text) > PIECE:
            gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            for a in range(0, len(gap) + 2 - window, PIECE_WORDS):
                begin = int(gap[a - 1]) + 1 if a else 0
                last = a + PIECE_WORDS + window - 2
                yield [k], [a], [text[begin : int(gap[last]) if last < len(gap) else len(text)]]
            continue
        places.append(k)
        first.append(0)
        data.append(text)
        size += len(text)
    if places:
        yield places, first, data


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """A mixed hash of each run of ``length`` values."""
    n = len(h) - length + 1
    out = h[:n].copy()
    for k in range(1, length):
        out *= _MIX
        out += h[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Stream:
    """The words of several canonical texts in a row: where they begin, their hashes, and what text they are of."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        gap = np.flatnonzero((raw == 32) | (raw == 10))
        self.begin = np.concatenate([[0], gap + 1])  # a word ends one before the next begins
        self.row = np.concatenate([[0], np.cumsum(raw[gap] == 10)])
        length = np.diff(np.append(self.begin, len(raw) + 1)) - 1
        # A word's hash: its bytes by powers of an odd number, by place in the word.
        place = np.arange(len(raw)) - np.repeat(self.begin, np.minimum(length + 1, len(raw) - self.begin))
        power = np.full(int(length.max()) + 1, _MIX)
        power[0] = 0x2545F4914F6CDD1D
        power = np.multiply.accumulate(power)
        value = (raw.astype(np.uint64) + np.uint64(1)) * power[place]
        value[gap] = 0
        h = np.add.reduceat(value, self.begin)
        h ^= h >> np.uint64(31)
        self.hash = h * np.uint64(0x94D049BB133111EB)

    def text(self, first: int, last: int) -> bytes:
        """Words from one to another, both included."""
        end = int(self.begin[last + 1]) - 1 if last + 1 < len(self.begin) else len(self.data)
        return self.data[int(self.begin[first]) : end]

    def segments(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, last window) of each run of windows whose minimizer stands at one place."""
        if len(self.hash) < window:
            e = np.empty(0, np.int64)
            return e.astype(np.uint64), e, e
        g = _rolled(self.hash, GRAM)
        span = window - GRAM + 1
        low, k = g, 1
        while k < span:
            step = min(k, span - k)
            low = np.minimum(low[: len(low) - step], low[step:])
            k += step
        # The leftmost minimizer moves on where the smallest value changes or where the window leaves it behind.
        fits = self.row[: len(low)] == self.row[window - 1 :]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (g[: len(low) - 1] == low[:-1]) | ~fits[:-1]])
        at = np.flatnonzero(new & fits)
        # A run ends before the next one, or before a window that would reach into the next text.
        ends = np.flatnonzero(np.append(new[1:] | ~fits[1:], True) & fits)
        return low[at], at, ends


def repeated_keys(docs: DataFrame, window: int, size: int, id_col: str, text_col: str, most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((id, key) of every document's segments whose key occurs elsewhere too, hot keys).

    A task sends each of its keys once, whatever the number of documents that
    have it; keys that two of its own segments have are known to repeat. So a
    key of a third of all documents costs a bucket one record a task. Buckets
    are as many as ``size``, the bytes of all texts, asks for.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"bucket int, data binary, `{id_col}` {kind}, key long, hot long"
    buckets = max(1, -(-size // (SEGMENT_BYTES * KEYS)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(id_array: pa.Array, flat: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            count = np.diff(np.concatenate([first, [len(flat)]]))
            many = np.repeat(count > 1, count)
            hot = np.zeros(len(flat), np.int64)  # the count, once for each key
            hot[first] = count * (count > 1)
            local = np.flatnonzero(many)
            k = len(local)
            if k:
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), id_array.take(pa.array(row[local])), pa.array(flat[local].view(np.int64)), pa.array(hot[local])], names)
            one, who, twice = flat[first], row[first], count > 1
            bucket = ((one >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cut[b] : cut[b + 1]]
                if len(own):
                    # The ids go along as numbers of rows, and as the ids of those rows.
                    used, local_row = np.unique(who[own], return_inverse=True)
                    sink = pa.BufferOutputStream()
                    table = pa.record_batch([pa.array(one[own].view(np.int64)), pa.array(local_row.astype(np.uint32)), pa.array(twice[own])], ["key", "row", "twice"])
                    idt = pa.record_batch([id_array.take(pa.array(used))], ["id"])
                    for t in (table, idt):
                        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                            w.write_batch(t)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, id_array.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

        names = ["bucket", "data", id_col, "key", "hot"]
        ids, keys, rows, n, base = [], [], [], 0, 0
        for batch in batches:
            column, id_array = batch.column(text_col), batch.column(id_col)
            for places, _, data in pieces((canonical(t.as_py()) for t in column), window):
                stream = Stream(data)
                key, first, _ = stream.segments(window)
                rows.append(stream.row[first] + base)
                ids.append(id_array.take(pa.array(places)))
                keys.append(key)
                n += len(key)
                base += len(places)
                if n > HELD_KEYS:
                    yield from out(pa.concat_arrays(ids), np.concatenate(keys), np.concatenate(rows))
                    ids, keys, rows, n, base = [], [], [], 0, 0
        if n:
            yield from out(pa.concat_arrays(ids), np.concatenate(keys), np.concatenate(rows))

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, ids, twice = [], [], []
        for blob in table.column("data"):
            source = pa.BufferReader(blob.as_buffer())
            a = pa.ipc.open_stream(source).read_all()
            b = pa.ipc.open_stream(source).read_all()
            keys.append(a.column("key").to_numpy())
            twice.append(a.column("twice").to_numpy())
            ids.append(b.column("id").combine_chunks().take(a.column("row").combine_chunks()))
        keys, twice, ids = np.concatenate(keys), np.concatenate(twice), pa.chunked_array(ids)
        order = np.argsort(keys, kind="stable")
        own = keys[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.concatenate([first, [len(own)]]))
        # A record that is alone repeats only inside its own task, and its segments are known there.
        found = order[np.repeat(count > 1, count)]
        found = found[~twice[found]]
        return pa.table({id_col: ids.take(pa.array(found)), "key": pa.array(keys[found])})

    met = materialise(docs.select(id_col, text_col).mapInArrow(spread, schema), "segment-keys")
    across = met.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(meet, f"`{id_col}` {kind}, key long")
    local = met.where("bucket is null")
    total = local.where("hot > 0").groupBy("key").agg(F.sum("hot").alias("n")).where(F.col("n") > most)
    return local.select(id_col, "key").unionByName(across), materialise(total.select("key"), "hot-keys")


def shard_repeats(blobs: list[pa.Buffer], window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, starts, ends) of the words that repeated windows cover, from a shard's packed segments.

    Segments of equal text (one a task at most, as tasks send each text once)
    are one pattern of the search and one entry of the index, that of the
    first place; each takes the answer for its own place.
    """
    table = pa.concat_tables([pa.ipc.open_stream(pa.BufferReader(b)).read_all() for b in blobs])
    table = table.sort_by([("id", "ascending"), ("first", "ascending")]).combine_chunks()
    first = table.column("first").to_numpy().astype(np.int64)
    code = table.column("text").combine_chunks().dictionary_encode()  # codes in the order of first places
    of = code.indices.to_numpy()
    words = pc.split_pattern(code.dictionary, " ")
    length = np.diff(words.offsets.to_numpy()).astype(np.int64)
    # The text of the index: words by number from 1 on, a 0 after each segment.
    number = words.values.dictionary_encode().indices.to_numpy().astype(np.int32) + np.int32(1)
    symbols = np.zeros(len(number) + len(length), np.int32)
    symbols[np.arange(len(number)) + np.repeat(np.arange(len(length)), length)] = number
    index = FmIndex(symbols, window)
    # Of each text's windows, whether the index has an earlier occurrence of it.
    begin = np.cumsum(length + 1) - (length + 1)
    windows = length - window + 1
    of_window = np.cumsum(windows) - windows
    earlier = np.empty(int(windows.sum()), bool)
    at = 0
    while at < len(length):  # streamed in parts of bounded size
        to = max(at + 1, int(np.searchsorted(of_window, of_window[at] + STREAMED)))
        n = windows[at:to]
        starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts += np.repeat(begin[at:to] - begin[at], n)
        last = int(begin[to]) if to < len(length) else len(symbols)
        reach, least = index.statistics(symbols[int(begin[at]) : last], starts)
        earlier[int(of_window[at]) : int(of_window[at]) + len(starts)] = (reach >= window) & (least < starts + begin[at])
        at = to
    # A text's first segment loses its windows that stand earlier; of the others, all do.
    again = np.ones(len(of), bool)
    _, keep = np.unique(of, return_index=True)
    again[keep] = False
    copy = np.flatnonzero(again)
    every = length[of]
    hit = np.flatnonzero(earlier)
    owner = np.repeat(np.arange(len(length)), windows)[hit]
    run = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner) != 0)])) if len(hit) else hit
    end = np.append(run[1:], len(hit))[: len(run)] - 1
    own = owner[run]
    shift = first[keep[own]] - of_window[own]
    rows = np.concatenate([copy, keep[own]])
    a = np.concatenate([first[copy], shift + hit[run]])
    b = np.concatenate([first[copy] + every[copy], shift + hit[end] + window])
    return table.column("id").combine_chunks().take(pa.array(rows)), a.astype(np.int32), b.astype(np.int32)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, most: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): what is left of every text without words in repeated windows.

    A window is repeated if its words also start earlier: in a row of a
    smaller id, or earlier in the same row. Null, empty and short texts have
    no window and keep all their words. Rows that share an id are taken as
    the same positions, so neither is earlier than the other, and each loses
    what any of them does. Rows without an id keep all their words and don't
    count as earlier. An empty table gives no rows;
    other columns are not read. ``with_text`` adds ``kept``, the words that
    stay, joined by one space.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    keys, hot = repeated_keys(docs, window, size, id_col, text_col, most)
    hot = hot.withColumn("hot", F.lit(True))
    hot = F.broadcast(hot) if hot.count() <= HOT_SENT else hot
    keys = materialise(keys.join(hot, "key", "left"), "repeated-keys")
    shards = max(1, -(-keys.count() // SEGMENTS))
    pack_keys = keys.groupBy(id_col).agg(F.collect_list(F.when(F.col("hot").isNull(), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([pack_bytes(canonical(t.as_py())) for t in batch.column(text_col)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), data], [id_col, "data"])

    packed = docs.select(id_col, text_col).mapInArrow(pack, f"`{id_col}` {kind}, data binary")
    schema = f"shard int, data binary, `{id_col}` {kind}, start int, end int"
    names = ["shard", "data", id_col, "start", "end"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple] = {}  # text of a segment to its first place here
        place: dict[bytes, int] = {}
        again: dict[object, list[list[int]]] = {}  # id to ranges of words that stand earlier

        def late(i, a: int, b: int) -> None:
            ranges = again.setdefault(i, [])
            if ranges and ranges[-1][0] <= a <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], b)
            else:
                ranges.append([a, b])

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(i, a, b) for i, ranges in again.items() for a, b in ranges]
            if rows:
                ids, starts, ends = zip(*rows)
                k = len(rows)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(ids, id_type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names)
            by: dict[int, list[bytes]] = {}
            for t, x in place.items():
                by.setdefault(x, []).append(t)
            for x, ts in by.items():
                sink = pa.BufferOutputStream()
                t = pa.record_batch([pa.array([best[y][0] for y in ts], id_type), pa.array([best[y][1] for y in ts], pa.int32()), pa.array(ts, pa.binary())], ["id", "first", "text"])
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(t)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, id_type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())], names)

        id_type, held = pa.int64(), 0
        for batch in batches:
            id_type, ids = batch.column(id_col).type, batch.column(id_col)
            every_key, every_hot = batch.column("keys"), batch.column("hot")
            for places, origin, texts in pieces((unpack_bytes(x.as_buffer()) for x in batch.column("data")), window):
                stream = Stream(texts)
                key, first, last = stream.segments(window)
                mine, at = pa.array(places), np.array(origin)
                of = lambda c: c.take(mine).flatten().to_numpy().view(np.uint64)
                # A key that is known to repeat does so in every document that has it.
                known, dealt = np.isin(key, of(every_key)), np.isin(key, of(every_hot))
                base = np.searchsorted(stream.row, np.arange(len(texts))) - at  # from words of the stream to those of the text
                runs = [(key[known], first[known], last[known])]
                if dealt.any():
                    n = (last - first + 1)[dealt]
                    each = np.repeat(first[dealt], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    runs.append((_rolled(stream.hash, window)[each], each, each))
                x, a, b = (np.concatenate(c) for c in zip(*runs))
                row = stream.row[a]
                to = ((x >> np.uint64(7)) % np.uint64(shards)).tolist()
                begin = stream.begin[a].tolist()
                end = np.append(stream.begin, len(stream.data) + 1)[b + window].tolist()
                start, data = (a - base[row]).tolist(), stream.data
                size, who = (b - a + window).tolist(), ids.take(mine).take(pa.array(row)).to_pylist()
                for p, q, i, w, n, shard in zip(begin, end, who, start, size, to):
                    t = data[p : q - 1]
                    old = best.get(t)
                    if old is None:
                        best[t] = (i, w)
                        place[t] = shard
                        held += q - p + ENTRY
                    elif old < (i, w):
                        late(i, w, w + n)
                        held += ENTRY // 4
                    elif old != (i, w):  # else a row of the same id
                        best[t] = (i, w)
                        late(old[0], old[1], old[1] + n)
                        held += ENTRY // 4
                if held > HELD_BYTES:
                    yield from out()
                    best, place, again, held = {}, {}, {}, 0
        yield from out()

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, starts, ends = shard_repeats([b.as_buffer() for b in table.column("data")], window)
        return pa.table({id_col: ids, "start": pa.array(starts), "end": pa.array(ends)})

    chosen = packed.join(pack_keys, id_col)
    parts = materialise(chosen.mapInArrow(cut, schema), "segments")
    local = parts.where("shard is null").select(id_col, "start", "end")
    across = parts.where("shard is not null").select("shard", "data").groupBy("shard").applyInArrow(search, f"`{id_col}` {kind}, start int, end int")
    gone = local.unionByName(across).groupBy(id_col).agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    result = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha, kept = [], [], [], []
            ranges = batch.column("gone")
            first, last = (ranges.values.field(k).to_numpy() for k in (0, 1))
            offsets, has = ranges.offsets.to_pylist(), ranges.is_valid().to_pylist()
            for k, data in enumerate(batch.column("data")):
                text = unpack_bytes(data.as_buffer())
                n.append(text.count(b" ") + 1 if text else 0)
                removed.append(0)
                if has[k]:
                    gap = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    begin, stop = np.append(0, gap + 1), np.append(gap, len(text))
                    parts, at = [], 0
                    for a, b in sorted(zip(first[offsets[k] : offsets[k + 1]].tolist(), last[offsets[k] : offsets[k + 1]].tolist())):
                        if a > at:
                            parts.append(text[int(begin[at]) : int(stop[a - 1])])
                        if b > at:
                            removed[-1] += b - max(a, at)
                            at = b
                    if at < n[-1]:
                        parts.append(text[int(begin[at]) :])
                    text = b" ".join(parts)
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            columns = [batch.column(id_col), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    return packed.join(materialise(gone, "repeats"), id_col, "left").mapInArrow(finish, result)
