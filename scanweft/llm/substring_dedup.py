"""Substring dedup by FM-indexes (operator 4): removes every word in a window of words that starts elsewhere too.

1. Scan: in every window the 8-word gram of the least hash, the leftmost if tied, is its anchor. Equal
   windows have equal anchors at equal places. The windows around one anchor are a segment; equal segments
   of a step's texts are one row of hashes and places, which is stored.
2. Anchors are counted with partial sums; segments whose anchor stands nowhere else hold no repeated window
   and go in a join, which Spark splits where one anchor has very many rows.
3. Equal segments are one with a number of times. Their words are fetched, once for each distinct segment.
4. Segments are dealt by anchor into shards sized for memory, so all occurrences of a window are in one
   shard. Each shard is an FM-index; every segment is streamed against it backward, and windows whose
   interval holds two occurrences or more are reported.
5. An anchor of more than HOT distinct segments (the rim of a passage in very many documents) is no one
   shard's work: its segments are cut into single windows, those that stand nowhere else go by counts of their
   hashes, and the distinct rest are segments of their own, fetched, dealt by anchor and window, and searched alike.
6. Reported windows go back to the steps of the scan that hold the segment, a row each, and from there to their
   documents, a row each; a last scan drops the words.

Words are compared by 64-bit hashes within a shard; segments by 128 bits (anchor and content); texts of rows with
one id, or without an id, are told apart by 128 bits.

Defined results: null, empty and blank texts have no words; texts shorter than a window keep all; very long texts
are scanned in stretches, whole; rows that repeat an id are documents of their own, and rows equal in id and text
too (they remove each other's words like any repeats, and are worked on once); null ids stay; an empty table gives
no rows; other columns, of whatever name, are ignored (kept by `deduplicated`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweft.llm.fm_index import FMIndex
from scanweft.llm.shared import arrow_rows, bound_batches, buffer_of, column, gram_hash, grouped, mix, plain, span_hash, steps, stored, trim, words_of

WINDOW, GRAM = 35, 8
#: Distinct segments of an anchor beyond which its windows are segments of their own.
HOT = 5000
#: Words in the FM-index of a shard, about: it takes some 120 bytes each while it is built.
SHARD_WORDS = 1_000_000
#: Windows of a document that are looked at in one go.
STRETCH = 1 << 23
#: Reported segments up to which they are broadcast (24 bytes each, some 100 in memory); more are joined by shuffle.
BROADCAST_REPORTED = 200_000


class Segments(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # first window, as a word of the buffer
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of keys[i : i + span] for every i."""
    size, out = 1, keys
    while 2 * size <= span:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(keys) - span + 1], out[span - size :][: len(keys) - span + 1])


def segments_of(words: np.ndarray, row: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Segments:
    """The segments of all texts of a buffer of word hashes. Each has at most window - gram + 1 windows."""
    span = window - gram + 1
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]
    for first in range(0, max(0, len(words) - window + 1), STRETCH):
        part = words[first : first + STRETCH + window - 1]
        own = row[first : first + STRETCH + window - 1]
        grams = gram_hash(part, gram)
        # the hash decides, then the place: the leftmost
        best = _least((grams & ~np.uint64(STRETCH * 2 - 1)) | np.arange(len(grams), dtype=np.uint64), span)
        at = (best & np.uint64(STRETCH * 2 - 1)).astype(np.int64)
        inside = own[window - 1 :] == own[: len(own) - window + 1]
        begin = np.ones(len(at), bool)
        begin[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(begin)
        count = np.diff(np.append(start, len(at)))
        real = inside[start]
        start, count = start[real], count[real]
        # grams end to end, the last one moved back to the segment's end, hold all of its words
        ends, most = start + count + window - 1 - gram, int(count.max(initial=1)) + window - 1
        tiles = np.stack([grams[np.minimum(start + j, ends)] for j in range(0, most, gram)])
        sums = sum(mix(t + np.uint64(j)) for j, t in enumerate(tiles))
        found.append([own[start], start + first, count, grams[at[start]].view(np.int64), mix(sums + count.astype(np.uint64)).view(np.int64)])
    return Segments(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, row and hash of every word."""
    raw, offsets = buffer_of(texts)
    starts, ends, row = words_of(raw, offsets)
    return raw, starts, ends, row, span_hash(raw, starts, ends)


#: How a document is told from others: by its id and 128 bits of its text. Rows equal in both are alike in every result.
KEY = ["id", "k1", "k2"]
_PLACE = {"id": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "start": pa.int32()}
PLACE = "id:long,k1:long,k2:long,start:int"
_FOUND = {"step": pa.int64(), "anchor": pa.int64(), "content": pa.int64(), "windows": pa.int32(), "times": pa.int64(), "at": pa.list_(pa.struct(list(_PLACE.items())))}
FOUND = f"step long, anchor long, content long, windows int, times long, at array<struct<{PLACE}>>"
_CUT = {"anchor": pa.int64(), "content": pa.int64(), "times": pa.int64(), "words": pa.binary()}
CUT = "anchor long, content long, times long, words binary"
_RIM = {"anchor": pa.int64(), "content": pa.int64(), "times": pa.int64(), "j": pa.int32(), "hash": pa.int64(), **_PLACE}
RIM = f"anchor long, content long, times long, j int, hash long, {PLACE.replace(':', ' ').replace(',', ', ')}"
_REPORTED = {"anchor": pa.int64(), "content": pa.int64(), "bits": pa.int64()}
REPORTED = "anchor long, content long, bits long"


def _named(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return [F.coalesce(column(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text")]


def _alike(step: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows of one key as one, and how many each stands for."""
    keys = np.column_stack([step.column(k).to_numpy() for k in range(3)])
    _, first, times = np.unique(keys, axis=0, return_index=True, return_counts=True)
    if len(first) == step.num_rows:
        return step, np.ones(step.num_rows, np.int64)
    order = np.argsort(first)
    return step.take(pa.array(first[order])), times[order]


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, whole in enumerate(steps(batches)):
            step, copies = _alike(whole)
            _, _, _, row, hashes = _words(step.column(3))
            s = segments_of(hashes, row, window, gram)
            if not len(s.row):
                continue
            first = np.searchsorted(row, np.arange(step.num_rows))
            # equal segments of the step's texts are one row with all their places
            order = np.lexsort((s.content, s.anchor))
            anchor, content = s.anchor[order], s.content[order]
            head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
            own = pa.array(s.row[order])
            places = pa.StructArray.from_arrays([*(step.column(k).take(own) for k in range(3)), pa.array((s.start - first[s.row])[order], pa.int32())], names=list(_PLACE))
            at = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), places)
            yield arrow_rows({"step": np.full(len(head), part << 32 | number), "anchor": anchor[head], "content": content[head], "windows": s.windows[order][head], "times": np.add.reduceat(copies[s.row[order]], head), "at": at}, _FOUND)

    return run


def _segments_at(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that hold the wanted segments, each with those it is to give."""
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", "anchor", "content", "times")).alias("segments"))  # at most those of one document
    return base.join(lists, KEY).select(*KEY, "text", "segments")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of texts with segments: bytes, word starts and ends, hashes, row and first word of each segment, and its own columns."""
    met: set[tuple] = set()
    for step in steps(batches):
        key = list(zip(*(step.column(k).to_pylist() for k in range(3)), strict=True))
        new = []
        for k in key:  # of rows alike, a task's first gives the segments
            new.append(k not in met)
            met.add(k)
        step = step.filter(pa.array(new))
        raw, starts, ends, row, hashes = _words(step.column(3))
        lists = step.column(4)
        owner = np.repeat(np.arange(step.num_rows), np.diff(lists.offsets.to_numpy()))
        start, windows, anchor, content, times = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
        yield step, raw, starts, ends, hashes, owner, np.searchsorted(row, np.arange(step.num_rows))[owner] + start, start, windows, anchor, content, times


def _cut(window: int):
    """A row of words for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, starts, ends, _, _, first, _, windows, anchor, content, times in _places(batches):
            a, b = starts[first].tolist(), ends[first + windows + window - 2].tolist()
            held = memoryview(raw)
            yield arrow_rows({"anchor": anchor, "content": content, "times": times, "words": [bytes(held[x:y]) for x, y in zip(a, b, strict=True)]}, _CUT)

    return run


def _rims(window: int):
    """A row for each window of each segment: its hash and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _, _, _, hashes, owner, first, start, windows, anchor, content, times in _places(batches):
            n = windows.astype(np.int64)
            at = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            own = pa.array(owner[at])
            yield arrow_rows({"anchor": anchor[at], "content": content[at], "times": times[at], "j": j, "hash": gram_hash(hashes, window)[first[at] + j].view(np.int64), **{k: step.column(i).take(own) for i, k in enumerate(KEY)}, "start": start[at] + j}, _RIM)

    return run


def _search(window: int):
    """A shard: the bits of the windows with two occurrences or more, for each segment that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        names = np.column_stack([shard.column(k).to_numpy() for k in ("anchor", "content")])
        _, once = np.unique(names, axis=0, return_index=True)  # several tasks may give one segment
        if len(once) < len(names):
            shard, names = shard.take(pa.array(once)).combine_chunks(), names[once]
        _, _, _, row, hashes = _words(shard.column("words"))
        index = FMIndex(hashes, np.bincount(row, minlength=shard.num_rows), shard.column("times").to_numpy(), window)
        counts, first = index.window_counts()
        j = np.arange(len(counts)) - np.repeat(first, np.diff(np.append(first, len(counts))))
        bits = np.add.reduceat((counts > 1).astype(np.int64) << j, first)
        some = np.flatnonzero(bits)
        yield arrow_rows({"anchor": names[some, 0], "content": names[some, 1], "bits": bits[some]}, _REPORTED)
        del index, hashes, row, shard
        trim()

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a step's reported segments with all their places: a row for each document, its places in order."""
    for batch in batches:
        found = batch.column(0).flatten()
        step = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy())
        many = found.field(1).value_lengths().to_numpy()
        step, bits = np.repeat(step, many), np.repeat(found.field(0).to_numpy(), many)
        id_, k1, k2, start = (found.field(1).flatten().field(i).to_numpy() for i in range(4))
        order = np.lexsort((start, id_, k2, k1, step))
        step, bits, id_, k1, k2, start = (x[order] for x in (step, bits, id_, k1, k2, start))
        if not len(order):
            continue
        same = (step[1:] == step[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (id_[1:] == id_[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        places = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(bits)], names=["start", "bits"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), places)
        yield pa.RecordBatch.from_arrays([pa.array(x[head]) for x in (id_, k1, k2)] + [lists], names=[*KEY, "places"])


def _searched(base: DataFrame, wanted: DataFrame, deal: list[str], window: int) -> DataFrame:
    """The wanted segments (anchor, content, windows, times, key and start of one place), dealt into shards and searched."""
    total = wanted.agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    shards = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // SHARD_WORDS))
    return _segments_at(base, wanted).mapInArrow(_cut(window), CUT).repartition(shards, *deal).mapInArrow(_search(window), REPORTED)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with repeated windows: its KEY and the places (start, bits of the windows from it)."""
    bound_batches(docs.sparkSession)
    base = docs.select(*_named(id_col, text_col))
    segments = stored(base.mapInArrow(_scan(window, gram), FOUND), "segments")
    again = grouped(segments, "anchor", F.sum("times").alias("n")).where("n > 1").select("anchor")
    live = stored(segments.join(again, "anchor", "left_semi"), "live-segments")
    distinct = live.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.min(F.get("at", F.lit(0))).alias("at"), F.max("windows").alias("windows"))
    distinct = stored(distinct.select("anchor", "content", "times", "at.*", "windows"), "distinct-segments")
    hot = stored(distinct.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot-anchors")
    reported = _searched(base, distinct.join(hot, "anchor", "left_anti"), ["anchor"], window)
    if hot.take(1):
        rims = stored(_segments_at(base, distinct.join(hot, "anchor", "left_semi")).mapInArrow(_rims(window), RIM), "rims")
        twice = rims.groupBy("anchor", "hash").agg(F.sum("times").alias("times"), F.min(F.struct(*_PLACE)).alias("at")).where("times > 1")
        twice = stored(twice.select("anchor", F.col("hash").alias("content"), "times", "at.*", F.lit(1).alias("windows")), "rim-windows")
        sure = _searched(base, twice, ["anchor", "content"], window).select("anchor", F.col("content").alias("hash"))
        reported = reported.union(rims.join(sure, ["anchor", "hash"]).groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("bits")))
    reported = stored(reported, "reported")
    few = reported.count() <= BROADCAST_REPORTED
    back = live.join(F.broadcast(reported) if few else reported, ["anchor", "content"])
    steps_of = back.groupBy("step").agg(F.collect_list(F.struct("bits", "at")).alias("found")).select("found")  # at most those of one step
    own = steps_of.mapInArrow(_by_document, "id long, k1 long, k2 long, places array<struct<start:int,bits:long>>")
    # rows alike of several steps have equal lists, each whole and in order of places: any of them will do
    return stored(own.groupBy(*KEY).agg(F.any_value("places").alias("places")), "repeats")


def _kept(step: pa.RecordBatch, text_at: int, places_at: int, window: int) -> tuple:
    """Bytes, word starts and ends, row, and whether each word is kept."""
    raw, starts, ends, row, _ = _words(step.column(text_at))
    lists = step.column(places_at)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    first = np.searchsorted(row, np.arange(step.num_rows))
    known = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.take(pa.array(known))
    flat = lists.flatten()
    owner = np.repeat(known, np.diff(lists.offsets.to_numpy()))
    start, bits = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
    depth = np.zeros(len(starts) + 1, np.int64)
    for j in range(int(bits.max()).bit_length() if len(bits) else 0):
        at = (first[owner] + start)[(bits >> j) & 1 == 1] + j
        np.add.at(depth, at, 1)
        np.add.at(depth, at + window, -1)
    return raw, starts, ends, row, np.cumsum(depth[:-1]) == 0


def _joined(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """docs with the places of each row as a last column. The names of docs' columns differ from all here."""
    own = [f"own_{k}" for k in KEY]
    marked = repeats(docs, window, gram, id_col, text_col)
    keyed = docs.select("*", *(c.alias(o) for c, o in zip(_named(id_col, text_col), own, strict=False)))
    return keyed.join(marked, [F.col(o) == F.col(k) for o, k in zip(own, KEY, strict=True)], "left").select(*docs.columns, "places")


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the checksum of the kept words joined by spaces."""
    own = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            raw, starts, ends, row, keep = _kept(step, 1, 2, window)
            n, sha = np.bincount(row, minlength=step.num_rows), []
            for text in _texts(raw, starts, ends, row, keep, step.num_rows):
                sha.append(hashlib.sha256(text).hexdigest())
            yield arrow_rows({"doc_id": step.column(0), "n_words": n, "n_removed": np.bincount(row[~keep], minlength=step.num_rows), "kept_sha256": sha}, {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()})

    return _joined(own, window, gram, "doc_id", "text").mapInArrow(run, DIGEST)


def _texts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keep: np.ndarray, n: int) -> Iterator[bytes]:
    """The kept words of each row, joined by one space."""
    size = np.where(keep, ends - starts, 0)
    own = np.repeat(keep, ends - starts)
    within = np.arange(len(own)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    letters = raw[np.repeat(starts, ends - starts) + within][own]
    out = np.full(int(size.sum() + keep.sum()), 32, np.uint8)  # a space after each kept word
    to = np.cumsum(np.where(keep, size + 1, 0)) - np.where(keep, size + 1, 0)
    out[(np.repeat(to, ends - starts) + within)[own]] = letters
    ends_of = np.cumsum(np.bincount(row[keep], weights=(size + 1)[keep], minlength=n)).astype(np.int64).tolist()
    held, at = memoryview(out), 0
    for end in ends_of:
        yield bytes(held[at : max(at, end - 1)])
        at = end


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated words cut from their texts. A text that loses none stays as it is, to the byte;
    in others the kept words are joined by one space, with line feeds where the text had them between two."""
    rows, (own_id, own_text) = plain(docs, id_col, text_col)
    names = rows.columns
    at, places_at = names.index(own_text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, own_text):
            touched = step.column(places_at).is_valid().to_numpy(zero_copy_only=False)
            if touched.any():
                changed = pa.array(np.flatnonzero(touched))
                part = step.take(changed)
                raw, starts, ends, row, keep = _kept(part, at, places_at, window)
                texts = step.column(at).to_pylist()
                for i, cut in zip(changed.to_pylist(), _lines(raw, starts, ends, row, keep, part.num_rows), strict=True):
                    texts[i] = cut
                step = step.set_column(at, step.schema.field(at), pa.array(texts, step.schema.field(at).type))
            yield step.select(names)

    return _joined(rows, window, gram, own_id, own_text).mapInArrow(run, rows.schema).toDF(*docs.columns)


def _lines(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keep: np.ndarray, n: int) -> Iterator[str]:
    feeds = np.concatenate([[0], np.cumsum(raw == 10)])
    edge = np.searchsorted(row, np.arange(n + 1))
    held = memoryview(raw)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        mine = a + np.flatnonzero(keep[a:b])
        out = bytearray()
        for k, (s, e) in enumerate(zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)):
            if k:
                out += b"\n" if feeds[s] > feeds[ends[mine[k - 1]]] else b" "
            out += held[s:e]
        yield out.decode()
