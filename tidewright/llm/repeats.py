"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every string of `length` bytes is named by its anchor: the 32-byte window inside it with the least hash. Equal strings
have equal anchors, so strings meet only under their anchor, and neighbouring strings with one anchor travel as one
stretch of text. Steps:

1. Each task finds the stretches of its documents. Of equal stretches it keeps the first; the rest are repeats.
2. A shuffle by anchor finds equal stretches of other tasks in the same way, and anchors with different stretches.
3. The bytes of those first different stretches, small shards of text, are gathered by anchor. In each partition their
   transforms are merged by interleave refinement: all suffixes start in one block, and each step sorts the current
   interleave stably by the two symbols before each suffix (a counting sort, no comparison of suffixes) and marks where
   blocks break. After length / 2 steps a block is an interval of suffixes with a common prefix of `length` bytes;
   all but the first of a block are repeats.

An anchor's rows in step 2 number at most one per task and different stretch, whatever its frequency.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import bitmap_of, documents, opened, share, written

GRAM = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_END = 0xFF  # never a byte of UTF-8


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.r_[out, out * np.uint64(pow(base, len(out), 1 << 64))]
    return out[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Anchors:
    """Stretches of texts. A stretch: anchor hash, hash of its bytes, text number, first string, number of strings."""

    def __init__(self, length: int = 100) -> None:
        self.length, self.window = length, length - GRAM + 1
        self.codes = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up, self.down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def stretches(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of texts of less than 2**23 bytes together, or one text of any length."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        n, sizes = len(data), np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        if n < self.length:
            return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        total = np.r_[np.uint64(0), np.cumsum(self.codes[data] * self.up[:n])]
        gram = _mix((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        # least hash of each window of grams, the leftmost of equals
        where = np.arange(len(gram), dtype=np.int64)
        low, at, span = gram, where, 1
        while span * 2 <= self.window:
            low, at = self._less(low[:-span], at[:-span], low[span:], at[span:])
            span *= 2
        rest = self.window - span
        if rest:
            low, at = self._less(low[: len(low) - rest], at[: len(at) - rest], low[rest:], at[rest:])
        strings = n - self.length + 1
        owner = np.repeat(np.arange(len(texts)), sizes)[:strings]
        inside = np.arange(strings) + self.length <= (first + sizes)[owner]
        p = np.flatnonzero(inside)
        if not len(p):
            return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
        a = at[p]
        new = np.r_[True, (a[1:] != a[:-1]) | (owner[p][1:] != owner[p][:-1])]
        head = p[new]
        count = np.diff(np.r_[np.flatnonzero(new), len(p)])
        end = head + count - 1 + self.length
        body = _mix(_mix((total[end] - total[head]) * self.down[head]) + (a[new] - head).astype(np.uint64) * np.uint64(131) + count.astype(np.uint64))
        return [gram[a[new]], body, owner[head], head - first[owner[head]], count]

    @staticmethod
    def _less(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take = b < a
        return np.where(take, b, a), np.where(take, ib, ia)


def _first_of_equals(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by keys: True where a new key starts."""
    return np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(keys[0]) else np.zeros(0, bool)


_ROW = "kind int, anchor long, body long, doc_id long, start long, n long"


def _rows(kind: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["kind", "anchor", "body", "doc_id", "start", "n"]
    table = pa.table([pa.array(kind.astype(np.int32)), *[pa.array(c.view(np.int64)) for c in cols]], names=names)
    yield from table.to_batches(max_chunksize=100_000)


def _find_stretches(docs: DataFrame, length: int) -> DataFrame:
    """Kind 0: repeated within its task; kind 1: the first of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, texts, ids, size = Anchors(length), [], [], [], 0

        def take() -> None:
            found = anchors.stretches(texts)
            held.append([found[0], found[1], np.array(ids, np.int64)[found[2]], found[3], found[4]])
            texts.clear()
            ids.clear()

        def out() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 5
            held.clear()
            order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            return _rows(_first_of_equals(cols[0], cols[1]), *cols)

        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and len(text) >= length:
                    if size + len(text) > _PIECE and texts:
                        take()
                        size = 0
                    texts.append(text)
                    ids.append(ident)
                    size += len(text)
            if sum(len(h[0]) for h in held) > 1_500_000:
                yield from out()
        if texts:
            take()
        yield from out()

    return docs.mapInArrow(run, _ROW)


def _meet_by_anchor(rows: DataFrame) -> DataFrame:
    """Kind 0: repeated; kind 2: the first of its kind under an anchor that has other stretches too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        kind, anchor, body, doc, start, n = (t.column(i).to_numpy() for i in range(6))
        done = int((kind == 0).sum())  # these sort first
        out = np.zeros(len(kind), np.int32)
        if done < len(kind):
            run_ = np.cumsum(_first_of_equals(anchor[done:])) - 1
            fresh = _first_of_equals(anchor[done:], body[done:])
            several = np.bincount(run_, fresh)[run_] > 1
            out[done:] = np.where(~fresh, 0, np.where(several, 2, 1))
        keep = out != 1
        yield from _rows(out[keep], anchor[keep], body[keep], doc[keep], start[keep], n[keep])

    # What its task found to be repeated needs no meeting; it is dealt out evenly.
    place = F.when(F.col("kind") == 0, F.xxhash64("doc_id", "start")).otherwise(F.col("anchor"))
    return rows.repartition(place).sortWithinPartitions("kind", "anchor", "body", "doc_id", "start").mapInArrow(run, _ROW)


def merge_transforms(strings: list[bytes], length: int) -> np.ndarray:
    """Block numbers of all suffixes by common prefixes of `length` bytes, in text order (terminators count as positions).

    The strings are shards in text order; position i's transform symbol is what stands before it, cyclically in its string.
    """
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    first = np.cumsum(sizes) - sizes
    before = np.arange(-1, len(text) - 1)
    before[first] = first + sizes - 1
    two = before[before].astype(np.int32)
    symbols = text[two].astype(np.uint16) << np.uint16(8) | text[before]  # the two symbols before a suffix
    order = np.arange(len(text), dtype=np.int32)
    block = np.zeros(len(text), np.int32)
    for _ in range((length + 1) // 2):
        sym = symbols[order]
        step = np.argsort(sym, kind="stable")
        order, sym, block = two[order[step]], sym[step], block[step]
        block = np.cumsum(np.r_[False, (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])], dtype=np.int32)
    out = np.empty(len(text), np.int32)
    out[order] = block
    return out


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive positions per document: doc, first, count. Rows sorted by (doc, pos)."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], pos[at], np.diff(np.r_[at, len(doc)])


def _merge_shards(pieces: DataFrame, length: int, shard_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n): repeated strings among the pieces (anchor, doc_id, start, bytes); pieces of one anchor share a merge."""

    def merge(doc: list[int], start: list[int], body: list[bytes]) -> pa.RecordBatch:
        block = merge_transforms(body, length)
        sizes = np.array([len(s) for s in body], np.int64)
        count = sizes - length + 1
        who = np.repeat(np.arange(len(body)), count)
        offset = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(sizes + 1) - sizes - 1)[who] + offset
        d, p, b = np.array(doc, np.int64)[who], np.array(start, np.int64)[who] + offset, block[at]
        order = np.lexsort((p, d, b))
        gone = order[~_first_of_equals(b[order])]
        gone = gone[np.lexsort((p[gone], d[gone]))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _runs(d[gone], p[gone])], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, body, size, last = [], [], [], 0, None
        for b in batches:
            for anchor, d, s, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if anchor != last and size > shard_bytes:
                    yield merge(doc, start, body)
                    doc, start, body, size = [], [], [], 0
                last = anchor
                doc.append(d)
                start.append(s)
                body.append(text)
                size += len(text)
        if body:
            yield merge(doc, start, body)

    return pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(run, "doc_id long, start long, n long")


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `counts`: false for rows without doc_id and for those whose doc_id has other texts of a lesser hash.

    Texts are looked at only where a doc_id is repeated.
    """
    again = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    present = docs.withColumn("counts", F.col("doc_id").isNotNull())
    if again.isEmpty():
        return present
    least = written(docs.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least")))
    return present.join(least, "doc_id", "left").withColumn("counts", F.col("counts") & (F.col("least").isNull() | (F.xxhash64("text") == F.col("least")))).drop("least")


def repeated_strings(rows: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, start, n): runs of n strings of `length` bytes, the first at byte `start`, that also start earlier.

    rows: doc_id and text (binary), one text for a doc_id. Earlier means in a smaller doc_id, or before in the same document.
    """
    docs = rows
    met = written(_meet_by_anchor(_find_stretches(rows, length)))
    mixed = met.filter("kind = 2").select("doc_id", F.struct("anchor", "start", "n").alias("x"))
    wanted = written(mixed.groupBy("doc_id").agg(F.collect_list("x").alias("want")))
    shared = share(docs.sparkSession, bitmap_of(wanted, "doc_id"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = opened(shared)
        for b in batches:
            yield b.filter(pa.array(bitmap.may_hold(b.column(0).to_numpy().view(np.uint64))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for ident, text, want in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                for w in want:
                    piece = text[w["start"] : w["start"] + w["n"] - 1 + length]
                    if len(piece) >= length:
                        for col, v in zip(out, (w["anchor"], ident, w["start"], piece), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.binary())], names=["anchor", "doc_id", "start", "bytes"])

    pieces = rows.mapInArrow(flagged, "doc_id long, text binary").join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(cut, "anchor long, doc_id long, start long, bytes binary")
    return met.filter("kind = 0").select("doc_id", "start", "n").unionByName(written(_merge_shards(pieces, length)))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, text, kept, n_bytes, n_removed, n_spans), one row per row of docs: kept is what is left of the bytes, joined.

    Null and empty texts have nothing to remove; an empty table gives no rows; very long texts are treated whole; other columns of docs are not
    looked at. Equal rows count once and lose the same bytes. Of rows with one doc_id and different texts the one of the least hash takes
    part; the others stay whole and are compared with nothing, as do rows without doc_id.
    """
    given = one_text_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    gone = repeated_strings(given.filter("counts").select("doc_id", "text"), length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    gone = written(gone).select(F.col("doc_id").alias("own_id"), "gone")
    rows = given.join(gone, F.col("doc_id") == F.col("own_id"), "left").select("doc_id", "text", F.when(F.col("counts"), F.col("gone")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed, spans = [], [], []
            for text, want in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not want:
                    kept.append(text)
                    removed.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(text) + 1, np.int32)
                for w in want:
                    if w["start"] < len(text):
                        edge[w["start"]] += 1
                        edge[min(len(text), w["start"] + w["n"] - 1 + length)] -= 1
                cover = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(text, np.uint8)[~cover].tobytes())
                removed.append(int(cover.sum()))
                spans.append(int(np.count_nonzero(np.diff(np.r_[False, cover].astype(np.int8)) == 1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(run, "doc_id long, text binary, kept binary, n_bytes long, n_removed long, n_spans long")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document row at 100 bytes."""
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, bytes]], length: int = 100) -> list[tuple]:
    """What op7 has to return, by one set of all strings."""
    seen: set[bytes] = set()
    out = []
    for ident, text in sorted(docs):
        cover = bytearray(len(text))
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((ident, len(text), sum(cover), spans, hashlib.sha256(bytes(t for t, c in zip(text, cover, strict=True) if not c)).hexdigest()))
    return out
