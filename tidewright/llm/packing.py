"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Each task tokenises the documents of its input split once and packs them as it goes, in blocks of bounded size;
nothing is shuffled. Windows that a document fills alone are cut off first. The remainders of a block, about half a window
less than its windows hold, are split over them by the largest differencing method: partial partitions start with one
remainder each, and the two with the largest imbalance are merged with opposing order until one is left. The sums are near
equal; where one exceeds the capacity all the same, the block is split over one window more. So no remainder is cut, and about
half a window of a block is padding.
"""

from __future__ import annotations

import heapq
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents

BLOCK_WINDOWS = 128

#: Visible ASCII and Latin letters, whose stretches this tokenizer encodes alike alone and between others.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class WordTokenizer(dict):
    """Ids of whole texts; maps each distinct stretch without white space to a number.

    This tokenizer drops white space and neither normalises nor merges across it, so the ids of a text are those of
    its stretches. Stretches not met before go through the library in one text, parted by a special token; those with other
    letters or with special tokens one by one. The first `most` stretches stay, which frequent ones are among; what comes
    later is forgotten now and then.
    """

    def __init__(self, path: str, most: int = 400_000, late: int = 100_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library, self.most, self.late = Tokenizer.from_file(path), most, late
        self.mark, token = min((i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.special)
        self.between = token.content.encode()
        self.flat, self.start = array("H"), array("q", [0])  # ids of stretch n stand from start[n] to start[n + 1]

    def learn(self, stretches: list[bytes]) -> None:
        plain, odd = [], []
        for stretch in stretches:
            known = stretch.isascii() and stretch.isalnum() or _PLAIN.fullmatch(stretch.decode(errors="replace")) and b"<|" not in stretch
            (plain if known else odd).append(stretch)
        found = [self.library.encode(x.decode(errors="replace"), add_special_tokens=False).ids for x in odd]
        ids, sizes = array("H", chain.from_iterable(found)), [len(x) for x in found]
        if plain:
            text = self.between.join(plain).decode()
            got = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
            marks = np.flatnonzero(got == self.mark)
            sizes += (np.diff(np.r_[-1, marks, len(got)]) - 1).tolist()
            ids.frombytes(np.delete(got, marks).tobytes())
        self.update(zip(chain(odd, plain), range(len(self), len(self) + len(sizes)), strict=True))
        ends = self.start[-1] + np.cumsum(np.array(sizes, np.int64))
        self.flat.extend(ids)
        self.start.frombytes(ends.tobytes())

    def forget_late(self) -> None:
        while len(self) > self.most:
            self.popitem()
        del self.start[len(self) + 1 :]
        del self.flat[self.start[-1] :]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text as uint32."""
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.get, words))
        if late := [k for k, n in enumerate(found) if n is None]:
            self.learn(list({words[k] for k in late}))
            for k in late:
                found[k] = self[words[k]]
        at = np.array(found, np.int64)
        start = np.array(self.start, np.int64)
        size = start[at + 1] - start[at]
        ends = np.r_[0, np.cumsum(size)]
        ids = np.array(self.flat, np.uint16)[np.repeat(start[at] - ends[:-1], size) + np.arange(ends[-1])].astype(np.uint32)
        cuts = ends[np.cumsum([len(x) for x in split])].tolist()
        if len(self) > self.most + self.late:
            self.forget_late()
        return [ids[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process: workers serve several tasks, and later ones find most words known."""
    known = sys.modules.setdefault("_tidewright_tokenizers", types.ModuleType("_tidewright_tokenizers")).__dict__
    if path not in known:
        known[path] = WordTokenizer(path)
    return known[path]


def _groups(rows: Iterator[tuple], most: int = 1 << 20) -> Iterator[list[tuple]]:
    """Consecutive (name, text) rows of about `most` bytes of text together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def largest_differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Split the numbered sizes into `ways` parts of near-equal sums."""
    heap = []
    for k, size in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = size
        heap.append((-size, k, sums, [k] + [None] * (ways - 1)))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, s1, p1 = heapq.heappop(heap)
        _, _, s2, p2 = heapq.heappop(heap)
        sums = s1 + s2[::-1]
        parts = [a if b is None else b if a is None else (a, b) for a, b in zip(p1, reversed(p2), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tick, sums, [parts[i] for i in order.tolist()]))
        tick += 1
    out = []
    for part in heap[0][3] if heap else []:
        items, stack = [], [part]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                items.append(x)
        out.append(sorted(items))
    return out


def pack_block(items: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) pieces, none over capacity; each piece is at most `capacity` long and stays whole."""
    sizes = [n for _, _, n in items]
    ways = max(1, -(-sum(sizes) // capacity))
    parts = largest_differencing(sizes, ways)
    while any(sum(sizes[k] for k in part) > capacity for part in parts):
        ways += 1  # the window count rises
        parts = largest_differencing(sizes, ways)
    return [[items[k] for k in part] for part in parts if part]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence.

    A document is its ids and `end_id`; a null or empty text is `end_id` alone. Each id lies in exactly one piece; a document
    longer than `capacity` is cut at its multiples, others stay whole. Rows that repeat a doc_id are packed one by one, null ids too. An empty
    table gives no rows. Other columns of docs are not looked at. sequence_id holds the input split in its upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, base = _tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        ids: dict[int, np.ndarray] = {}  # of documents with a remainder that is not placed yet
        names: dict[int, int | None] = {}
        items: list[tuple[int, int, int]] = []
        rows: list[tuple] = []
        state = {"held": 0, "seq": 0, "next": 0}
        full = block_windows * capacity - capacity // 2

        def place(windows: list[list[tuple[int, int, int]]]) -> None:
            for window in windows:
                offset = 0
                for doc, start, n in window:
                    crc = zlib.crc32(ids[doc][start : start + n].tobytes())
                    rows.append((names[doc], start, n, crc, len(ids[doc]), base + state["seq"], offset))
                    offset += n
                state["seq"] += 1

        def flush() -> None:
            place(pack_block(items, capacity))
            for doc, _, _ in items:
                del ids[doc], names[doc]
            items.clear()
            state["held"] = 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        given = ((name, text or b"") for b in batches for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for group in _groups(given):
            for (name, _), got in zip(group, tokenizer.encode([text for _, text in group]), strict=True):
                doc = state["next"]
                state["next"] += 1
                ids[doc], names[doc] = np.append(got, np.uint32(end_id)).astype("<u4"), name
                n = len(ids[doc])
                whole = n // capacity * capacity
                place([[(doc, s, capacity)] for s in range(0, whole, capacity)])
                if n == whole:
                    del ids[doc], names[doc]
                    continue
                if state["held"] + n - whole > full:
                    mine = ids.pop(doc), names.pop(doc)
                    flush()
                    ids[doc], names[doc] = mine
                items.append((doc, whole, n - whole))
                state["held"] += n - whole
            if rows:
                yield out()
        if items:
            flush()
        yield out()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids of the public word vocabulary; see `pack`."""
    return pack(documents(spark, sf_dir), word_bpe())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of all documents that are left, one row each; nulls, repeated rows and empty tables as in `pack`."""
    return pack(docs, word_bpe())
