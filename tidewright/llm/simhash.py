"""SimHash near-duplicate detection over a Gray-order hierarchical index.

A fingerprint is cut into ``radius + agree`` bit blocks; fingerprints at most ``radius`` bits apart agree on at least
``agree`` of them. For each choice of `agree` blocks the bits are permuted so that the chosen blocks lead, and all permuted
fingerprints are range-partitioned and sorted by their Gray rank: neighbours in Gray order share leading bit patterns. A sorted
run with one leading pattern is the root of a tree: leaves of LEAF neighbours, upper nodes of FANOUT children, each with the
bits that all its members share (mask and pattern). Pairs of nodes are followed from the root; what they differ in on commonly
masked bits adds up on the way down, each bit once, and a pair of groups is pruned as a whole when the sum exceeds the radius
or when the members of both are connected already. A task writes a spanning forest of the pairs it found close, never all pairs.

The number of leading bits follows the number of fingerprints, so runs stay short at any size. Range partitioning cuts a run
that is long all the same over tasks; its parts meet pair by pair in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents, written
from tidewright.llm.components import components

CHUNK, LEAF, FANOUT = 512, 32, 8
_POINTS = "r int, rank long, id long, word long, s0 long, s1 long"
_LINKS = "kind int, a long, b long, r int, node long, chunk long, word long, s0 long, s1 long"


def _bits_over_half(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle of the ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    n = max(1, len(words) - k + 1)
    first, last = starts[:n].tolist(), (starts[min(k, len(words)) :][:n] - 1).tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(first, last, strict=True)], np.uint64)


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text. Null texts and texts without words get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text or b"", k)
                out.append(_bits_over_half(h) if len(h) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Labels of a set of points that are joined bit by bit; all batches are arrays."""

    def __init__(self, n: int) -> None:
        self.lab = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Join the pairs; which of them brought two trees together."""
        lab, new = self.lab, np.zeros(len(i), bool)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            while lab[a] != a:
                a = lab[a]
            while lab[b] != b:
                b = lab[b]
            if a != b:
                lab[max(a, b)] = min(a, b)
                new[k] = True
        while not np.array_equal(lab, up := lab[lab]):
            lab = up
        self.lab = lab
        return new

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.lab[i] != self.lab[j]


class _Points:
    """Fingerprints with optional sketches; decides which pairs are close."""

    def __init__(self, fp: np.ndarray, s0: np.ndarray, s1: np.ndarray, radius: int, most_sketch_bits: int) -> None:
        self.fp, self.s0, self.s1, self.radius, self.most = fp, s0, s1, radius, most_sketch_bits

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The close ones of the pairs (i, j), those of the likest sketches first."""
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.radius
        i, j = i[near], j[near]
        if self.most >= 128 or not len(i):
            return i, j
        apart = np.bitwise_count(self.s0[i] ^ self.s0[j]) + np.bitwise_count(self.s1[i] ^ self.s1[j])
        order = np.argsort(apart, kind="stable")
        order = order[apart[order] <= self.most]
        return i[order], j[order]


def _join_close(forest: _Forest, points: _Points, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Join the close ones of the pairs (i, j), in slices, so that pairs already connected are not looked at twice. The pairs that joined trees, as rows."""
    out = []
    for s in range(0, len(i), 1 << 17):
        a, b = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
        new = forest.apart(a, b)
        a, b = points.close(a[new], b[new])
        if len(a):
            new = forest.join(a, b)
            out.append(np.stack([a[new], b[new]], axis=1))
    return out


def _join_checked(forest: _Forest, points: _Points, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], share: float) -> list[np.ndarray]:
    """The same for pairs whose sets have at least `share` in common; no other pair joins anything."""
    up, out = forest.lab.tolist(), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s in range(0, len(i), 1 << 18):
        a, b = points.close(i[s : s + (1 << 18)], j[s : s + (1 << 18)])
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = root(x), root(y)
            n, m = len(sets[x]), len(sets[y])
            if rx != ry and min(n, m) >= share * max(n, m):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= share * (n + m - both):
                    up[max(rx, ry)] = min(rx, ry)
                    out.append(np.array([[x, y]]))
        forest.lab = np.array([root(x) for x in range(len(up))], np.int64)
    return out


def _expanded(a: np.ndarray, b: np.ndarray, fan: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of children of node pairs (a <= b), each pair once, and the number of the pair they come from."""
    k = np.arange(fan)
    x = (a[:, None] * fan + np.repeat(k, fan)).ravel()
    y = (b[:, None] * fan + np.tile(k, fan)).ravel()
    of = np.repeat(np.arange(len(a)), fan * fan)
    keep = (x <= y) & (y < n)
    return x[keep], y[keep], of[keep]


def _join_tree(forest: _Forest, points: _Points, lo: int, hi: int) -> list[np.ndarray]:
    """Join what is close among the points lo to hi, which stand in Gray order, by descending a tree of shared patterns."""
    fp = points.fp[lo:hi]
    starts = np.arange(0, hi - lo, LEAF)
    levels = [(np.bitwise_and.reduceat(fp, starts), np.bitwise_or.reduceat(fp, starts))]
    while len(levels[-1][0]) > 1:
        at = np.arange(0, len(levels[-1][0]), FANOUT)
        levels.append((np.bitwise_and.reduceat(levels[-1][0], at), np.bitwise_or.reduceat(levels[-1][1], at)))
    a = b = np.zeros(1, np.int64)
    sum_, seen = np.zeros(1, np.int64), np.zeros(1, np.uint64)
    for depth in range(len(levels) - 1, -1, -1):
        every, some = levels[depth]
        if depth < len(levels) - 1:
            a, b, of = _expanded(a, b, FANOUT, len(every))
            sum_, seen = sum_[of], seen[of]
        mask = ~(every ^ some)
        both = mask[a] & mask[b]
        sum_ = sum_ + np.bitwise_count((every[a] ^ every[b]) & both & ~seen)
        keep = sum_ <= points.radius
        a, b, sum_, seen = a[keep], b[keep], sum_[keep], both[keep]
    found, own = [], a == b
    for a, b in ((a[own], b[own]), (a[~own], b[~own])):
        for s in range(0, len(a), 128):
            x, y = a[s : s + 128], b[s : s + 128]
            label = forest.lab[lo:hi]
            least, most = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            new = (np.minimum(least[x], least[y]) != np.maximum(most[x], most[y]))
            i, j, _ = _expanded(x[new], y[new], LEAF, hi - lo)
            i, j = i[i < j] + lo, j[i < j] + lo
            found += _join_close(forest, points, i, j)
    return found


def _gray_rank(word: np.ndarray) -> np.ndarray:
    """Place of a word in the reflected Gray sequence, as a signed long in the order of the unsigned rank."""
    rank = word.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return (rank ^ np.uint64(1 << 63)).view(np.int64)


def _choices(radius: int, agree: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of `agree` of the blocks: all blocks (first bit, bits), the chosen ones first, and the bits of the chosen."""
    blocks = radius + agree
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    out = []
    for lead in combinations(range(blocks), agree):
        order = [spans[i] for i in lead] + [spans[i] for i in range(blocks) if i not in lead]
        out.append((order, sum(n for _, n in order[:agree])))
    return out


def _permuted(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for first, bits in order:
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(64 - first - bits)) & np.uint64((1 << bits) - 1))
    return out


def agreeing_blocks(n: int, radius: int, least: int = 2) -> int:
    """How many blocks lead: as many as keep runs of n evenly spread fingerprints to a few."""
    agree = least
    while agree < 6 and n > 4 * 2 ** (64 * agree // (radius + agree)):
        agree += 1
    return agree


def hamming_links(points: DataFrame, radius: int, fps: list[str] | None = None, sketch: tuple[str, str] | None = None, most_sketch_bits: int = 128, agree: int | None = None, chunk: int = CHUNK, sets: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """(a, b): pairs that were compared and connect the same points as all pairs at most `radius` bits apart do.

    points: written, with id (long, unique), fingerprint columns `fps` (long; a pair may meet in any of them) and optionally the
    two words of a 128-bit sketch, in which a pair may differ by `most_sketch_bits`.
    sets: (id, grp, items) for each point, items distinct. With it a pair also needs `share` of the two sets in common
    before it connects anything; points of one grp are connected from the start and give no pairs.
    """
    fps, checked = fps or ["fp"], sets is not None
    choices = _choices(radius, agree or agreeing_blocks(points.count(), radius))
    widths = np.array([width for _ in fps for _, width in choices])
    given = [F.col(c).cast("long") for c in sketch] if sketch else [F.lit(0).cast("long")] * 2

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ident, s0, s1 = b.column(0), b.column(1), b.column(2)
            for t in range(len(fps)):
                fp = b.column(3 + t).to_numpy().view(np.uint64)
                for c, (order, _) in enumerate(choices):
                    word = _permuted(fp, order)
                    r = pa.array(np.full(len(fp), t * len(choices) + c, np.int32))
                    yield pa.RecordBatch.from_arrays([r, pa.array(_gray_rank(word)), ident, pa.array(word.view(np.int64)), s0, s1], names=["r", "rank", "id", "word", "s0", "s1"])

    rows = points.select("id", given[0].alias("s0"), given[1].alias("s1"), *fps).mapInArrow(permute, _POINTS)
    rows = rows.repartitionByRange("r", "rank").sortWithinPartitions("r", "rank", "id")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        r, _, ident, word, s0, s1 = (t.column(i).to_numpy() for i in range(6))
        fp, n = word.view(np.uint64), len(word)
        node = (fp >> (64 - widths[r]).astype(np.uint64)).astype(np.int64)
        new = np.r_[True, (r[1:] != r[:-1]) | (node[1:] != node[:-1])]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        first = np.flatnonzero(new)
        forest, close, pairs = _Forest(n), _Points(fp, s0.view(np.uint64), s1.view(np.uint64), radius, most_sketch_bits), []
        if not checked:
            short = size[run] <= 2 * LEAF
            i, d = np.flatnonzero(short), 1
            while len(i):
                i = i[i + d < n]
                i = i[run[i + d] == run[i]]
                pairs += _join_close(forest, close, i, i + d)
                d += 1
            for k in np.flatnonzero(size > 2 * LEAF).tolist():
                pairs += _join_tree(forest, close, int(first[k]), int(first[k] + size[k]))
        # Members of runs that may go on in another task meet in chunks; if sets decide, those of all runs do.
        meet = ((run == 0) | (run == run[-1])) if not checked else size[run] > 1
        out = np.flatnonzero(meet)
        leaf = (np.arange(n) - first[run]) // chunk + np.cumsum(np.r_[0, -(-size // chunk)])[run]
        base = TaskContext.get().partitionId() << 40
        kids, mates = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T
        nil = np.zeros(len(kids), np.int64)
        cols = [
            np.r_[np.zeros(len(kids), np.int32), np.ones(len(out), np.int32)], np.r_[ident[kids], ident[out]], np.r_[ident[mates], np.zeros(len(out), np.int64)],
            np.r_[nil, r[out]].astype(np.int32), np.r_[nil, node[out]], np.r_[nil, base + leaf[out]], np.r_[nil, word[out]], np.r_[nil, s0[out]], np.r_[nil, s1[out]],
        ]
        names = ["kind", "a", "b", "r", "node", "chunk", "word", "s0", "s1"]
        yield from pa.Table.from_arrays([pa.array(c) for c in cols], names=names).to_batches(max_chunksize=20_000)

    found = written(rows.mapInArrow(nodes, _LINKS))
    links = found.filter("kind = 0").select("a", "b")
    members = found.filter("kind = 1").select(F.col("a").alias("id"), "r", "node", "chunk", "word", "s0", "s1")
    # A run that lies in one task as a whole has been gone through there.
    if not checked:
        members = members.join(members.groupBy("r", "node").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter(F.shiftright("lo", 40) != F.shiftright("hi", 40)).select("r", "node"), ["r", "node"])
    known = components(links) if not checked else sets.select("id", F.col("grp").alias("component"))
    members = written(members.join(known, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component"))
    # Upper nodes: what all members of a chunk share. Pairs of chunks of one run that differ too much, or are connected as a whole, are pruned.
    upper = written(members.groupBy("r", "node", "chunk").agg(F.bit_and("word").alias("all"), F.bit_or("word").alias("any"), F.min("root").alias("least"), F.max("root").alias("most")))
    upper = upper.withColumn("mask", F.bitwise_not(F.col("all").bitwiseXOR(F.col("any")))).drop("any")
    right = upper.select("r", "node", *[F.col(c).alias(f"{c}2") for c in ("chunk", "all", "mask", "least", "most")])
    differ = F.bit_count(F.col("all").bitwiseXOR(F.col("all2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    apart = (F.col("chunk") <= F.col("chunk2")) if checked else (F.shiftright("chunk", 40) < F.shiftright("chunk2", 40))
    open_ = F.least("least", "least2") != F.greatest("most", "most2")
    units = upper.join(right, ["r", "node"]).filter(apart & open_ & (differ <= radius))
    ends = F.array(F.struct(F.col("chunk").alias("own"), F.lit(0).alias("side")), F.struct(F.col("chunk2").alias("own"), F.lit(1).alias("side")))
    units = written(units.select(F.explode(ends).alias("x"), F.col("chunk").alias("c1"), F.col("chunk2").alias("c2")).select("x.*", "c1", "c2").filter("side = 0 OR c1 <> c2"))

    def across(table: pa.Table) -> pa.Table:
        side, ident = table.column("side").to_numpy(), table.column("id").to_numpy()
        fp, s0, s1 = (table.column(c).to_numpy().view(np.uint64) for c in ("word", "s0", "s1"))
        _, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        forest, heads, close = _Forest(len(fp)), {}, _Points(fp, s0, s1, radius, most_sketch_bits)
        pre = [(heads.setdefault(x, k), k) for k, x in enumerate(root.tolist())]
        forest.join(np.array([a for a, _ in pre]), np.array([b for _, b in pre]))
        left, rightside = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.triu_indices(len(left), 1) if not len(rightside) else (np.repeat(left, len(rightside)), np.tile(rightside, len(left)))
        if checked:
            pairs = _join_checked(forest, close, i, j, [np.asarray(x) for x in table.column("items").to_numpy()], share)
        else:
            pairs = _join_close(forest, close, i, j)
        i, j = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T
        return pa.table({"a": ident[i], "b": ident[j]})

    pairs = members.join(units, F.col("chunk") == F.col("own")).select("c1", "c2", "side", "id", "word", "s0", "s1", "root")
    if checked:
        pairs = pairs.join(sets.select("id", "items"), "id")
    return links.unionByName(pairs.groupBy("c1", "c2").applyInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are connected by steps of at most `radius` bits.

    Exact copies collapse to one fingerprint before anything is compared. Null, empty and word-less texts have
    fingerprint zero and are linked like any other; a table without rows gives no rows. Other columns of docs
    are not looked at. Rows that repeat a doc_id count as one document if their texts agree.
    """
    fp = written(fingerprints(docs, k, id_col, text_col))
    reps = fp.groupBy("fp").agg(F.min("doc_id").alias("id"))
    reps = written(reps)
    comps = components(hamming_links(written(reps.filter("id IS NOT NULL")), radius))
    groups = written(reps.join(comps, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return fp.join(groups, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
