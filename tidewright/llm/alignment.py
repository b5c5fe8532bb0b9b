"""Alignment of two tokenizations of the same texts through sparse products over bytes.

The tokens of a batch of texts and the bytes that they cover are incidence matrices in compressed rows, built by hand. The row products
of A times B transposed link each pair of tokens that share a byte. Byte offsets where tokens of both end cut a text into
groups; the products of the group incidences with ones count what each group holds, which gives the shared-group links as
group by group factors instead of all their pairs.

How many documents hold an id pair linked is counted over the corpus. The pairs that most documents hold are few and sent to
all tasks, in at most a stated number of rows; the other pairs are joined by shuffles.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents, opened, share, small, written

BATCH_BYTES = 1 << 19
MOST_SENT = 1 << 20  # id pairs that are sent to all tasks


class Rows(NamedTuple):
    """A sparse matrix in compressed rows: row i has the entries start[i] to start[i + 1]."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int


def incidence(sizes: np.ndarray) -> Rows:
    """Tokens by bytes, for consecutive tokens of these sizes."""
    start = np.r_[0, np.cumsum(sizes)]
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int32), int(start[-1]))


def transposed(m: Rows) -> Rows:
    order = np.argsort(m.column, kind="stable")
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))[order]
    return Rows(np.r_[0, np.cumsum(np.bincount(m.column, minlength=m.width))], row, m.value[order], len(m.start) - 1)


def product(a: Rows, b: Rows) -> Rows:
    """a times b, row by row: row i is the sum of the rows of b at the columns of row i of a, scaled by its values."""
    n = b.start[a.column + 1] - b.start[a.column]
    ends = np.cumsum(n)
    at = np.repeat(b.start[a.column] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    row = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), n)
    value = np.repeat(a.value, n) * b.value[at]
    key = row * b.width + b.column[at]
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    value = np.add.reduceat(value, first) if len(first) else value
    return Rows(np.searchsorted(key, np.arange(len(a.start)) * b.width), key % max(1, b.width), value, b.width)


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[Rows, Rows]:
    """Groups by tokens of A and groups by tokens of B: which tokens lie between two offsets where both end."""
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    out = []
    for ends in (end_a, end_b):
        of = np.searchsorted(cuts, ends)
        one_each = Rows(np.arange(len(ends) + 1), of, np.ones(len(ends), np.int32), len(cuts))
        out.append(transposed(one_each))
    return out[0], out[1]


def linked_pairs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, group_a: Rows, group_b: Rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each token of A and the id pairs of all links, in order. Products are taken over whole groups of about BATCH_BYTES together, so a long text needs no more."""
    ends = np.cumsum(size_a)[group_a.start[1:] - 1] if len(a) else np.zeros(0, np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1, len(ends)]
    per_a, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        in_a, in_b = (slice(g.start[i], g.start[j]) for g in (group_a, group_b))
        links = product(incidence(size_a[in_a]), transposed(incidence(size_b[in_b])))
        per_a.append(np.diff(links.start))
        pairs.append(np.repeat(a[in_a], per_a[-1]) * width + b[in_b][links.column])
    return np.concatenate(per_a), np.concatenate(pairs)


class Aligned(NamedTuple):
    """Of consecutive texts: five counts each, the groups as written, and where the linked id pairs of each begin in the list of all."""

    counts: np.ndarray
    said: list[bytes]
    start: np.ndarray
    pairs: np.ndarray


class Tokenizers:
    """Both libraries with the bytes of each id, and the units met before with their alignment.

    A unit is a run of spaces and line ends and what follows it up to the next. Where A splits words as byte-level vocabularies do and no piece
    of B has a space or line end after another character, no token of either crosses into the next unit, so a text's tokens, groups
    and links are those of its units, and the product of equal blocks is taken once. Other vocabularies see whole texts. The first
    `most` units stay, which frequent ones are among; what comes later is forgotten now and then.
    """

    def __init__(self, path_a: str, path_b: str, most: int = 150_000, late: int = 50_000) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        of_char = _byte_of_char()
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(of_char[c] for c in name) if all(c in of_char for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.width, self.ids = len(pieces), max(len(self.bytes_a), len(pieces))
        #: decimal ids with the sign after them
        self.text = np.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(self.ids)], f"S{len(str(self.ids)) + 1}")
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and made["normalizer"] is None
        self.in_units = bool(words) and not any(re.search("[^▁\n][▁\n]", p) for p in pieces)
        self.most, self.late = most, late
        self.number: dict[str, int] = {}
        self.counts, self.said, self.start, self.pairs = array("q"), [], array("q", [0]), array("q")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of texts that begin with a space or line end, and how many each text has of both; none where the bytes of either differ from the text."""
        given = [t[1:] if t[0] == " " else t for t in texts]
        out = []
        for text, got, b in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode(given, num_threads=1), strict=True):
            a, want = got.ids, text.encode()
            if text[0] != " " and b and self.bytes_b[b[0]] == b" ":
                b = b[1:]  # the space that B adds
            same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            out.append((a, b) if same else ([], []))
        n_a, n_b = (np.array([len(x[k]) for x in out], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in out), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        return a, b, n_a, n_b

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for units that are not white space alone: as one text, cut again where they end, unless it isn't given back."""
        a, b, whole, _ = self.encode(["".join(units)])
        if whole[0]:
            ends = np.cumsum([len(u.encode()) for u in units])
            n_a, n_b = (np.diff(np.searchsorted(np.cumsum(size[ids]), ends, "right"), prepend=0) for size, ids in ((self.size_a, a), (self.size_b, b)))
            return a, b, n_a, n_b
        return self.encode(units)

    def learn(self, units: list[str]) -> None:
        blank = [u for u in units if u[-1] in " \n"]
        units = [u for u in units if u[-1] not in " \n"]
        for part, encode in ((units, self.encode_units), (blank, self.encode)):
            if part:
                self.add(part, aligned(self, encode(part)))

    def add(self, units: list[str], got: Aligned) -> None:
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.counts.frombytes(got.counts.tobytes())
        self.said += got.said
        self.start.frombytes((self.start[-1] + got.start[1:]).tobytes())
        self.pairs.frombytes(got.pairs.tobytes())

    def forget_late(self) -> None:
        while len(self.number) > self.most:
            self.number.popitem()
        del self.said[self.most :], self.counts[5 * self.most :], self.start[self.most + 1 :]
        del self.pairs[self.start[-1] :]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [i for i in range(256) if i not in set(plain)]
    return {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(others)}


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    known = sys.modules.setdefault("_tidewright_aligners", types.ModuleType("_tidewright_aligners")).__dict__
    if (path_a, path_b) not in known:
        known[path_a, path_b] = Tokenizers(path_a, path_b)
    return known[path_a, path_b]


def aligned(tokenizers: Tokenizers, encoded: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Aligned:
    """Counts (n_a, n_b, n_groups, n_links, n_shared), groups and linked id pairs (a times width of B plus b, in order) of encoded texts."""
    a, b, n_a, n_b = encoded
    size_a, size_b = tokenizers.size_a[a], tokenizers.size_b[b]
    group_a, group_b = groups(np.cumsum(size_a), np.cumsum(size_b))  # a text ends where tokens of both end
    per_a, pairs = linked_pairs(a, b, size_a, size_b, group_a, group_b, tokenizers.width)
    in_a, in_b = np.diff(group_a.start), np.diff(group_b.start)
    # tokens in the order in which they are written: those of A, then those of B, group by group
    order = np.zeros(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.repeat(group_b.start[:-1], in_a)
    place_b = np.arange(len(b)) + np.repeat(group_a.start[1:], in_b)
    order[place_a], order[place_b] = a, b
    order[place_a[group_a.start[1:] - 1]] += tokenizers.ids
    order[place_b[group_b.start[1:] - 1]] += 2 * tokenizers.ids
    at_a, at = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_a + n_b)]
    group_at = np.searchsorted(group_a.start[:-1], at_a)
    start = np.r_[0, np.cumsum(per_a)][at_a]
    shared = np.r_[0, np.cumsum(in_a * in_b)][group_at]
    text = tokenizers.text[order]
    said = [text[i:j].tobytes().translate(None, b"\0")[:-1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return Aligned(np.stack([n_a, n_b, np.diff(group_at), np.diff(start), np.diff(shared)], 1).astype(np.int64), said, start, pairs)


#: White space other than spaces and line ends: words that end in it do not end a unit.
_ODD = "\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[ \n]*+(?:[^ \n]++(?:(?<=[{_ODD}])[ \n]++)?)++|[ \n]++")


def _tallied(doc: np.ndarray, pairs: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts per document, distinct pairs and how often each occurs."""
    bits = 62 - max(1, n).bit_length()
    if len(pairs) and int(pairs.max()) >> bits:
        raise ValueError("too many texts in one batch for these vocabularies")
    key = (doc << bits) | pairs
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], first) if len(first) else times[:0]
    return np.searchsorted(key[first], np.arange(n + 1) << bits), key[first] & ((1 << bits) - 1), total


def _gathered(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the chosen lists and the places of their entries."""
    sizes = start[which + 1] - start[which]
    ends = np.cumsum(sizes)
    return sizes, np.repeat(start[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def align_texts(tokenizers: Tokenizers, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Counts and digests of texts, and their distinct linked id pairs with how often each occurs, one list after the other."""
    n = len(texts)
    whole = [" " + t for t in texts]
    counts, digests = np.zeros((n, 5), np.int64), [""] * n
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, pair, times
    alone = [k for k in range(n) if texts[k]]
    if tokenizers.in_units:
        units = [_UNIT.findall(whole[k]) for k in alone]
        number = tokenizers.number
        if new := {u for u in chain.from_iterable(units) if u not in number}:
            tokenizers.learn(list(new))
        table = np.array(tokenizers.counts).reshape(-1, 5)
        start, pairs, said = np.array(tokenizers.start), np.array(tokenizers.pairs), tokenizers.said
        left = []
        for k, split in zip(alone, units, strict=True):
            ids = np.fromiter(map(number.__getitem__, split), np.int64, len(split))
            if not table[ids, 0].all():
                left.append(k)  # a unit that is not given back: the whole text decides
                continue
            counts[k] = table[ids].sum(0)
            digests[k] = hashlib.sha256(b";".join(map(said.__getitem__, ids.tolist()))).hexdigest()
            distinct, times = np.unique(ids, return_counts=True)
            sizes, at = _gathered(start, distinct)
            found.append((np.full(len(at), k), pairs[at], np.repeat(times, sizes)))
        alone = left
        if len(number) > tokenizers.most + tokenizers.late:
            tokenizers.forget_late()
    if alone:
        got = aligned(tokenizers, tokenizers.encode([whole[k] for k in alone]))
        for x, k in enumerate(alone):
            counts[k] = got.counts[x]
            if counts[k, 0]:
                digests[k] = hashlib.sha256(got.said[x]).hexdigest()
            part = got.pairs[got.start[x] : got.start[x + 1]]
            found.append((np.full(len(part), k), part, np.ones(len(part), np.int64)))
    doc, pair, times = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in range(3))
    return counts, digests, *_tallied(doc, pair, times, n)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its counts, the digest of its groups, its linked id pairs and how often it holds each."""
    of_a, of_b = _vocabularies(path_a, path_b)
    kind = "int" if of_a * of_b < 1 << 31 else "long"
    narrow = np.int32 if kind == "int" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizers(path_a, path_b)
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            counts, digests, starts, pairs, times = align_texts(known, [t for _, t in held])
            lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x)) for x in (pairs.astype(narrow), times.astype(np.int32))]
            rows = [pa.array([i for i, _ in held], pa.int64()), *[pa.array(counts[:, c]) for c in range(5)], pa.array(digests, pa.string()), *lists]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"])

        size = 0
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                held.append((name, text))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + f", groups_sha256 string, pairs array<{kind}>, times array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Known:
    """Sorted id pairs with their counts, and the highest count of each id of A."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray, width: int) -> None:
        order = np.argsort(pairs)
        self.pairs, self.counts = pairs[order], counts[order]
        self.is_best = self.counts == best[self.pairs // width]


def pair_counts(found: DataFrame) -> DataFrame:
    """How many rows of `alignments` hold each linked id pair: pair, n."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_shared (pairs of tokens in one group), n_best, count_sum, groups_sha256.

    Both tokenizers see a space and the text, special tokens as plain text. A null or empty text, and one that either does
    not give back byte by byte, has zeros and the empty digest. Texts are read whole, whatever their length. Rows that repeat a
    doc_id are documents of their own, and each counts. Ties for the highest count of an id are all best. An empty table gives no
    rows. Other columns of docs are not looked at. `most_sent` bounds what is sent to all tasks and does not change the result.
    """
    spark = docs.sparkSession
    of_a, width = _vocabularies(path_a, path_b)
    found = written(alignments(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(found))
    best = np.zeros(of_a, np.int64)
    highest = counts.groupBy((F.col("pair") / width).cast("int").alias("a")).agg(F.max("n").alias("n"))  # at most one row per id of A
    for row in highest.toLocalIterator():
        best[row.a] = row.n
    # the power of two from which pairs are common enough to be sent: as many as may be
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    least, sent = 64, 0
    for k in range(63, -1, -1):
        sent += sizes.get(k, 0)
        if sent > most_sent:
            break
        least = k
    common = counts.where(F.col("n") >= F.lit(min(2**least, (1 << 63) - 1))).toArrow()
    known = share(spark, Known(common.column("pair").to_numpy(), common.column("n").to_numpy(), best, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = opened(known)
        for b in batches:
            pairs, times = (b.column(b.num_columns - x).flatten().to_numpy() for x in (2, 1))
            row = np.repeat(np.arange(b.num_rows), b.column(b.num_columns - 1).value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(k.pairs, pairs), max(0, len(k.pairs) - 1))
            hit = k.pairs[at] == pairs if len(k.pairs) else np.zeros(len(pairs), bool)
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            if hit.any():
                np.add.at(n_best, row[hit], times[hit] * k.is_best[at[hit]])
                np.add.at(total, row[hit], times[hit] * k.counts[at[hit]])
            ends = np.searchsorted(row[~hit], np.arange(b.num_rows + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_best), pa.array(total), *rest], names=[*b.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    plain = ["row", "doc_id", *_COUNTS, "groups_sha256"]
    schema = found.select(*plain).schema.add("n_best", "long").add("count_sum", "long").add(found.schema["pairs"]).add(found.schema["times"])
    scored = found.select(*plain, "pairs", "times").mapInArrow(run, schema)
    out = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    if not least:
        return scored.select(*out)
    scored = written(scored)
    # pairs that fewer documents hold, each at most 2 ** least: joined, and added up per document
    top = small(spark.createDataFrame([(i, int(n)) for i, n in enumerate(best.tolist()) if n], "a int, most long"))
    rare = counts.where(F.col("n") < F.lit(min(2**least, (1 << 63) - 1))).join(top, (F.col("pair") / width).cast("int") == F.col("a"))
    left = scored.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    more = left.toDF("row", "pair", "times").join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    both = scored.join(more, "row", "left")
    return both.withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0))).select(*out)


def _vocabularies(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True).values()) + 1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the public byte-level and piece vocabularies over all documents; nulls, ties, repeated rows, empty and long texts, clashing columns and empty tables as in `align`."""
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
