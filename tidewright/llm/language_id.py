"""Language identification by interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters with single spaces between words. Character 4-grams are counted per
language over all training documents: each task sums its own grams, a shuffle adds them up. From the counts come
Kneser-Ney probabilities of orders 4 to 1, kept in sorted arrays that are searched by gram. A text gets, per language,
its cross-entropy per character over the whole text; the lowest wins. A prediction is marked as rejected when its
cross-entropy exceeds what nearly all texts of the predicted language stay under that a model has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents, opened, share, small, split_remainder, written

ORDER, SPACE = 4, 32
_MASK = [np.uint64((1 << (16 * n)) - 1) for n in range(ORDER + 1)]
_NOT_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters of a text, stretches of anything else a single space."""
    return _NOT_LETTER.sub(" ", (text or "").lower()).strip()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of each text, and the text's number; three spaces stand before, one after.

    A gram packs four 16-bit characters; characters beyond the basic plane keep their low 16 bits.
    """
    codes = np.frombuffer("".join(f"   {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    sizes = np.array([len(t) + 4 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
    owner = owner[3:]
    first = np.cumsum(sizes) - sizes
    keep = np.arange(3, len(codes)) - first[owner] >= 3
    return gram[keep], owner[keep]


def _slices(texts: list[str], most: int = 1 << 19) -> Iterator[slice]:
    """Consecutive texts of about `most` characters together, so that arrays over characters stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class _Order:
    """One order of one language: sorted grams with their discounted share, sorted contexts with the mass left to lower orders."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = keys >> np.uint64(16)
        self.contexts, inv, types = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inv, counts)
        self.keys, self.share, self.left = keys, np.maximum(counts - discount, 0) / total[inv], discount * types / total

    def split(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hit = _find(self.keys, grams)
        share = np.where(hit, self.share[at], 0.0)
        at, hit = _find(self.contexts, grams >> np.uint64(16))
        return share, np.where(hit, self.left[at], 1.0)


class KneserNey:
    """Models of all languages. grams: sorted union of their 4-grams; table: log probability per gram and language."""

    def __init__(self, names: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.names, self.orders = names, []
        alphabet = set()
        for name in names:
            keys, c = counts[name]
            own = [_Order(keys, c.astype(float))]
            for n in range(ORDER - 1, 0, -1):  # how many different characters stand before a gram
                keys, c = np.unique(keys & _MASK[n], return_counts=True)
                own.append(_Order(keys, c.astype(float)))
            alphabet.update(keys.tolist())
            self.orders.append(own)
        self.floor = 1.0 / (len(alphabet) + 1)
        self.grams = np.unique(np.concatenate([counts[n][0] for n in names])) if names else np.zeros(0, np.uint64)
        self.table = self._log(self.grams)

    def _log(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), len(self.names)), np.float32)
        for k, own in enumerate(self.orders):
            p = np.full(len(grams), self.floor)
            for n, order in zip(range(1, ORDER + 1), reversed(own), strict=True):
                share, left = order.split(grams & _MASK[n])
                p = share + left * p
            out[:, k] = np.log(p)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each text under each language; zero for empty texts."""
        return np.concatenate([self._entropies(texts[s]) for s in _slices(texts)] or [np.zeros((0, len(self.names)))])

    def _entropies(self, texts: list[str]) -> np.ndarray:
        gram, owner = _grams(texts)
        total = np.zeros((len(texts), len(self.names)))
        for s in range(0, len(gram), 1 << 19):
            g, o = gram[s : s + (1 << 19)], owner[s : s + (1 << 19)]
            at, hit = _find(self.grams, g)
            log = self.table[at]
            if not hit.all():
                new, inv = np.unique(g[~hit], return_inverse=True)
                log[~hit] = self._log(new)[inv]
            for k in range(len(self.names)):
                total[:, k] -= np.bincount(o, log[:, k], len(texts))
        return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]


def train(docs: DataFrame) -> tuple[KneserNey, KneserNey]:
    """The model of all rows with a language outside the held-out split, and that of those with remainders 0 and 1 only, whose
    entropies on the others are those of texts it has not seen. All grams are kept: their number grows with the input until
    the four-letter sequences of its languages are met, and a rare language has as many as its texts give."""
    rows = docs.filter(F.col("lang").isNotNull() & (split_remainder("doc_id", 4) != 2) & F.col("text").isNotNull())
    rows = rows.select(F.concat(F.when(split_remainder("doc_id", 4) == 3, "3").otherwise("0"), "lang").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inv, np.concatenate([c for _, c in parts])).astype(np.int64)

        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if clean := letters(text):
                    by.setdefault(lang, []).append(clean)
            for lang, texts in by.items():
                for piece in _slices(texts):
                    gram = np.sort(_grams(texts[piece])[0])
                    cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                    parts = held.setdefault(lang, [])
                    parts.append((gram[cut], np.diff(np.r_[cut, len(gram)])))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            keys, c = merged(parts)
            for s in range(0, len(keys), 50_000):
                k = keys[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c[s : s + 50_000])], names=["lang", "gram", "n"])

    split = rows.mapInArrow(count, "lang string, gram long, n long").select(F.substring("lang", 2, 1 << 30).alias("lang"), "gram", "n", F.when(F.col("lang").startswith("0"), F.col("n")).otherwise(0).alias("m"))
    got = written(split.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))).toArrow()
    lang, keys, n, m = got.column("lang").combine_chunks().dictionary_encode(), *[got.column(c).to_numpy() for c in ("gram", "n", "m")]
    number, keys = lang.indices.to_numpy(), keys.view(np.uint64)
    full, part = {}, {}
    for k, name in sorted(enumerate(lang.dictionary.to_pylist()), key=lambda x: x[1]):
        own = np.flatnonzero(number == k)
        own = own[np.argsort(keys[own])]
        full[name], seen = (keys[own], n[own]), own[m[own] > 0]
        if len(seen):
            part[name] = (keys[seen], m[seen])
    return KneserNey(list(full), full), KneserNey(list(part), part)


def identify(docs: DataFrame, model: KneserNey, keep: list[str], sharpness: float = 12.0) -> DataFrame:
    """keep columns, lang_pred, entropy and score: the share of the winner when entropies are weighted by exp(-sharpness * entropy).

    `und`, score 0 and a null entropy if a text is null or has no letter, or no language was learned. Ties go to the first language by name.
    """
    shared, schema = share(docs.sparkSession, model), docs.select(*keep).schema.add("lang_pred", "string").add("entropy", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared)
        for b in batches:
            texts = [letters(t) for t in b.column(b.num_columns - 1).to_pylist()]
            known = np.array([any(map(str.isalpha, t)) and bool(m.names) for t in texts], bool)
            names, best, score = ["und"] * len(texts), np.full(len(texts), np.nan), np.zeros(len(texts))
            if known.any():
                h = m.entropies(texts)
                win = h.argmin(axis=1)
                low = h.min(axis=1)
                score = np.where(known, 1 / np.exp(-sharpness * (h - low[:, None])).sum(axis=1), 0.0)
                best = np.where(known, low, np.nan)
                names = [m.names[w] if k else "und" for w, k in zip(win, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names), pa.array(best, from_pandas=True), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "entropy", "score"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def predict(docs: DataFrame, accept: float = 0.995) -> DataFrame:
    """(doc_id, held_out, lang_pred, entropy, score, rejected), one row per row of docs; other columns of docs are not looked at.

    The limit of a language is the `accept` quantile of the entropies of training documents of that language under a model that
    has not seen them; a language without such documents rejects nothing. Null texts and texts without a letter are `und` and rejected.
    """
    model, blind = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    unseen = identify(rows.filter((split_remainder("doc_id", 4) == 3) & F.col("lang").isNotNull()), blind, ["lang"])
    limit = written(unseen.filter("lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("entropy", accept, 1000).alias("limit")))
    out = identify(rows, model, ["doc_id"]).join(small(limit), "lang_pred", "left")
    rejected = F.col("entropy").isNull() | F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False))
    return out.select("doc_id", (split_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "entropy", "score", rejected.alias("rejected"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each document row."""
    return predict(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
