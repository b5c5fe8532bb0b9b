"""Ranked search, mixing and alignment against brute force, on small tables with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, corpus
from tidewright.llm import alignment, mixing, ranked_search

ODD = ["", "a", "  b \n\n c", "x▁y", "é日本語 text", "\n", "\n\n x", "a\t\n b", "a\t b\r\n c\r\n\r\n", "x  y　 \n z", "a \x1c b", ") \r\n", "<|endoftext|> <s> </s>", " ", " \n ", "don't 12,5 % of\tit"]


@pytest.fixture(scope="module")
def rows():
    odd = [(1000 + i, t, None, None, 0, 1, 2, "x") for i, t in enumerate(ODD)]
    twice = [(5, "said twice over", "en", "s1", 0, 1, 2, "x")] * 3 + [(None, "no id here", "en", "s1", 0, 1, 2, "x"), (None, None, None, "s9", 0, 1, 2, "x")]
    return corpus() + odd + twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- ranked search


def best_by_hand(rows, items, k):
    found = [(r[0], re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    n_docs, n_terms = sum(1 for _, t in found if t), sum(len(t) for _, t in found)
    df = collections.Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in items:
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for doc, ts in found:
            tf = collections.Counter(ts)
            m = 50 + 50 * len(ts) * n_docs // n_terms if ts else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in asked if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        scores.sort()
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(scores[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block", [(5, 400_000), (50, 30)])
def test_ranked_search_equals_all_scores(spark, docs, rows, k, block):
    items = [(i, rows[j][1]) for i, j in enumerate([0, 3, 10, 60, 61, 66])] + [(99, "ÄÖ über z Z one"), (99, "two three nowhere"), (7, "said TWICE; over-over")]
    table = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, query long")
    assert plain(ranked_search.search(docs, table, k, block)) == best_by_hand(rows, items, k)


def test_ranked_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0
    assert ranked_search.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_buckets_pass_over_what_cannot_score():
    """With a k-th score known, most vectors of unlike documents are not scored in integers, and no better one is missed."""
    rng = np.random.default_rng(3)
    q = ranked_search.Queries([0], [[b"a", b"b", b"c"]])
    q.number.update({str(i).encode(): i for i in range(3, 200)})
    q.weigh(rng.integers(200, 9000, 200))
    n = 3000
    sets = [np.sort(rng.choice(200, rng.integers(1, 30), replace=False)) for _ in range(n)]
    impact = [rng.integers(1, 900_000, len(s)) for s in sets]
    length = np.array([math.sqrt((q.weights[s] * x.astype(float) ** 2).sum()) for s, x in zip(sets, impact, strict=True)])
    order = np.argsort(-length)
    score = np.array([sum(int(w) * int(x) for t, w, x in zip(sets[i], q.weights[sets[i]], impact[i], strict=True) if t < 3) for i in order])
    starts = np.r_[0, np.cumsum([len(sets[i]) for i in order])]
    ids, flat = np.concatenate([sets[i] for i in order]), np.concatenate([impact[i] for i in order])
    best = [ranked_search.Best(10, int(np.sort(score)[-10]))]
    scored = 0
    for i, j in ranked_search._buckets(length[order]):
        part = slice(starts[i], starts[j])
        scored += ranked_search.search_bucket(q, best, length[order][i:j], starts[i : j + 1] - starts[i], ids[part], flat[part], np.zeros(j - i, bool), np.arange(i, j))
    want = np.lexsort((np.arange(n), -score))[:10]
    assert best[0].doc[np.lexsort((best[0].doc, -best[0].score))].tolist() == want.tolist()
    assert 10 <= scored < n // 5


# ---- mixing


def mixed_by_hand(rows, weights=(1, 2, 3), most=3):
    sized = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    size = {s: sum(n for _, x, n in sized if x == s) for s in names}
    total, full = sum(size.values()), set()
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while True:
        left, wide = total - sum(most * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: float(most * size[s]) if s in full else left * weight[s] / wide for s in names}
        over = {s for s in names if target[s] > most * size[s]}
        if not over:
            break
        full |= over
    queue, copies = [], []
    for rank, s in enumerate(names):
        mine = sorted(((hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0, n) for d, x, n in sized if x == s))
        sent = 0
        for _, there, d, n in mine:
            sent += n
            queue.append([d if there else None, n, size[s], target[s], 0])
            if n:
                copies += [((c * size[s] + sent) / target[s], rank, c * size[s] + sent, len(queue) - 1) for c in range(most)]
    left = total
    for _, _, _, at in sorted(copies):
        take = min(left, queue[at][1])
        queue[at][4] += take
        left -= take
    return sorted(map(tuple, queue), key=str)


def test_mix_equals_one_queue_at_a_time(docs, rows):
    got = mixing.mix(docs).drop("source").collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in got if r.doc_id is not None) == sorted((a, b, c, e) for a, b, c, _, e in mixed_by_hand(rows) if a is not None)
    assert sum(r.taken for r in got) == sum(r.size for r in got) and len(got) == len(rows)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(x[2], round(x[3], 6)) for x in mixed_by_hand(rows)}
    assert plain(mixing.mix(docs.repartition(7))) == plain(mixing.mix(docs))


def test_targets_stop_at_three_sizes_and_are_met(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), "tiny" if i % 50 == 0 else "a_hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = collections.defaultdict(int)
    for r in got:
        by[r.source, r.source_size, r.target] += r.taken
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert all(abs(taken - target) <= 61 for (_, _, target), taken in by.items())
    assert any(target == 3 * size for _, size, target in by)


def test_mix_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0, 0]


def test_running_totals_over_batches_and_equal_rows(spark):
    rows = [(i % 3, 7 if i % 2 else i, i % 5) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = mixing.running_totals(spark.createDataFrame(rows, "g long, k long, n long"), [F.col("g"), F.col("k")], "n", "g").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(3):
        mine = sorted((r.total, r.k, r.n) for r in got if r.g == g)
        assert mine[-1][0] == sum(n for x, _, n in rows if x == g)
        assert [k for _, k, n in mine if n] == sorted(k for _, k, n in mine if n)
        assert sorted(t for t, _, n in mine if n) == [t for t, _, n in sorted(mine) if n] and len({t for t, _, n in mine if n}) == sum(1 for *_, n in mine if n)


# ---- alignment


def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def aligned_by_hand(known, text):
    a, b, want = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text), (" " + text).encode()
    if not text or b"".join(known.bytes_a[i] for i in a) != want or b"".join(known.bytes_b[i] for i in b) != want:
        return (0, 0, 0, 0, 0), "", {}
    end_a, end_b = ([0, *np.cumsum([len(by[i]) for i in ids]).tolist()] for by, ids in ((known.bytes_a, a), (known.bytes_b, b)))
    cuts, links, shared, said, at = sorted(set(end_a) & set(end_b)), collections.Counter(), 0, [], (0, 0)
    for c in cuts[1:]:
        i, j = end_a.index(c), end_b.index(c)
        said.append(",".join(map(str, a[at[0] : i])) + "|" + ",".join(map(str, b[at[1] : j])))
        for x in range(at[0], i):
            for y in range(at[1], j):
                shared += 1
                if end_b[y] < end_a[x + 1] and end_a[x] < end_b[y + 1]:
                    links[a[x], b[y]] += 1
        at = i, j
    return (len(a), len(b), len(said), sum(links.values()), shared), hashlib.sha256(";".join(said).encode()).hexdigest(), dict(links)


def fuzzed(n=400):
    rng = random.Random(3)
    return ["".join(rng.choice(" \n\t\r aB1.é日▁;) ") for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("most,units", [(150_000, True), (50, True), (0, False)])
def test_texts_align_as_by_hand(most, units):
    """Whether units are remembered, forgotten all the time or not used."""
    known = alignment.Tokenizers(*paths(), most=most, late=20)
    assert known.in_units
    known.in_units = units
    texts = ODD + fuzzed() + ["w" * 3000 + " " + "né" * 500]
    for at in range(0, len(texts), 60):
        part = texts[at : at + 60]
        counts, digests, starts, pairs, times = alignment.align_texts(known, part)
        for k, text in enumerate(part):
            want = aligned_by_hand(known, text)
            got = {(p // known.width, p % known.width): t for p, t in zip(pairs[starts[k] : starts[k + 1]].tolist(), times[starts[k] : starts[k + 1]].tolist(), strict=True)}
            assert (tuple(counts[k].tolist()), digests[k], got) == want, text


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.4), rng.integers(0, 3, (9, 5)) * (rng.random((9, 5)) < 0.4)
    made = [alignment.Rows(np.r_[0, np.cumsum((m != 0).sum(1))], np.nonzero(m)[1], m[m != 0], m.shape[1]) for m in (a, b)]
    got, dense = alignment.product(*made), np.zeros((7, 5), int)
    for i in range(7):
        dense[i, got.column[got.start[i] : got.start[i + 1]]] = got.value[got.start[i] : got.start[i + 1]]
    assert (dense == a @ b).all()
    back = alignment.transposed(alignment.transposed(made[0]))
    assert (back.start == made[0].start).all() and (back.column == made[0].column).all() and (back.value == made[0].value).all()


@pytest.mark.parametrize("most_sent", [1 << 20, 300, 0])
def test_alignment_of_a_table(docs, rows, most_sent):
    """Pairs that are sent, joined, or some of both, give the same counts."""
    known = alignment.Tokenizers(*paths())
    made = [(r[0], aligned_by_hand(known, r[1] or "")) for r in rows]
    n = collections.Counter(p for _, (_, _, links) in made for p in links)
    top = collections.defaultdict(int)
    for (a, _), x in n.items():
        top[a] = max(top[a], x)
    want = []
    for doc, (counts, digest, links) in made:
        best = sum(t for p, t in links.items() if n[p] == top[p[0]])
        want.append((doc, *counts, best, sum(t * n[p] for p, t in links.items()), digest))
    assert plain(alignment.align(docs, *paths(), most_sent=most_sent)) == sorted(want, key=str)


def test_alignment_of_nothing(none):
    assert alignment.align(none, *paths()).count() == 0
