"""Small tables with nulls, empty and long texts, ties, repeated rows, no rows and extra columns, against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import components, decontamination, language_id, licenses, line_dedup, near_duplicates, packing, quality, quality_rules, repeats, simhash, text_stats, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, h string"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """Documents of invented words with copies, near copies, shared passages and odd rows; the last columns clash with names used inside."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    passage = line(40)
    texts: list[str | None] = []
    for i in range(n):
        body = "\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(1, 8)))
        if i % 7 == 3:
            body += "\n" + passage
        if i % 5 == 4:
            body = texts[i - 1] or ""
        if i % 11 == 5:
            parts = (texts[i - 2] or "x y z").split(" ")
            parts[len(parts) // 2] = "changed"
            body = " ".join(parts)
        texts.append(body)
    texts += [None, "", "   \n\t ", "one", "one two three", "ÄÖ über\nÄÖ über ÄÖ", "z " * 3000, passage, passage.upper()]
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or ""), 1, 2, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def closed(n: int, links) -> list[int]:
    up = list(range(n))

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400, 401 + i) for i in range(50)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (900, 900)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = closed(1000, links)
    assert got == {i: want[i] for i in {x for ab in links for x in ab}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_fingerprint(text: str | None, k: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, none):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [reference_fingerprint(t) for _, t, *_ in rows]
    want = closed(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert got == {i: (fps[i], want[i]) for i in range(len(fps))}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("chunk", [4, 512])
def test_hamming_links_split_hot_nodes(spark, chunk):
    """One leading block holds nearly all points, so nodes split into chunks that meet pair by pair."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    points = np.unique(np.concatenate([b ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 40, 60, dtype=np.uint64) for _ in range(3)]) for b in base]))
    df = spark.createDataFrame([(i, int(np.int64(p.view(np.int64)))) for i, p in enumerate(points)], "id long, fp long")
    got = {r.id: r.component for r in components.components(simhash.hamming_links(df, 4, chunk=chunk)).collect()}
    want = closed(len(points), [(i, j) for i in range(len(points)) for j in range(i) if int(points[i] ^ points[j]).bit_count() <= 4])
    assert {i: got.get(i, i) for i in range(len(points))} == dict(enumerate(want))


def test_near_duplicate_stage(spark, docs, rows, none):
    kept = {r.doc_id for r in near_duplicates.near_duplicate_stage(spark, docs, "").collect()}
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in [(t or "").encode().lower().decode().split() for _, t, *_ in rows]]
    want = closed(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert kept == {i for i, w in enumerate(want) if i == w}
    assert near_duplicates.near_duplicate_stage(spark, none, "").count() == 0


@pytest.mark.parametrize("n", [40, 600])
def test_near_duplicates_of_one_original(spark, n):
    """Copies are alike enough to the original (0.87), not to each other (0.76)."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    texts = [" ".join(words)]
    for i in range(n):
        w = list(words)
        for k in rng.sample(range(1, 59), 4):
            w[5 * k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone = {r.doc_id: r.component_id for r in near_duplicates.duplicate_ids(df).collect()}
    assert set(gone.values()) == {0} and len(gone) >= 0.98 * n


def test_repeats(docs, rows, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in repeats.without_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()}
    assert got == {x[0]: x[1:] for x in repeats.brute_force([(i, (t or "").encode()) for i, t, *_ in rows])}
    assert repeats.without_repeats(none).count() == 0


def test_repeats_of_one_id_with_two_texts(spark):
    """A doc_id that stands for two texts: nothing that occurs only once is lost."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    one, two, three = (" ".join(word() for _ in range(40)) for _ in range(3))
    rows = [(1, one), (1, two), (2, one + " " + three), (None, one), (None, one)]
    got = {(r.doc_id, bytes(r.text).decode()): bytes(r.kept).decode() for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = min((one, two), key=lambda t: got[1, t] != t)
    assert got[1, one] == one and got[1, two] == two and got[None, one] == one and got[2, one + " " + three].endswith(three) and first


CLASHES = ["score", "_id", "own_id", "_removed", "_kept", "_gone", "gone", "_bad", "_text", "counts", "SCORE2"]


def test_stages_keep_clashing_columns(spark, tmp_path, rows):
    """Extra columns with the names used inside come out of every filtering stage as they were, in their order."""
    import corpus_pipeline

    given = [(i, t, lang, source, n, *[f"{c}{i}" for c in CLASHES]) for i, t, lang, source, n, *_ in rows]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "if Anna has 12 kg 5 m 7 s and 9 cm of 3 g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {r[0]: r[5:] for r in given}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        assert out.columns == df.columns and got, name
        assert all(tuple(r)[5:] == want[r[0]] for r in got), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name


def test_queries_follow_their_contracts(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = lambda i, m: zlib.crc32(str(i).encode()) % m
    fps = {r.doc_id: r for r in simhash.op1_simhash(spark, d).collect()}
    assert {i: r.fingerprint for i, r in fps.items()} == {i: f"{reference_fingerprint(r.text):016x}" for i, r in docs.items()}
    names = sorted(docs)
    near = closed(len(names), [(a, b) for a in range(len(names)) for b in range(a) if (int(fps[names[a]].fingerprint, 16) ^ int(fps[names[b]].fingerprint, 16)).bit_count() <= 4])
    assert [fps[i].component_id for i in names] == [names[k] for k in near]
    for op, threshold, query in ((2, 0.3, quality.op2_quality), (9, 0.5, toxicity.op9_toxicity)):
        out = query(spark, d).collect()
        assert {r.doc_id for r in out} == set(docs) and all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in out), op
    out = language_id.op3_language_id(spark, d).collect()
    langs = {r.lang for r in docs.values() if r.lang}
    assert all(r.held_out == (held(r.doc_id, 4) == 2) and r.lang_pred in langs | {"und"} for r in out)
    told = [r.lang_pred == docs[r.doc_id].lang for r in out if r.held_out and docs[r.doc_id].lang]
    assert np.mean(told) > 0.95
    want = {x[0]: x[1:] for x in repeats.brute_force([(i, (r.text or "").encode()) for i, r in docs.items()])}
    assert {r.doc_id: tuple(r)[1:] for r in repeats.op7_suffix_dedup(spark, d).collect()} == want


def test_workers_need_no_package(tmp_path):
    """From a folder where only the driver can import the package, as on a cluster."""
    import subprocess
    import sys

    from tests.conftest import ROOT

    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', 'shared').getOrCreate()\n"
        "from tidewright.llm import registry, near_duplicates\n"
        "d = '/root/testdata/sf0.001'\n"
        "docs = spark.read.parquet(d + '/documents.parquet').limit(40)\n"
        "assert near_duplicates.near_duplicate_stage(spark, docs, d).count() > 0\n"
        "for n in ('op2_quality', 'op3_language_id', 'op6_decontamination', 'op7_suffix_dedup', 'op9_toxicity'):\n"
        "    assert registry.queries()[n](spark, d).count() > 0, n\n"
    )
    import os

    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def distance(a: str, b: str) -> int:
    """Edit distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alike_equals_brute_force():
    """Near and far pairs, common ends, one text within the other, letters outside ASCII, at and around the limit."""
    rng, seen = random.Random(23), set()
    for k in range(1500):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(1, 90)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "a", "é", "b c"])
        b = "".join(b) if k % 5 else "".join(rng.choice("abc é") for _ in range(rng.randint(1, 90)))
        true = distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)
        assert line_dedup.alike(a, b, 0.8) == line_dedup.alike(b, a, 0.8) == true, (a, b)
        seen.add(true)
    assert seen == {True, False}


def test_line_hashes_stay_whole(spark):
    """Hashes over 2 ** 63 next to small ones, nulls, empty texts and a line of several hundred words."""
    texts = ["\n".join(f"line number {i} of text {t} goes on" for i in range(40)) for t in range(3)] + [None, "", "\n\n", " ".join(f"w{i}" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.with_signatures(df).selectExpr("doc_id", "no", "h", "size(keys) AS k").collect()
    lines = spark.createDataFrame([(d, n, x) for d, t in enumerate(texts) if t for n, x in enumerate(t.split("\n")) if len(x.split()) > 4], "d long, n int, x string")
    assert {(r.doc_id, r.no, r.h) for r in got} == {tuple(r) for r in lines.selectExpr("d", "n", "xxhash64(x)").collect()} and len(got) == 121
    assert all(r.k > 0 for r in got)


def test_line_dedup_recall(spark):
    """Of all pairs of lines with an edit similarity of 0.8, nine in ten at least come into one group; short and long lines, few and many edits."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    lines = []
    for k in range(240):
        base = [word() for _ in range([6, 9, 14, 30, 60, 500][k % 6])]
        copy = list(base)
        for _ in range(max(1, len(base) // [20, 12][k % 2])):
            copy[rng.randrange(len(copy))] = word()
        lines += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.duplicate_lines(df).collect()}
    alike = [2 * k + 1 for k in range(240) if len(lines[2 * k]) > 1000 or distance(lines[2 * k], lines[2 * k + 1]) <= 0.2 * max(map(len, lines[2 * k : 2 * k + 2]))]
    assert len(alike) > 150 and len(gone & set(alike)) >= 0.9 * len(alike) and gone <= set(range(1, 480, 2)), (len(alike), len(gone & set(alike)))


def test_line_dedup_compares_few_pairs(spark, monkeypatch):
    """Two families that share blocks, of lengths too far apart to be alike: pairs grow with the lines, not with the product of the families."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9)))
    base, lines = [word() for _ in range(60)], []
    for k in range(160):
        copy = base[: 60 if k % 2 else 44]
        for _ in range(3):
            copy[rng.randrange(len(copy))] = word()
        lines.append(" ".join(copy))
    counts, real = [], line_dedup.written

    def counted(df):
        out = real(df)
        if df.columns == ["h1", "h2"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    gone = {r.doc_id for r in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert gone == set(range(2, 160)) and 0 < sum(counts) < 12 * 160, (sorted(set(range(2, 160)) ^ gone), counts)
    assert line_dedup._distance("kitten", "sitting", 3) == 3 and line_dedup._distance("a" * 90, "b" * 90, 20) == 21


def test_merge_transforms():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 60))) for _ in range(30)]
    block, at = repeats.merge_transforms(strings, 10), 0
    seen: dict[bytes, set[int]] = {}
    for s in strings:
        for i in range(len(s) - 9):
            seen.setdefault(s[i : i + 10], set()).add(int(block[at + i]))
        at += len(s) + 1
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.word_bpe())
    out = [r.asDict() for r in packing.pack(docs, packing.word_bpe(), capacity=256, block_windows=4).collect()]
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    sequences: dict[int, list] = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(none, packing.word_bpe()).count() == 0


@pytest.mark.parametrize("text", ["áb ́c", "x\x85y\xa0z\x1cq", "<|endoftext|>hi<|startoftext|> yo <|x|>", "İstanbul ΑΣ Σ ß ﬁ ẞ", "don't we'll it's''s DON'T I'VE ''ll", "12a3 ½ ²", " k　j", "", "×÷ À×b Ÿ ŉ ŀ ſs ǅ ø", "a_b-c...d!!$%&", "\x7f \x01a", "日本語 ж"])
def test_tokenizer_equals_library(text):
    from tokenizers import Tokenizer

    own, library = packing.WordTokenizer(packing.word_bpe()), Tokenizer.from_file(packing.word_bpe())
    assert own.encode([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_tokenizer_that_forgets_equals_library():
    from tokenizers import Tokenizer

    own, library, rng = packing.WordTokenizer(packing.word_bpe(), most=30, late=20), Tokenizer.from_file(packing.word_bpe()), random.Random(21)
    for _ in range(60):
        texts = [" ".join("".join(rng.choice("abcXYZ019'.,-éßñ日<|>\u0301") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own) <= 30 + 20 + 90


def test_pack_block_takes_more_windows():
    """Three pieces of 60 in two windows of 100 cannot stay whole; no piece is cut."""
    items = [(i, 0, 60) for i in range(3)]
    assert sorted(packing.pack_block(items, 100)) == [[x] for x in items]
    rng = random.Random(22)
    items = [(i, 5, rng.randint(1, 99)) for i in range(300)]
    windows = packing.pack_block(items, 100)
    assert sorted(x for w in windows for x in w) == items and all(sum(n for _, _, n in w) <= 100 for w in windows)
    assert len(windows) <= 1.03 * sum(n for _, _, n in items) / 100 + 1


def test_largest_differencing():
    rng = random.Random(6)
    sizes = [rng.randint(1, 1000) for _ in range(200)]
    parts = packing.largest_differencing(sizes, 16)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(200)) and max(sums) - min(sums) < 50


def test_line_dedup(docs, rows, none):
    out = {r.doc_id: r for r in line_dedup.without_duplicate_lines(docs).collect()}
    seen: dict[str, tuple] = {}
    for i, text, *_ in rows:  # exact repeats of normal forms at least
        for n, line in enumerate((text or "").split("\n")):
            normal = " ".join("".join(c if ord(c) > 127 or c.isalnum() else " " for c in line.lower()).split())
            if len(normal.split(" ")) >= 5:
                if normal in seen:
                    assert n in (out[i]["_removed"] or []), (i, n)
                seen.setdefault(normal, (i, n))
    for i, text, *_ in rows:
        gone = out[i]["_removed"]
        assert out[i]["_kept"] == (text if gone is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone))
    assert line_dedup.without_duplicate_lines(none).count() == 0


def test_line_dedup_finds_edited_lines(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    line = " ".join([*words[:60], "seven", *words[60:]])
    df = spark.createDataFrame([(1, line), (2, "first\n" + line.replace("seven", "eight")), (3, "an unrelated line of words that says something else entirely today")], "doc_id long, text string")
    assert {r.doc_id: r["_removed"] for r in line_dedup.without_duplicate_lines(df).collect()} == {1: None, 2: [1], 3: None}


def test_decontamination(spark, none):
    bench = spark.createDataFrame([(1, "If Anna buys 5 apples for 3 dollars and then Anna gives 2 apples away how many are left"), (2, None), (3, ""), (4, "short one"), (1, "If Anna buys 5 apples for 3 dollars and then Anna gives 2 apples away how many are left")], "item_id long, text string")
    df = spark.createDataFrame([
        (1, "noise here. If Bob buys 7 apples for 9 dollars and then Bob gives 4 apples away how many are left? yes"),
        (2, "If Bob buys 7 apples for 9 dollars and then Carl gives 4 apples away how many are left"),  # fillers differ
        (3, None), (4, ""), (5, "nothing of the kind stands in this text, not even a part of it"), (6, "A heading:\nShort one\nmore"), (7, "not a short one here"), (1, "noise"),
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == {(1, 1), (6, 4)}
    assert decontamination.leaks(none, bench).count() == 0
    assert decontamination.leaks(df, bench.limit(0)).count() == 0


def test_decontamination_of_fillers_and_short_items(spark):
    sums = "12 15 27 30 41 71 5 6 11 90 9 99"
    names = "Anna Berta Carl Dora Emil Fritz Gerd Hanna Ida Jonas Karl Lena"
    story = "When Anna came home from the market late in the evening 14 people sat down at the long table and ate 3 loaves of bread"
    bench = spark.createDataFrame([(1, sums), (2, names), (3, "Water boils at which temperature"), (4, story)], "item_id long, text string")
    df = spark.createDataFrame([
        (1, "see " + sums), (2, "guests were " + names), (3, "he asked Water boils at which temperature"), (4, "see 13 16 29 31 42 73 6 7 13 91 8 99"),
        (5, "so " + story.replace("3 loaves", "14 loaves")),  # 14 and 3 both 14: consistent
        (6, "so " + story.replace("14 people", "8 people") + " or When Anna left"),
        (7, story.replace("Anna", "Berta") + " " + story.replace("14 people", "Max people")),
    ], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontamination.leaks(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 4), (7, 4)} and got[1, 1] == 5 and got[2, 2] == 5


def test_decontamination_of_units_and_tiny_items(spark):
    item = "If Anna has 12 kg 5 m 7 s and 9 cm of 3 g"
    bench = spark.createDataFrame([(1, item), (2, "The"), (3, "capital of")], "item_id long, text string")
    df = spark.createDataFrame([
        (1, "Here: " + item), (2, "so, if Bob has 13 kg 6 m 8 s and 10 cm of 4 g"), (3, "The capital of the land. The end"), (4, "if Bob has 13 kg and 6 m of rope")
    ], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == {(1, 1), (2, 1)}


def test_decontamination_keeps_windows_beside_a_mixed_filler(spark):
    words = "the quick brown fox jumps over a lazy dog while seven small birds watch from their high branches and sing all day about summer"
    bench = spark.createDataFrame([(1, f"then 5 came. {words} until 5 left")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"then 6 came. {words} until 7 left")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()] == [(1, 1)]


def labelled(n: int = 600) -> tuple[list, list]:
    rng = random.Random(8)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(300)]
    docs, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if bad:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", "moron"]))
        junk = i % 5 == 1
        docs.append((i, " ".join(t + "###" if junk else t for t in text)))
        marks.append((i, int(not junk), int(bad)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "x")], marks


def test_toxicity(spark, none):
    docs, marks = labelled()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in held]) > 0.95 and len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    empty = toxicity.train(none, lab.limit(0))
    assert toxicity.score(none, empty).count() == 0 and toxicity.score(df, empty).count() == len(docs)


def test_toxicity_learns_pairs():
    """A group's name is as common among harmless rows as among toxic ones, and an insult too; only together they are toxic."""
    rng, names = np.random.default_rng(16), [b"term%d" % i for i in range(400)]
    docs, y = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.5
        toxic = insult and group
        if insult and not group and rng.random() < 0.6:
            toxic, insult = False, False
        docs.append(b" ".join([*rng.choice(names, 40), *([b"insult"] if insult else []), *([b"group"] if group else [])]))
        y.append(float(toxic))
    sets, y = [toxicity.term_slots(x) for x in docs], np.array(y)
    model = toxicity.FactorizationMachine().fit(sets[:2500], y[:2500])
    assert set(toxicity.term_slots(b"insult group").tolist()) <= set(model.slots.tolist()) and len(model.slots) < 40
    guess = model.margins(sets[2500:]) > 0
    assert (guess == (y[2500:] > 0)).mean() > 0.97
    alone = model.margins([toxicity.term_slots(x) for x in (b"insult term1", b"group term1", b"insult group term1")])
    assert alone[2] > 0 > max(alone[:2])


def test_quality(spark, none):
    docs, marks = labelled()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    counts = text_stats.with_counts(df, ["doc_id"])
    got = {r.doc_id: r.score for r in quality.score(counts, quality.train(counts, lab)).collect()}
    held = [m for m in marks if zlib.crc32(str(m[0]).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q, _ in held]) > 0.95 and len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    nothing = quality.train(text_stats.with_counts(none, ["doc_id"]), lab)
    assert {r.score for r in quality.score(counts, nothing).collect()} == {0.5}


def test_isotonic():
    x, y = quality.pool_adjacent(np.arange(5.0), np.array([0.0, 0.5, 0.2, 0.9, 0.8]), np.ones(5))
    assert np.allclose(y, [0, 0.35, 0.85]) and (np.diff(x) > 0).all()


def test_counts():
    import re

    for text in [t for _, t, *_ in corpus(20)] + ["a b c a b c a", "#x $y\n#x $y\n\n", "é\x85ü ñ"]:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        got = dict(zip(text_stats.COLUMNS, text_stats.count_text(None if text is None else t.encode()), strict=True))
        assert [got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def test_quality_rules(spark, docs, rows, none):
    rng = random.Random(9)
    clean = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(90)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(x + "##|$$" for x in clean[i][1].split()), "en", "s") for i in range(8)]
    short = [(2000, "a b", "en", "s"), (2001, None, None, None), (2002, "a b c " * 40, "en", "s")]
    df = spark.createDataFrame(clean + junk + short, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert sum(got[i].kept for i, *_ in clean) >= 198 and not any(got[i].kept for i, *_ in junk)
    assert all(got[i].base_failed and not got[i].kept for i, *_ in short)
    assert quality_rules.apply_rules(docs).count() == len(rows) and quality_rules.apply_rules(none).count() == 0


def test_minimum_determinant_against_exact(spark):
    """On groups of 12 rows all subsets of 9 can be gone through."""
    from itertools import combinations

    rng, floor = np.random.default_rng(15), {x: 0.3 for x in quality_rules.STATS}
    groups = {f"g{k}": np.r_[rng.normal(k, 1.0, (9, 5)), rng.normal(k + 9, 0.5, (3, 5))] for k in range(4)}
    rows = spark.createDataFrame([(g, *map(float, x)) for g, a in groups.items() for x in a], "grp string, " + ", ".join(f"{x} double" for x in quality_rules.STATS))
    got = {r.grp: r for r in quality_rules.minimum_determinant(quality_rules.written(rows), floor).collect()}
    logdet = lambda a: np.linalg.slogdet(np.cov(a.T, bias=True) + np.eye(5) * 0.09)[1]
    for g, a in groups.items():
        best = min((logdet(a[list(c)]), c) for c in combinations(range(12), 9))
        assert best[1] == tuple(range(9)) and abs(got[g].logdet - best[0]) < 1e-6 and np.allclose(got[g].m, a[:9].mean(axis=0))


def test_quality_rules_pools(spark):
    """Null languages are no part of the pool of all small groups."""
    rows = [(i, float(i % 7), None, "s") for i in range(60)] + [(100 + i, 50.0 + i, "xx", f"t{i}") for i in range(10)]
    df = quality_rules._grouped(spark.createDataFrame(rows, "id long, x double, lang string, source string"), 50)
    by = {r.grp: r.n for r in df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(by.values()) == [10, 60]


def test_quality_rules_reject_repetition_alone(spark):
    """Documents that differ from a clean group only in duplicate lines, or only in repeated words."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9)))
    clean = [[[word() for _ in range(9)] for _ in range(10)] for _ in range(200)]
    text = lambda lines: "\n".join(" ".join(x) for x in lines)
    short = [[[word() for _ in range(6)] for _ in range(10)] + [["ab", "cd"]] * 15 for _ in range(4)]
    rows = [(i, text(x), "en", "s") for i, x in enumerate(clean)] + [(1000 + i, text(x), "en", "s") for i, x in enumerate(short)]
    for i in range(4):  # 36 of 90 words stand in a three-word sequence that comes twice
        x = clean[i][:6] + [clean[i][0][:6] + clean[i][1][:3], clean[i][1][3:] + clean[i][2][:3], clean[i][8], clean[i][9]]
        rows.append((2000 + i, text(x), "en", "s"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(200))
    assert all(got[i].n_repeat_words * 2 <= got[i].n_words and not got[i].base_failed for i in got if i >= 1000)
    assert not any(got[i].kept for i in got if i >= 1000), [(i, got[i].n_words, got[i].n_dup_lines, got[i].n_repeat_words, got[i].distance) for i in got if i >= 1000]


def test_language_id(spark, none):
    rng = random.Random(10)
    tongue = {"aa": ["ba", "ki", "no", "ru"], "bb": ["sch", "tz", "eu", "ent"], "cc": ["ñi", "llo", "que", "ar"]}
    make = lambda t: " ".join("".join(rng.choice(tongue[t]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(t), t) for i, t in enumerate(["aa", "bb", "cc"] * 40)] + [(500, None, "aa"), (501, "123 !!", None), (502, make("bb"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df).collect()}
    assert all(got[i].lang_pred == t for i, _, t in rows[:120]) and got[502].lang_pred == "bb"
    assert got[500].lang_pred == got[501].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    model, _ = language_id.train(df)
    total = sum(np.exp(model._log(np.array([ord(c) | ord("a") << 16 | ord("b") << 32 | 32 << 48 for c in map(chr, range(1, 70))], np.uint64))).sum(axis=0))
    assert total < 3.01  # at most one in all for each language
    assert language_id.predict(none).count() == 0
    assert {r.lang_pred for r in language_id.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_licenses(spark, none):
    mit = licenses.LICENSES[0][1]
    df = spark.createDataFrame([(1, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (2, "text\nReleased under the  MIT Licence!\nmore"), (3, None), (4, ""), (5, "nothing"), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert {(r.doc_id, r.license, r.n_lines, r.whole) for r in licenses.scan(df).collect()} == {(1, "MIT", 0, True), (2, "MIT", 1, False), (None, "CC-BY-NC-4.0", 1, True)}
    assert licenses.scan(none).count() == 0


def test_licenses_of_a_table(spark):
    """A table of whole texts takes the place of the fixed list; layout, case and copyright lines do not matter."""
    text = "The Example Licence\n\nYou may use, copy\nand sub-license this work."
    known = licenses.digests(spark.createDataFrame([("Example-1.0", text), ("None", None)], "license string, text string"))
    df = spark.createDataFrame([(1, "Copyright 2021 B\nTHE EXAMPLE LICENSE. You may use, copy and sublicense this work!"), (2, text + " Not.")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.whole) for r in licenses.scan(df, known).collect()] == [(1, "Example-1.0", True)]


def test_licenses_equal_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = {tuple(r) for r in con.sql("SELECT doc_id, license, n_lines, whole FROM (" + licenses.op10_sql() + ")").fetchall()}
    assert {(r.doc_id, r.license, r.n_lines, r.whole) for r in licenses.op10_license_scan(spark, d).collect()} == want


def test_pipeline(spark):
    import corpus_pipeline
    from tidewright.llm._common import documents, written

    d = "/root/testdata/sf0.001"
    before = docs = documents(spark, d)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d))
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
            before = docs
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
