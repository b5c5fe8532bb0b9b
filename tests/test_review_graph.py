"""The graph of reviews against a walk through each review, row by row."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from tidewright.operators import review_graph as G

TYPES = [("PRD", False), ("ING", False), ("PER", False), ("Scent", True), ("Feel", True)]
ALIASES = [("B-ING", "ING"), ("T-Feel", "Feel"), ("X", "Y")]
HELD = {"it": ("review_target", "PRD"), "i": ("reviewer", "PER"), "review target": ("review_target", "PRD")}
CODES = {"affects": "AFFECTS", "uses": "USES", "has_attribute": "HAS_ATTRIBUTE"}
TONES = {"good": "POS", "bad": "NEG"}
BEE = {c for c, b in TYPES if b}


def norm(t):
    return " ".join(t.lower().split())


def hid(*parts):
    return hashlib.sha256("::".join(p or "" for p in parts).encode()).hexdigest()[:32]


def tone(raw):
    return "NEU" if not raw else TONES.get(raw.strip(), raw.upper())


def type_of(grp):
    code = dict(ALIASES).get(grp, grp)
    return "BEE_ATTR" if code in BEE else code


class Walk:
    """One review, in the order of its rows."""

    def __init__(self, product, brand, spans, phrases, relations):
        self.made, self.by_key, self.by_place, self.related, self.same, self.edges, self.words, self.bare = [], {}, {}, set(), [], [], {}, []
        for s in spans:
            self.get(*s[1:6], "ner", s[0])
        for p in phrases:
            m = self.get(*p[1:6], "bee", (1 << 40) + p[0])
            if p[6] is not None:
                m["linked"], m["attribution"] = p[6], p[7]
        if brand:
            self.get(brand, "BRD", None, None, None, "meta", 2 << 40)
        for r in relations:
            self.relate(r)
        target = next((m for m in self.made if m["kind"] == "review_target"), None) or self.get("Review Target", "PRD", None, None, None, "synthetic", 4 << 40)
        for m in [m for m in self.made if m["type"] == "BEE_ATTR" and m["at"] not in self.related]:
            self.edges.append((target, m, "HAS_ATTRIBUTE", "NEU", 0.4, "BEE_SYNTHETIC", False, "unlinked"))
            self.bare.append((m["at"], m["word"]))
        self.canon(product or "UNKNOWN", brand, target)

    def get(self, word, grp, start, end, tone_, source, at):
        kind, held = HELD.get((word or "").strip().lower(), (None, None))
        kind_type = held or type_of(grp or "")
        key = (kind_type, word or "", start, end)
        if key not in self.by_key:
            m = {"at": at, "type": kind_type, "word": word or "", "grp": grp or "", "kind": kind, "source": source, "start": start, "end": end, "linked": None, "attribution": None, "tone": tone(tone_) if kind_type == "BEE_ATTR" and tone_ else None}
            self.by_key[key] = m
            self.made.append(m)
            if start is not None and end is not None:
                self.by_place.setdefault((start, end), m)
        return self.by_key[key]

    def find(self, word, grp, start, end, tone_, at):
        t = type_of(grp or "")
        if m := self.by_key.get((t, word or "", start, end)):
            return m
        if start is not None and end is not None and (start, end) in self.by_place:
            return self.by_place[start, end]
        return self.by_key.get((t, word or "", None, None)) or self.get(word, grp, start, end, tone_, "relation", at)

    def relate(self, r):
        ord_, s, o, code, source, tone_, keywords = r
        at = (3 << 40) + 2 * ord_
        a, b = self.find(*s, None, at), self.find(*o, tone_, at + 1)
        if (code or "").lower() == "same_entity":
            self.same.append((a["at"], b["at"]))
            return
        if (code or "").lower() == "no_relationship":
            return
        if source == "NER-BeE" or (o[1] or "") in BEE:
            edge, edge_tone = "HAS_ATTRIBUTE", "NEU"
            self.related.add(b["at"])
            if tone_:
                b["tone"] = tone(tone_)
            if keywords:
                for k in keywords:
                    if k and k.strip():
                        self.words.setdefault((k.strip(), o[1] or ""), b)
            elif o[0] and len(o[0]) > 1 and norm(o[0]):
                self.bare.append((at + 1, o[0]))
        elif code in CODES:
            edge, edge_tone = CODES[code], tone(tone_)
        else:
            return
        self.edges.append((a, b, edge, edge_tone, 0.8 if source == "NER-BeE" else 1.0, None, b["linked"], b["attribution"]))

    def canon(self, product, brand, target):
        up = {m["at"]: m["at"] for m in self.made}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in self.same:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        groups = collections.defaultdict(list)
        for m in self.made:
            groups[root(m["at"])].append(m)
        self.entity, self.entities = {}, {}
        for members in groups.values():  # in the order of their first member
            held = sorted((m for m in members if m["kind"]), key=lambda m: (0 if m["kind"] == "review_target" else 1, m["at"]))
            often = collections.Counter(m["word"] for m in members)
            rep = held[0] if held else min(members, key=lambda m: (-often[m["word"]], m["at"]))
            if rep["kind"]:
                e = (hid(rep["type"], rep["kind"], product), rep["type"], rep["kind"], None, None)
            elif rep["grp"] in BEE:
                e = (hid("BEE_ATTR", norm(rep["grp"])), "BEE_ATTR", rep["grp"], rep["tone"], rep["word"])
            else:
                e = (hid(rep["type"], norm(rep["word"])), rep["type"], rep["word"], None, None)
            row = self.entities.setdefault(e[0], [e[1], e[2], e[3], [], 0])
            row[4] += 1
            if e[4] is not None and e[4] not in row[3]:
                row[3].append(e[4])
            for m in members:
                self.entity[m["at"]] = e[0]
        out = {}

        def edge(s, kind, o, tone_, sure, evidence, linked, attribution):
            x = out.setdefault((s, kind, o, tone_), [0, None, None, None, None])
            x[0] += 1
            x[1] = sure if sure is not None else x[1]
            x[2] = evidence or x[2]
            if linked is not None:
                x[3:] = linked, attribution

        for a, b, kind, tone_, sure, evidence, linked, attribution in self.edges:
            edge(self.entity[a["at"]], kind, self.entity[b["at"]], tone_, sure, evidence, linked, attribution)
        for (k, _), b in self.words.items():
            self.entities.setdefault(hid("KEYWORD", norm(k)), ["KEYWORD", k, None, [], 1])
            edge(self.entity[b["at"]], "HAS_KEYWORD", hid("KEYWORD", norm(k)), "NEU", None, None, None, None)
        if brand:
            self.entities.setdefault(hid("BRD", norm(brand)), ["BRD", brand, None, [], 1])
            edge(self.entity[target["at"]], "OFFICIAL_BRAND", hid("BRD", norm(brand)), "NEU", None, None, None, None)
        self.out = out


def reviews(n=150, seed=4):
    rng = random.Random(seed)
    words, groups = ["aloe", "Aloe", "it", "I", "rose oil", "soft", "This", "Review Target", ""], ["PRD", "ING", "B-ING", "PER", "Scent", "Feel", "T-Feel", "X", "Z"]
    place = lambda: rng.choice([(None, None), (3, None), (1, 4), (1, 4), (5, 9), (2, 6)])
    end = lambda: (rng.choice(words), rng.choice(groups), *place())
    for i in range(n):
        few = lambda k: range(rng.randint(0, k))
        spans = [(k, *end(), rng.choice([None, "good", "meh"])) for k in few(5)]
        said = [(k, rng.choice(words), rng.choice(["Scent", "Feel", "T-Feel", "ING"]), *place(), rng.choice([None, "good", " bad", "meh", ""]), rng.choice([None, True, False]), rng.choice(["direct", None])) for k in few(4)]
        told = [(k, end(), end(), rng.choice(["affects", "uses", "same_entity", "Same_Entity", "no_relationship", "odd", None, "has_attribute"]), rng.choice(["NER-BeE", "NER-NER", None]), rng.choice([None, "good", "bad", ""]), rng.choice([None, [], ["rich", " thick "], ["", "rich", None]])) for k in few(9)]
        yield f"r{i}", rng.choice(["p1", "p2", None]), rng.choice(["Dove", "it", None, ""]), spans, said, told


@pytest.fixture(scope="module")
def made(spark):
    given = list(reviews())
    span = "review_id string, ord long, word string, grp string, start long, end long, sentiment string"
    frame = spark.createDataFrame
    rows = G.review_rows(
        frame([(r, p, b) for r, p, b, *_ in given], "review_id string, product_id string, brand string"),
        frame([(r, *s) for r, _, _, x, _, _ in given for s in x], span),
        frame([(r, *s) for r, _, _, _, x, _ in given for s in x], span + ", linked boolean, attribution string"),
        frame([(r, o, *a, *b, *rest) for r, _, _, _, _, x in given for o, a, b, *rest in x],
              "review_id string, ord long, subj_word string, subj_grp string, subj_start long, subj_end long, obj_word string, obj_grp string, obj_start long, obj_end long, relation string, source_type string, sentiment string, keywords array<string>"),
        G.entity_groups(frame(TYPES, "code string, is_bee boolean"), frame(ALIASES, "alias string, code string")),
        frame([(w, *k) for w, k in HELD.items()], "word string, kind string, type string"),
        frame(list(CODES.items()), "code string, edge string"),
        frame(list(TONES.items()), "sentiment string, polarity string"),
    )
    return {r: Walk(p, b, *x) for r, p, b, *x in given}, rows


def test_mentions(made):
    walks, rows = made
    got = {(m.review_id, m.mention): m for m in G.mentions(rows).collect()}
    want = {(r, m["at"]): (w, m) for r, w in walks.items() for m in w.made}
    assert set(got) == set(want)
    for k, (w, m) in want.items():
        g = got[k]
        assert (g.source, g.type, g.word, g.start, g.end, g.placeholder, g.sentiment, g.confidence, g.entity_id) == (m["source"], m["type"], m["word"], m["start"], m["end"], m["kind"], m["tone"], G.SOURCE_CONFIDENCE[m["source"]], w.entity[m["at"]]), k


def test_entities(made):
    walks, rows = made
    got = {(e.review_id, e.entity_id): (e.entity_type, e.name, e.polarity, e.phrases, e.weight) for e in G.entities(rows).collect()}
    assert got == {(r, e): tuple(x) for r, w in walks.items() for e, x in w.entities.items()}


def test_edges(made):
    walks, rows = made
    got = {(e.review_id, e.subject, e.edge, e.object, e.sentiment): (e.weight, e.confidence, e.evidence_kind, e.linked, e.attribution) for e in G.edges(rows).collect()}
    assert got == {(r, *k): tuple(x) for r, w in walks.items() for k, x in w.out.items()}
    sure = {x[1] for x in got.values()}
    assert {0.4, 0.8, 1.0} <= sure


def test_keyword_candidates(made):
    walks, rows = made
    known = rows.sparkSession.createDataFrame([("soft",)], "text string")
    got = sorted((c.review_id, c.at, c.context) for c in G.keyword_candidates(rows, known).collect())
    assert got == sorted((r, at, word) for r, w in walks.items() for at, word in w.bare if norm(word) not in ("", "soft"))
