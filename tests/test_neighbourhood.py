from __future__ import annotations

import random

from tidewright.operators import neighbourhood as H


def test_hops_equal_a_walk_and_hubs_are_cut(spark):
    rng = random.Random(6)
    pairs = {(f"a{rng.randint(0, 20)}", f"b{rng.randint(0, 15)}", rng.choice("xy")) for _ in range(120)} | {(f"a{i}", "hub", "x") for i in range(21)}
    edges = sorted(pairs | {(b, a, k) for a, b, k in pairs})
    near = {}
    for s, t, _ in edges:
        near.setdefault(s, set()).add(t)
    strong = {s: sorted((e for e in edges if e[0] == s), key=lambda e: (len(near.get(e[1], ())), e[1], e[2]))[:3] for s in near}
    nodes, links = set(), set()
    for seed in ("a1", "a7", "alone"):
        seen, front = {seed: 0}, [seed]
        for hop in (1, 2, 3):
            step = [e for n in front for e in strong.get(n, [])]
            links |= {(seed, hop, *e) for e in step}
            front = sorted({t for _, t, _ in step} - set(seen))
            seen |= dict.fromkeys(front, hop)
        nodes |= {(seed, n, h) for n, h in seen.items()}
    frame = spark.createDataFrame
    got = H.neighbourhoods(frame([("a1",), ("a7",), ("alone",), ("a1",), (None,)], "node string"), frame(edges, "src string, dst string, kind string"), 3, 3)
    assert {tuple(r) for r in got[0].collect()} == nodes and {tuple(r) for r in got[1].collect()} == links
    assert ("a1", "hub", 1) not in nodes
