"""Equal items, products and users are computed once: results as of brute force over rows, and no exchange of what the copies multiply."""

from __future__ import annotations

import contextlib
import io
import math
from collections import defaultdict

from tidewright.operators import similarity as S


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().split("Initial Plan")[0]


def copied_items(spark):
    """Forty items of eight kinds, some with nodes in common."""
    rows = [(f"i{k:02d}", n) for k in range(40) for n in (f"a{k % 8}", f"b{k % 4}", f"c{k % 8 // 3}", "all") if n != "c2"]
    return rows, spark.createDataFrame(rows, "item string, node string")


def brute_pairs(rows, groups=None):
    has = defaultdict(set)
    for i, n in rows:
        has[n].add(i)
    total = len({i for i, _ in rows})
    out = defaultdict(lambda: [0.0, 0])
    for items in has.values():
        w = math.log(total / len(items))
        for a in items:
            for b in items:
                if a < b and w > 0 and (groups is None or groups[a] == groups[b]):
                    out[a, b][0] += w
                    out[a, b][1] += 1
    return {k: (round(s, 4), n) for k, (s, n) in out.items()}


def test_pairs_of_equal_items_are_not_shuffled(spark):
    rows, nodes = copied_items(spark)
    df = S.shared_nodes(nodes)
    assert {(r.a, r.b): (r.score, r.n_shared) for r in df.collect()} == brute_pairs(rows)
    plan = plan_of(df)
    assert "Exchange" not in plan[: plan.index("Generate")] and "HashAggregate" not in plan[: plan.index("Generate")]


def test_gated_pairs_stay_inside_groups(spark):
    rows, nodes = copied_items(spark)
    of = {f"i{k:02d}": f"g{k % 3}" for k in range(40)}
    groups = spark.createDataFrame([(i, g) for i, g in of.items()] * 2, "item string, grp string")  # repeated rows count once
    df = S.shared_nodes(nodes, 2.0, groups)
    assert {(r.a, r.b): (r.score, r.n_shared) for r in df.collect()} == {k: v for k, v in brute_pairs(rows, of).items() if v[0] >= 2.0}
    plan = plan_of(df)
    assert "Exchange" not in plan[: plan.index("Generate")]


def brute_near(rows, n):
    pairs, out = brute_pairs(rows), defaultdict(list)
    for (a, b), (s, _) in pairs.items():
        out[a].append((-s, b))
        out[b].append((-s, a))
    return {(a, b): (-s, k) for a, x in out.items() for k, (s, b) in enumerate(sorted(x)[:n], 1)}


def test_nearest_of_equal_items(spark):
    rows, nodes = copied_items(spark)
    for n in (2, 10):
        df = S.nearest(nodes, n)
        assert {(r.a, r.b): (r.score, r["rank"]) for r in df.collect()} == brute_near(rows, n)


def test_attached_neighbours_of_equal_items(spark):
    rows, nodes = copied_items(spark)
    items = spark.createDataFrame([(f"i{k:02d}",) for k in range(41)], "product_id string")
    got = {r.product_id: [x.id for x in r.similar] for r in S.attach_neighbours(items, S.nearest(nodes, 3), "product_id", "similar").collect()}
    want = brute_near(rows, 3)
    assert got == {f"i{k:02d}": [b for _, b in sorted((n, b) for (a, b), (_, n) in want.items() if a == f"i{k:02d}")] for k in range(41)}


def test_related_of_equal_items(spark):
    rows, nodes = copied_items(spark)
    anchors = spark.createDataFrame([("q", "i01"), ("q", "i09"), ("r", "i02")], "query_id string, product_id string")
    want, near = {}, brute_near(rows, 10)
    for q, own in (("q", {"i01", "i09"}), ("r", {"i02"})):
        best = defaultdict(float)
        for (a, b), (s, _) in near.items():
            if a in own and b not in own:
                best[b] = max(best[b], s)
        want |= {(q, b): (s, k) for k, (s, b) in enumerate(sorted(((s, b) for b, s in best.items()), key=lambda x: (-x[0], x[1]))[:5], 1)}
    got = {(r.query_id, r.product_id): (r.score, r["rank"]) for r in S.related(anchors, S.nearest(nodes, 10), n=5).collect()}
    assert got == want


def test_owned_boost_of_equal_items(spark):
    rows, nodes = copied_items(spark)
    owned = [(u, f"i{(u * 7 + k * 5) % 44:02d}") for u in range(12) for k in range(u % 5)]
    near, want = brute_near(rows, 3), {}
    for u, i in owned:
        for (a, b), (s, _) in near.items():
            if a == i and (u, b) not in owned:
                want[u, b] = max(want.get((u, b), 0), round(min(s / 30, 1.0), 4))
    df = S.owned_boost_near(spark.createDataFrame(owned * 2, "user_id int, product_id string"), nodes, 3)
    assert {(r.user_id, r.product_id): r.boost for r in df.collect()} == want
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1  # the owned products; neither their neighbours nor what is left of them


def offers(spark):
    """Users' wants and products of which several have the same keys and attributes, and what the users own."""
    from tidewright.operators import recommend as R

    wants = [(u, a, f"{a[0]}{(u * 5 + k * 3) % 7}", 0.25 * (1 + (u + k) % 4)) for u in range(9) for k, a in enumerate(["keyword", "category", "similar", "keyword"]) if (u + k) % 5]
    has = [(f"p{p:02d}", a, f"{a[0]}{(p % 6) * j % 7}") for p in range(36) for j, a in enumerate(["keyword", "category", "similar"], 1)]
    shop = [(f"p{p:02d}", f"b{p % 3}", f"c{p % 2}", p % 3 * 5, p % 6 * 9, 3.5 + p % 2) for p in range(36)]
    own = [(u, f"p{p:02d}", f"b{p % 3}") for u in range(9) for p in range(36) if (u * 11 + p * 7) % 23 < u % 4]
    users = spark.createDataFrame(wants, "user_id int, axis string, key string, strength double")
    keys = spark.createDataFrame(has, "product_id string, axis string, key string")
    products = spark.createDataFrame(shop, "product_id string, brand_id string, category_id string, review_count_30d int, review_count_all int, rating double")
    return R, users, keys, products, spark.createDataFrame(own, "user_id int, product_id string, brand_id string")


def same(a, b, least=21):
    key = lambda df: sorted(map(tuple, df.select(*a.columns).collect()))
    assert key(a) == key(b) and a.count() >= least


def exchanges_after_users(df) -> str:
    """The plan above the part where the users' rows are dealt."""
    plan = plan_of(df)
    return plan[: plan.index("REPARTITION_BY_NUM")]


def test_overlaps_by_classes(spark):
    R, users, keys, _, _ = offers(spark)
    classes = R.product_classes(keys)
    found = R.of_products(R.class_overlaps(users, classes), classes)
    same(R.overlaps(users, keys), found)
    assert "Exchange hashpartitioning" not in exchanges_after_users(found)[:-60]


def test_scores_by_classes(spark):
    R, users, keys, products, own = offers(spark)
    classes = R.product_classes(keys, products)
    assert classes.info.count() < 36
    found = R.scores_of_products(R.score_classes(R.class_overlaps(users, classes), classes, own), classes)
    same(found, R.score(R.overlaps(users, keys), products, own))


def test_reranked_by_classes(spark):
    R, users, keys, products, own = offers(spark)
    classes = R.product_classes(keys, products)
    for n in (2, 10):
        first = R.first_scores(R.class_overlaps(users, classes), classes, own, 2 * n)
        same(R.rerank(first, n), R.rerank(R.score(R.overlaps(users, keys), products, own), n), 9)
        assert first.count() < R.score(R.overlaps(users, keys), products, own).count() or n == 10


def test_explanations_by_classes(spark):
    R, users, keys, _, _ = offers(spark)
    classes = R.product_classes(keys)
    found = R.of_products(R.explanations(R.class_overlaps(users, classes), 3), classes)
    same(R.explanations(R.overlaps(users, keys), 3), found)
    assert "Exchange hashpartitioning" not in exchanges_after_users(found)[:-60]


def test_eligible_by_classes(spark):
    R, users, keys, _, _ = offers(spark)
    classes = R.product_classes(keys)
    found = R.of_products(R.eligible(R.class_overlaps(users, classes)), classes)
    same(R.eligible(R.overlaps(users, keys)), found)
    assert "Exchange hashpartitioning" not in exchanges_after_users(found)[:-60]


def test_retrieved_by_classes(spark):
    R, users, keys, _, own = offers(spark)
    classes = R.product_classes(keys)
    for n in (1, 4):
        found = R.retrieve_classes(R.eligible(R.class_overlaps(users, classes)), classes, own, n)
        same(R.retrieve(R.eligible(R.overlaps(users, keys)), own, n), found, 5)


def test_exclusions_meet_classes_of_products(spark):
    from tidewright.operators import serving as V

    avoided = spark.createDataFrame([(u, f"k{k}") for u in range(6) for k in range(9) if (u + k) % 3], "user_id int, key string")
    has = {p: {f"k{p % 4}", f"k{p % 3 + 4}"} for p in range(60)}
    keys = spark.createDataFrame([(f"p{p}", k) for p, ks in has.items() for k in ks], "product_id string, key string")
    df = V.exclusion_counts(avoided, keys)
    shut = {u: {f"k{k}" for k in range(9) if (u + k) % 3} & set().union(*has.values()) for u in range(6)}
    assert {r.user_id: (r.n_keys, r.n_products) for r in df.collect()} == {u: (len(s), sum(bool(s & ks) for ks in has.values())) for u, s in shut.items()}
    assert "product_id" not in plan_of(df)


def test_stretches_of_texts_go_into_no_exchange(spark):
    from tidewright.operators import search

    texts, words = [f"show red bolt {k:06d} of brand#{k % 9}" for k in range(40)], [f"red bolt {k:06d}" for k in range(60)] + ["brand#1", "w", "red bolt 0000"]
    df = search.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string"), 16)
    assert {tuple(r) for r in df.collect()} == {(t, w) for t in texts for w in words if w in t}
    plan = plan_of(df)
    below = plan[plan.index("Join") :]
    assert "BroadcastHashJoin" in plan and "_at" not in " ".join(x for x in below.splitlines() if "Exchange hashpartitioning" in x)


def test_ingredients_are_found_once(spark):
    from tidewright.operators import query_reading as Q

    products = spark.createDataFrame([("1", "red bolt 000001", "b#1", "tools", "g")], "product_id string, name string, brand string, category string, group string")
    words = spark.createDataFrame([("salt", "s1"), ("sugar", "s2")], "surface string, ingredient string")
    catalog = Q.Catalog(products, spark.createDataFrame([("1", "s1"), ("1", "s1")], "product_id string, ingredient string"), words, spark.createDataFrame([], "surface string, group string, whole boolean"))
    assert catalog.words() is catalog.words() and catalog.held is catalog.held
    asks = spark.createDataFrame([(1, "Salt and  red bolt 000001 oddly")], "query_id int, text string")
    spans = Q.negation_spans(asks, ["aside"], ["free"], ["not"])
    gone = Q.exclusions(spans, catalog)
    found, stand = Q.readings(asks, catalog, gone)
    assert {(r.axis, r.key) for r in stand.collect()} == {("product", "red bolt 000001"), ("ingredient", "s1")}
    assert {r.word for r in Q.unread(asks, found, stand, spans, gone, []).collect()} == {"and", "oddly"}
