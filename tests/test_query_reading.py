from __future__ import annotations

from tidewright.operators import query_reading as Q
from tidewright.sources.scratch import saved

TEXTS = [
    (1, "레티놀없는 수분크림"), (2, "Dawn Rich Cream 빼고 Dawn 말고 cream"), (3, "oil-free lotion by Dawn"), (4, None), (5, ""), (6, "lip balm 빼고 skincare"), (7, "retinol 빼고 retinol 제외 lotion"),
    (8, "hyaluron lotion"), (9, "dew serum of Dusk"), (10, "mystery 빼고 thing"), (11, "skincare 빼고 balm"), (8, "hyaluron lotion"), (None, "Dawn"), (12, "ginseng lotion"),
]
PRODUCTS = [
    ("a", "Dawn Rich Cream", "Dawn", "rich cream", "skincare"), ("b", "Dawn Light Lotion", "Dawn", "lotion", "skincare"), ("c", "Dusk Lip Balm", "Dusk", "lip balm", "makeup"),
    ("d", "Dew Serum", "Dawn", "serum", "skincare"), ("e", None, None, None, None), ("f", "Ginseng", "", "lotion", None),
]
INGREDIENTS = [("a", "retinol"), ("b", "mineral oil"), ("b", "sodium hyaluronate"), ("d", "hyaluronic acid"), ("c", "oil")]
WORDS = [("retinol", "retinol"), ("레티놀", "retinol"), ("hyaluron", "sodium hyaluronate"), ("hyaluron", "hyaluronic acid"), ("oil", "oil"), ("mineral oil", "mineral oil"), ("ginseng", "absent")]
GROUPS = [("skincare", "skincare", True), ("basics", "skincare", False)]


def _all(spark, products=PRODUCTS, texts=TEXTS):
    frame = spark.createDataFrame
    catalog = Q.Catalog(
        frame(products, "product_id string, name string, brand string, category string, group string"), frame(INGREDIENTS, "product_id string, ingredient string"),
        frame(WORDS, "surface string, ingredient string"), frame(GROUPS, "surface string, group string, whole boolean"),
    )
    asks = frame(texts, "query_id int, text string")
    spans = saved(Q.negation_spans(asks, ["없는", "빼고", "제외", "말고"], ["free"], ["without"]))
    gone = saved(Q.exclusions(spans, catalog))
    found, stand = Q.readings(asks, catalog, gone)
    return asks, catalog, spans, gone, found, saved(stand)


def test_negations_readings_and_answers(spark):
    asks, catalog, spans, gone, found, stand = _all(spark)
    ruled_out = {(r.query_id, r.word, r.axis, r.key) for r in gone.collect()}
    assert ruled_out == {
        (1, "레티놀", "ingredient", "retinol"), (2, "cream", "product", "dawn rich cream"), (2, "dawn", "brand", "dawn"), (3, "oil", "ingredient", "oil"), (6, "balm", "product", "dusk lip balm"),
        (7, "retinol", "ingredient", "retinol"), (11, "skincare", "group", "skincare"),
    }
    stands = {(r.query_id, r.axis, r.key) for r in stand.collect()}
    assert {q for q, *_ in stands} == {2, 3, 6, 7, 8, 9, 12}
    assert (3, "brand", "dawn") in stands and not any(q == 2 and a == "brand" for q, a, _ in stands)
    assert {(a, k) for q, a, k in stands if q == 8} == {("category", "lotion"), ("ingredient", "sodium hyaluronate"), ("ingredient", "hyaluronic acid")}
    assert {(a, k) for q, a, k in stands if q == 9} == {("brand", "dusk"), ("category", "serum")}  # the serum is another brand's
    left = {(r.query_id, r.word, r.negated) for r in Q.unread(asks, found, stand, spans, gone, ["please"]).collect()}
    assert (10, "mystery", True) in left and (10, "thing", False) in left and not any(q in (1, 7) and n for q, _, n in left)
    rows, state = Q.answers(stand, gone, catalog)
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    assert got[8] == ["b", "d"] and "c" not in got[3] and "c" not in got.get(6, [])
    assert got[12][0] == "f"  # named by its product name, whose ingredient no product has
    flags = {r.query_id: (r.n_families, r.n_matched, r.applied, r.relaxed) for r in state.collect()}
    assert flags[8] == (1, 2, True, False) and flags[3] == (0, 0, False, False)


def test_condition_that_no_product_meets_is_given_up(spark):
    _, catalog, _, gone, _, stand = _all(spark, texts=[(1, "retinol lotion Dawn Rich Cream 빼고")])
    rows, state = Q.answers(stand, gone, catalog)
    assert [r.product_id for r in rows.orderBy("rank").collect()] == ["b", "d", "f"]  # the brand is still asked for
    assert [(r.n_matched, r.applied, r.relaxed) for r in state.collect()] == [(0, False, True)]


def test_broad_parts_of_names_mean_no_product(spark):
    many = [(f"x{i}", f"glow item {i:02d}", "Dawn", "lotion", "skincare") for i in range(11)]
    gone = _all(spark, many, [(1, "glow item 빼고"), (2, "item 03 빼고")])[3]
    assert {(r.query_id, r.axis, r.key) for r in gone.collect()} == {(2, "product", "glow item 03")}


def test_nothing_asked_and_nothing_to_offer(spark):
    for products, texts in (([], TEXTS), (PRODUCTS, [])):
        asks, catalog, spans, gone, found, stand = _all(spark, products, texts)
        rows, state = Q.answers(stand, gone, catalog)
        assert rows.where("pinned = 1").count() == 0 and state.where("query_id IS NULL").count() == 0
        assert Q.unread(asks, found, stand, spans, gone, []).where("word = ''").count() == 0


def test_classes_of_the_profile(spark):
    asks = spark.createDataFrame([(1, "for  MY brand"), (2, "my"), (None, "my brand"), (3, None)], "query_id int, text string")
    triggers = spark.createDataFrame([("brands", "my brand"), ("owned", ""), ("brands", "my brand")], "class string, phrase string")
    assert [tuple(r) for r in Q.profile_classes(asks, triggers).collect()] == [(1, "brands")]
