import itertools
import random

import numpy as np

from cardloom.operators import benchmark as B


def test_least_cost_against_all_assignments():
    draw = np.random.default_rng(2)
    for n, m in [(1, 1), (2, 2), (3, 5), (4, 4), (5, 6), (0, 3)]:
        for _ in range(20):
            cost = draw.integers(-5, 6, (n, m)).astype(float)
            chosen = B.least_cost(cost)
            assert len(set(chosen)) == n
            best = min((sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)), default=0)
            assert sum(cost[i, j] for i, j in enumerate(chosen)) == best


CARD = "case_id int, at bigint, card_id string, player string, year int, brand string, set_name string, card_number string"
ITEM = "case_id int, at bigint, needs_confirmation boolean, player string, year string, brand string, card_number string"
MATCH = "case_id int, at bigint, rank int, confidence double, card_id string, player string, year int, brand string, set_name string, card_number string"


def test_items_go_to_the_cards_they_agree_with_most(spark):
    draw = random.Random(4)
    words = ["ann lee", "bo", "cy", None, ""]
    cards, items = [], []
    for case in range(25):
        cards += [(case, at, None, draw.choice(words), draw.choice([2001, 2002]), draw.choice(["topps", "panini"]), None, str(draw.randrange(4))) for at in range(draw.randrange(1, 4))]
        items += [(case, at, False, draw.choice(words), draw.choice(["2001", "2002"]), draw.choice(["Topps!", "x"]), str(draw.randrange(4))) for at in range(draw.randrange(0, 4))]
    found = {(r["case_id"], r["at"]): r["item_at"] for r in B.assigned(spark.createDataFrame(cards, CARD), spark.createDataFrame(items, ITEM)).collect()}
    plain = lambda x: "".join(c if c.isalnum() else " " for c in str(x or "").lower()).strip()
    worth = lambda c, i: sum(bool(plain(e) and plain(a) and (plain(e) in plain(a) or plain(a) in plain(e))) for e, a in ((c[3], i[3]), (c[4], i[4]), (c[5], i[5]), (c[7], i[6])))
    for case in range(25):
        own, seen = [c for c in cards if c[0] == case], [i for i in items if i[0] == case]
        places = [found[case, c[1]] for c in own]
        used = [p for p in places if p is not None]
        assert len(set(used)) == len(used) == min(len(own), len(seen))
        got = sum(worth(c, seen[p]) for c, p in zip(own, places, strict=True) if p is not None)
        wide = seen + [None] * len(own)
        assert got == max(sum(worth(c, i) for c, i in zip(own, p, strict=True) if i) for p in itertools.permutations(wide, len(own)))


def test_scores_by_scene_field_and_failure(spark):
    cards = spark.createDataFrame([(1, 0, "c1", "Ann Lee", 2001, "Topps", "Chrome", "7"), (2, 0, None, "Bo", 1999, None, None, None), (2, 1, "c9", "Cy", None, "", None, None), (3, 0, "c1", "Ann", 2001, None, None, None)], CARD)
    items = spark.createDataFrame([(1, 0, False, "ann", "2001", None, "8"), (2, 0, True, "bo", "99", None, None)], ITEM)
    matches = spark.createDataFrame(
        [(1, 0, 1, 0.9, "c5", "Ann Lee", 2001, "Panini", "Prizm", "8"), (1, 0, 2, 0.8, "c1", None, None, None, None, None), (1, 0, 4, 0.1, "c1", None, None, None, None, None), (2, 0, 1, 0.95, "c8", "Bo", 1999, "x", "y", "z")], MATCH
    )
    scored = B.score_cards(cards, items, matches, B.in_place(cards, items))
    rows = {(r["case_id"], r["at"]): r for r in scored.collect()}
    flags = {k: (r["top1"], r["top3"], r["false_confident"], r["needs_confirmation"]) for k, r in rows.items()}
    # the second card of case 2 has no item of its own and takes the first one's
    assert flags == {(1, 0): (False, True, True, False), (2, 0): (True, True, False, True), (2, 1): (False, False, False, True), (3, 0): (False, False, False, False)}
    assert {f["field"]: f["correct"] for f in rows[1, 0]["fields"]} == {"player": True, "year": True, "brand": False, "set_name": False, "card_number": False}
    assert {f["field"]: f["correct"] for f in rows[2, 0]["fields"]} == {"player": True, "year": True} and {f["field"]: f["correct"] for f in rows[2, 1]["fields"]} == {"player": False}
    cases = spark.createDataFrame([(1, "single_card", "Single Card", True), (2, "single_card", "binder_page", True), (3, "binder_page", None, True), (4, "binder_page", "binder_page", False), (5, None, None, True)], "case_id int, scene_expected string, scene_actual string, scorable boolean")
    by = {r["scene"]: r for r in B.by_scene(cases, scored).collect()}
    assert set(by) == {"all", "single_card", "binder_page", "unknown", B.FOCUS}
    assert (by["all"]["cases"], by["all"]["expected"], by["all"]["top1_accuracy"], by["all"]["top3_accuracy"], by["all"]["false_confident_rate"]) == (4, 4, 25.0, 50.0, 25.0)
    assert (by["single_card"]["scene_accuracy"], by[B.FOCUS]["cases"], by[B.FOCUS]["expected"], by["unknown"]["field_accuracy"]) == (50.0, 2, 3, 0.0)
    fields = {r["field"]: (r["total"], r["correct"], r["accuracy"], r["weak"]) for r in B.by_field(scored).collect()}
    assert fields["player"] == (4, 2, 50.0, True) and fields["year"] == (3, 2, 66.7, True)
    found = {r["pattern"]: (r["found"], r["examples"]) for r in B.failures(cases, scored).collect()}
    assert found == {"missed_top1": (3, "1:0,2:1,3:0"), "correct_in_top3": (1, "1:0"), "false_confident": (1, "1:0"), "needs_confirmation": (2, "2:0,2:1"), "scene_miss": (3, "2:0,3:0,5:0")}


def test_images_and_labels(spark):
    images = spark.createDataFrame([("a/Card 1.JPG",), ("b\\card-1.png",), ("card2.txt",), ("x.jpg",), (None,), ("...jpg",)], "image string")
    labels = spark.createDataFrame([(5, "CARD_1.webp"), (4, "card 1"), (6, "other.png"), (7, None), (8, "")], "label_id int, name string")
    rows = sorted(map(str, map(tuple, B.images_with_labels(images, labels).collect())))
    assert rows == sorted(map(str, [("card1", "a/Card 1.JPG", 4, "paired"), ("card1", "b\\card-1.png", 4, "paired"), ("x", "x.jpg", None, "unlabeled_image"), ("", "...jpg", None, "unlabeled_image"),
                                    ("card1", None, 5, "repeated_label"), ("other", None, 6, "unmatched_label"), ("", None, 7, "unmatched_label"), ("", None, 8, "unmatched_label")]))
