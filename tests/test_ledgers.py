import random

from pyspark.sql import functions as F

from cardloom.operators import learning as L
from cardloom.operators import versions as V


def test_containment_against_all_pairs(spark):
    draw = random.Random(3)
    words = [f"w{i:02d}" for i in range(30)]
    skew = lambda: words[min(int(draw.expovariate(0.15)), 29)]
    queries = [(i, [skew() for _ in range(draw.randrange(0, 12))]) for i in range(60)]
    labels = [(i, list({skew() for _ in range(draw.randrange(0, 8))})) for i in range(80)]
    for least in (0.25, 0.5, 1.0):
        found = {(r["query_id"], r["id"]): r["share"] for r in L.containment_join(spark.createDataFrame(queries, "query_id int, words array<string>"), spark.createDataFrame(labels, "id int, words array<string>"), least).collect()}
        share = lambda q, w: sum(x in w for x in q) / len(q) if q and w else 0
        assert found == {(q, i): share(ws, held) for q, ws in queries for i, held in labels if share(ws, held) >= least}


def test_corrections_add_and_raise_cards(spark):
    cards = spark.createDataFrame([(1, "2001 topps ann lee"), (2, "1999 panini bob ray"), (3, None), (4, "ann marie")], "card_id int, label string")
    regions = spark.createDataFrame([("r", "Topps Ann Lee card"), ("s", None)], "item string, text string")
    matches = spark.createDataFrame([("r", 1, 2, 0.9, 5.0), ("s", 1, 1, 0.6, 1.0)], "item string, rank int, card_id int, confidence double, match_score double")
    corrections = spark.createDataFrame([(1, "ann lee"), (1, "ann lee"), (2, "bob"), (3, None), (4, "zzz")], "card_id int, reason string")
    found = {(r["item"], r["card_id"]): (r["rank"], r["confidence"], r["boost"], r["added"]) for r in L.learned_candidates(regions, matches, corrections, cards).collect()}
    # card 1 has three and card 4 one of the four words; nothing matches a region without words
    assert found == {("r", 2): (1, 0.92, 0.02, False), ("r", 1): (2, 0.6, 0.08, True), ("r", 4): (3, 0.54, 0.02, True), ("s", 1): (1, 0.68, 0.08, False)}


def test_versions_against_a_log_played_row_by_row(spark):
    draw = random.Random(9)
    ups, backs, now, created, wanted, states = [], [], {}, {}, {}, {}
    for at in range(1, 300):
        if draw.random() < 0.15:
            batch = draw.randrange(12)
            backs.append((at, batch))
            for card in [c for c, (_, b) in now.items() if b == batch]:
                wanted[now.pop(card)[0]][1:3] = [at, "rollback"]
        else:
            card, batch = draw.choice([None, *range(15)]), draw.choice([None, *range(12)])
            ups.append((at, card, batch, at * 2))
            states[at] = dict(now)
            if card is None:
                continue
            action = "updated" if card in now else "added"
            if card in now:
                wanted[now[card][0]][1:3] = [at, "upsert"]
            else:
                created[card] = at
            now[card] = (at, batch)
            wanted[at] = [card, None, None, action, created[card]]
        states[at] = dict(now)
    upserts, rollbacks = spark.createDataFrame(ups, "at int, card_id int, batch int, value int"), spark.createDataFrame(backs, "at int, batch int")
    versions = V.override_versions(upserts, rollbacks)
    assert {r["at"]: [r["card_id"], r["valid_to"], r["ended_by"], r["action"], r["created_at"]] for r in versions.collect()} == wanted
    for at in (50, 150, 299):
        assert {r["card_id"]: (r["at"], r["batch"]) for r in V.valid_at(versions, at).collect()} == states[at]
    removed = {r["at"]: r["rows"] for r in V.override_audit(versions, rollbacks).filter("type = 'batch_rollback'").collect()}
    assert removed == {at: sum(w[1] == at and w[2] == "rollback" for w in wanted.values()) for at, _ in backs}


def test_partial_unique_inserts(spark):
    schema = "id int, a string, b string, ok boolean"
    old = spark.createDataFrame([(1, "x", None, True), (2, "y", "1", False)], schema)
    new = spark.createDataFrame([(3, "x", "", True), (4, "y", "1", True), (5, "y", "1", True), (6, "x", None, False), (7, "x", None, None)], schema)
    found = {r["id"]: r["action"] for r in V.insert_ignore(old, new, ["a", "b"], F.col("ok"), ["id"]).collect()}
    assert found == {1: "kept", 2: "kept", 4: "inserted", 6: "inserted", 7: "inserted"}
    assert V.insert_ignore(old.limit(0), new.limit(0), ["a"], F.col("ok"), ["id"]).count() == 0


def test_only_cards_that_may_be_kept_are_listed(spark, monkeypatch):
    draw = random.Random(8)
    words = [f"w{i:02d}" for i in range(14)]
    some = lambda least, most: [draw.choice(words) for _ in range(draw.randrange(least, most))]
    labels = {i: ["brand", *some(1, 4)] for i in range(150)}
    corrections = [(i, draw.choice([" ".join(["brand", *some(0, 3)]), " ".join(some(1, 4)), "zzz", None])) for i in range(150) for _ in range(draw.randrange(3))]
    texts = {f"r{i}": ["brand"] * draw.randrange(2) + some(0, 6) for i in range(30)} | {"s": [], "t": ["other", "words"], "u": ["zzz", "w01"]}
    matches = [(r, k + 1, c, 0.3 + 0.1 * draw.randrange(5), 1.0 * draw.randrange(3)) for r in texts for k, c in enumerate(draw.sample(range(150), draw.randrange(4)))]

    share = lambda left, right: sum(w in right for w in left) / len(left) if left and right else 0
    wanted = set()
    for item, ws in texts.items():
        own = [m for m in matches if m[0] == item]
        every = [(c, rank, confidence, score, False) for _, rank, c, confidence, score in own]
        every += [(c, None, 0.52, 0.0, True) for c in {c for c, _ in corrections} - {m[2] for m in own} if share(ws, labels[c]) >= 0.25]
        rows = []
        for card, rank, confidence, score, added in every:
            shares = [share((r or "").split(), ws or labels[card]) for c, r in corrections if c == card]
            boost = round(max([0.03 + x * 0.05 if x > 0 else 0.02 for x in shares], default=0.0), 6)
            rows.append((-min(0.995, round(confidence + boost, 6)), -score, rank or 99, card, boost, added))
        wanted |= {(item, at + 1, r[3], r[4], r[5]) for at, r in enumerate(sorted(rows)[:7])}

    listed, join = [], L.containment_join
    monkeypatch.setattr(L, "containment_join", lambda queries, *rest: listed.append(queries.count()) or join(queries, *rest))
    found = L.learned_candidates(
        spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "item string, text string"),
        spark.createDataFrame(matches, "item string, rank int, card_id int, confidence double, match_score double"),
        spark.createDataFrame(corrections, "card_id int, reason string"),
        spark.createDataFrame([(k, " ".join(v)) for k, v in labels.items()], "card_id int, label string"),
    )
    assert {(r["item"], r["rank"], r["card_id"], r["boost"], r["added"]) for r in found.collect()} == wanted
    assert sum(listed) < len(texts) / 2, "regions with enough cards of a good reason are not joined with all labels"
