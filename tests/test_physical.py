import random

from pyspark.sql import functions as F

from cardloom.operators import components, order
from cardloom.operators import physical as P
from cardloom.operators.physical import identity_of, physical_items, unique_serial
from cardloom.plans import likeness
from cardloom.plans.likeness import item_views

NAMES = ["id", "content_hash", "fingerprint", "captured", "identity", "identity_confidence", "side", "cert", "serial"]


def placed_by_hand(views):
    """The cascade, one view after the other."""
    done, out = [], {}
    for v in sorted(views, key=lambda v: (v["content_hash"] or "", v["id"])):
        rules = [
            ("exact_content_duplicate", lambda o: v["content_hash"] is not None and o["content_hash"] == v["content_hash"]),
            ("cert_match", lambda o: v["cert"] is not None and o["cert"] == v["cert"]),
            ("serial_match", lambda o: None not in (v["serial"], v["identity"]) and (o["serial"], o["identity"]) == (v["serial"], v["identity"])),
            (
                "visual_duplicate_with_capture_time",
                lambda o: None not in (v["fingerprint"], o["fingerprint"], v["captured"], o["captured"])
                and ((v["fingerprint"] ^ o["fingerprint"]) & (2**64 - 1)).bit_count() <= 5
                and abs(v["captured"] - o["captured"]) <= 240,
            ),
        ]
        hit = next(((m, o["group"]) for m, rule in rules for o in done if rule(o)), None)
        if hit is None and v["identity"] is not None and (v["identity_confidence"] or 0) >= 0.9 and v["side"] in ("front", "back"):
            other = "back" if v["side"] == "front" else "front"
            has = {o["group"] for o in done if o["side"] == v["side"]}
            hit = next((("front_back_identity", o["group"]) for o in done if o["identity"] == v["identity"] and o["side"] == other and o["group"] not in has), None)
        method, group = hit or ("unique", v["id"])
        done.append(v | {"group": group})
        out[v["id"]] = (group, method)
    return out


def placed(frame):
    return {r["id"]: (r["group"], r["method"]) for r in physical_items(frame).collect()}


SCHEMA = "id bigint, content_hash string, fingerprint bigint, captured bigint, identity string, identity_confidence double, side string, cert string, serial string"


def framed(spark, views):
    return spark.createDataFrame([tuple(v[n] for n in NAMES) for v in views], SCHEMA).withColumn("captured_at", F.timestamp_seconds("captured"))


def drawn(seed, n, identities):
    draw = random.Random(seed)
    maybe = lambda p, x: x if draw.random() < p else None
    return [
        dict(
            id=i, content_hash=maybe(0.95, f"{draw.randrange(n):05d}"), fingerprint=maybe(0.7, draw.choice([0, -1, 12345]) ^ (1 << draw.randrange(60)) ^ draw.choice([0, 0, 255 << 20])),
            captured=maybe(0.6, draw.randrange(20_000)), identity=maybe(0.8, f"k{draw.randrange(identities)}"), identity_confidence=maybe(0.95, draw.choice([0.5, 0.9, 0.95])),
            side=draw.choice(["front", "back", "front", "back", "unknown", None]), cert=maybe(0.1, f"c{draw.randrange(n // 8)}"), serial=maybe(0.2, f"{draw.randrange(5)}/99"),
        )
        for i in range(n)
    ]


def test_groups_are_those_of_the_cascade_in_any_input_order(spark):
    for seed, n, identities in ((1, 150, 6), (2, 150, 60), (3, 60, 2)):
        views = drawn(seed, n, identities)
        wanted = placed_by_hand(views)
        assert {m for _, m in wanted.values()} >= {"unique", "front_back_identity", "exact_content_duplicate"}
        random.Random(0).shuffle(views)
        assert placed(framed(spark, views).repartition(3)) == wanted


def test_a_hot_identity_is_numbered_and_a_hot_content_is_one_tree(spark):
    plain = dict(fingerprint=None, captured=None, cert=None, serial=None, identity_confidence=0.95)
    views = [dict(plain, id=i, content_hash=f"{(i * 7919) % 5003:05d}", identity="hot", side="front" if i % 3 else "back") for i in range(900)]
    views += [dict(plain, id=10_000 + i, content_hash="copy", identity="hot2", side="front") for i in range(300)]
    assert placed(framed(spark, views)) == placed_by_hand(views)


def test_query_is_the_cascade(spark):
    frame = item_views(spark, "/root/testdata/sf0.001").withColumn("captured", F.unix_timestamp("captured_at"))
    wanted = placed_by_hand([r.asDict() for r in frame.collect()])
    found = physical_items(frame)
    assert {r["id"]: (r["group"], r["method"]) for r in found.collect()} == wanted


def test_hard_rows(spark):
    none = dict.fromkeys(NAMES)
    views = [none | dict(id=1), none | dict(id=2), none | dict(id=3, content_hash=""), none | dict(id=4, content_hash="")]
    assert placed(framed(spark, views)) == placed_by_hand(views) == {1: (1, "unique"), 2: (2, "unique"), 3: (3, "unique"), 4: (3, "exact_content_duplicate")}
    assert physical_items(framed(spark, views).limit(0)).count() == 0
    row = spark.createDataFrame([("No. 12 / 99 of", "a"), ("1234567/1", "a"), (None, None)], "s string, x string")
    assert [r[0] for r in row.select(unique_serial(F.col("s"))).collect()] == ["12/99", None, None]
    keys = row.select(identity_of([F.col("x"), F.lit(" B  c"), F.lit(2001)], F.lit("7"), F.lit(None))).collect()
    assert [k[0] for k in keys] == ["a|b c|2001", "a|b c|2001", None]


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    plans = []
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (P, components, order):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, write=write: plans.append(planned(df)) or write(df))
    plans.append(planned(likeness.lot_representatives(spark, "/root/testdata/sf0.001")))
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
