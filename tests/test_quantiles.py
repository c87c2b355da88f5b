import numpy as np
from pyspark.sql import functions as F

from cardloom.operators.quantiles import exact_quantiles, with_quantiles

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p100": 1.0}


def test_quantiles_of_groups_one_of_which_holds_a_third_of_all_rows(spark):
    draw = np.random.default_rng(4)
    rows = [("hot", int(v), i % 5) for i, v in enumerate(draw.integers(0, 300, 4000))] + [(f"g{int(g)}", float(v), int(v * 10) % 5) for g, v in zip(draw.integers(0, 60, 8000), draw.random(8000) * 50, strict=True)]
    rows += [(None, 1.5, 0), (None, None, 0), ("none", None, 1), ("one", 7.0, 4)]
    frame = spark.createDataFrame([(g, None if v is None else float(v), f) for g, v, f in rows], "g string, v double, f int")
    subsets = {"all": F.lit(True), "few": F.col("f") < 2}
    found = {r["g"]: r for r in exact_quantiles(frame, ["g"], "v", subsets, PROBS).collect()}
    held = {}
    for g, v, f in rows:
        if v is not None:
            held.setdefault(g, []).append((float(v), f))
    assert found.keys() == held.keys()
    for g, values in held.items():
        for s, part in (("all", [v for v, _ in values]), ("few", [v for v, f in values if f < 2])):
            assert found[g][f"{s}_n"] == len(part)
            for q, p in PROBS.items():
                assert (found[g][f"{s}_{q}"] is None) if not part else abs(found[g][f"{s}_{q}"] - np.quantile(part, p)) < 1e-9
    beside = with_quantiles(frame, ["g"], exact_quantiles(frame, ["g"], "v", {"all": F.lit(True)}, {"p50": 0.5}))
    assert beside.count() == len(rows) and beside.filter("g IS NULL AND all_p50 = 1.5").count() == 2 and beside.filter("g = 'none' AND all_p50 IS NULL").count() == 1
    assert exact_quantiles(frame.limit(0), ["g"], "v", subsets, PROBS).count() == 0
