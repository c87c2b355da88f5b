import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from cardloom.llm.conversation_repair import ENDS, Lattice, digests, op12_conversation_repair, prices_between, repair, traces

LEGAL = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, initials, repaired rows) of the cheapest edits of (role, text, fault) rows, by looking at all of them."""

    @cache
    def best(at, last, inserted):
        found = []
        if at == len(rows) and last in ("", "a"):
            found.append((0, "", ()))

        def go(cost, initial, at, last, row, inserted=0):
            rest = best(at, last, inserted)
            if rest is not None:
                found.append((cost + rest[0], initial + rest[1], (*row, *rest[2])))

        if inserted < 3:
            for role in ("user", "assistant"):
                if (last, role[0]) in LEGAL:
                    go(5, "I", at, role[0], [(role, "")], inserted + 1)
        if at < len(rows):
            role, text, fault = rows[at]
            go(2, "D", at + 1, last, [])
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if (last, role[:1]) in LEGAL:
                    go(late, "K", at + 1, role[:1], [(role, text)])
                for new in ("user", "assistant"):
                    if (last, new[0]) in LEGAL:
                        go(1 + late, "R", at + 1, new[0], [(new, text)])
        return min(found, default=None)

    for at in range(len(rows), 0, -1):  # from the end, so that no call is deep
        for last in ("", "s", "u", "a"):
            best(at, last, 0)
    return best(0, "", 0)


def by_hand(rows):
    """The contract's columns for each conversation, one row at a time."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 1:
            text = ""
        if how == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if how == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows_, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
        for _, role, text in kept:
            body = text.encode().strip()
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1:] not in (b".", b"!", b"?") else ""
            seen.add((role, text))
            counts[fault] += 1
            rows_.append((role, text, fault))
        turns = {t for t, *_ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows_, rows_[1:]))
        cost, audit, repaired = cheapest(tuple(rows_))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TEXTS = ["Fine.", "Fine!", "cut off", "", " \n\t", None, "Ends here? \n", "one", "two.", "\x1c", "a. b"]
ROLES = ["user", "assistant", "system", "user", "assistant", None, "tool", "unknown", "a", ""]


def drawn(seed, convs, most):
    draw = random.Random(seed)
    rows = []
    for conv in range(convs):
        for at in range(draw.randrange(1, most)):
            role = ROLES[(at + 1) % 2] if draw.random() < 0.5 else draw.choice(ROLES)
            text = f"say {draw.randrange(9)}." if draw.random() < 0.6 else draw.choice(TEXTS)
            rows.append((conv, None if draw.random() < 0.05 else at + draw.randrange(3), role, text))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    wanted = by_hand(rows)
    assert found.keys() == wanted.keys()
    for conv in wanted:
        assert found[conv] == wanted[conv], [r for r in rows if r[0] == conv]


def test_query_against_all_edits(spark, tmp_path):
    rows = drawn(1, 250, 12)
    rows += [(None, t, *r) for t, r in enumerate([("user", "Hi."), ("assistant", "Yes."), ("user", "Hi.")])]
    rows += [(1000, None, "user", "x."), (1000, None, "assistant", "y."), (1001, None, None, None), (1002, 7, "system", "only.")]
    rows += [(1003, 1, "user", "same.")] * 5 + [(1004, 0, "user", "w " * 50_000 + "end."), (1004, 1, "assistant", "ok.")]
    check(spark, tmp_path, rows)


def test_long_conversations_cross_blocks(spark, tmp_path):
    draw = random.Random(4)
    rows = [(1, t, draw.choice(ROLES), f"text {draw.randrange(400)}" + draw.choice([".", "", "."])) for t in range(700)]
    rows += [(2, t, ["user", "assistant"][t % 2], f"text {t}.") for t in range(300)]
    check(spark, tmp_path, rows + drawn(9, 30, 150))


def test_rows_that_all_go(spark, tmp_path):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, 0, "user", "dropped.") for c in gone] + [(c, 0, "user", " ") for c in range(3)]
    check(spark, tmp_path, rows)
    out = op12_conversation_repair(spark, str(tmp_path)).filter(F.col("conv_id") == gone[0]).first()
    assert tuple(out[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_lattice_prices_and_traces():
    draw = random.Random(8)
    for _ in range(150):
        n = draw.randrange(0, 9)
        roles, faults = "".join(draw.choices("suao", k=n)), "".join(draw.choices("---tbd", k=n))
        names = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
        kinds = {"-": "", "t": "truncated", "b": "blank", "d": "duplicate"}
        wanted = cheapest(tuple((names[r], "", kinds[f]) for r, f in zip(roles, faults)))
        ways, _, cost = traces(roles, faults, ENDS, 1)
        assert (cost, ways[0].translate(str.maketrans("uaUA", "RRII"))) == wanted[:2]
        between = prices_between(roles, faults)
        assert min(between[0], between[3] if between[3] is not None else 99) == cost
        for cut in range(n + 1):  # prices of parts add up to those of the whole
            a, b = prices_between(roles[:cut], faults[:cut]), prices_between(roles[cut:], faults[cut:])
            for start in range(4):
                for end in range(4):
                    sums = [a[4 * start + m] + b[4 * m + end] for m in range(4) if a[4 * start + m] is not None and b[4 * m + end] is not None]
                    assert min(sums, default=None) == between[4 * start + end]


def test_prices_end_dual_feasible_and_tight_on_the_path():
    lattice = Lattice("uusaaou", "-t--d--", ENDS)
    lattice.trace(0)
    for node in range(len(lattice.prices) - 1):
        assert all(lattice.prices[node] <= cost + lattice.prices[to] for _, cost, to in lattice.arcs(node))


@pytest.mark.parametrize("size", [2, 5])
def test_blocks_of_any_size_agree(spark, size):
    rows = spark.createDataFrame([r for r in drawn(3, 60, 14)], SCHEMA).selectExpr("*", "'x' AS letter", "1 AS _pos", "2 AS steps", "3 AS audit")
    wanted, found = repair(rows), repair(rows, size=size)
    assert sorted(map(tuple, found[1].collect())) == sorted(map(tuple, wanted[1].collect()))
    assert sorted(map(tuple, digests(found[0]).collect())) == sorted(map(tuple, digests(wanted[0]).collect()))


def test_empty(spark):
    turns, summary = repair(spark.createDataFrame([], SCHEMA))
    assert turns.count() == 0 and summary.count() == 0 and digests(turns).count() == 0
