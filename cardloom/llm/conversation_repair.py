"""Conversation structure repair: cheapest edits by an auction shortest path over a lattice of rows and grammar states."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.text import SPACE_CLASS
from cardloom.session import table, written

#: What the edits cost, and what keeping or reroling a truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: at the start, after a system, a user and an assistant row; a conversation may end at the start or after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, None, None, 0)
LEGAL = {"su", "ua", "au"}
#: Rows that one lattice spans.
BLOCK = 64


def follows(state: int) -> int:
    """The state that a user or assistant row leads to; one of both may come in any state."""
    return ASSISTANT if state == USER else USER


class Lattice:
    """Nodes (row, state) of a block of rows, arcs that edit them, and integer prices of the nodes.

    roles has one letter for each row: s, u, a, or o for any other. faults has b (blank), d
    (duplicate), t (truncated) or - for each row. exits are the prices of the states after the block, None where it can't be left.
    Arcs go to states that can still reach an exit.
    """

    def __init__(self, roles: str, faults: str, exits: tuple[int | None, ...]):
        self.roles, self.faults, self.exits, self.rows = roles, faults, exits, len(roles)
        self.useful = set(range(4)) if exits[USER] is not None or exits[ASSISTANT] is not None else set(range(START, SYSTEM + (exits[SYSTEM] is not None)))
        # feasible prices to begin with: what each row left costs whatever is done with it
        price = min(x for x in exits if x is not None)
        self.prices = [price] * (4 * self.rows + 4)
        for row in range(self.rows - 1, -1, -1):
            price += DELETE if faults[row] != "-" else 0
            self.prices[4 * row : 4 * row + 4] = [price] * 4
        self.prices.append(0)
        self.known: dict[int, list[tuple[str, int, int]]] = {}

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(step, cost, next node) by the initial of the step; leaving the block has none and comes first.

        Steps: D deletes and K keeps a row, u and a give it the role user or assistant, U and A insert a row.
        """
        if node in self.known:
            return self.known[node]
        row, state = divmod(node, 4)
        found: list[tuple[str, int, int]] = []
        if row == self.rows and self.exits[state] is not None:
            found.append(("", self.exits[state], len(self.prices) - 1))
        next_ = follows(state)
        if row < self.rows:
            found.append(("D", DELETE, node + 4))
        found.append(("A" if next_ == ASSISTANT else "U", INSERT, 4 * row + next_))
        if row < self.rows and self.faults[row] in "t-":
            late = TRUNCATED if self.faults[row] == "t" else 0
            role = self.roles[row]
            kept = SYSTEM if role == "s" and state == START else next_ if role == "__ua"[next_] else None
            if kept is not None:
                found.append(("K", late, 4 * row + 4 + kept))
            found.append(("a" if next_ == ASSISTANT else "u", REROLE + late, 4 * row + 4 + next_))
        self.known[node] = [arc for arc in found if not arc[0] or arc[2] % 4 in self.useful]
        return self.known[node]

    def auction(self, origin: int) -> int | None:
        """The price of a node once its shortest path is found; None if no path leaves the block.

        The path grows along an arc whose cost and next price make up the price of its last node.
        Where no arc does, that price rises to the cheapest one and the path gives the node up.
        """
        prices, path, exit_ = self.prices, [origin], len(self.prices) - 1
        while path[-1] != exit_:
            node = path[-1]
            best, next_ = None, -1
            for _, cost, to in self.arcs(node):
                if prices[to] is not None and (best is None or cost + prices[to] < best):
                    best, next_ = cost + prices[to], to
            if best is None or prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
                elif best is None:
                    return None
            else:
                path.append(next_)
        return prices[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """The least steps by their initials among the cheapest from a state, and the state they leave in.

        An arc is tight if its cost and the price of its end make up the price of its begin. The
        end's price is settled by an auction of its own before the arc counts.
        """
        node, exit_, steps, prices = state, len(self.prices) - 1, [], self.prices
        self.auction(node)
        while node != exit_:
            for step, cost, to in self.arcs(node):
                if prices[to] is None or prices[node] != cost + prices[to]:
                    continue
                if to != exit_ and prices[node] != cost + self.auction(to):
                    continue
                steps.append(step)
                if to == exit_:
                    return "".join(steps), node % 4
                node = to
                break
        raise AssertionError("a settled node has a tight arc")


@lru_cache(maxsize=1 << 15)
def prices_between(roles: str, faults: str) -> tuple[int | None, ...]:
    """The cheapest edits of a block from each state (rows of four) to each state."""
    found = []
    for end in range(4):
        lattice = Lattice(roles, faults, tuple(0 if s == end else None for s in range(4)))
        found.append([lattice.auction(s) if s in lattice.useful else None for s in range(4)])
    return tuple(found[end][start] for start in range(4) for end in range(4))


@lru_cache(maxsize=1 << 15)
def traces(roles: str, faults: str, exits: tuple[int | None, ...], states: int) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    """For each of the first states: the steps through a block and the state it is left in; and the price of the first."""
    lattice = Lattice(roles, faults, exits)
    found = [lattice.trace(s) for s in range(states)]
    return tuple(steps for steps, _ in found), tuple(left for _, left in found), lattice.prices[START]


def conversation_key(key: Column) -> Column:
    """A text that names a conversation, null ids too."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def in_order(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows, written with _conv and _at, which rises along each conversation: by turn (null first), role, text; repeated rows in any order.

    Rows are dealt by ranges of that whole order, so a conversation of a third of all rows is dealt to many tasks.
    """
    named = rows.select(
        conversation_key(F.col(key)).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"), F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("_row")]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()))


def with_faults(placed: DataFrame) -> DataFrame:
    """_conv, _at, letter and fault of each row: the first of b, d and t that applies, or -; texts stay behind.

    Of the rows equal in role and text the first is no duplicate; only one row of each such group moves to find it.
    """
    told = F.sha2(F.concat_ws(":", F.char_length("_role"), "_role", "_text").cast("binary"), 256)
    initial = F.substring("_role", 1, 1)
    narrow = placed.select(
        "_conv", "_at", told.alias("_told"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("letter"),
        (~F.col("_text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"), (~F.col("_text").rlike(rf"[.!?]{SPACE_CLASS}*\z")).alias("_cut"),
    )
    firsts = narrow.groupBy("_conv", "_told").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("_cut"), "t").otherwise("-")
    return narrow.join(firsts, "_at", "left").select("_conv", "_at", "letter", fault.alias("fault"))


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block of at most size rows: _conv, _block, _last (whether no block follows), ats, roles, faults."""
    task = F.shiftright("_at", 33)
    runs = rows.groupBy("_conv", task.alias("_task")).agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_n"))
    # a conversation has one run in each task that it was dealt to
    before = Window.partitionBy("_conv").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    totals = runs.groupBy("_conv").agg(F.sum("_n").alias("_total"))
    places = runs.join(totals, "_conv").select("_conv", "_task", "_total", (F.col("_before") - F.col("_begin")).alias("_shift"))
    # ids of a task count up over the rows of its partition, so they count up by one within a run
    placed = rows.withColumn("_task", task).join(places, ["_conv", "_task"]).withColumn("_pos", F.col("_at") + F.col("_shift"))
    held = placed.groupBy("_conv", F.expr(f"_pos div {size}").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "letter", "fault"))).alias("_rows"), F.max("_total").alias("_total")
    )  # at most size rows
    return held.select(
        "_conv", "_block", (F.col("_block") == F.expr(f"(_total - 1) div {size}")).alias("_last"), F.col("_rows._at").alias("ats"),
        F.array_join("_rows.letter", "").alias("roles"), F.array_join("_rows.fault", "").alias("faults"),
    )


def folded(rows: DataFrame, descending: bool, step: Callable, schema: str) -> DataFrame:
    """Fold each conversation's blocks, sorted, by step(state, block) -> (state, values); state is None at first.

    Rows stream through their task one by one: a conversation's blocks are never held together.
    """
    order = F.col("_block").desc() if descending else F.col("_block")
    named = schema.replace(",", " ").split()[::2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for batch in batches:
            out = []
            for block in batch.itertuples(index=False):
                if block[0] != conv:
                    conv, state = block[0], None
                state, values = step(state, block)
                out.append((block[0], block[1], *values))
            yield pd.DataFrame(out, columns=named)

    return rows.repartition("_conv").sortWithinPartitions("_conv", order).mapInPandas(run, schema)


def plan(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The cheapest edits of each block: _conv, _block, ats, faults, steps, cost (of the conversation, in block 0), illegal.

    rows are those of with_faults. A conversation of one block is solved at once. Of a longer one, blocks give the prices between
    all states in tasks of their own; these 16 numbers are folded from the last block to the first, which gives each block the prices of
    its exits, and the states that its steps lead to are folded from the first to the last.
    """
    blocks = written(in_blocks(rows, size))
    long = blocks.filter(~F.col("_last") | (F.col("_block") > 0))

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["prices"] = [list(prices_between(r, f)) for r, f in zip(batch.pop("roles"), batch.pop("faults"), strict=True)]
            yield batch

    def exits_of(state, block):
        exits = list(ENDS) if state is None else state
        costs = lambda start: [int(p + e) for p, e in zip(block[2][4 * start : 4 * start + 4], exits, strict=True) if not (none(p) or none(e))]
        return [min(costs(start), default=None) for start in range(4)], (exits,)

    prices = long.select("_conv", "_block", "roles", "faults").mapInPandas(between, "_conv string, _block bigint, prices array<bigint>")
    exits = folded(prices, True, exits_of, "_conv string, _block bigint, exits array<bigint>")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block, roles, faults, ends in zip(batch["_block"], batch["roles"], batch["faults"], batch["exits"], strict=True):
                ends = ENDS if ends is None else tuple(None if none(e) else int(e) for e in ends)
                steps, left, cost = traces(roles, faults, ends, 4 if block else 1)
                out.append((list(steps), list(left), cost if block == 0 else None, sum(roles[at : at + 2] not in LEGAL for at in range(len(roles) - 1))))
            made = pd.DataFrame(out, columns=["ways", "left", "cost", "illegal"])
            made["cost"] = made["cost"].astype("Int64")
            yield pd.concat([batch[["_conv", "_block", "_last", "ats", "roles", "faults"]].reset_index(drop=True), made], axis=1)

    solved = blocks.join(exits, ["_conv", "_block"], "left").select("_conv", "_block", "_last", "ats", "roles", "faults", "exits")
    kind = "_conv string, _block bigint, _last boolean, ats array<bigint>, roles string, faults string, ways array<string>, left array<int>, cost bigint, illegal bigint"
    solved = written(solved.mapInPandas(solve, kind))

    def enter(state, block):
        at, role = (START, "") if state is None else state
        illegal = int(bool(role) and role + block[3][0] not in LEGAL)
        return (block[2][at], block[3][-1]), (at, illegal)

    several = solved.filter(~F.col("_last") | (F.col("_block") > 0)).select("_conv", "_block", "left", "roles")
    entered = folded(several, False, enter, "_conv string, _block bigint, entry int, joint bigint")
    joined = solved.join(entered, ["_conv", "_block"], "left")
    return written(
        joined.select(
            "_conv", "_block", "ats", "faults", "cost", F.get("ways", F.coalesce("entry", F.lit(START))).alias("steps"),
            (F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal"),
        )
    )


def none(x) -> bool:
    return x is None or x != x


def repair(rows: DataFrame, size: int = BLOCK, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repaired rows and a summary of the edits of each conversation that has rows.

    A conversation is legal if the initials of its roles read (s?(ua)+)?. Keeping a row costs 0, another role 1, deleting it 2,
    an inserted empty row 5; blank rows and those equal in role and text to an earlier one must be deleted, and a row that doesn't end in
    . ! or ? costs 5 more if it stays. Of the cheapest edits those with the least initials are taken.

    Repaired rows: _conv, _at, _step (their order), role, text. Summary: _conv, blank, duplicate, truncated, illegal, cost, audit.
    Rows count by turn, null turns first, ties by role and text; repeated rows are duplicates; null roles and
    texts are one space, null ids one conversation. Texts of any length stay whole and move only where rows are put in order. Other columns are not read, so clashing names
    do no harm; an empty table gives two empty ones. A conversation's audit is one text of the result, a letter for each of its
    edits; no task holds more of a conversation than that.
    """
    placed = in_order(rows, key, turn, role, text)
    planned = plan(with_faults(placed), size)
    counted = lambda fault: F.sum(F.char_length("faults") - F.char_length(F.replace("faults", F.lit(fault), F.lit("")))).cast("long")
    audit = F.array_join(F.array_sort(F.collect_list(F.struct("_block", F.translate("steps", "uaUA", "RRII").alias("audit"))))["audit"], "")
    summary = planned.groupBy("_conv").agg(
        counted("b").alias("blank"), counted("d").alias("duplicate"), counted("t").alias("truncated"), F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), audit.alias("audit")
    )
    # a row's steps: the rows inserted before it, what happens to it, and after the last row those inserted behind
    parts = F.regexp_extract_all("steps", F.lit("[UA]*[KDua]([UA]+$)?"), F.lit(0))
    by_row = planned.select(F.explode(F.arrays_zip(F.col("ats").alias("_at"), parts.alias("part"))).alias("x")).select("x._at", F.col("x.part"))
    steps = placed.join(by_row, "_at").select("_conv", "_at", "_role", "_text", F.posexplode(F.split("part", "")).alias("_step", "step"))
    new_role = F.when(F.col("step") == "K", F.col("_role")).when(F.lower("step") == "u", "user").otherwise("assistant")
    new_text = F.when(F.col("step").isin("U", "A"), "").otherwise(F.col("_text"))
    return steps.filter("step NOT IN ('D', '')").select("_conv", "_at", "_step", new_role.alias("role"), new_text.alias("text")), summary


def digests(turns: DataFrame) -> DataFrame:
    """_conv and the hash of its rows as role:text, joined by line feeds; rows stream through the hash in order, as it demands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, hashlib.sha256()

        def made(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[at] for r in rows], pa.string()) for at in range(2)], ["_conv", "repaired_sha256"])

        for batch in batches:
            done = []
            for name, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != conv:
                    if conv is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = name, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield made(done)
        if conv is not None:
            yield made([(conv, state.hexdigest())])

    ordered = turns.repartition("_conv").sortWithinPartitions("_conv", "_at", "_step")
    return ordered.select("_conv", "role", "text").mapInArrow(run, "_conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the hash of conv_id:turn: dropped, emptied, without . ! ?, repeated, or said by the user."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(how == 4, "user").otherwise(blank("role"))
    times = F.when(how == 3, 2).otherwise(1)
    return rows.filter(how != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    original = table(spark, sf_dir, "conversations")
    rows = damaged(original)
    turns, summary = repair(rows)
    # one row for each turn number, so that a hot conversation's numbers are counted in many tasks
    numbers = rows.filter("turn IS NOT NULL").select(conversation_key(F.col("conv_id")).alias("_conv"), "turn").distinct()
    gaps = numbers.groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    every = original.select("conv_id").distinct().withColumn("_conv", conversation_key(F.col("conv_id")))
    found = every.join(summary, "_conv", "left").join(gaps, "_conv", "left").join(digests(turns), "_conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLES: dict[str, str] = {}
