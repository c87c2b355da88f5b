"""Hashes of many bits: difference hashes, neighbours within a distance by multi-index probing, groups, verified matches."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.components import linked_groups
from cardloom.session import written

WORD = 64
#: Rows of a block of references and of queries at most, cells and pairs that are compared at a time, and the likeliest references of a query that are verified first.
REFERENCES, QUERIES, CELLS, PAIRS, FEW = 1 << 16, 1 << 16, 1 << 21, 1 << 14, 4


def difference_hash(values: Column, size: int, words: int) -> Column:
    """words * 64 bits as longs from size numbers: whether a number exceeds one some steps on, round the end, for growing steps.

    All numbers take part, whatever the number of bits; null where the array has another size or a null.
    """
    fine = (F.size(values) == size) & F.forall(values, lambda x: x.isNotNull())

    def word(at: int) -> Column:
        bits = []
        for bit in range(WORD):
            turn, place = divmod(at * WORD + bit, size)
            more = F.get(values, F.lit(place)) > F.get(values, F.lit((place + turn + 1) % size))
            weight = (1 << bit) - (1 << WORD if bit == WORD - 1 else 0)
            bits.append(F.when(more, F.lit(weight)).otherwise(F.lit(0)).cast("long"))
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return F.when(fine, F.array(*[word(at) for at in range(words)]))


def distance(left: Column, right: Column, words: int) -> Column:
    """Bits in which two hashes of so many longs differ."""
    out = F.bit_count(F.get(left, F.lit(0)).bitwiseXOR(F.get(right, F.lit(0))))
    for at in range(1, words):
        out = out + F.bit_count(F.get(left, F.lit(at)).bitwiseXOR(F.get(right, F.lit(at))))
    return out


def band_plan(bits: int, most: int, rows: int) -> tuple[int, int]:
    """Bands and radius: hashes within most of bits differ in at most radius = most // bands bits of one band at least.

    More bands need smaller radii but are shorter, so more rows share one by chance. The plan with
    the least probes and chance meetings for so many rows is taken; bands fit a long.
    """
    best = None
    for bands in range(-(-bits // 62), most + 2):
        width, radius = bits // bands, most // bands
        probes = sum(comb(-(-bits // bands), r) for r in range(radius + 1))
        cost = bands * probes * (1 + rows / 2.0**width)
        if best is None or cost < best[0]:
            best = cost, bands, radius
    return best[1], best[2]


def band(hash_: Column, low: int, high: int) -> Column:
    """Bits low .. high - 1 of a hash as a long; a band may span two longs."""
    out = None
    while low < high:
        at, shift = divmod(low, WORD)
        take = min(high - low, WORD - shift)
        part = F.shiftrightunsigned(F.get(hash_, F.lit(at)), shift)
        part = part if take == WORD else part.bitwiseAND(F.lit((1 << take) - 1))
        out = part if out is None else F.shiftleft(out, take).bitwiseOR(part)
        low += take
    return out


def flips(width: int, radius: int) -> list[int]:
    """All patterns of at most radius bits among width."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def banded(rows: DataFrame, bits: int, bands: int, radius: int, probing: bool) -> DataFrame:
    """rows, once for each band (at) and key: the band's own value, or all values within radius of it.

    The patterns of a radius can be thousands, so they are rows to join with and no part of the plan.
    """
    cuts = [bits * i // bands for i in range(bands + 1)]
    own = F.array(*[F.struct(F.lit(i).alias("at"), band(F.col("hash"), cuts[i], cuts[i + 1]).alias("key")) for i in range(bands)])
    listed = rows.withColumn("_probe", F.explode(own)).select("*", "_probe.at", "_probe.key").drop("_probe")
    if not probing or radius == 0:
        return listed
    patterns = [(width, x) for width in {cuts[i + 1] - cuts[i] for i in range(bands)} for x in flips(width, radius)]
    near = rows.sparkSession.createDataFrame(patterns, "_width int, _flip bigint")
    width = F.element_at(F.array(*[F.lit(cuts[i + 1] - cuts[i]) for i in range(bands)]), F.col("at") + 1)
    met = listed.withColumn("_width", width).join(F.broadcast(near), "_width")
    return met.withColumn("key", F.col("key").bitwiseXOR(F.col("_flip"))).drop("_width", "_flip")


def neighbours(left: DataFrame, right: DataFrame, most: int, words: int, bands: int | None = None) -> DataFrame:
    """a, b, distance: ids of left and right whose hashes are at most this far apart, each pair once.

    Both tables have distinct ids and hashes of so many longs; rows without a hash meet nothing. Multi-index
    probing: right is listed by the values of its bands, and left asks for all values within the radius
    that some band of every neighbour must keep, so no pair beyond the bands is made and none within the distance is missed.
    """
    bits = WORD * words
    n = bands or band_plan(bits, most, right.count())[0]
    radius = most // n
    asked = banded(left.filter("hash IS NOT NULL").select(F.col("id").alias("a"), "hash"), bits, n, radius, True).withColumnRenamed("hash", "_x")
    held = banded(right.filter("hash IS NOT NULL").select(F.col("id").alias("b"), "hash"), bits, n, radius, False).withColumnRenamed("hash", "_y")
    met = asked.join(held, ["at", "key"]).withColumn("distance", distance(F.col("_x"), F.col("_y"), words)).filter(F.col("distance") <= most)
    # neighbours meet in each band that they nearly share; only the first of these counts
    cuts = [bits * i // n for i in range(n + 1)]
    shared = [F.bit_count(band(F.col("_x"), cuts[i], cuts[i + 1]).bitwiseXOR(band(F.col("_y"), cuts[i], cuts[i + 1]))) <= radius for i in range(n)]
    first = F.coalesce(*[F.when(s, F.lit(i)) for i, s in enumerate(shared)])
    return met.filter(F.col("at") == first).select("a", "b", "distance")


def representatives(rows: DataFrame) -> DataFrame:
    """id and hash: the least id of each hash, so that copies meet their neighbours once."""
    return written(rows.filter("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id")).select("id", "hash"))


def near_links(rows: DataFrame, most: int, words: int) -> DataFrame:
    """a, b, distance: neighbours among the representatives of hashes (a < b), and each representative with its copies at distance 0."""
    rows = written(rows.select("id", "hash"))
    reps = representatives(rows)
    links = neighbours(reps, reps, most, words).filter("a < b")
    copies = rows.join(reps.withColumnRenamed("id", "a"), "hash").filter("a <> id").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return links.unionByName(copies)


def near_groups(rows: DataFrame, most: int, words: int) -> DataFrame:
    """id, group (the least id linked over any path of neighbours) and links (neighbours of the row's hash); rows without a hash stand alone."""
    rows = written(rows.select("id", "hash"))
    reps = representatives(rows)
    links = written(neighbours(reps, reps, most, words).filter("a < b"))
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    groups = linked_groups(reps, links).join(reps, "id").join(degree, "id", "left").select("hash", "group", F.coalesce("links", F.lit(0)).alias("links"))
    found = rows.join(groups, "hash", "left")
    return found.select("id", F.coalesce("group", "id").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def blocks_of(rows: DataFrame, least: float | None) -> DataFrame:
    """rows with _bucket by set size: sets that share least of all their elements lie in one bucket or in two that follow each other."""
    # a little wider than need be, so that rounding parts no pair
    return rows.withColumn("_bucket", F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1.001 / least)).cast("int") if least else F.lit(0))


def parity_bits(numbers: np.ndarray) -> np.ndarray:
    """Of 4 to 8 bits for each of the distinct numbers, 1,024 at least and a power of two: whether an odd count of them has the bit as its remainder."""
    width = 1024
    while width < 4 * len(numbers):
        width *= 2
    return (np.bincount((numbers % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(bool)


def folded(parities: pa.ListArray, least: int, most: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The longs of each row, and for each width of least to most longs the parities of all rows that have so many, folded to it by halves."""
    flat, ends = parities.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(parities.value_lengths().to_numpy()))
    lengths, rows = np.diff(ends), {}
    width = int(lengths.max())
    above = np.zeros((len(lengths), width), np.uint64)
    while width >= least:
        own = np.flatnonzero(lengths == width)
        above[own] = flat[ends[own][:, None] + np.arange(width)]
        rows[width] = above
        above, width = above[:, : width // 2] ^ above[:, width // 2 :], width // 2
    return lengths, {w: x for w, x in rows.items() if w <= most}


def near_pairs(queries: DataFrame, references: DataFrame, most: int, least: float | None, few: int | None) -> DataFrame:
    """a, b, bound: ids of queries and references whose hashes are at most this far apart, and the most that their sets can score.

    queries: id, hash, plain (the nearer one counts), size, parities, floor, floor_id; references: id, hash, size, parities. parities (parity_bits) says of each bit whether an odd
    number of the set's elements falls there: sets differ in as many elements at least as their parities in bits, so no pair that shares least is missed. Without least
    the bound is infinite. Pairs below floor, or at it with a greater id than floor_id, are left out. Each block of references keeps the few best bounds
    of a query, ties the least ids; where others are left, a row without b has the best of these. At so short a distance bands of a hash say little and
    are met again and again, so blocks of queries meet blocks of references, of near sizes only, by plain counts of bits.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = max(queries.sparkSession.sparkContext.defaultParallelism, -(-references.count() // REFERENCES))
    turns = -(-queries.count() // QUERIES) or 1
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    beside = F.explode(F.array(*[F.col("_bucket") + i for i in ((-1, 0, 1) if least else (0,))]))
    by = ["_bucket", "_deal", "_turn"]
    asked = blocks_of(queries, least).withColumn("_bucket", beside).withColumn("_turn", deal(turns)).withColumn("_deal", every(deals)).repartition(parts, *by)
    held = blocks_of(references, least).withColumn("_deal", deal(deals)).withColumn("_turn", every(turns)).repartition(parts, *by)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bound", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1)
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        number = lambda t, c: t.column(c).to_numpy()
        ids, found = number(right, "id"), []
        looks, hashes = [flat(left, "hash"), flat(left, "plain")], flat(right, "hash")
        apart = lambda x: np.bitwise_count(x[:, None] ^ hashes[:, 0]) if x.ndim == 1 else sum(np.bitwise_count(x[:, w, None] ^ hashes[:, w]).astype(np.int32) for w in range(x.shape[1]))
        if least:
            n_left, n_right = number(left, "size"), number(right, "size")
            odd = [t.column("parities").combine_chunks() for t in (left, right)]
            widths = [x.value_lengths().to_numpy() for x in odd]
            (w_left, odd_left), (w_right, odd_right) = (folded(x, min(n.min() for n in widths), min(n.max() for n in widths)) for x in odd)
        floor, floor_id, names = number(left, "floor"), number(left, "floor_id"), number(left, "id")
        lines = max(1, CELLS // len(ids))
        for start in range(0, len(names), lines):
            own = slice(start, start + lines)
            at, to = np.nonzero(np.minimum(*[apart(x[own, 0] if x.shape[1] == 1 else x[own]) for x in looks]) <= most)
            at += start
            kept = []
            for some in range(0, len(at), PAIRS):
                x, y = at[some : some + PAIRS], to[some : some + PAIRS]
                if least:
                    total = n_left[x] + n_right[y]
                    fine = least * np.maximum(n_left[x], n_right[y]) <= np.minimum(n_left[x], n_right[y])
                    x, y, total = x[fine], y[fine], total[fine]
                    both, apart_by = np.minimum(w_left[x], w_right[y]), np.zeros(len(x), np.int64)
                    for width in np.unique(both):
                        alike = np.flatnonzero(both == width)
                        apart_by[alike] = np.bitwise_count(odd_left[width][x[alike]] ^ odd_right[width][y[alike]]).sum(1, dtype=np.int64)
                    shared = (total - apart_by) // 2
                    bound = shared / (total - shared)
                    fine = bound >= least
                    x, y, bound = x[fine], y[fine], bound[fine]
                else:
                    bound = np.full(len(x), np.inf)
                fine = (bound > floor[x]) | ((bound == floor[x]) & (ids[y] < floor_id[x]))
                kept.append((x[fine], ids[y[fine]], bound[fine]))
            if not kept:
                continue
            x, y, bound = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort((y, -bound, x))
            x, y, bound = x[order], y[order], bound[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            shown = place <= (few if few is not None else len(x))
            x, y, bound, place = x[shown], y[shown], bound[shown], place[shown]
            found.append(pa.table([pa.array(names[x]), pa.array(y, mask=place == few if few is not None else None), pa.array(bound)], schema=kinds))
        return pa.concat_tables(found) if found else kinds.empty_table()

    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(compare, "a bigint, b bigint, bound double")


def verified_matches(queries: DataFrame, references: DataFrame, most: int, words: int, score: Column, accepted: Column, least: float | None = None, evidence: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id, method, score: the best reference of each query; queries without one have no row.

    Both tables have id, content, hash, plain_hash (of the normalised item; references use hash only) and evidence. A reference of equal
    content wins outright, the least id of several, with score 1. Otherwise references whose hash is within most bits of either hash of the query
    are looked at; score and accepted are columns over left and right evidence. The best score wins, ties the least id.

    With least, evidence is a set, the score is the share of two sets' elements that both hold, none below least is accepted, and both tables have size and
    parities of it: pairs that can't reach least, or what a query's likeliest references reached, move no evidence. evidence makes id and evidence of a
    table of ids, so that only rows in such pairs get it. References alike in content and hash are one, by their least id.
    """
    facts = ["size", "parities"] if least else []
    alike = references.filter("hash IS NOT NULL OR content IS NOT NULL").groupBy("content", "hash", F.when(F.col("content").isNull(), F.col("id")).alias("_alone")).agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in facts])
    held = written(alike.drop("_alone"))
    first = held.filter("content IS NOT NULL").groupBy(F.col("content").alias("_content")).agg(F.min("id").alias("_same"))
    asked = written(queries.select("id", "content", "hash", "plain_hash", *facts).join(first, F.col("content") == F.col("_content"), "left"))
    exact = asked.filter("_same IS NOT NULL").select(F.col("id").alias("query_id"), F.col("_same").alias("id"), F.lit("exact_content").alias("method"), F.lit(1.0).alias("score"))
    open_ = asked.filter("_same IS NULL").select("id", F.coalesce("hash", "plain_hash").alias("hash"), F.coalesce("plain_hash", "hash").alias("plain"), *facts).filter("hash IS NOT NULL")
    open_ = open_.withColumns({"floor": F.lit(0.0), "floor_id": F.lit(0).cast("long")})
    held = held.filter("hash IS NOT NULL").select("id", "hash", *facts)
    of = lambda rows, ids: evidence(ids) if evidence else rows.select("id", "evidence").join(ids, "id", "left_semi")

    def judged(pairs: DataFrame) -> DataFrame:
        left = of(queries, pairs.select(F.col("a").alias("id")).distinct()).select(F.col("id").alias("a"), F.col("evidence").alias("left"))
        right = of(references, pairs.select(F.col("b").alias("id")).distinct()).select(F.col("id").alias("b"), F.col("evidence").alias("right"))
        return written(pairs.select("a", "b").join(left, "a").join(right, "b").filter(accepted).select("a", "b", score.alias("score")))

    def best_of(found: DataFrame) -> DataFrame:
        return found.groupBy("a").agg(F.max_by(F.struct("b", "score"), F.struct("score", -F.col("b"))).alias("_best")).select("a", "_best.b", "_best.score")

    near = written(near_pairs(open_, held, most, least, FEW))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("bound"), "b"))
    named = near.filter("b IS NOT NULL")
    likeliest = best_of(judged(written(named.withColumn("_place", place).filter(F.col("_place") <= FEW))))
    reached = written(likeliest.select("a", "score", F.col("b").alias("_b")))
    # what the likeliest leave open: pairs seen, and queries with pairs that their blocks left out
    may = lambda rows: rows.join(reached, "a", "left").filter("score IS NULL OR bound >= score")
    again = may(near.filter("b IS NULL").groupBy("a").agg(F.max("bound").alias("bound"))).select(F.col("a").alias("id"), F.coalesce("score", F.lit(0.0)).alias("floor"), F.coalesce("_b", F.lit(0)).cast("long").alias("floor_id"))
    again = written(again)
    rest = may(named.withColumn("_place", place).filter(F.col("_place") > FEW)).join(again.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b")
    whole = near_pairs(open_.drop("floor", "floor_id").join(again, "id"), held, most, least, None).select("a", "b") if again.head(1) else named.limit(0).select("a", "b")
    best = best_of(likeliest.unionByName(judged(written(rest.unionByName(whole)))))
    return exact.unionByName(best.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.lit("verified").alias("method"), "score"))


def pack_bits(bits: np.ndarray) -> list[int]:
    """Longs of a row of bits, the least bit first."""
    return np.packbits(bits.reshape(-1, WORD)[:, ::-1], axis=1).view(">i8").ravel().tolist()
