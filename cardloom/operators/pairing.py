"""Scan files and captures brought together: sides and pairs by name, by turn and by time, and splits by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.expr import natural_key


#: Words in a file name that mark a side; words at its end that do not tell families apart.
FRONT, BACK = ["front", "f", "obverse", "a"], ["back", "b", "reverse", "r"]
ENDINGS = ["front", "back", "obverse", "reverse", "img", "image", "photo", "scan", "page"]
SIDE_ENDING = rf"(?i)([_\-. ]({'|'.join(ENDINGS)})[_\-. ]*\d*)+$"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")


def marked_parts(name: Column) -> Column:
    """The parts of a file's name in lower case, cut at each of _ - . and white space, and at (from 0) of its last marker, -1 without one.

    A marker takes the signs beside it, so a part right behind one is none.
    """
    parts = F.split(F.lower(stem(name)), r"[_\-.\s]")
    start = F.struct(F.lit(0).alias("turn"), F.lit(False).alias("hit"), F.lit(-1).alias("at"))

    def step(state: Column, part: Column) -> Column:
        hit = part.isin(FRONT + BACK) & ~state["hit"]
        return F.struct((state["turn"] + 1).alias("turn"), hit.alias("hit"), F.when(hit, state["turn"]).otherwise(state["at"]).alias("at"))

    return F.struct(parts.alias("parts"), F.aggregate(parts, start, step)["at"].alias("at"))


def side_of(name: Column) -> Column:
    """front or back by the last marker in a file's name; null without one."""
    marked = marked_parts(name)
    return F.when(marked["at"] >= 0, F.when(F.get(marked["parts"], marked["at"]).isin(FRONT), "front").otherwise("back"))


def base_of(name: Column) -> Column:
    """Letters and digits of a file's name without its last marker; the whole name without its ending where nothing else is left."""
    marked = marked_parts(name)
    others = F.filter(marked["parts"], lambda part, at: at != marked["at"])
    return F.coalesce(F.nullif(F.regexp_replace(F.array_join(others, ""), "[^a-z0-9]+", ""), F.lit("")), F.lower(stem(name)))


def filename_pairs(files: DataFrame, name: str = "name", folder: str = "folder") -> DataFrame:
    """folder, base, turn, front, back: marked files of one base, fronts and backs by natural order; a back alone takes the front's place."""
    marked = files.withColumns({"side": side_of(F.col(name)), "base": base_of(F.col(name))}).filter("side IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy(folder, "base", "side").orderBy(natural_key(name), name))
    g = marked.withColumn("turn", turn).groupBy(folder, "base", "turn").agg(F.max(F.when(F.col("side") == "front", F.col(name))).alias("_f"), F.max(F.when(F.col("side") == "back", F.col(name))).alias("_b"))
    return g.select(folder, "base", "turn", F.coalesce("_f", "_b").alias("front"), F.when(F.col("_f").isNotNull(), F.col("_b")).alias("back"))


def alternating_pairs(files: DataFrame, name: str = "name", folder: str = "folder") -> DataFrame:
    """folder, pair, front, back: files of a folder two by two in natural order; the last may have no back."""
    at = F.row_number().over(Window.partitionBy(folder).orderBy(natural_key(name), name)) - 1
    placed = files.withColumn("_at", at).withColumn("pair", F.floor(F.col("_at") / 2).cast("int"))
    return placed.groupBy(folder, "pair").agg(F.max(F.when(F.col("_at") % 2 == 0, F.col(name))).alias("front"), F.max(F.when(F.col("_at") % 2 == 1, F.col(name))).alias("back"))


def family_of(path: Column) -> Column:
    """A file's folder and name in lower case, without ending and side."""
    plain = F.lower(path)
    folder, file = F.regexp_extract(plain, "^(.*)/", 1), F.regexp_extract(plain, "([^/]*)$", 1)
    bare = F.regexp_replace(stem(file), SIDE_ENDING, "")
    return F.when(folder != "", F.concat_ws("/", folder, bare)).otherwise(bare)


def family_split(family: Column) -> Column:
    """70 / 20 / 10 by the hash of the family, so that the sides of a card stay together."""
    bucket = F.conv(F.substring(F.sha2(family, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").when(bucket < 90, "valid").otherwise("test")


def capture_neighbours(views: DataFrame, seconds: int = 240, bits: int = 24, k: int = 8) -> DataFrame:
    """id, rank, other, distance: the k views of an owner taken within seconds, of hashes within bits.

    views: owner, id, at (seconds), hash. Times are cut into spans of that length, and a view meets
    its own span and the two beside it, so an owner's views are never all compared.
    """
    span = views.withColumn("_span", F.floor(F.col("at") / seconds))
    others = span.select("owner", F.col("id").alias("other"), F.col("at").alias("_at"), F.col("hash").alias("_hash"), F.explode(F.array(F.col("_span") - 1, F.col("_span"), F.col("_span") + 1)).alias("_span"))
    met = span.join(others, ["owner", "_span"]).filter(F.col("id") != F.col("other")).filter(F.abs(F.col("at") - F.col("_at")) <= seconds)
    near = met.withColumn("distance", F.bit_count(F.col("hash").bitwiseXOR(F.col("_hash")))).filter(F.col("distance") <= bits)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "other", "distance")


def open_sides(views: DataFrame) -> DataFrame:
    """group, other: groups of one identity that lack each other's side. views: identity, group, side."""
    g = views.groupBy("identity", "group").agg(F.max(F.col("side") == "front").alias("f"), F.max(F.col("side") == "back").alias("b"))
    fronts, backs = g.filter("f AND NOT b").select("identity", "group"), g.filter("b AND NOT f").select("identity", F.col("group").alias("other"))
    return fronts.join(backs, "identity")
