"""Queries on raw sales, imports, certificates, scenes, surveys, scan files and source rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.expr import jaccard, tokens
from cardloom.operators import events as Q
from cardloom.operators import normalize as N
from cardloom.operators import pairing as P
from cardloom.operators import policy as R
from cardloom.operators.vectors import iou
from cardloom.plans.views import CARDS_SQL, SALES_SQL, cards, sales
from cardloom.session import table


def pick(values: list, by: Column) -> Column:
    """One of the values by the remainder of a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values: list, by: str) -> str:
    shown = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}" for v in values)
    return f"([{shown}])[({by}) % {len(values)} + 1]"


SOURCES = [None, "sold", "active", "completed_sale", "asking"]
SALE_KINDS = [None, "auction", "asking", "private"]
GRADE_TEXTS = ["psa 10", "PSA-10", "BGS 9.5", "raw", "Mint ", None]


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as providers send them: kinds, grades, extras and prices with gaps."""
    rows = sales(spark, sf_dir).join(cards(spark, sf_dir).select("card_id", "year", "set_name", "player", "card_number"), "card_id")
    line, part, supp = F.col("seen.l_linenumber"), F.col("card_id"), F.col("seen.l_suppkey")
    return rows.select(
        "card_id", "provider", "raw_id", F.col("seen.l_extendedprice").alias("list_price"), pick(SOURCES, line).alias("source_type"), F.when(part % 6 == 0, "active").alias("listing_type"), pick(SALE_KINDS, supp).alias("sale_type"),
        (supp % 9 == 0).alias("completed_flag"), F.when(F.col("completed"), F.col("sold_at")).alias("sold_at"), F.when(part % 50 == 0, None).when(part % 51 == 0, -F.col("price")).otherwise(F.col("price")).alias("price"),
        F.when(part % 7 != 0, F.col("shipping")).alias("shipping"), "premium", pick(GRADE_TEXTS, part).alias("grade_text"), F.when(part % 4 != 0, F.col("confidence")).alias("confidence"), "year", "set_name", "player", "card_number", "basis", "verified",
    )


RAW_SQL = rf"""{SALES_SQL}, {CARDS_SQL}, raw AS (
  SELECT s.card_id, s.provider, s.raw_id, s.seen[6] AS list_price, {pick_sql(SOURCES, 's.seen[2]')} AS source_type, CASE WHEN s.card_id % 6 = 0 THEN 'active' END AS listing_type, {pick_sql(SALE_KINDS, 's.seen[4]')} AS sale_type,
    s.seen[4] % 9 = 0 AS completed_flag, CASE WHEN completed THEN sold_at END AS sold_at, CASE WHEN s.card_id % 50 = 0 THEN NULL WHEN s.card_id % 51 = 0 THEN -price ELSE price END AS price,
    CASE WHEN s.card_id % 7 <> 0 THEN shipping END AS shipping, premium, {pick_sql(GRADE_TEXTS, 's.card_id')} AS grade_text, CASE WHEN s.card_id % 4 <> 0 THEN confidence END AS confidence, year, set_name, player, card_number, basis, verified
  FROM sales s JOIN cards USING (card_id)
)"""


def normalized_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.normalize_sales(raw_sales(spark, sf_dir))
    return rows.select("provider", "raw_id", "list_price", "completed", "source_type", "listing_type", "sale_type", F.unix_seconds("sold_at").alias("sold_s"), "all_in", "company", "grade", "card_key", "confidence", "error")


def coerced_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import rows of a file whose flags are texts."""
    rows = raw_sales(spark, sf_dir).withColumns({"completed_text": pick(["Yes", "no", "", None, "SOLD"], F.col("card_id")), "verified_text": pick(["", "true", "0"], F.col("card_id")), "provider": F.when(F.col("card_id") % 40 == 0, " ").otherwise(F.col("provider"))})
    return N.coerce_imports(rows).select("provider", "raw_id", "list_price", "completed", "verified", "confidence", "error")


def manual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cards(spark, sf_dir).select(
        F.col("card_id").alias("comp_id"), F.when(F.col("card_id") % 2 == 0, F.col("card_id") * 1.5).alias("read_price"), (F.col("card_id") * 2.0).alias("price"),
        F.when(F.col("card_id") % 3 == 0, "2024-02-03").alias("read_sold_on"), F.when(F.col("card_id") % 5 == 0, "2024-01-01").alias("sold_on"), pick([0.0, 0.6, 0.9], F.col("card_id")).alias("read_confidence"), pick([0.5, 0.0], F.col("card_id")).alias("confidence"),
    )
    return N.manual_comps(rows)


#: Texts of certificates, {n} a number of eight digits, with the company that they name and the number that they give.
CERT_TEXTS = [
    ("PSA 10 cert {n}", "PSA", "{n}"), ("https://www.psacard.com/cert/{n}", "PSA", "{n}"), ("Beckett Certification Number: 00{n}", "BGS", "00{n}"), ("SGC 9.5 certificate number: ab{n}", "SGC", "AB{n}"),
    ("https://www.cgcgrading.com/verify/{n}", "CGC", "{n}"), ("PSA cert no. 12O4S67l", "PSA", "12045671"), ("BGS gem mint 9.5", "BGS", None), ("no company {n}", None, None), ("CGC 99", "CGC", None), ("", None, None),
    ("https://www.gosgc.com/cert-code-lookup?certificateNumber=AA{n}", "SGC", "AA{n}"), ("certification # {n}", None, "{n}"), ("gem mint PSA {n}", "PSA", "{n}"), ("BGS 9 cert 123", "BGS", None),
]


def card_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of certificates with numbers after the cards, every other one with its company beside it."""
    rows = cards(spark, sf_dir)
    number = (F.lit(30_000_000) + F.col("card_id") * 37).cast("string")
    text = F.replace(pick([t for t, _, _ in CERT_TEXTS], F.col("card_id")), F.lit("{n}"), number)
    company = F.when(F.pmod(F.floor(F.col("card_id") / len(CERT_TEXTS)), F.lit(2)) == 0, pick([c for _, c, _ in CERT_TEXTS], F.col("card_id")))
    return N.certificates(rows.select("card_id", F.when(company == "BGS", "Beckett").otherwise(company).alias("grader"), text.alias("cert_text")))


def parsed_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_certificates(spark, sf_dir).select("card_id", "cert_grader", "cert", "cert_valid", "cert_confidence")


def certificate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best certificate of every ten cards, and whether they disagree."""
    return N.best_certificate(card_certificates(spark, sf_dir).withColumn("item", F.floor(F.col("card_id") / 10)))


SCENE_TEXTS = ["single card", "binder page", "Empty scene", "mixed raw slab", "a table of cards", "hobby box", "cert label", "manual text", "two singles", "landscape", "Multi-card table", "retail tin"]
TITLES = ["Binder with 9 pocket page", "Hobby box sealed", "Lot of 20 cards", "PSA 9 slab", "Rookie", "Graded gem mint", "Bundle", "Tin"]


def scene_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("card_id", N.scene_type(pick(SCENE_TEXTS, F.col("card_id"))).alias("scene"), N.title_scene(pick(TITLES, F.col("card_id"))).alias("title_scene"), N.box_side(F.when(F.col("card_id") % 3 != 0, (F.col("card_id") % 250) / 2), 1.0).alias("side"))


PAYLOADS = [
    ("https://www.psacard.com/cert/{n}", "url", "PSA", "{n}"), ("https://www.psacard.com/cert/verify/{n}", "url", "PSA", "{n}"), ("https://www.beckett.com/grading/card-lookup?item_id={n}", "url", "BGS", "{n}"), ("https://www.gosgc.com/auth-code/AB{n}", "url", "SGC", "AB{n}"),
    ("https://www.cgccards.com/certlookup/{n}", "url", "CGC", "{n}"), ("QR:psa {n}", "qr_text", "PSA", "{n}"), ("{n}", "numeric_cert", None, "{n}"), ("https://example.com/x", "url", None, None), ("hello", "text", None, None), ("", "none", None, None),
]


def scanned_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What payloads after the cards say."""
    number = (F.lit(30_000_000) + F.col("card_id") * 37).cast("string")
    rows = cards(spark, sf_dir).select("card_id", F.replace(pick([p for p, *_ in PAYLOADS], F.col("card_id")), F.lit("{n}"), number).alias("payload"))
    return N.scanned_payloads(rows).select("card_id", "payload_type", "payload_grader", "payload_cert")


LABELS = [
    "{year} Topps Chrome\n{player}\n#{n} Prizm\nPSA GEM MT 10\n3{id}", "BECKETT | {player} | {year} Panini Basketball | card no. {n}/99 | 9.5", "Pokemon {player} grade: 8", "CSG\n1234567", "", "{player} {n} / 25 SGC 9 cert AB12{id}",
]


def slab_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels after the cards say."""
    rows = cards(spark, sf_dir)
    label = pick(LABELS, F.col("card_id"))
    for name, value in (("year", F.col("year").cast("string")), ("player", F.initcap("player")), ("n", F.col("card_number")), ("id", F.lpad(F.col("card_id").cast("string"), 7, "0"))):
        label = F.replace(label, F.lit("{" + name + "}"), value)
    read = N.slab_labels(rows.select("card_id", label.alias("label_text")))
    return read.select("card_id", "cert_grader", "cert", "grade", F.col("year").alias("label_year"), "card_number", "serial", F.array_join("useful_lines", "|").alias("useful"), "player_hint", "sport_hint", F.array_join("warnings", ",").alias("warnings"))


QUALITY_MEASURES = [N.DEFECTS.get(m, m) for m in N.QUALITY_WEIGHTS]


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of pages taken for images: measures come from the sizes of their parts, some in percent and some missing."""
    size = F.length(F.coalesce("html", F.lit("")))
    measure = lambda k: F.when(F.pmod(size + k, F.lit(11)) == 10, None).when(F.pmod(size, F.lit(3)) == 0, F.pmod(size * k, F.lit(101)).cast("double")).otherwise(F.pmod(size * k, F.lit(17)) / 16)
    rows = table(spark, sf_dir, "pages").select("page_id", *[measure(k + 3).alias(m) for k, m in enumerate(QUALITY_MEASURES)])
    return N.quality_gate(rows).select("page_id", "quality", F.array_join("failures", ",").alias("failures"), "tier", F.array_join("actions", ",").alias("actions"))


KINDS = ["one_row_box", "binder", "shoe_box", "slab_case", "heap", "toploader_box", "graded_card_box"]
CONTENTS = ["raw", "penny sleeves", "toploaders", "slabs"]


def survey_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of a survey for each order, from its lines."""
    line = table(spark, sf_dir, "lineitem")
    turn = F.pmod("l_linenumber", F.lit(3))
    rows = line.select(
        F.col("l_orderkey").alias("survey"), pick(KINDS, F.col("l_partkey")).alias("kind"), pick(CONTENTS, F.col("l_suppkey")).alias("content"), (F.pmod("l_partkey", F.lit(3)) + 1).alias("quantity"), (F.col("l_quantity") / 50).alias("fullness"),
        F.when(turn == 0, F.pmod("l_partkey", F.lit(400))).alias("direct_count"), F.when(turn == 1, F.pmod("l_partkey", F.lit(90))).alias("stack_count"), ((F.pmod("l_suppkey", F.lit(7)) + 3) / 10).alias("confidence"),
        F.concat_ws("-", pick(KINDS, F.col("l_partkey")), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("visual_key"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seen"),
    )
    return N.survey_counts(rows)


def survey_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and cards of each way of counting."""
    return survey_objects(spark, sf_dir).groupBy("method", "kind").agg(F.count(F.lit(1)).alias("objects"), F.sum("low").alias("low"), F.sum("expected").alias("expected"), F.sum("high").alias("high"))


def survey_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.survey_totals(survey_objects(spark, sf_dir), "survey", "visual_key", "seen")


ENDINGS = ["_front", "_back", " F", ".B", "-reverse", ""]


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan file for each document, in a folder for each source."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"), F.concat(F.lit("Card "), F.floor(doc / 60).cast("string"), pick(ENDINGS, F.floor(doc / 20)), F.lit(".jpg")).alias("name"))


def scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filename_pairs(scan_files(spark, sf_dir))


def scan_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alternating_pairs(scan_files(spark, sf_dir))


def family_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of scan files by folder and name without side."""
    family = P.family_of(F.concat_ws("/", "folder", "name"))
    return scan_files(spark, sf_dir).select("doc_id", family.alias("family"), P.family_split(family).alias("split"))


def capture_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within ten minutes whose hashes differ in at most 14 of 32 bits."""
    views = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long").alias("hash"))
    return P.capture_neighbours(views, 600, 14, 8)


def open_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = scan_files(spark, sf_dir).select(F.concat_ws("/", "folder", P.base_of(F.col("name"))).alias("identity"), F.floor(F.col("doc_id") / 20).alias("group"), P.side_of(F.col("name")).alias("side")).filter("side IS NOT NULL")
    return P.open_sides(views)


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what the rules of their sources say of their paths."""
    key = F.col("page_id") % 3
    texts = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.when(key == 1, texts("/en", "/de")).otherwise(texts()).alias("allowed"), F.when(key == 2, texts("/fr", "/p")).otherwise(texts()).alias("disallowed"),
        F.when(key == 0, texts("/en/")).otherwise(texts()).alias("robots_allow"), F.when(key == 0, texts("/e", "/d")).otherwise(texts()).alias("robots_disallow"),
    )
    return R.path_decisions(rows).select("page_id", "path", "decision")


HOSTS = ["images.example.com", "example.org"]
IMAGE_URLS = ["https://images.example.com/a.png", "http://images.example.com/a.png", "https://cdn.example.org/x", "https://example.organic/x", None]


def image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales(spark, sf_dir).select((F.col("card_id") + F.when(F.col("seen.l_linenumber") == 5, 10**9).otherwise(0)).alias("card_id"), "raw_id", "basis", pick(IMAGE_URLS, F.col("card_id")).alias("image_url"))
    return R.image_rows(rows, cards(spark, sf_dir), HOSTS)


def image_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_candidates(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), "host").agg(F.count(F.lit(1)).alias("rows"))


def unknown_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_candidates(spark, sf_dir).select("card_id", "raw_id")
    return R.unknown_cards(rows, cards(spark, sf_dir)).groupBy("card_id").agg(F.count(F.lit(1)).alias("rows"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a manifest of all documents."""
    doc = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("asset_"), F.floor(doc / 2).cast("string")).alias("asset_id"), F.when(doc % 10 == 0, "none").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"),
        pick(["train", "test", "validation", "other"], F.floor(doc / 3)).alias("split"), F.floor(doc / 5).alias("family"),
    )
    return R.manifest_errors(rows, ["train", "validation", "calibration", "test", "locked_test"])


def conversation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty conversations after a cursor, by their number of turns."""
    heads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return R.keyset_page(heads, "turn", "conv_id", 50, (4, 60))


def draft_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_versions(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 events of each user."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return R.newest(rows, "user_id", 25, F.desc("ts"), "event_id").select("user_id", "event_id", "event_type")


def latest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return R.last_wins(rows, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


def corrected_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of the cards whose corrections name another grade or price."""
    rows = raw_sales(spark, sf_dir).select("card_id", "raw_id", "list_price", "grade_text", "price")
    fixes = cards(spark, sf_dir).filter("card_id % 3 = 0").select("card_id", F.when(F.col("card_id") % 2 == 0, "PSA 9").alias("grade_text"), F.when(F.col("card_id") % 5 == 0, 10.0).alias("price"))
    return R.patched(rows, fixes, "card_id", ["grade_text", "price"])


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = sales(spark, sf_dir).groupBy("card_id").agg(F.round(F.avg("all_in"), 4).alias("value"))
    order = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 2500).alias("card_id"), F.when(F.col("o_orderkey") % 2 == 0, "above").otherwise("below").alias("direction"), (F.col("o_totalprice") / 100).alias("target"))
    return R.watch_triggers(order, values)


def watch_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New alerts, without those that customers of even numbers have open for cards of even numbers."""
    found = watches(spark, sf_dir)
    return R.new_alerts(found, found.filter("owner % 2 = 0 AND card_id % 2 = 0").select("owner", "card_id", "direction").distinct())


def watch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watches(spark, sf_dir).groupBy("direction", "triggered").agg(F.count(F.lit(1)).alias("watches"), F.count("value").alias("valued"))


def embedding_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), pick(["front", "back", "edge"], F.col("vec_id")).alias("side"), (F.col("vec_id") % 4 != 0).alias("commercial_use"))
    queue = table(spark, sf_dir, "embeddings").filter("vec_id % 5 < 2").select(F.col("vec_id").alias("image_id"), pick(["complete", "pending", "failed"], F.floor(F.col("vec_id") / 5)).alias("status"), (F.col("vec_id") % 9).cast("int").alias("priority"))
    return R.enqueue(queue, images, 5)


def reference_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = cards(spark, sf_dir).select("card_id", F.concat(F.lit("key"), F.col("card_id").cast("string")).alias("card_key"))
    vec = table(spark, sf_dir, "embeddings")
    uri = F.concat(F.lit("img/"), F.col("vec_id").cast("string"))
    old = vec.filter("vec_id % 3 = 0").select(uri.alias("image_uri"), (F.col("vec_id") + 1).alias("card_id"), F.lit("front").alias("side"), F.md5(uri).alias("sha"), F.lit(640).alias("width"))
    new = vec.filter("vec_id % 2 = 0").select(F.concat(F.lit("key"), (F.col("vec_id") * 7).cast("string")).alias("card_key"), uri.alias("image_uri"), F.lit("back").alias("side"), F.when(F.col("vec_id") % 4 == 0, "new").alias("sha"), F.when(F.col("vec_id") % 5 == 0, 800).alias("width"))
    return R.reference_images(old, new, known)


def provider_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("P0", True, "authorized"), ("P1", False, "authorized"), ("P2", True, "demo_only"), ("P8", True, "authorized"), ("P9", True, "demo_only")], "provider string, completed_sales boolean, rights string")
    return R.provider_coverage(listed, sales(spark, sf_dir))


def task_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable keys of scan tasks."""
    return table(spark, sf_dir, "pages").select("page_id", R.idempotency_key(task=F.lit("ocr"), job=(F.col("page_id") % 7), scope=F.when(F.col("page_id") % 2 == 0, "region")).alias("key"))


FAILURE_MESSAGES = ["", "Rate limit", "decode failed", "forbidden", "timeout", None, "disk", "CUDA out of memory", "model file missing"]


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of tasks made from events, by class: code, whether to try again, how to wait."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(pick([200, 429, 503, 413, 400, None], n).alias("status"), pick(FAILURE_MESSAGES, n).alias("message"), F.when(n % 4 == 0, F.concat(F.lit("e_"), "event_type")).alias("own"))
    return rows.groupBy(Q.failure_class(F.col("status"), F.col("message"), F.col("own")).alias("f")).agg(F.count(F.lit(1)).alias("tasks")).select("f.*", "tasks")


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of a card's name and set agree."""
    return cards(spark, sf_dir).select("card_id", F.round(jaccard(F.array_distinct(tokens(F.concat_ws(" ", "player", "brand"))), F.array_distinct(tokens(F.concat_ws(" ", "set_name", "brand")))), 6).alias("overlap"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two boxes made from each page's id."""
    n = F.col("page_id")
    side = lambda k, m: ((n * k) % m).cast("double") / 10
    return table(spark, sf_dir, "pages").select("page_id", F.round(iou(side(3, 7), side(5, 7), side(7, 11), side(11, 13), side(13, 7), side(17, 7), side(19, 11), side(23, 13)), 6).alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_sales, coerced_imports, manual_evidence, parsed_certificates, certificate_evidence, scene_types, slab_labels, scanned_payloads, image_quality, survey_estimates, survey_summaries, scan_pairs, scan_turn_pairs, family_splits, capture_neighbours, open_sides, path_rules,
        image_rejections, unknown_card_rows, manifest_check, conversation_page, draft_versions, usage_log, latest_observations, corrected_sales, watch_alerts, watch_counts, embedding_queue, reference_upserts, provider_coverage, task_keys, failure_classes, token_overlap, box_overlaps,
    )
}

_norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_money = lambda x: f"floor(({x}) * 100 + 0.5) / 100"
_step = lambda x: f"CASE WHEN {x} < 100 THEN floor({x} + 0.5) WHEN {x} < 1000 THEN floor({x} / 10 + 0.5) * 10 WHEN {x} < 10000 THEN floor({x} / 100 + 0.5) * 100 ELSE floor({x} / 500 + 0.5) * 500 END::BIGINT"

_cert_pick = lambda at: pick_sql([c[at] for c in CERT_TEXTS], "card_id")
_SHAPES = " ".join(f"WHEN '{name}' THEN regexp_matches(cert, '{shape}')" for name, shape in N.CERT_SHAPES.items())
#: The numbers and companies that the texts were made with, not what a pattern finds in them.
CERT_SQL = rf"""{CARDS_SQL}, certs AS (SELECT card_id, {_cert_pick(1)} AS cert_grader, replace({_cert_pick(2)}, '{{n}}', (30000000 + card_id * 37)::VARCHAR) AS cert FROM cards
), shaped AS (SELECT *, coalesce(CASE cert_grader {_SHAPES} ELSE length(cert) BETWEEN 5 AND 18 END, false) AS cert_valid FROM certs
), worth AS (SELECT *, CASE WHEN cert IS NULL THEN 0.15::DOUBLE WHEN cert_valid THEN 0.9 ELSE 0.68 END AS cert_confidence FROM shaped)"""

SURVEY_SQL = rf"""o AS (
  SELECT l_orderkey AS survey, {pick_sql(KINDS, 'l_partkey')} AS kind, {pick_sql(CONTENTS, 'l_suppkey')} AS content, l_partkey % 3 + 1 AS q, l_quantity / 50 AS full_, CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 400 END AS direct, CASE l_linenumber % 3 WHEN 1 THEN l_partkey % 90 END AS stack,
    (l_suppkey % 7 + 3) / 10.0::DOUBLE AS sure, {pick_sql(KINDS, 'l_partkey')} || '-' || (l_suppkey % 5)::VARCHAR AS visual_key, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seen FROM lineitem
), cap AS (SELECT * FROM (VALUES ('one_row_box', 800, 650, 180, 0), ('binder', 360, 360, 0, 0), ('shoe_box', 1000, 800, 220, 0), ('slab_case', 0, 0, 0, 70), ('toploader_box', 0, 0, 240, 0), ('graded_card_box', 0, 0, 0, 110)) AS v(kind, raw_, penny, top_, slab)
), m AS (SELECT o.*, CASE WHEN coalesce(direct, 0) > 0 THEN 'direct_instance_count' WHEN coalesce(stack, 0) > 0 THEN 'stack_height_estimation' WHEN cap.kind IS NOT NULL THEN 'container_capacity' ELSE 'indeterminate' END AS method,
    coalesce(nullif(CASE content WHEN 'slabs' THEN slab WHEN 'toploaders' THEN top_ WHEN 'penny sleeves' THEN penny ELSE raw_ END, 0), nullif(raw_, 0), nullif(top_, 0), nullif(slab, 0), 0) AS held FROM o LEFT JOIN cap USING (kind)
), e AS (SELECT *, CASE method WHEN 'direct_instance_count' THEN direct * q WHEN 'stack_height_estimation' THEN stack * q WHEN 'container_capacity' THEN held * least(1, greatest(0, full_)) * q ELSE 0 END::DOUBLE AS x,
    CASE method WHEN 'direct_instance_count' THEN CASE WHEN sure >= 0.85::DOUBLE THEN 0.02 WHEN sure >= 0.6::DOUBLE THEN 0.08 ELSE 0.18 END WHEN 'stack_height_estimation' THEN CASE WHEN sure >= 0.75::DOUBLE THEN 0.12 ELSE 0.25 END
      WHEN 'container_capacity' THEN CASE WHEN sure >= 0.8::DOUBLE THEN 0.12 WHEN sure >= 0.55::DOUBLE THEN 0.25 ELSE 0.42 END ELSE 0 END::DOUBLE AS spread FROM m
), counted AS (SELECT *, {_step('(x * (1 - spread))')} AS low, {_step('x')} AS expected, {_step('(x * (1 + spread))')} AS high FROM e)"""

FILES_SQL = rf"""f AS (SELECT doc_id, source AS folder, doc_id // 60 AS n, (doc_id // 20) % 6 AS e, 'Card ' || (doc_id // 60)::VARCHAR || {pick_sql(ENDINGS, 'doc_id // 20')} || '.jpg' AS name FROM documents
), s AS (SELECT *, CASE e WHEN 0 THEN 'front' WHEN 2 THEN 'front' WHEN 5 THEN NULL ELSE 'back' END AS side, 'card' || n::VARCHAR AS base FROM f)"""

IMAGES_SQL = rf"""{SALES_SQL}, i AS (SELECT card_id + CASE WHEN seen[2] = 5 THEN 1000000000 ELSE 0 END AS card_id, raw_id, basis, {pick_sql(IMAGE_URLS, 'card_id')} AS u, card_id % 5 AS k FROM sales
), j AS (SELECT i.*, {pick_sql(['images.example.com', None, 'cdn.example.org', 'example.organic', None], 'k')} AS host, CASE WHEN card_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown_card' WHEN k NOT IN (0, 2) THEN 'host_not_allowed' WHEN basis = 'scraped' THEN 'not_authorized' END AS reason FROM i)"""

WATCH_SQL = rf"""{SALES_SQL}, v AS (SELECT card_id, round(avg(all_in), 4) AS value FROM sales GROUP BY card_id
), w0 AS (SELECT o_custkey AS owner, o_orderkey % 2500 AS card_id, CASE WHEN o_orderkey % 2 = 0 THEN 'above' ELSE 'below' END AS direction, o_totalprice / 100 AS target FROM orders
), w AS (SELECT w0.*, value, coalesce(CASE direction WHEN 'above' THEN value >= target ELSE value <= target END, false) AS triggered FROM w0 LEFT JOIN v USING (card_id))"""


def _measure_sql(k: int, missing: float) -> str:
    x = f"CASE WHEN (size + {k}) % 11 = 10 THEN NULL WHEN size % 3 = 0 THEN ((size * {k}) % 101)::DOUBLE ELSE ((size * {k}) % 17) / 16.0::DOUBLE END"
    return f"CASE WHEN ({x}) IS NULL THEN {missing}::DOUBLE WHEN ({x}) > 1 THEN least(1, ({x}) / 100) ELSE greatest(0, {x}) END"


_METRICS = ", ".join(f"{'1 - ' if m in N.DEFECTS else ''}{_measure_sql(k + 3, 0.0 if m in N.DEFECTS else 0.5)} AS {m}" for k, m in enumerate(N.QUALITY_WEIGHTS))
_GAINED = " + ".join(f"{m} * {w}::DOUBLE" for m, w in N.QUALITY_WEIGHTS.items())
_FAILED = ", ".join(f"CASE WHEN {m} < {least}::DOUBLE THEN '{name}' END" for m, (least, name) in N.CRITICAL.items())
_ASKED = ", ".join(f"CASE WHEN {m} < {least}::DOUBLE THEN '{name}' END" for m, (least, name) in N.METRIC_ACTIONS.items())
_BY_TIER = " ".join(f"WHEN '{tier}' THEN '{','.join(actions)}'" for tier, actions in N.TIER_ACTIONS.items())

LABELS_SQL = rf"""{CARDS_SQL}, l AS (SELECT card_id, card_id % 6 AS k, array_to_string(list_transform(string_split(player, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS p, year::VARCHAR AS y, card_number AS n, lpad(card_id::VARCHAR, 7, '0') AS d FROM cards)
  SELECT card_id, (['PSA', 'BGS', NULL, 'CGC', NULL, 'SGC'])[k + 1] AS cert_grader, CASE k WHEN 0 THEN '3' || d WHEN 3 THEN '1234567' WHEN 5 THEN 'AB12' || d END AS cert, (['10', NULL, '8', NULL, NULL, '9'])[k + 1] AS grade,
    CASE WHEN k < 2 THEN y::INT END AS label_year, CASE k WHEN 0 THEN n WHEN 1 THEN n || '/99' END AS card_number, CASE k WHEN 1 THEN n || '/99' WHEN 5 THEN n || ' / 25' END AS serial,
    CASE k WHEN 0 THEN y || ' Topps Chrome|' || p || '|Prizm' WHEN 1 THEN p || '|' || y || ' Panini Basketball|card . ' || n || '/99' WHEN 2 THEN 'Pokemon ' || p || ' : 8' WHEN 5 THEN p || ' ' || n || ' / 25 9 AB12' || d ELSE '' END AS useful,
    CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN 'Pokemon ' || p || ' : 8' WHEN 5 THEN p || ' ' || n || ' / 25 9 AB12' || d END AS player_hint, (['', 'Basketball', 'Pokemon'])[CASE WHEN k IN (1, 2) THEN k + 1 END] AS sport_hint,
    CASE k WHEN 1 THEN 'no_cert_number' WHEN 2 THEN 'no_cert_number,no_grader' ELSE '' END AS warnings FROM l"""

ORACLES = {
    "normalized_sales": rf"""WITH {RAW_SQL}, c AS (SELECT *, coalesce(completed_flag, false) OR coalesce(source_type IN ('sold', 'completed_sale'), false) OR coalesce(sale_type IN ('auction', 'private'), false)
        OR (sold_at IS NOT NULL AND NOT (coalesce(source_type IN ('active', 'asking'), false) OR coalesce(listing_type = 'active', false) OR coalesce(sale_type = 'asking', false))) AS done,
        CASE WHEN grade_text IN ('psa 10', 'PSA-10') THEN 'PSA' WHEN grade_text = 'BGS 9.5' THEN 'BGS' WHEN grade_text = 'Mint ' THEN 'OTHER' ELSE 'RAW' END AS company, CASE WHEN grade_text IN ('psa 10', 'PSA-10') THEN '10' WHEN grade_text = 'BGS 9.5' THEN '9.5' WHEN grade_text = 'Mint ' THEN 'Mint' ELSE 'Raw' END AS grade FROM raw)
      SELECT provider, raw_id, list_price, done AS completed, coalesce(source_type, CASE WHEN done THEN 'sold' ELSE 'active_listing' END) AS source_type, coalesce(listing_type, CASE WHEN done THEN 'completed' ELSE 'active' END) AS listing_type,
        coalesce(sale_type, CASE WHEN done THEN 'fixed_price' ELSE 'asking' END) AS sale_type, CASE WHEN done THEN epoch(sold_at)::BIGINT END AS sold_s, {_money("price + (coalesce(shipping, 0) + coalesce(premium, 0))")} AS all_in, company, grade,
        concat_ws('|', year::VARCHAR, {_norm('set_name')}, {_norm('player')}, card_number, lower(company), {_norm('grade')}) AS card_key, coalesce(confidence, 0.7::DOUBLE) AS confidence,
        CASE WHEN price IS NULL OR price < 0 THEN 'invalid_price' WHEN done AND sold_at IS NULL THEN 'invalid_sale_date' END AS error FROM c""",
    "coerced_imports": rf"""WITH {RAW_SQL} SELECT CASE WHEN card_id % 40 = 0 THEN ' ' ELSE provider END AS provider, raw_id, list_price, card_id % 5 IN (0, 4) OR coalesce(source_type, listing_type, '') IN ('sold', 'completed_sale') AS completed,
        CASE card_id % 3 WHEN 0 THEN basis IN ('official_api', 'ebay_api', 'written_license', 'commercial_partner') ELSE card_id % 3 = 1 END AS verified, coalesce(confidence, CASE basis WHEN 'official_api' THEN 0.95::DOUBLE WHEN 'user_csv' THEN 0.72 ELSE 0.82 END) AS confidence,
        CASE WHEN card_id % 40 = 0 THEN 'missing_provider' WHEN basis = 'scraped' THEN 'not_authorized' END AS error FROM raw""",
    "manual_evidence": f"""WITH {CARDS_SQL} SELECT card_id AS comp_id, CASE WHEN card_id % 2 = 0 THEN card_id * 1.5::DOUBLE ELSE card_id * 2.0::DOUBLE END AS price, CASE WHEN card_id % 3 = 0 THEN '2024-02-03' WHEN card_id % 5 = 0 THEN '2024-01-01' END AS sold_on,
        'manual_evidence' AS sale_type, card_id % 3 = 0 OR card_id % 5 = 0 AS completed, false AS verified, CASE card_id % 3 WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.72 ELSE CASE WHEN card_id % 2 = 0 THEN 0.5 ELSE 0.45 END END AS confidence FROM cards""",
    "parsed_certificates": f"WITH {CERT_SQL} SELECT card_id, cert_grader, cert, cert_valid, cert_confidence FROM worth",
    "certificate_evidence": f"""WITH {CERT_SQL}, k AS (SELECT *, card_id // 10 AS item, round(cert_confidence + CASE WHEN cert_valid THEN 0.08::DOUBLE ELSE 0 END, 4) AS w, count(DISTINCT cert) OVER (PARTITION BY card_id // 10) AS vals FROM worth WHERE cert IS NOT NULL
      ), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY w DESC, cert DESC, cert_grader DESC NULLS LAST) AS n FROM k) SELECT item, cert, cert_grader, least(1.0::DOUBLE, w) AS confidence, vals > 1 AS conflict FROM r WHERE n = 1""",
    "scene_types": f"""WITH {CARDS_SQL} SELECT card_id, {pick_sql(['single_card', 'binder_page', 'no_card', 'mixed_raw_slab', 'multi_card_table', 'sealed_product', 'cert_label', 'manual_text', 'single_card', 'unknown', 'multi_card_table', 'sealed_product'], 'card_id')} AS scene,
        {pick_sql(['binder_page', 'sealed_product', 'multi_card_table', 'mixed_raw_slab', 'single_card', 'mixed_raw_slab', 'multi_card_table', 'sealed_product'], 'card_id')} AS title_scene,
        CASE WHEN card_id % 3 = 0 THEN 1 ELSE least(1, CASE WHEN (card_id % 250) / 2.0::DOUBLE > 1 THEN (card_id % 250) / 200.0::DOUBLE ELSE (card_id % 250) / 2.0::DOUBLE END) END AS side FROM cards""",
    "slab_labels": f"WITH {LABELS_SQL}",
    "scanned_payloads": f"WITH {CARDS_SQL} SELECT card_id, {pick_sql([p[1] for p in PAYLOADS], 'card_id')} AS payload_type, {pick_sql([p[2] for p in PAYLOADS], 'card_id')} AS payload_grader, replace({pick_sql([p[3] for p in PAYLOADS], 'card_id')}, '{{n}}', (30000000 + card_id * 37)::VARCHAR) AS payload_cert FROM cards",
    "image_quality": f"""WITH h AS (SELECT page_id, length(coalesce(html, '')) AS size FROM pages), m AS (SELECT page_id, {_METRICS} FROM h), q AS (SELECT *, round(({_GAINED}) / {sum(N.QUALITY_WEIGHTS.values())}::DOUBLE, 6) AS quality, concat_ws(',', {_FAILED}) AS failures, concat_ws(',', {_ASKED}) AS asked FROM m
      ), t AS (SELECT *, CASE WHEN failures <> '' OR quality < 0.38 THEN 'insufficient' WHEN quality >= 0.78 AND edges >= 0.75 AND readability >= 0.65 THEN 'fast' WHEN quality >= 0.52 THEN 'enhance' ELSE 'review' END AS tier FROM q)
      SELECT page_id, quality, failures, tier, concat_ws(',', CASE tier {_BY_TIER} END, nullif(asked, '')) AS actions FROM t""",
    "survey_estimates": f"WITH {SURVEY_SQL} SELECT method, kind, count(*) AS objects, sum(low)::BIGINT AS low, sum(expected)::BIGINT AS expected, sum(high)::BIGINT AS high FROM counted GROUP BY ALL",
    "survey_summaries": f"""WITH {SURVEY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY survey, visual_key ORDER BY seen) AS n FROM counted), g AS (SELECT survey, count(*) FILTER (WHERE n = 1) AS objects, count(*) FILTER (WHERE n > 1) AS duplicates,
        sum(low) FILTER (WHERE n = 1)::DOUBLE AS l, sum(expected) FILTER (WHERE n = 1)::DOUBLE AS x1, sum(high) FILTER (WHERE n = 1)::DOUBLE AS h, count(*) FILTER (WHERE n = 1 AND (method = 'indeterminate' OR sure < 0.45::DOUBLE)) AS unresolved FROM r GROUP BY survey)
      SELECT survey, objects, duplicates, {_step('l')} AS low, {_step('x1')} AS expected, {_step('h')} AS high, unresolved, CASE WHEN unresolved > 0 OR duplicates > 0 THEN 'needs_review' ELSE 'draft_complete' END AS status FROM g""",
    "scan_pairs": f"""WITH {FILES_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY folder, base, side ORDER BY lower(name), name)::INT AS turn FROM s WHERE side IS NOT NULL), g AS (SELECT folder, base, turn, max(name) FILTER (WHERE side = 'front') AS a, max(name) FILTER (WHERE side = 'back') AS b FROM t GROUP BY ALL)
      SELECT folder, base, turn, coalesce(a, b) AS front, CASE WHEN a IS NOT NULL THEN b END AS back FROM g""",
    "scan_turn_pairs": f"""WITH {FILES_SQL}, t AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY n, CASE e WHEN 5 THEN '.jpg' ELSE lower(regexp_replace(name, '^Card \\d+', '')) END, name) - 1 AS k FROM s)
      SELECT folder, (k // 2)::INT AS pair, max(name) FILTER (WHERE k % 2 = 0) AS front, max(name) FILTER (WHERE k % 2 = 1) AS back FROM t GROUP BY ALL""",
    "family_splits": f"""WITH {FILES_SQL}, x AS (SELECT doc_id, folder || '/card ' || n::VARCHAR || CASE e WHEN 2 THEN ' f' WHEN 3 THEN '.b' ELSE '' END AS family FROM s), y AS (SELECT *, ('0x' || substr(sha256(family), 1, 8))::BIGINT % 100 AS k FROM x)
      SELECT doc_id, family, CASE WHEN k < 70 THEN 'train' WHEN k < 90 THEN 'valid' ELSE 'test' END AS split FROM y""",
    "capture_neighbours": """WITH v AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS at_s, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS h FROM events), m AS (SELECT a.id, b.id AS other, bit_count(xor(a.h, b.h))::INT AS distance FROM v a JOIN v b ON a.user_id = b.user_id AND a.id <> b.id AND abs(a.at_s - b.at_s) <= 600
      ), r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank, other, distance FROM m WHERE distance <= 14) SELECT * FROM r WHERE rank <= 8""",
    "open_sides": f"""WITH {FILES_SQL}, g AS (SELECT folder || '/' || base AS identity, doc_id // 20 AS g, bool_or(side = 'front') AS f, bool_or(side = 'back') AS b FROM s WHERE side IS NOT NULL GROUP BY ALL)
      SELECT x.identity, x.g AS "group", y.g AS other FROM g x JOIN g y ON x.identity = y.identity AND x.f AND NOT x.b AND y.b AND NOT y.f""",
    "path_rules": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, page_id % 3 AS k FROM pages)
      SELECT page_id, path, CASE WHEN k = 2 AND (starts_with(path, '/fr') OR starts_with(path, '/p')) THEN 'disallowed_by_policy' WHEN k = 1 AND NOT (starts_with(path, '/en') OR starts_with(path, '/de')) THEN 'not_in_allowed_paths'
        WHEN k = 0 AND ((starts_with(path, '/e') AND NOT starts_with(path, '/en/')) OR starts_with(path, '/d')) THEN 'disallowed_by_robots' ELSE 'allowed' END AS decision FROM p""",
    "image_rejections": f"""WITH {IMAGES_SQL} SELECT coalesce(reason, 'accepted') AS reason, host, count(*) AS "rows" FROM j GROUP BY ALL""",
    "unknown_card_rows": f"""WITH {IMAGES_SQL} SELECT card_id, count(*) AS "rows" FROM j WHERE reason = 'unknown_card' GROUP BY card_id""",
    "manifest_check": f"""WITH r AS (SELECT doc_id // 2 AS a, CASE WHEN doc_id % 10 = 0 THEN 'none' ELSE sha256(coalesce(text, '')) END AS h, {pick_sql(['train', 'test', 'validation', 'other'], 'doc_id // 3')} AS s, doc_id // 5 AS f FROM documents
      ), e AS (SELECT 'bad_hash' AS error FROM r WHERE h = 'none' UNION ALL SELECT 'bad_split' FROM r WHERE s = 'other' UNION ALL SELECT 'repeated_asset' FROM r GROUP BY a HAVING count(*) > 1 UNION ALL SELECT 'repeated_hash' FROM r GROUP BY h HAVING count(*) > 1
        UNION ALL SELECT 'family_in_several_splits' FROM r GROUP BY f HAVING count(DISTINCT s) > 1) SELECT error, count(*) AS "rows" FROM e GROUP BY error""",
    "conversation_page": "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING (max(turn), conv_id) < (4, 60) ORDER BY turn DESC, conv_id DESC LIMIT 50",
    "draft_versions": "SELECT conv_id, max(turn) + 1 AS next_version FROM conversations GROUP BY conv_id",
    "usage_log": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 25",
    "latest_observations": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "corrected_sales": f"""WITH {RAW_SQL} SELECT card_id, raw_id, list_price, CASE WHEN card_id % 6 = 0 THEN 'PSA 9' ELSE grade_text END AS grade_text, CASE WHEN card_id % 15 = 0 THEN 10.0::DOUBLE ELSE price END AS price FROM raw""",
    "watch_alerts": f"WITH {WATCH_SQL} SELECT owner, card_id, direction, min(target) AS target, any_value(value) AS value FROM w WHERE triggered AND NOT (owner % 2 = 0 AND card_id % 2 = 0) GROUP BY owner, card_id, direction",
    "watch_counts": f"WITH {WATCH_SQL} SELECT direction, triggered, count(*) AS watches, count(value) AS valued FROM w GROUP BY ALL",
    "embedding_queue": f"""WITH q AS (SELECT vec_id AS image_id, {pick_sql(['complete', 'pending', 'failed'], 'vec_id // 5')} AS status, (vec_id % 9)::INT AS priority FROM embeddings WHERE vec_id % 5 < 2), n AS (SELECT vec_id AS image_id FROM embeddings WHERE vec_id % 3 < 2 AND vec_id % 4 <> 0)
      SELECT image_id, CASE WHEN n.image_id IS NULL OR status = 'complete' THEN status ELSE 'pending' END AS status, CASE WHEN n.image_id IS NULL THEN priority ELSE greatest(coalesce(priority, 5), 5) END AS priority FROM q FULL JOIN n USING (image_id)""",
    "reference_upserts": """WITH o AS (SELECT vec_id AS k, 'img/' || vec_id::VARCHAR AS image_uri, vec_id + 1 AS card_id, 'front' AS side, md5('img/' || vec_id::VARCHAR) AS sha, 640 AS width FROM embeddings WHERE vec_id % 3 = 0
      ), n AS (SELECT 'img/' || vec_id::VARCHAR AS image_uri, vec_id * 7 AS card_id, CASE WHEN vec_id % 4 = 0 THEN 'new' END AS sha, CASE WHEN vec_id % 5 = 0 THEN 800 END AS width FROM embeddings WHERE vec_id % 2 = 0 AND vec_id * 7 IN (SELECT p_partkey FROM part))
      SELECT image_uri, coalesce(n.card_id, o.card_id) AS card_id, CASE WHEN n.card_id IS NOT NULL THEN 'back' ELSE side END AS side, coalesce(n.sha, o.sha) AS sha, coalesce(n.width, o.width) AS width FROM o FULL JOIN n USING (image_uri)""",
    "provider_coverage": f"""WITH {SALES_SQL}, p AS (SELECT * FROM (VALUES ('P0', true, 'authorized'), ('P1', false, 'authorized'), ('P2', true, 'demo_only'), ('P8', true, 'authorized'), ('P9', true, 'demo_only')) AS v(provider, done, rights)), c AS (SELECT provider, count(*) AS n FROM sales GROUP BY provider)
      SELECT provider, rights, coalesce(n, 0) AS sales, done AND coalesce(n, 0) = 0 AND rights <> 'demo_only' AS stale FROM p LEFT JOIN c USING (provider)""",
    "task_keys": """SELECT page_id, sha256('{"job":' || (page_id % 7)::VARCHAR || CASE WHEN page_id % 2 = 0 THEN ',"scope":"region"' ELSE '' END || ',"task":"ocr"}') AS key FROM pages""",
    "failure_classes": f"""WITH e AS (SELECT {pick_sql([200, 429, 503, 413, 400, None], 'event_id')} AS s, coalesce({pick_sql(FAILURE_MESSAGES, 'event_id')}, '') AS m, CASE WHEN event_id % 4 = 0 THEN upper('e_' || event_type) END AS own FROM events
      ), k AS (SELECT CASE WHEN s = 429 OR m = 'Rate limit' THEN 1 WHEN s = 503 OR m = 'timeout' THEN 2 WHEN s = 413 THEN 3 WHEN m = 'decode failed' THEN 4 WHEN m LIKE 'CUDA%' THEN 5 WHEN m IN ('forbidden', 'model file missing') THEN 6 ELSE 7 END AS k, own FROM e)
      SELECT CASE k WHEN 2 THEN coalesce(own, 'TRANSIENT_PROVIDER_FAILURE') WHEN 7 THEN coalesce(own, 'UNKNOWN_TASK_FAILURE') ELSE (['RATE_LIMITED', '', 'PAYLOAD_TOO_LARGE', 'INVALID_IMAGE', 'GPU_OOM', 'CONFIGURATION_ERROR'])[k] END AS code, k IN (1, 2, 5) AS retryable,
        CASE k WHEN 1 THEN 'provider' WHEN 2 THEN 'transient' WHEN 5 THEN 'smaller_batch' END AS backoff, count(*) AS tasks FROM k GROUP BY ALL""",
    "token_overlap": f"""WITH {CARDS_SQL}, t AS (SELECT card_id, list_distinct(string_split({_norm("player || ' ' || brand")}, ' ')) AS a, list_distinct(string_split({_norm("set_name || ' ' || brand")}, ' ')) AS b FROM cards)
      SELECT card_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS overlap FROM t""",
    "box_overlaps": """WITH b AS (SELECT page_id, (page_id * 3 % 7) / 10.0::DOUBLE AS ax, (page_id * 5 % 7) / 10.0::DOUBLE AS ay, (page_id * 7 % 11) / 10.0::DOUBLE AS aw, (page_id * 11 % 13) / 10.0::DOUBLE AS ah, (page_id * 13 % 7) / 10.0::DOUBLE AS bx, (page_id * 17 % 7) / 10.0::DOUBLE AS by_, (page_id * 19 % 11) / 10.0::DOUBLE AS bw, (page_id * 23 % 13) / 10.0::DOUBLE AS bh FROM pages
      ), i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) AS n FROM b) SELECT page_id, CASE WHEN aw * ah + bw * bh - n > 0 THEN round(n / (aw * ah + bw * bh - n), 6) ELSE 0 END AS overlap FROM i""",
}
