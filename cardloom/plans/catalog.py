"""Queries on the catalog, listing titles, evidence texts and table merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.expr import money, natural_key, normalize_text, window_days
from cardloom.operators import catalog as C
from cardloom.operators import listings as L
from cardloom.operators import tables as M
from cardloom.plans.views import CARDS_SQL, SALES_SQL, cards, sales
from cardloom.session import table

_money = lambda x: f"floor(({x}) * 100 + 0.5) / 100"


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts after every card whose id is divisible by 20, one letter of the name wrong in some."""
    few = cards(spark, sf_dir).filter("card_id % 20 = 0")
    name = F.when(F.col("card_id") % 40 == 0, F.col("player")).otherwise(F.concat(F.lit("x"), F.substring("player", 2, 99)))
    return few.select(F.col("card_id").alias("query_id"), F.concat_ws(" ", F.col("year").cast("string"), "brand", name, F.concat(F.lit("#"), F.col("card_number"))).alias("query"))


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rank_cards(search_queries(spark, sf_dir), cards(spark, sf_dir), 10)


def catalog_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve(C.rank_cards(search_queries(spark, sf_dir), cards(spark, sf_dir), 3))


def identification_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.identify_outcome(C.rank_cards(search_queries(spark, sf_dir), cards(spark, sf_dir), 3), cards(spark, sf_dir))


def catalog_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soccer and hockey cards whose player contains ring, and whose text holds economy."""
    rows = C.filter_cards(cards(spark, sf_dir), "economy", {"sport": "soccer"}, {"player": "ring"})
    return rows.select("card_id", "player", "set_name", "year")


def catalog_set_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.set_index(cards(spark, sf_dir))


def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(cards(spark, sf_dir))


def card_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids, initials and slugs of cards."""
    rows = cards(spark, sf_dir)
    core = F.concat_ws("|", F.col("year").cast("string"), "brand", "set_name", "player", "card_number")
    key = F.concat(F.lit("card_"), F.replace(normalize_text("player"), F.lit(" "), F.lit("_")), F.lit("_"), F.substring(F.sha2(core, 256), 1, 10))
    return rows.select("card_id", key.alias("card_key"), C.initials(F.concat_ws(" ", "brand", "player")).alias("short"), natural_key("brand").alias("sort_key"))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised words of every document, counted."""
    plain = normalize_text(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).cast("long").alias("length"), F.md5(plain).alias("hash"), window_days(F.concat(F.pmod("doc_id", F.lit(400)).cast("string"), F.lit("d"))).alias("days"))


#: What stands before and after a card's number in titles.
NUMBER_FORMS = [(" #", "/99"), (" RC-", ""), (" X", "/50"), (" No. 0", "")]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing titles of every kind after the cards."""
    tail = F.element_at(F.array(*map(F.lit, [" PSA 10", " BGS 9.5", " lot of 5", " custom proxy", " PSA 10?", " SGC 8", "", " psa 9 ready to grade"])), (F.pmod("card_id", F.lit(8)) + 1).cast("int"))
    turn, n = F.pmod("card_id", F.lit(11)), F.col("card_number")
    number = F.when(F.pmod("card_id", F.lit(5)) == 0, "").when(F.pmod("card_id", F.lit(7)) == 0, " #999")
    for at, (before, after) in enumerate(NUMBER_FORMS):
        number = number.when(turn == at, F.concat(F.lit(before), n, F.lit(after)))
    number = number.otherwise(F.concat(F.lit(" #"), n))
    return cards(spark, sf_dir).select("card_id", "card_number", F.concat(F.initcap("player"), number, tail).alias("title"))


def listing_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.judge_titles(titles(spark, sf_dir))
    return rows.select("card_id", "title", "company", "grade", F.array_join("numbers", ",").alias("numbers"), "valid", "reason")


def listing_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles each reason rejects."""
    return L.judge_titles(titles(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("titles"))


def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale notes after the cards."""
    house = F.element_at(F.array(*map(F.lit, ["eBay", "Whatnot", "COMC", "Goldin", "a shop"])), (F.pmod("card_id", F.lit(5)) + 1).cast("int"))
    price = F.format_number(F.lit(5) + F.col("card_id") * 1.25, 2)
    text = F.concat(
        F.initcap("player"), F.lit(" #"), F.col("card_number"), F.lit(" PSA 9\nSold for $"), price, F.lit(" on "), house, F.when(F.pmod("card_id", F.lit(3)) == 0, " shipping: $4.99").otherwise(""),
        F.when(F.pmod("card_id", F.lit(4)) != 0, F.lit(" 2024-03-15")).otherwise(""), F.when(F.pmod("card_id", F.lit(6)) == 0, " 12/99").otherwise(""), F.when(F.pmod("card_id", F.lit(2)) == 0, " https://example.com/itm/1").otherwise(""),
    )
    return cards(spark, sf_dir).select("card_id", text.alias("text"))


def sale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_evidence(evidence_texts(spark, sf_dir)).drop("text")


def sale_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales of even orders, updated by a batch of every third order that raises some prices."""
    key = ["provider", "raw_id"]
    every = M.latest(sales(spark, sf_dir), key, "seen").withColumn("order", F.col("seen.l_orderkey")).withColumn("price", money("price"))
    old = every.filter("order % 2 = 0").select(*key, "price", "verified")
    new = every.filter("order % 3 = 0").select(*key, money(F.when(F.col("order") % 4 == 0, F.col("price") * 1.05).otherwise(F.col("price"))).alias("price"), "verified")
    return M.upsert(old, new, key, ["price", "verified"])


def sale_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_upsert(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def card_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with an update that has gaps: old values stay in them, notes join key by key."""
    rows = cards(spark, sf_dir)
    note = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    old = rows.filter("card_id % 3 <> 0").select("card_id", "brand", "sport", note(("source", F.lit("bundled")), ("set", F.col("set_name"))).alias("notes"))
    new = rows.filter("card_id % 2 = 0").select("card_id", F.when(F.col("card_id") % 4 == 0, F.upper("brand")).alias("brand"), F.lit(None).cast("string").alias("sport"), note(("source", F.lit("import")), ("year", F.col("year").cast("string"))).alias("notes"))
    merged = M.merge_keep_old(old, new, ["card_id"], ["brand", "sport"], ["notes"])
    entries = F.array_sort(F.map_entries("notes"))
    return merged.select("card_id", "brand", "sport", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("notes"))


def import_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each row of a sale import, counted with its worth."""
    rows = sales(spark, sf_dir)
    rules = [(F.col("basis") == "scraped", "not_authorized"), (F.col("price").isNull() | (F.col("price") <= 0), "missing_price"), (~F.col("completed"), "not_completed")]
    disposed = M.dispose(rows, rules, ["provider", "raw_id"], "seen")
    return disposed.groupBy("provider", "disposition").agg(F.count(F.lit(1)).alias("rows"), money(F.sum("all_in")).alias("worth"))


def batch_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales before and after a provider's batch is taken back."""
    rows = sales(spark, sf_dir)
    left = M.roll_back(rows, F.col("provider") == "P2")
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("before")).join(left.groupBy("provider").agg(F.count(F.lit(1)).alias("after")), "provider", "left").select("provider", "before", F.coalesce("after", F.lit(0)).alias("after"))


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash chain of each user's events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return M.hash_chain(events, "user_id", ["event_id"], "event_type")


def barcode_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and listing ids of scanned payloads made from cards."""
    kinds = ["https://www.psacard.com/cert/1", "https://www.beckett.com/x", "https://example.com/itm/", "012345678905", "12345678", "text", ""]
    payload = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod("card_id", F.lit(7)) + 1).cast("int"))
    payload = F.when(payload.endswith("/itm/"), F.concat(payload, (F.col("card_id") + 100000000000).cast("string"))).otherwise(payload)
    return cards(spark, sf_dir).select("card_id", L.barcode_kind(payload).alias("kind"), L.listing_id(payload).alias("listing"))


QUERIES = {f.__name__: f for f in (catalog_search, catalog_resolution, identification_outcome, catalog_facets, catalog_set_index, catalog_coverage, card_identity, normalized_texts, listing_titles, listing_rejections, sale_evidence, sale_upsert, sale_upsert_counts, card_merge, import_disposition, batch_rollback, audit_chain, barcode_payloads)}

NORM = lambda x: rf"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"

RANKED_SQL = rf"""{CARDS_SQL}, q AS (
  SELECT card_id AS query_id, {NORM("concat_ws(' ', year::VARCHAR, brand, CASE WHEN card_id % 40 = 0 THEN player ELSE 'x' || substr(player, 2) END, '#' || card_number)")} AS q FROM cards WHERE card_id % 20 = 0
), qt AS (SELECT *, list_filter(string_split(q, ' '), lambda t: length(t) >= 2) AS toks FROM q
), al AS (
  SELECT *, list_distinct(list_filter([list_aggregate(list_transform(list_filter(string_split({NORM("brand")}, ' '), lambda w: length(w) > 1), lambda w: w[1]), 'string_agg', ''),
    list_aggregate(list_transform(list_filter(string_split({NORM("set_name")}, ' '), lambda w: length(w) > 1), lambda w: w[1]), 'string_agg', '')], lambda a: a <> '')) AS aliases FROM cards
), hay AS (SELECT *, {NORM("concat_ws(' ', year::VARCHAR, brand, set_name, player, card_number, grader, grade::VARCHAR, sport, list_aggregate(list_sort(aliases), 'string_agg', ' '))")} AS h FROM al
), hs AS (SELECT *, list_distinct(list_filter(string_split(h, ' '), lambda t: length(t) >= 2)) AS ht FROM hay
), pairs AS (
  SELECT query_id, card_id, toks, h, ht, 100 * (12 * contains(q, {NORM("player")})::INT + 5 * contains(q, year::VARCHAR)::INT + 5 * contains(q, card_number)::INT + 5 * contains(q, {NORM("set_name")})::INT + 3 * contains(q, {NORM("brand")})::INT
    + 3 * contains(q, lower(grader))::INT + 3 * contains(q, {NORM("grade::VARCHAR")})::INT + 2 * len(list_filter(aliases, lambda a: contains(q, a)))) AS e FROM qt, hs
), toks AS (
  SELECT query_id, card_id, e, unnest(toks) AS t, h, ht FROM pairs
), weighed AS (
  SELECT *, CASE WHEN length(t) >= 8 THEN 3 WHEN length(t) >= 5 THEN 2 ELSE 1 END AS w,
    CASE WHEN contains(h, t) THEN 100 WHEN length(t) >= 4 AND len(list_filter(ht, lambda c: starts_with(c, t) OR starts_with(t, c) OR levenshtein(t, c) <= CASE WHEN length(t) >= 8 THEN 2 ELSE 1 END)) > 0 THEN 65 ELSE 0 END AS f FROM toks
), sums AS (SELECT query_id, card_id, any_value(e)::BIGINT AS e, sum(w * f)::BIGINT AS m, sum(w * 100)::BIGINT AS t FROM weighed GROUP BY 1, 2
), scored AS (SELECT *, (2 * ((e + m) * 10000 * t + 8000000 * m) + t) // (2 * t) AS s6, (2000000 * m + t) // (2 * t) AS c6 FROM sums
), ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s6 DESC, c6 DESC, card_id)::INT AS rank FROM scored WHERE e + m > 0
), ranked AS (SELECT query_id, rank, card_id, s6 / 1e6::DOUBLE AS score, ((20000 * m + t) // (2 * t)) / 1e4::DOUBLE AS coverage,
    least(9900, greatest(2000, (2 * ((5600 - 500 * (rank - 1)) * t + 5 * t * (e + m) + 10400 * m) + 2 * t) // (4 * t))) / 1e4::DOUBLE AS confidence FROM ranks)"""

TITLES_SQL = rf"""{CARDS_SQL}, titles AS (
  SELECT card_id, card_number, array_to_string(list_transform(string_split(player, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
    || CASE WHEN card_id % 5 = 0 THEN '' WHEN card_id % 7 = 0 THEN ' #999' WHEN card_id % 11 = 0 THEN ' #' || card_number || '/99' WHEN card_id % 11 = 1 THEN ' RC-' || card_number
        WHEN card_id % 11 = 2 THEN ' X' || card_number || '/50' WHEN card_id % 11 = 3 THEN ' No. 0' || card_number ELSE ' #' || card_number END
    || ([' PSA 10', ' BGS 9.5', ' lot of 5', ' custom proxy', ' PSA 10?', ' SGC 8', '', ' psa 9 ready to grade'])[card_id % 8 + 1] AS title FROM cards
), numbered_titles AS (
  SELECT *, CASE WHEN card_id % 5 = 0 THEN '' WHEN card_id % 7 = 0 THEN '999' WHEN card_id % 11 = 1 THEN '' WHEN card_id % 11 = 2 THEN 'X' || card_number ELSE card_number END AS numbers FROM titles
), judged_titles AS (
  SELECT *, CASE WHEN card_id % 8 = 0 THEN 'PSA' WHEN card_id % 8 = 1 THEN 'BGS' WHEN card_id % 8 = 5 THEN 'SGC' ELSE 'RAW' END AS company,
    CASE card_id % 8 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 9.5 WHEN 5 THEN 8 END AS grade,
    CASE WHEN card_id % 8 = 2 THEN 'negative_keyword:lot' WHEN card_id % 8 = 3 THEN 'negative_keyword:custom'
      WHEN regexp_matches(upper(title), '(^|[^A-Z0-9])#?\s*' || card_number || '($|[^A-Z0-9])') THEN NULL WHEN numbers = '' THEN 'card_number_missing' WHEN numbers <> card_number THEN 'card_number_mismatch' END AS reason FROM numbered_titles)"""

UPSERT_SQL = rf"""{SALES_SQL}, one AS (SELECT *, seen.l_orderkey AS ok FROM (SELECT *, row_number() OVER (PARTITION BY provider, raw_id ORDER BY seen) AS r FROM sales) WHERE r = 1
), old AS (SELECT provider, raw_id, {_money("price")} AS price, verified FROM one WHERE ok % 2 = 0
), new AS (SELECT provider, raw_id, {_money("CASE WHEN ok % 4 = 0 THEN " + _money("price") + " * 1.05::DOUBLE ELSE " + _money("price") + " END")} AS price, verified FROM one WHERE ok % 3 = 0
), merged AS (SELECT provider, raw_id, coalesce(n.price, o.price) AS price, coalesce(n.verified, o.verified) AS verified,
    CASE WHEN o.price IS NULL THEN 'added' WHEN n.price IS NULL THEN 'kept' WHEN o.price <> n.price THEN 'updated' ELSE 'skipped' END AS action FROM old o FULL JOIN new n USING (provider, raw_id))"""
UPSERT_SQL = UPSERT_SQL.replace("seen.l_orderkey", "seen[1]")

ORACLES = {
    "catalog_search": f"WITH {RANKED_SQL} SELECT * FROM ranked WHERE rank <= 10",
    "catalog_resolution": f"""WITH {RANKED_SQL}, t AS (SELECT *, lead(confidence) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM ranked WHERE rank <= 3)
      SELECT query_id, card_id, confidence, coalesce(round(confidence - nxt, 4) < 0.08, false) AS ambiguous, confidence >= 0.72 AND NOT coalesce(round(confidence - nxt, 4) < 0.08, false) AS accepted FROM t WHERE rank = 1""",
    "identification_outcome": f"""WITH {RANKED_SQL}, t AS (SELECT r.*, c.player, c.year, c.brand, c.set_name FROM ranked r JOIN cards c USING (card_id) WHERE rank <= 3
      ), g AS (SELECT query_id, max(confidence) AS best, count(DISTINCT (player, year, brand, set_name)) AS families, count(*) AS n, max(confidence) FILTER (WHERE rank = 2) AS second FROM t GROUP BY query_id)
      SELECT query_id, CASE WHEN best >= 0.9 AND round(best - coalesce(second, 0), 4) >= 0.08 THEN 'exact_variant' WHEN best >= 0.72 AND round(best - coalesce(second, 0), 4) >= 0.08 THEN 'exact_card'
        WHEN families = 1 AND n > 1 THEN 'card_family' WHEN best >= 0.45 THEN 'candidate' ELSE 'unknown' END AS outcome, best, families FROM g""",
    "catalog_facets": f"WITH {CARDS_SQL} SELECT card_id, player, set_name, year FROM cards WHERE sport = 'soccer' AND contains(lower(player), 'ring') AND contains(lower(set_name), 'economy')",
    "catalog_set_index": f"""WITH {CARDS_SQL}, k AS (SELECT sport, year, brand, set_name, count(*) AS cards FROM cards GROUP BY ALL),
      p AS (SELECT sport, year, brand, set_name, string_agg(player, '|' ORDER BY player) AS players FROM (SELECT *, row_number() OVER (PARTITION BY sport, year, brand, set_name ORDER BY player) AS r FROM (SELECT DISTINCT sport, year, brand, set_name, player FROM cards)) WHERE r <= 10 GROUP BY ALL),
      n AS (SELECT sport, year, brand, set_name, string_agg(card_number, '|' ORDER BY card_number::INT) AS numbers FROM (SELECT *, row_number() OVER (PARTITION BY sport, year, brand, set_name ORDER BY card_number::INT) AS r FROM (SELECT DISTINCT sport, year, brand, set_name, card_number FROM cards)) WHERE r <= 10 GROUP BY ALL)
      SELECT * FROM k LEFT JOIN p USING (sport, year, brand, set_name) LEFT JOIN n USING (sport, year, brand, set_name)""",
    "catalog_coverage": f"""WITH {CARDS_SQL} SELECT dimension, label, count(*) AS cards FROM (SELECT 'sport' AS dimension, sport AS label FROM cards UNION ALL SELECT 'brand', brand FROM cards UNION ALL SELECT 'year', year::VARCHAR FROM cards
      UNION ALL SELECT 'grader', grader FROM cards) GROUP BY ALL""",
    "card_identity": rf"""WITH {CARDS_SQL} SELECT card_id, 'card_' || replace(player, ' ', '_') || '_' || substr(sha256(concat_ws('|', year::VARCHAR, brand, set_name, player, card_number)), 1, 10) AS card_key,
      list_aggregate(list_transform(list_filter(string_split({NORM("brand || ' ' || player")}, ' '), lambda w: length(w) > 1), lambda w: w[1]), 'string_agg', '') AS short,
      regexp_replace(lower(brand), '\d+', '') || lpad(regexp_extract(brand, '\d+'), 20, '0') AS sort_key FROM cards""",
    "normalized_texts": f"""SELECT doc_id, length({NORM("coalesce(text, '')")}) AS length, md5({NORM("coalesce(text, '')")}) AS hash, least(3650, greatest(1, doc_id % 400))::INT AS days FROM documents""",
    "listing_titles": f"WITH {TITLES_SQL} SELECT card_id, title, company, grade, numbers, reason IS NULL AS valid, reason FROM judged_titles",
    "listing_rejections": f"WITH {TITLES_SQL} SELECT coalesce(reason, 'valid') AS reason, count(*) AS titles FROM judged_titles GROUP BY ALL",
    "sale_evidence": rf"""WITH {CARDS_SQL}, e AS (SELECT card_id, card_number AS n FROM cards)
      SELECT card_id, (['eBay', 'Whatnot', 'COMC', 'Goldin', 'Manual'])[card_id % 5 + 1] AS house, {_money("5 + card_id * 1.25::DOUBLE")} AS price, CASE WHEN card_id % 3 = 0 THEN 4.99::DOUBLE ELSE 0 END AS shipping, 0.0::DOUBLE AS premium,
        CASE WHEN card_id % 4 <> 0 THEN '2024-03-15' END AS sold_on, 'PSA' AS grader, 9.0::DOUBLE AS grade_value, NULL::VARCHAR AS cert, n AS card_number, CASE WHEN card_id % 6 = 0 THEN '12/99' END AS serial, CASE WHEN card_id % 4 <> 0 THEN 2024 END AS year,
        CASE WHEN card_id % 2 = 0 THEN 'https://example.com/itm/1' END AS url, (22 + CASE WHEN card_id % 4 <> 0 THEN 20 ELSE 0 END + 16 + 12 + 8 + 8 + CASE WHEN card_id % 2 = 0 THEN 8 ELSE 0 END) / 100.0::DOUBLE AS confidence FROM e""",
    "sale_upsert": f"WITH {UPSERT_SQL} SELECT provider, raw_id, price, verified, action FROM merged",
    "sale_upsert_counts": f'WITH {UPSERT_SQL} SELECT action, count(*) AS "rows" FROM merged GROUP BY action',
    "card_merge": f"""WITH {CARDS_SQL}, m AS (SELECT *, card_id % 3 <> 0 AS o, card_id % 2 = 0 AS n FROM cards WHERE card_id % 3 <> 0 OR card_id % 2 = 0)
      SELECT card_id, CASE WHEN n AND card_id % 4 = 0 THEN upper(brand) WHEN o THEN brand END AS brand, CASE WHEN o THEN sport END AS sport,
        concat_ws(';', CASE WHEN o THEN 'set=' || set_name END, 'source=' || CASE WHEN n THEN 'import' ELSE 'bundled' END, CASE WHEN n THEN 'year=' || year::VARCHAR END) AS notes FROM m""",
    "import_disposition": f"""WITH {SALES_SQL}, e AS (SELECT *, CASE WHEN basis = 'scraped' THEN 'not_authorized' WHEN price IS NULL OR price <= 0 THEN 'missing_price' WHEN NOT completed THEN 'not_completed' END AS err FROM sales
      ), d AS (SELECT *, coalesce(err, CASE WHEN row_number() OVER (PARTITION BY err IS NOT NULL, provider, raw_id ORDER BY seen) > 1 THEN 'duplicate' ELSE 'accepted' END) AS disposition FROM e)
      SELECT provider, disposition, count(*) AS "rows", {_money("sum(all_in)")} AS worth FROM d GROUP BY 1, 2""",
    "batch_rollback": f"WITH {SALES_SQL} SELECT provider, count(*) AS before, count(*) FILTER (WHERE provider <> 'P2') AS after FROM sales GROUP BY provider",
    "barcode_payloads": f"""WITH {CARDS_SQL} SELECT card_id, (['psa_link', 'grader_link', 'link', 'upc', 'certificate', 'text', 'empty'])[card_id % 7 + 1] AS kind,
      CASE WHEN card_id % 7 = 2 THEN (card_id + 100000000000)::VARCHAR WHEN card_id % 7 = 3 THEN '012345678905' END AS listing FROM cards""",
}
