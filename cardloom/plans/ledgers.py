"""Queries on learned candidates, override versions, partial unique inserts, pages and capped lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import catalog as C
from cardloom.operators import learning as L
from cardloom.operators import order as O
from cardloom.operators import phrases as T
from cardloom.operators import versions as V
from cardloom.plans.catalog import NORM, RANKED_SQL, search_queries
from cardloom.plans.views import CARDS_SQL, SALES_SQL, cards, sales
from cardloom.session import table
from cardloom.streaming import imports as S

REASONS = ["wrong {player}", "is {brand} {set_name}", None, "{player} {set_name} {year}", "mixed up"]


def learned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each catalog search, with the cards that corrections of every third card add."""
    rows = cards(spark, sf_dir)
    queries = search_queries(spark, sf_dir)
    matches = C.rank_cards(queries, rows, 5).select(F.col("query_id").alias("item"), "rank", "card_id", "confidence", F.col("score").alias("match_score"))
    reason = F.element_at(F.array(*map(F.lit, REASONS)), F.pmod("card_id", F.lit(5)).cast("int") + 1)
    for name in ("player", "brand", "set_name", "year"):
        reason = F.replace(reason, F.lit("{" + name + "}"), F.col(name).cast("string"))
    corrections = rows.filter("card_id % 3 = 0").select("card_id", reason.alias("reason"))
    labels = rows.select("card_id", F.concat_ws(" ", F.col("year").cast("string"), "brand", "set_name", "player", F.concat(F.lit("#"), "card_number")).alias("label"))
    return L.learned_candidates(queries.select(F.col("query_id").alias("item"), F.col("query").alias("text")), matches, corrections, labels)


TITLE_FORMS = ["{year} {brand} {set_name} {player} #{n} Refractor", "{player} rc {brand}! #{n} PSA 10", "{YEAR} {PLAYER} card no. {n}", "{year} {set_name} silver {player}", "{year} {brand} x{player} #{n}"]


def title_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What titles after the cards say, by the names of the catalog."""
    rows = cards(spark, sf_dir)
    title = F.element_at(F.array(*map(F.lit, TITLE_FORMS)), F.pmod("card_id", F.lit(5)).cast("int") + 1)
    for name, value in (("year", F.col("year").cast("string")), ("YEAR", F.col("year").cast("string")), ("brand", F.col("brand")), ("set_name", F.col("set_name")), ("player", F.col("player")), ("PLAYER", F.upper("player")), ("n", F.col("card_number"))):
        title = F.replace(title, F.lit("{" + name + "}"), value)
    names = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("brand", "set_name", "player")]))).distinct()
    found = T.infer_titles(rows.select(F.col("card_id").alias("id"), title.alias("title")), names)
    return found.select(F.col("id").alias("card_id"), "title", "year", "brand", "set_name", "player", "number", "company", "grade", "parallel", "sport", "usable")


def override_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as upserts of a customer's image, in batches of a hundred, and every 97th as the rollback of an earlier batch."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), F.pmod("o_custkey", F.lit(400)).alias("card_id"), (F.col("o_orderkey") / 100).cast("bigint").alias("batch"), F.col("o_totalprice").alias("value"))
    return orders.filter("at % 97 <> 0"), orders.filter("at % 97 = 0").select("at", (F.col("batch") - F.col("at") % 3).alias("batch"))


def image_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.override_versions(*override_log(spark, sf_dir)).select("card_id", "valid_from", "valid_to", "ended_by", "action", "created_at", "batch", "value")


def overrides_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides as they were after the change in the middle of the log."""
    upserts, rollbacks = override_log(spark, sf_dir)
    middle = upserts.agg(F.floor(F.max("at") / 2).alias("m"))  # one row
    versions = V.override_versions(upserts, rollbacks).join(F.broadcast(middle))
    return V.valid_at(versions, F.col("m")).select("card_id", "valid_from", "created_at", "value")


def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    upserts, rollbacks = override_log(spark, sf_dir)
    audit = V.override_audit(V.override_versions(upserts, rollbacks), rollbacks)
    return audit.groupBy("type", "batch").agg(F.count(F.lit(1)).alias("entries"), F.sum("rows").alias("rows"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reviewed items: those with an approved status are unique in part and price class."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("item"), F.col("l_partkey").alias("front"),
        F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_quantity") / 10).cast("int")).alias("back"), F.when(F.col("l_returnflag") == "A", "approved").otherwise("open").alias("status"), F.col("l_linenumber").alias("turn"), F.col("l_extendedprice").alias("price"),
    )
    old, new = lines.filter("turn = 1").dropDuplicates(["item"]), lines.filter("turn > 1")
    old = V.insert_ignore(old.limit(0), old, ["front", "back"], F.col("status") == "approved", ["item", "price"]).drop("action")
    done = V.insert_ignore(old, new, ["front", "back"], F.col("status") == "approved", ["item", "price"])
    return done.groupBy("front", "status", "action").agg(F.count(F.lit(1)).alias("rows"))


def sales_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty sales from the 1,000th dearest on."""
    rows = sales(spark, sf_dir).select("raw_id", "card_id", F.col("seen.l_suppkey").alias("supplier"), F.round("all_in", 6).alias("all_in"), "sold_at")
    return O.page(rows, [F.desc("all_in"), F.col("raw_id"), F.col("card_id"), F.col("supplier"), F.col("sold_at")], 1000, 50)


def echo_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sent jobs and as echoes of earlier ones: the earliest echo of each message, and whether its job was sent."""
    events = table(spark, sf_dir, "events")
    owner = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    sent = events.filter("event_id % 3 <> 0").select(F.lit("sent").alias("kind"), owner.alias("owner"), (F.col("event_id") % 700).cast("string").alias("message_id"), F.col("event_id").alias("job_id"), F.when(F.col("event_type") != "error", "SENT").otherwise("FAILED").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    echoes = events.filter("event_id % 2 = 0").select(F.lit("echo").alias("kind"), owner.alias("owner"), (F.col("event_id") % 700).cast("string").alias("message_id"), F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("string").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return S.echoes_of(sent.unionByName(echoes))


RULES = [("verify", "NOT verified AND all_in > 1000"), ("reprice", "completed AND sale_type = 'auction'"), ("review", "confidence < 0.7")]


def recommended_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of an ordered list, the sales found and those shown under a cap of 5,000 in all, with the first and last position shown."""
    rows = sales(spark, sf_dir).withColumn("supplier", F.col("seen.l_suppkey"))
    shown, counts = O.capped([rows.filter(rule).select("raw_id", "card_id", "supplier", "sold_at") for _, rule in RULES], [F.col("raw_id"), F.col("card_id"), F.col("supplier"), F.col("sold_at")], 5000)
    ends = shown.groupBy("rule").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.sum("card_id").alias("cards"))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in RULES]), F.col("rule") + 1)
    return counts.join(ends, "rule", "left").select(name.alias("rule"), "found", "shown", "first", "last", "cards")


QUERIES = {f.__name__: f for f in (learned_candidates, title_inference, image_overrides, overrides_restored, override_audit, training_rows, echo_reconciliation, sales_page, recommended_sales)}

_words = lambda x: f"list_filter(string_split({NORM(x)}, ' '), lambda w: length(w) >= 3)"
_share = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_filter({a}, lambda w: list_contains({b}, w))) / len({a})::DOUBLE ELSE 0 END"
_REASON = "(['wrong ' || player, 'is ' || brand || ' ' || set_name, '', player || ' ' || set_name || ' ' || year::VARCHAR, 'mixed up'])[card_id % 5 + 1]"
VERSIONS_SQL = """l AS (SELECT o_orderkey AS at_, o_custkey % 400 AS card_id, o_orderkey // 100 AS batch, o_totalprice AS value FROM orders
), u AS (SELECT * FROM l WHERE at_ % 97 <> 0), b AS (SELECT at_, batch - at_ % 3 AS batch FROM l WHERE at_ % 97 = 0
), n AS (SELECT u.*, lead(at_) OVER (PARTITION BY card_id ORDER BY at_) AS nxt, (SELECT min(b.at_) FROM b WHERE b.batch = u.batch AND b.at_ > u.at_) AS gone FROM u
), e AS (SELECT *, CASE WHEN gone <= coalesce(nxt, gone) THEN gone ELSE nxt END AS valid_to, CASE WHEN gone <= coalesce(nxt, gone) THEN 'rollback' WHEN nxt IS NOT NULL THEN 'upsert' END AS ended_by FROM n
), a AS (SELECT *, CASE WHEN lag(ended_by) OVER (PARTITION BY card_id ORDER BY at_) = 'upsert' THEN 'updated' ELSE 'added' END AS action FROM e
), v AS (SELECT *, max(CASE WHEN action = 'added' THEN at_ END) OVER (PARTITION BY card_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS created_at FROM a)"""
_RULES_SQL = " UNION ALL ".join(f"SELECT {i} AS r, '{name}' AS rule, raw_id, card_id, seen[4] AS supplier, sold_at FROM sales WHERE {rule}" for i, (name, rule) in enumerate(RULES))

ORACLES = {
    "learned_candidates": f"""WITH {RANKED_SQL}, reg AS (SELECT query_id AS item, list_filter(string_split(q, ' '), lambda w: length(w) >= 3) AS words FROM q
      ), lab AS (SELECT card_id, list_distinct({_words("concat_ws(' ', year::VARCHAR, brand, set_name, player, '#' || card_number)")}) AS words FROM cards
      ), cor AS (SELECT card_id, {_words(_REASON)} AS words FROM cards WHERE card_id % 3 = 0
      ), mat AS (SELECT query_id AS item, rank AS r0, card_id, confidence AS c0, score FROM ranked WHERE rank <= 5
      ), allm AS (SELECT *, false AS added FROM mat UNION ALL SELECT reg.item, NULL, lab.card_id, 0.52::DOUBLE, 0, true FROM reg, lab WHERE lab.card_id % 3 = 0 AND {_share("reg.words", "lab.words")} >= 0.25 AND NOT EXISTS (SELECT 1 FROM mat WHERE mat.item = reg.item AND mat.card_id = lab.card_id)
      ), bst AS (SELECT m.*, CASE WHEN c.card_id IS NULL THEN 0 WHEN {_share("c.words", "reg.words")} > 0 THEN 0.03::DOUBLE + ({_share("c.words", "reg.words")}) * 0.05::DOUBLE ELSE 0.02 END AS bo FROM allm m JOIN reg USING (item) LEFT JOIN cor c ON c.card_id = m.card_id
      ), fin AS (SELECT item, r0, card_id, score, added, round(bo, 6) AS boost, least(0.995::DOUBLE, round(c0 + round(bo, 6), 6)) AS confidence FROM bst
      ), rk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY confidence DESC, score DESC, r0 NULLS LAST, card_id)::INT AS rank FROM fin) SELECT item, rank, card_id, confidence, boost, added FROM rk WHERE rank <= 7""",
    "title_inference": f"""WITH {CARDS_SQL}, t AS (SELECT *, card_id % 5 AS k FROM cards)
      SELECT card_id, CASE k WHEN 0 THEN concat(year, ' ', brand, ' ', set_name, ' ', player, ' #', card_number, ' Refractor') WHEN 1 THEN concat(player, ' rc ', brand, '! #', card_number, ' PSA 10') WHEN 2 THEN concat(year, ' ', upper(player), ' card no. ', card_number)
          WHEN 3 THEN concat(year, ' ', set_name, ' silver ', player) ELSE concat(year, ' ', brand, ' x', player, ' #', card_number) END AS title,
        CASE WHEN k <> 1 THEN year END AS year, CASE WHEN k IN (0, 1, 4) THEN brand END AS brand, CASE WHEN k IN (0, 3) THEN set_name WHEN k <> 4 AND player LIKE lower(set_name) || ' %' THEN NULL END AS set_name, CASE WHEN k <> 4 THEN player END AS player,
        CASE WHEN k <> 3 THEN card_number END AS number, CASE WHEN k = 1 THEN 'PSA' ELSE 'RAW' END AS company, CASE WHEN k = 1 THEN 10.0::DOUBLE END AS grade, (['Refractor', 'Rookie', 'Base', 'Silver', 'Base'])[k + 1] AS parallel, 'Sports Cards' AS sport, k IN (0, 2) AS usable FROM t""",
    "image_overrides": f"WITH {VERSIONS_SQL} SELECT card_id, at_ AS valid_from, valid_to, ended_by, action, created_at, batch, value FROM v",
    "overrides_restored": f"WITH {VERSIONS_SQL} SELECT card_id, at_ AS valid_from, created_at, value FROM v WHERE at_ <= (SELECT max(at_) // 2 FROM u) AND (valid_to IS NULL OR valid_to > (SELECT max(at_) // 2 FROM u))",
    "override_audit": f"""WITH {VERSIONS_SQL}, x AS (SELECT at_, 'override_' || action AS type, batch, 1 AS r FROM v UNION ALL SELECT b.at_, 'batch_rollback', b.batch, (SELECT count(*) FROM v WHERE ended_by = 'rollback' AND valid_to = b.at_) FROM b)
      SELECT type, batch, count(*) AS entries, sum(r)::BIGINT AS "rows" FROM x GROUP BY ALL""",
    "training_rows": """WITH l AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR AS item, l_partkey AS front, CASE WHEN l_suppkey % 3 <> 0 THEN floor(l_quantity / 10)::INT END AS back,
        CASE WHEN l_returnflag = 'A' THEN 'approved' ELSE 'open' END AS status, l_linenumber AS turn, l_extendedprice AS price FROM lineitem
      ), o0 AS (SELECT DISTINCT ON (item) * FROM l WHERE turn = 1), o1 AS (SELECT *, row_number() OVER (PARTITION BY front, back, status = 'approved' ORDER BY item, price) AS n FROM o0
      ), o AS (SELECT * FROM o1 WHERE status <> 'approved' OR n = 1), w AS (SELECT *, row_number() OVER (PARTITION BY front, back, status = 'approved' ORDER BY item, price) AS n FROM l WHERE turn > 1
      ), i AS (SELECT * FROM w WHERE status <> 'approved' OR (n = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.status = 'approved' AND o.front = w.front AND o.back IS NOT DISTINCT FROM w.back)))
      SELECT front, status, 'kept' AS action, count(*) AS "rows" FROM o GROUP BY ALL UNION ALL SELECT front, status, 'inserted', count(*) FROM i GROUP BY ALL""",
    "echo_reconciliation": """WITH s AS (SELECT 'u' || user_id::VARCHAR AS owner, (event_id % 700)::VARCHAR AS message_id, min(event_id) AS job_id FROM events WHERE event_id % 3 <> 0 AND event_type <> 'error' GROUP BY ALL
      ), e AS (SELECT 'u' || user_id::VARCHAR AS owner, (event_id % 700)::VARCHAR AS message_id, min(ts) AS echo_at FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT owner, message_id, job_id, echo_at, job_id IS NOT NULL AS matched FROM e LEFT JOIN s USING (owner, message_id)""",
    "sales_page": f"""WITH {SALES_SQL}, r AS (SELECT raw_id, card_id, seen[4] AS supplier, round(all_in, 6) AS all_in, sold_at, row_number() OVER (ORDER BY round(all_in, 6) DESC, raw_id, card_id, seen[4], sold_at) - 1 AS position FROM sales) SELECT * FROM r WHERE position BETWEEN 1000 AND 1049""",
    "recommended_sales": f"""WITH {SALES_SQL}, x AS ({_RULES_SQL}), p AS (SELECT *, row_number() OVER (ORDER BY r, raw_id, card_id, supplier, sold_at) - 1 AS position FROM x)
      SELECT rule, count(*) AS found, count(*) FILTER (WHERE position < 5000) AS shown, min(position) FILTER (WHERE position < 5000) AS first, max(position) FILTER (WHERE position < 5000) AS last, sum(card_id) FILTER (WHERE position < 5000)::BIGINT AS cards FROM p GROUP BY r, rule""",
}
