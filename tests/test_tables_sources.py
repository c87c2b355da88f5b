import hashlib
import json
import struct

from pyspark.sql import functions as F

from cardloom.operators import events as Q
from cardloom.operators import tables as M
from cardloom.operators.listings import judge_titles, parse_evidence
from cardloom.sources import files as S


def test_upsert_counts_and_values(spark):
    old = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None)], "id int, price double")
    new = spark.createDataFrame([(2, 20.0), (3, 5.0), (4, 40.0)], "id int, price double")
    got = {r["id"]: (r["price"], r["action"]) for r in M.upsert(old, new, ["id"], ["price"]).collect()}
    assert got == {1: (10.0, "kept"), 2: (20.0, "skipped"), 3: (5.0, "updated"), 4: (40.0, "added")}
    kept = {r["id"]: r["action"] for r in M.upsert(old, new, ["id"], ["price"], replace=False).collect()}
    assert kept[3] == "skipped"


def test_dispositions_and_cascade(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True)], "n int, k string, ok boolean")
    got = {r["n"]: r["disposition"] for r in M.dispose(rows, [(~F.col("ok"), "refused")], ["k"], "n").collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "refused", 4: "accepted"}
    children = spark.createDataFrame([(1, "x", "approved"), (2, "y", "approved")], "id int, who string, status string")
    parents = spark.createDataFrame([("x", True), ("y", False)], "who string, gone boolean")
    assert [r["status"] for r in M.cascade(children, parents, "who", F.col("gone")).orderBy("id").collect()] == ["revoked", "approved"]


def test_hash_chain_covers_what_came_before(spark):
    rows = spark.createDataFrame([("o", 2, "b"), ("o", 1, "a"), ("p", 1, None)], "owner string, n int, body string")
    got = {(r["owner"], r["n"]): (r["position"], r["chain"]) for r in M.hash_chain(rows, "owner", ["n"], "body").collect()}
    first = hashlib.sha256(b"|a").hexdigest()
    assert got == {("o", 1): (1, first), ("o", 2): (2, hashlib.sha256(f"{first}|b".encode()).hexdigest()), ("p", 1): (1, hashlib.sha256(b"|").hexdigest())}


def test_titles_and_evidence(spark):
    titles = [("Red Ring #12 PSA 10", "12"), ("Red Ring #12 PSA 10?", "12"), ("Digital ring #12", "12"), ("Red Ring #7", "12"), ("Red Ring", "12"), ("BGS 9.5 ring card no. 012", "12"), (None, "1")]
    got = judge_titles(spark.createDataFrame(titles, "title string, card_number string")).collect()
    assert [(r["company"], r["grade"], r["reason"]) for r in got] == [("PSA", 10.0, None), ("RAW", None, None), ("RAW", None, "negative_keyword:digital"), ("RAW", None, "card_number_mismatch"), ("RAW", None, "card_number_missing"), ("BGS", 9.5, None), ("RAW", None, "missing_title")]
    text = "1952 Ring #311 BECKETT 8\nSold for $1,234.50 on eBay shipping $5 2024-02-03 http://e.co/x"
    r = parse_evidence(spark.createDataFrame([(text,), (None,)], "text string")).first()
    assert (r["house"], r["price"], r["shipping"], r["sold_on"], r["grader"], r["card_number"], r["year"], r["url"]) == ("eBay", 1234.5, 5.0, "2024-02-03", "BGS", "311", 1952, "http://e.co/x")


def test_dates_and_certificates_of_evidence(spark):
    texts = ["sold 3/7/2024 PSA cert # 12345678 total: $5", "BGS 9.5 on March 7, 2024", "CSG mar. 7 2024 price $1,000.5", "13/45/2024"]
    got = [(r["sold_on"], r["grader"], r["grade_value"], r["cert"], r["price"]) for r in parse_evidence(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == [("2024-03-07", "PSA", None, "12345678", 5.0), ("2024-03-07", "BGS", 9.5, None, None), ("2024-03-07", "CSG", None, None, 1000.5), (None, None, None, None, None)]


def test_first_hit_windows_and_readiness(spark):
    hits = spark.createDataFrame([("u", t) for t in (0, 5, 9, 10, 11, 25)], "k string, t bigint")
    got = [(r["at"], r["used"], r["allowed"]) for r in Q.first_hit_windows(hits, "k", "t", 10, 2).orderBy("at").collect()]
    assert got == [(0, 1, True), (5, 2, True), (9, 3, False), (10, 1, True), (11, 2, True), (25, 1, True)]
    tasks = spark.createDataFrame([("a", [], "complete"), ("b", ["a"], "pending"), ("c", ["b"], "pending"), ("d", ["x", "a"], "pending"), ("x", [], "failed")], "task_id string, depends_on array<string>, status string")
    ready = {r["task_id"]: (r["ready"], r["blocked"]) for r in Q.readiness(tasks).collect()}
    assert ready["b"] == (True, False) and ready["c"] == (False, False) and ready["d"] == (False, True)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,price\n"Say ""hi"", you", 5 \n\nshort\n')
    rows = S.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [('Say "hi", you', "5"), ("short", "")]
    (tmp_path / "h.csv").write_text("report\n\nplayer,set,card number\nx,y,1\n")
    assert S.header_line(spark, str(tmp_path / "h.csv"), ["player", "set", "card number"]) in (1, 2)
    for name, body in (("a.json", [{"id": "1"}]), ("b.json", {"cards": [{"id": "1"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [r["id"] for r in S.read_records(spark, str(tmp_path / name), "id:string").collect()] == ["1"]
    (tmp_path / "n.ndjson").write_text('{"id": 1}\nnot json\n\n{"id": 2}\n')
    good, bad = S.read_ndjson(spark, str(tmp_path / "n.ndjson"), "id int")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["not json"]
    (tmp_path / "m.jsonl").write_text('{"id": 1, "authorization_state": "PROHIBITED"}\n{"id": 2}\n')
    assert [r["id"] for r in S.read_manifest(spark, str(tmp_path / "m.jsonl"), "id int, authorization_state string").collect()] == [2]
    S.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), str(tmp_path / "out"), ["y", "x"])
    assert b"\r\n" in next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "out")).collect()] == [("1", "a,b")]


def test_images_and_nested_feeds(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 9)
    (tmp_path / "i/b.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 9)
    (tmp_path / "i/c.png").write_bytes(b"no image")
    got = sorted((r["kind"] or "", r["width"], r["height"]) for r in S.image_sizes(spark, str(tmp_path / "i")).collect())
    assert got == [("", None, None), ("jpeg", 40, 30), ("png", 640, 480)]
    body = json.dumps({"entry": [{"id": "p", "messaging": [{"sender": {"id": "s"}, "message": {"mid": "m1", "text": "t"}}, {"message": {"mid": "m2", "is_echo": True}}], "changes": [{"field": "comments", "value": {"id": "c1"}}, {"field": "likes", "value": {"id": "c2"}}]}]})
    rows = S.flatten_messages(spark.createDataFrame([(body,)], "body string")).collect()
    assert sorted((r["kind"], r["event_id"], r["ignored"]) for r in rows) == [("comment", "c1", None), ("comment", "c2", "unsupported_field"), ("message", "m1", None), ("message", "m2", "echo")]


def test_pages_and_unions(spark):
    html = "<html><style>p{}</style><script>var x='1 - y'</script><ul><li>12 - Red Ring</li><li>#13: Blue &amp; Co</li><li>12 - again</li><li>36 packs per box</li></ul></html>"
    got = S.html_checklist(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id").collect()
    assert sorted((r["card_number"], r["subject"]) for r in got) == [("12", "Red Ring"), ("13", "Blue & Co")]
    a, b = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, 5), (2, 6)], "id int, y int")
    assert sorted(tuple(r) for r in S.union_tables([a, b], "id").collect()) == [(1, "a", None), (2, None, 6)]


def test_token_matches_follow_all_pairs(spark):
    from cardloom.operators.catalog import token_matches

    asked = ["ab", "rose", "roses", "diamonds", "xiamonds", "dimondz", "12", "prose"]
    held = ["rose", "a", "ab", "cab", "diamond", "diamonds", "prosecco", "ros", "1234", "roze", "dxamonds"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    def share(t, v):
        near = len(t) >= 4 and (v.startswith(t) or t.startswith(v) or edits(t, v) <= (2 if len(t) >= 8 else 1))
        return 1.0 if t in v else 0.65 if near and len(v) > 1 else None

    frame = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    found = {(r["t"], r["v"]): r["share"] for r in token_matches(frame(asked, "t"), frame(held, "v")).collect()}
    assert found == {(t, v): share(t, v) for t in asked for v in held if share(t, v)}


def test_tables_between_steps_are_discarded_but_for_those_still_read(spark):
    from cardloom.session import discard_tables, written

    old, new = written(spark.range(5)), written(spark.range(7))
    both = new.withColumn("x", F.lit(1))
    assert discard_tables(both) >= 1 and both.count() == 7
    assert old.inputFiles() and not spark._jvm.java.io.File(old.inputFiles()[0].removeprefix("file:")).exists()
    assert discard_tables(both) == 0
