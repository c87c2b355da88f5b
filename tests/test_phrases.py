import random

from cardloom.operators import phrases as T


def by_hand(text, phrases):
    words, out, at = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split(), [], 0
    known = {tuple("".join(c if c.isalnum() else " " for c in (p or "").lower()).split()) for p in phrases} - {()}
    while at < len(words):
        n = max((len(p) for p in known if tuple(words[at : at + len(p)]) == p), default=0)
        if n:
            out.append((at, n, " ".join(words[at : at + n])))
        at += n or 1
    return out


def test_both_ways_find_the_leftmost_longest(spark):
    draw = random.Random(7)
    words = ["a", "b", "c", "topps", "chrome", "ann"]
    phrases = [" ".join(draw.choices(words, k=draw.randrange(1, 5))) for _ in range(25)] + ["A-b!", "", None, "topps chrome", "Topps", "topps chrome update"]
    texts = [" ".join(draw.choices([*words, "x,", "B."], k=draw.randrange(0, 15))) for _ in range(80)] + [None, "", "Topps--Chrome", "toppschrome", "a " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    held = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    wanted = {i: by_hand(t, phrases) for i, t in enumerate(texts)}
    for most in (1 << 20, 0):
        assert {r["id"]: [tuple(h) for h in r["found"]] for r in T.find_phrases(rows, held, most).collect()} == wanted
    assert {r["id"]: r["found"] for r in T.find_phrases(rows, held.limit(0)).collect()} == {i: [] for i in wanted}


def test_titles(spark):
    names = spark.createDataFrame([("brand", "Topps"), ("set_name", "Topps Chrome"), ("player", "Ann Lee"), ("player", "ANN LEE"), ("player", "Lee"), ("brand", None)], "kind string, value string")
    titles = ["2001 Topps Chrome Ann Lee #7 refractor PSA 9", "Ann Lee #7", "1999 topps Lee RC", None, "2001 pokemon ann-lee no. 12"]
    found = T.infer_titles(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), names).orderBy("id").collect()
    shown = [(r["year"], r["brand"], r["set_name"], r["player"], r["number"], r["company"], r["grade"], r["parallel"], r["sport"], r["usable"]) for r in found]
    assert shown == [
        (2001, None, "Topps Chrome", "ANN LEE", "7", "PSA", 9.0, "Refractor", "Sports Cards", True), (None, None, None, "ANN LEE", "7", "RAW", None, "Base", "Sports Cards", False),
        (1999, "Topps", None, "Lee", None, "RAW", None, "Rookie", "Sports Cards", False), (None, None, None, None, None, "RAW", None, "Base", "Sports Cards", False), (2001, None, None, "ANN LEE", "12", "RAW", None, "Base", "Pokemon", True),
    ]
