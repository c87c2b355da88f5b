import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, score string, host string, slot string"

BASE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
LINE = "This exact licence line is in many documents."


def documents(spark):
    """Rows with nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    rows = [
        (1, BASE, "en", "a"),
        (2, BASE, "en", "a"),
        (2, BASE, "en", "a"),
        (3, BASE.replace("word59", "other"), "en", "b"),
        (4, f"{LINE}\nfirst own line of four here\n\t{LINE.upper()} ", "en", "b"),
        (5, f"{LINE}\nshort\nshort", "de", None),
        (6, f"second own line of six here\n{LINE}", None, "c"),
        (7, None, None, None),
        (8, "", "fr", "c"),
        (9, " \t\n \r\n", "fr", "c"),
        (10, LONG, "en", "a"),
        (11, "two words", "en", "é"),
        (12, "12345 *** $$$ ###", "de", "z"),
        (None, "a row without any id at all", "en", "a"),
        (14, "Élan ÉLAN élan été déjà vu", "fr", "b"),
    ]
    return spark.createDataFrame([(*r, None, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def shingles(text, width):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
