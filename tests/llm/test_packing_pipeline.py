import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cardloom.llm.mixing import mix
from cardloom.llm.packing import Encoder, default_vocabulary, pack, patterns, plan_places, solve_repeats

from .helpers import documents, empty
from .test_dedup import line_dedup_by_hand


#: Code points of every kind of letter, number, mark and white space, below and above the quick pattern's limit.
CODES = [*range(0x250), 0x2028, 0x3000, 0x2003, 0x200B, 0x301, 0x661, 0x2167, 0x4E2D, 0x1F642, 0x10400, 0x250, 0x24F, *([0x20, 0x0A, 0x27, 0x73, 0x74] * 40)]


def whole_ids(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_vocabulary())
    return [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_gives_the_ids_of_the_whole_text():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 150").fetchall()]
    texts += ["", "   ", "a  b\n\n c\t\t", "it's we'll I'D", "日本語 emoji 🙂‍↔️ x y", "<|endoftext|> 12 3.5€", "a<|endoftext|>b"]
    drawn = random.Random(3)
    texts += ["".join(chr(drawn.choice(CODES)) for _ in range(60)) for _ in range(400)]
    encoder = Encoder(default_vocabulary())
    for text, ids in zip(texts, whole_ids(texts), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\ny <|endoftext", "no such token", ""]
    found = {r["doc_id"]: r for r in pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), window=64).collect() if r["start"] == 0}
    for at, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert found[at]["doc_tokens"] == len(ids)
        assert found[at]["ids_crc32"] == zlib.crc32(ids[: found[at]["length"]].tobytes())


def test_patterns_fill_the_window_and_least_squares_fit():
    combos = patterns(256)
    assert (combos.sum(axis=1) == 256).all() and (combos[:, :2] > 0).all() and (combos.tolist() == patterns(256).tolist())
    assert {tuple(row[:2]) for row in combos.tolist() if not row[2]} == {(256 - i, i) for i in range(1, 129)}
    histogram = np.bincount(np.random.default_rng(0).integers(1, 256, 50_000), minlength=257)
    repeats = solve_repeats(combos, histogram)
    made = np.bincount(combos.ravel(), np.repeat(repeats, combos.shape[1]), 257)
    made[0] = 0
    assert (repeats >= 0).all() and np.abs(made - histogram).sum() < 0.1 * histogram.sum()
    places = plan_places(histogram, 256)
    used = (places["last"] - places["first"]).groupby(places["length"]).sum()
    assert (used <= histogram[used.index]).all() and used.sum() > 0.8 * histogram.sum()


@pytest.mark.parametrize("window", [64, 2048])
def test_pieces_cover_documents_and_fill_sequences(spark, window):
    docs = documents(spark).union(spark.createDataFrame([(300 + i, f"word {i} " * (i % 40), None, None, None, None, None, None, None, None) for i in range(400)], documents(spark).schema))
    rows = docs.select("doc_id", "text").collect()
    expected = defaultdict(list)
    for r, ids in zip(rows, whole_ids([r["text"] for r in rows]), strict=True):
        expected[r["doc_id"]].append(np.array([*ids, 1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in pack(docs, window=window).collect():
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert pieces.keys() == expected.keys()
    for doc, found in pieces.items():
        if len(expected[doc]) == 1:
            ids, at = expected[doc][0], 0
            for p in sorted(found, key=lambda p: p["start"]):
                assert (p["start"], p["doc_tokens"]) == (at, len(ids))
                assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
        else:  # repeated rows: each is packed
            assert sum(p["length"] for p in found) == sum(map(len, expected[doc]))
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_an_empty_table(spark):
    assert pack(empty(spark)).count() == 0


def test_pipeline_stages_keep_the_columns_and_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    columns, n = docs.columns, docs.count()
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf_dir).cache()
        if at < 4:
            assert after.columns == columns
        if name in ("language_id", "near_dedup"):
            assert 0.8 * n < after.count() <= n
        if name == "line_dedup":
            assert after.count() == docs.count() and after.selectExpr("sum(n_chars)").first()[0] <= docs.selectExpr("sum(n_chars)").first()[0]
        docs, n = after, after.count()
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_of_hard_rows_match_plain_python(spark, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows and rows that share an id."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = documents(spark).select(names).union(spark.createDataFrame([(300 + i, f"a line that many documents share\nown words {i} of number {i}", "en", "abc"[i % 3], 1) for i in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows = [tuple(r) for r in docs.collect()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)

    kept = [tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert set(kept) < set(rows) and all(any(c.isalpha() for c in t) for _, t, *_ in kept)
    assert {i for i, *_ in rows} - {i for i, *_ in kept} <= {7, 8, 9, 12, 11, 14, None}

    lines = [tuple(r) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()]
    by_text = {(i, n, digest) for i, n, _, digest in line_dedup_by_hand([(i, t) for i, t, *_ in rows])}
    assert len(lines) == len(rows)
    assert {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in lines} == {(i, digest) for i, _, digest in by_text}
    assert all(n == len(t) for _, t, _, _, n in lines)

    mixed = [tuple(r) for r in corpus_pipeline.mixing(spark, docs, "").collect()]
    taken, planned = defaultdict(int), defaultdict(int)
    for i, t, _, source, n in mixed:
        assert n == len(t) and t.split()
        taken[i, source] += len(t.encode().split())
    for r in mix(docs).collect():
        planned[r["doc_id"], r["source"]] += r["taken"]
    assert {k: n for k, n in planned.items() if n} == dict(taken)
    assert sorted(mixed, key=key) == sorted((tuple(r) for r in corpus_pipeline.mixing(spark, docs.repartition(5), "").collect()), key=key)

    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    ids = whole_ids([t for _, t, *_ in rows])
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in ids)

    for part in (docs, docs.limit(0)):
        part.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(out) == bool(part.count())
        assert {p["doc_id"] for p in out} <= {i for i, *_ in rows}


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = text("a").replace("a59", "other")
    rows = [(5, text("a"), "en"), (5, text("b"), "en"), (6, near, "en"), (4, text("c"), "en"), (5, text("c"), "en"), (7, text("d"), "fr"), (7, text("d"), "de"), (None, text("e"), "en"), (None, text("e"), "en"), (None, text("b"), "en"), (8, " ", "en"), (9, " ", "en"), (9, " ", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    expected = [(5, text("a"), "en"), (5, text("b"), "en"), (4, text("c"), "en"), (7, text("d"), "de"), (None, text("e"), "en"), (8, " ", "en"), (9, " ", "en")]
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()), key=str) == sorted(expected, key=str)
