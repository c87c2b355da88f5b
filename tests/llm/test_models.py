from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from cardloom.llm import quality
from cardloom.llm.language_id import UNDETERMINED, Compressors, dictionaries, folded, identify, op9_language_id, own_passages
from cardloom.llm.quality import base_counts, fit_ratio, judge, op8_quality_rules, trusted_ids
from cardloom.llm.toxicity import BlockMaxIndex, fit, monotone, op7_toxicity, score, term_gains, terms_of
from cardloom.session import written

from .helpers import documents, empty, remainder, words

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def table(name, sf_dir=SF):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").fetchall()


def test_language_is_right_on_held_out_documents(spark):
    truth = {r[0]: r[2] for r in table("documents")}
    rows = op9_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_of_hard_rows(spark):
    docs = documents(spark)
    found = {r["doc_id"]: r for r in identify(docs, docs).collect()}
    assert all(found[i]["lang_pred"] == UNDETERMINED and found[i]["score"] == 0 and found[i]["rejected"] for i in (7, 8, 9, 12))
    assert found[10]["lang_pred"] == "en"
    assert identify(empty(spark), docs).count() == 0
    assert {r["lang_pred"] for r in identify(docs, empty(spark)).collect()} == {UNDETERMINED}


def test_sizes_cover_the_whole_text():
    compressors = Compressors({"a": b"alpha beta gamma " * 50, "b": b"lorem ipsum dolor " * 50})
    assert folded("ABC 12 déf_") == "abc déf".encode()
    assert compressors.guess("alpha gamma beta " * 4000 + "lorem")[0] == "a"
    assert compressors.guess("???") == (UNDETERMINED, 0.0)


def test_identify_matches_compression_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    contents = dictionaries(docs, 1 << 13, 1 << 26, 50, "doc_id", "text", "lang")
    assert list(contents) == [r["lang"] for r in docs.groupBy("lang").count().orderBy("count", ascending=False).collect()]

    def size(letters, content):
        settings = zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(content), min_match=3, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0)
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=settings)
        pieces = [letters[at : at + 4096] for at in range(0, len(letters), 4096)]
        return sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=settings).compress(p + b" " + p)) for p in pieces)

    found = {r["doc_id"]: r for r in identify(docs, docs, dict_bytes=1 << 13, rows_per_language=50).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        sizes = [size(folded(text), c) for c in contents.values()]
        best = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        assert found[doc]["lang_pred"] == list(contents)[best[0]]
        assert found[doc]["margin"] == pytest.approx(1 - sizes[best[0]] / sizes[best[1]])


def test_no_number_of_languages_is_too_many(spark):
    rows = [(i, f"tongue{i} speaks word{i} only twice word{i}", f"l{i:03d}") for i in range(300)] + [(1000, "common " * 4000, "l000")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    contents = dictionaries(docs, 1 << 12, 300 * 64, 10, "doc_id", "text", "lang")
    assert len(contents) == 300 and all(contents.values()) and list(contents)[0] == "l000"


def test_passages_of_two_languages_teach_none():
    shared, own = "a b c d e f".encode().split(), "x y z".encode().split()
    assert own_passages({"p": [shared + own], "q": [own[:2], shared]}) == {"p": [own], "q": [own[:2], []]}


def quality_by_hand(text):
    w = [x.decode() for x in words(text)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {at + d for at in range(len(w) - 2) if grams[tuple(w[at : at + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts_match_plain_python(spark):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(50, "a b c a b c a b"), (51, "x x x x x"), (52, "l\nl\n\nl\n m"), (53, "a b   c")], "doc_id bigint, text string"))
    for r in base_counts(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality_by_hand(r["text"]), r["doc_id"]


def test_every_trusted_document_is_used(spark):
    good = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    docs = good.select("doc_id", F.concat_ws(" ", F.lit("w"), "doc_id").alias("text"))
    found = trusted_ids(good).groupBy().agg(F.count(F.lit(1)), F.count_if(F.col("_fold") > 0)).first()
    model = fit_ratio(docs, good, 8).first()["model"]
    everything = fit_ratio(docs, good.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)) > 0), 8).first()["model"]
    assert found[0] == 20_500 and 0 < found[1] < 20_500 and model == everything


def test_ratio_matches_plain_python(spark):
    docs = [(i, t) for i, t, *_ in table("documents")][:120]
    labels = [(i, q) for i, q, _ in table("labels") if i < 120]
    buckets = 64
    bucket = lambda *w: (lambda h: (h - (1 << 64) if h >> 63 else h) % buckets)(chain(w))

    def chain(parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part, seed)
        return seed

    frame, taught = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    folds = {r["doc_id"]: r["_fold"] for r in trusted_ids(taught, 20_000).collect()}
    assert set(folds) == {i for i, q in labels if q == 1} and set(folds.values()) == {0, 1, 2, 3}
    raw, good, trusted = np.zeros(buckets), np.zeros(buckets), {i for i, fold in folds.items() if fold}
    grams = {}
    for i, t in docs:
        w = words(t)
        grams[i] = [bucket(x) for x in w] + [bucket(x, y) for x, y in zip(w, w[1:], strict=False)]
        for g in grams[i]:
            raw[g] += 1
            good[g] += i in trusted
    ratio = np.log((good + 1) / (good.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    found = judge(frame, taught, threshold=-0.05, buckets=buckets)
    for r in found.collect():
        expected = ratio[grams[r["doc_id"]]].sum() / max(1, len(grams[r["doc_id"]]))
        assert r["llr"] == pytest.approx(expected, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= -0.05)
    rows = judge(frame, taught, drop_share=0.25, buckets=buckets).collect()
    held = [r["llr"] for r in rows if folds.get(r["doc_id"]) == 0 and not r["base_failed"]]
    least = np.percentile(held, 25)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= least) for r in rows if abs(r["llr"] - least) > 1e-12)


def test_quality_keeps_clean_and_drops_bad_documents(spark):
    quality = {i: q for i, q, _ in table("labels")}
    rows = [r for r in op8_quality_rules(spark, SF).collect() if r["doc_id"] in quality and not r["base_failed"]]
    good = [r["kept"] for r in rows if quality[r["doc_id"]] == 1]
    assert sum(good) >= 0.99 * len(good)
    bad = [r["kept"] for r in rows if quality[r["doc_id"]] == 0]
    assert sum(bad) < 0.6 * len(bad)
    plan = op8_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trusted_texts_meet_their_labels_once_and_unsorted(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quality, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    op8_quality_rules(spark, SF)
    joined = [p for p in plans if "quality#" in p and "text#" in p]
    assert len(joined) == 1 and "ShuffledHashJoin" in joined[0] and "SortMergeJoin" not in joined[0] and "BroadcastHashJoin" not in joined[0]


def test_quality_of_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    docs = documents(spark)
    rows = judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(r["llr"] is not None and r["kept"] is not None for r in rows)
    assert judge(empty(spark), labels).count() == 0
    assert judge(docs, labels.limit(0)).count() == docs.count()


def test_nearest_examples_match_all_cosines():
    drawn = np.random.default_rng(4)
    dense = drawn.random((500, 12)) * (drawn.random((500, 12)) < 0.2)
    dense[400:] = dense[:100]  # copies tie
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    dense /= np.where(norms > 0, norms, 1)
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = BlockMaxIndex(12, vectors, block=16)
    for at, query in enumerate(vectors[:60]):
        for skip in (-1, at):
            cosines = (dense @ dense[at]).round(12)
            expected = sorted((-c, i) for i, c in enumerate(cosines) if c > 0 and i != skip)[:7]
            places, found = index.nearest(*query, 7, skip)
            assert places.tolist() == [i for _, i in expected]
            assert found.tolist() == pytest.approx([-c for c, _ in expected], abs=1e-9)
    assert index.visited < index.offered
    assert len(BlockMaxIndex(3, []).nearest(np.array([1]), np.array([1.0]), 5)[0]) == 0


def test_gains_count_only_ties_beyond_chance():
    gains = term_gains(np.array([3, 40, 40, 1] * 500), np.array([1, 40, 4, 1] * 500), 1000, 100)
    assert gains[0] == gains[2] == gains[3] == 1 and gains[1] > 5


def test_scores_follow_all_cosines_of_the_examples(spark):
    """The whole query by hand: every cosine between every document and every example."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit(docs, labels)
    texts = dict(map(tuple, docs.collect()))
    ids = [int(d) for d in model.docs]
    df = Counter(t for text in texts.values() for t in set(terms_of(text)))
    weights = dict(zip(model.vocabulary.terms, model.vocabulary.weights, strict=True))
    assert set(weights) == {t for i in ids for t in terms_of(texts[i])}
    assert all(w >= np.log((1 + len(texts)) / (0.5 + df[t])) - 1e-9 for t, w in weights.items())

    def vector(text):
        counts = {t: n for t, n in Counter(terms_of(text)).items() if t in weights}
        out = {t: (1 + np.log(n)) * weights[t] for t, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in out.values()))
        return {t: x / norm for t, x in out.items()}

    examples = [vector(texts[i]) for i in ids]
    found = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert sum(not r["evidence"] for r in found.values()) < 0.01 * len(found)
    for doc in sorted(texts)[::9]:
        query = vector(texts[doc])
        cosines = [round(sum(x * e.get(t, 0) for t, x in query.items()), 12) for e in examples]
        best = sorted(((-c, at) for at, c in enumerate(cosines) if c > 0))[: model.k]
        pulls = [(-c / (1.05 + c), model.toxic[at]) for c, at in best]
        vote = (sum(w * y for w, y in pulls) + model.toxic.mean() / 2) / (sum(w for w, _ in pulls) + 0.5)
        assert found[doc]["score"] == pytest.approx(np.interp(vote, model.edges, model.rates), abs=1e-6)
        assert found[doc]["evidence"] == [str(ids[at]) for _, at in best[:5]]


def test_monotone_pools_violators():
    edges, rates = monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]), np.ones(4))
    assert (np.diff(rates) > 0).all() and len(edges) == 3


def test_toxicity_on_held_out_labels(spark):
    toxic = {i: t for i, _, t in table("labels", LARGER)}
    rows = op7_toxicity(spark, LARGER).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    pairs = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(p and t for p, t in pairs)
    assert hit >= 0.85 * sum(t for _, t in pairs) and hit >= 0.8 * sum(p for p, _ in pairs)


def test_toxicity_of_hard_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, int(i > 3)) for i in range(1, 15)] + [(None, 1), (2, None), (99, 1)], "doc_id bigint, toxic int")
    for taught in (labels, labels.limit(0)):
        rows = score(docs, fit(docs, taught)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score(empty(spark), fit(docs, labels)).count() == 0
