import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from cardloom.llm.sentencepieces import Pieces, decode, default_model, encode, op11_sentencepiece

from .helpers import documents, empty

RULES = {"ﬁ": "fi", "①": "1", "é": "é", "é̂": "ê", "\t": " ", "　": " ", "…": "...", "ab": "", "é": "e", "㎏": "kg", "🙂": ":)"}
LETTERS = [*"  ab", "e", "́", "̂", "ﬁ", "①", "\t", "　", "…", "é", "㎏", "🙂", "𝒳", "the", "Ω", "▁", "\n", "中"]


def compiled(rules):
    """A double array of the rules, laid out first fit."""
    texts, at_of = b"", {}
    for text in rules.values():
        at_of.setdefault(text, len(texts))
        if at_of[text] == len(texts):
            texts += text.encode() + b"\0"
    trie = {}
    for key, text in rules.items():
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node["value"] = at_of[text]
    units, bases = {0: 0}, set()
    todo = [(0, 0, trie)]
    while todo:
        at, label, node = todo.pop()
        labels = [0 if b == "value" else b for b in node]
        base = next(b for b in range(1, 1 << 20) if b not in bases and all(b ^ x not in units for x in labels))
        bases.add(base)
        units[at] = (at ^ base) << 10 | label | (("value" in node) << 8)
        for byte, below in node.items():
            units[base ^ (0 if byte == "value" else byte)] = below | 1 << 31 if byte == "value" else 0
        todo += [(base ^ byte, byte, below) for byte, below in node.items() if byte != "value"]
    size = (max(units) | 0xFF) + 1
    body = b"".join(units.get(x, 0xFF).to_bytes(4, "little") for x in range(size))
    return len(body).to_bytes(4, "little") + body + texts


def model_file(folder, rules, one_space, prefix):
    model = model_pb2.ModelProto.FromString(open(default_model(), "rb").read())
    spec = model.normalizer_spec
    spec.name, spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix = "own", compiled(rules), one_space, prefix
    path = folder / "own.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def agrees(pieces, library, text):
    ids, begins, ends = pieces.encode(text)
    wanted = library.encode(text, return_type="proto").pieces
    body = text.encode()
    assert ids.tolist() == [p.id for p in wanted], text
    assert [body[a:b].decode() for a, b in zip(begins, ends, strict=True)] == [p.surface for p in wanted], text


def drawn(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices(LETTERS, k=draw.randrange(30))) for _ in range(n)] + ["", " ", "   ", "\t\t", "ab", " ab ", "abab", "x" * 5000, "é" * 50, "a " * 500]


@pytest.mark.parametrize("one_space", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_pieces_and_source_bytes_are_the_librarys_under_a_character_map(tmp_path, one_space, prefix):
    path = model_file(tmp_path, RULES, one_space, prefix)
    pieces, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert {c for c in pieces.map.first_characters()} == {key[0] for key in RULES}
    for text in drawn(1, 400):
        agrees(pieces, library, text)


def test_pieces_and_source_bytes_are_the_librarys_without_a_map():
    pieces, library = Pieces(default_model()), sentencepiece.SentencePieceProcessor(model_file=default_model())
    for text in drawn(2, 400) + ["\0a\0", "</s><unk><s>", "<0x0A>", "long" * 9000]:
        agrees(pieces, library, text)


def test_the_longest_key_wins(tmp_path):
    pieces = Pieces(model_file(tmp_path, {"é": "é", "é̂": "ê", "é": "e"}, False, False))
    text, begins = pieces.normalise("xé̂ée")
    assert text == "xêée" and begins.tolist() == [0, 1, 6, 9, 10]


def test_models_of_other_kinds_are_refused(tmp_path):
    model = model_pb2.ModelProto.FromString(open(default_model(), "rb").read())
    model.trainer_spec.treat_whitespace_as_suffix = True
    (tmp_path / "suffix.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="marks before words"):
        Pieces(str(tmp_path / "suffix.model"))


def test_encode_and_decode_keep_hard_rows(spark):
    docs = documents(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [r["text"] or "" for r in docs.collect()]
    rows = decode(encode(docs)).collect()
    wanted = sorted((library.encode(t, add_eos=True), library.decode(library.encode(t, add_eos=True))) for t in texts)
    assert sorted((r["ids"], r["decoded"]) for r in rows) == wanted
    assert [(r["begins"], r["ends"]) for r in rows if r["doc_id"] == 7] == [([0], [0])]
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert encode(docs, end=False).filter("doc_id = 8").first()["ids"] == []
    assert encode(empty(spark)).count() == 0 and decode(encode(empty(spark))).count() == 0
    assert encode(docs, key="lang").schema["lang"].dataType.simpleString() == "string"
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")).collect()[0]["decoded"] is None


def test_query_against_the_library(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = []
    for row in documents(spark).collect():
        ids = library.encode(row["text"] or "", add_eos=True)
        wanted.append((row["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert sorted(map(tuple, op11_sentencepiece(spark, str(tmp_path)).collect()), key=str) == sorted(wanted, key=str)
