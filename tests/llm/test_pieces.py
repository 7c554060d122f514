"""Pieces beside the library whose results they must equal."""

import hashlib
import os
import random

import numpy as np
import pytest
import sentencepiece

from earshot.llm import pieces

SF = "/root/testdata/sf0.001"
EDGES = ["", " ", "   ", "a", "▁", "▁▁a", "a▁b", " a", "a ", "\n", "\t\n x\r\n", "é", "日本語テキスト 中文", "🙂🙂 x", "a\x00b", "<s> </s>", "<unk><0x0A>", "12345 67", "x" * 3000, "the" * 2000, " " * 37 + "x" + " " * 18, "ﬁ ½ İ ß", "ab cd　ef", "a b", "é"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def merges():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Merges(f.read())


def ids_of(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def same(library, merges, text):
    ids = np.frombuffer(merges.encode(text), dtype="<u4").tolist()
    assert ids == ids_of(library, text), text[:200]
    assert merges.decode(ids).decode() == library.decode(ids)


@pytest.mark.parametrize("text", EDGES)
def test_edges_as_the_library(library, merges, text):
    same(library, merges, text)


def test_random_texts_as_the_library(library, merges):
    r = random.Random(3)
    pool = [*"abcdefghinorstuz ,.;:'\"()-_=/<>0123456789\n\t▁éèüß日本의д", "the", "ing", " of", "tion", "▁▁", "    ", "http://", "def ", "return"]
    for _ in range(1500):
        same(library, merges, "".join(r.choice(pool) for _ in range(r.randint(1, 60))))


def test_any_ids_decode_as_the_library_has_them(library, merges):
    r = random.Random(4)
    for _ in range(1500):
        ids = [r.choice([0, 1, 2, *range(3, 259), *range(259, 400), 29871]) for _ in range(r.randint(0, 12))]
        assert merges.decode(ids).decode() == library.decode(ids), ids


def test_each_prefix_has_the_last_piece_of_its_own_encoding(library, merges):
    text = "▁thentioning▁unbelievable▁▁▁x"
    table = merges.table(text)
    for n in range(1, len(text) + 1):
        assert table[n - 1] == merges.part(text[:n])[-1]
        assert "".join(merges.piece[i] for i in merges.part(text[:n])) == text[:n]


def test_the_table_does_not_depend_on_what_was_kept(merges, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 3)
    with open(pieces.MODEL, "rb") as f:
        small = pieces.Merges(f.read())
    for text in [*EDGES, "some words and some words and other words again"]:
        assert small.encode(text) == merges.encode(text)


def test_tables_of_texts(spark, library):
    rows = [(i // 2, t, "x") for i, t in enumerate(EDGES)] + [(None, None, "x"), (None, None, "x"), (7, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = ids_of(library, t or "")
        want.append((i, len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(library.decode(ids).encode())))
    assert sorted(map(tuple, pieces.digests(docs).collect()), key=key) == sorted(want, key=key)
    encoded = pieces.encode(docs)
    assert sorted((r.doc_id is None, r.ids) for r in encoded.collect()) == sorted((i is None, ids_of(library, t or "")) for i, t, _ in rows)
    assert sorted(r.text for r in pieces.decode(encoded).collect()) == sorted((t or "").replace("▁", " ") for _, t, _ in rows)
    assert pieces.digests(docs.where("false")).collect() == []
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_texts_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.digests(docs).collect():
        ids = ids_of(library, texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_another_kind_of_model_is_refused(tmp_path, spark):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.MODEL, "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.Merges(proto.SerializeToString())
