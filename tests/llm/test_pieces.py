"""Merge-type encoding against the library that the model comes from."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lossworks.llm import pieces
from tests.llm import data

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(pieces.read_model(PATH))


def ids_of(model, text):
    raw = model.encode(text)
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]


def texts(rng):
    yield from ["", " ", "   ", "\n", "a", "  a  b ", "\ta\r\n\n b", "a\x00b", "▁x ▁▁", "éé", "<s> <unk> </s> <0x0A>", "中文字 テスト 한국어", "�", "x" * 4000, "=" * 333, " " * 777, "ab" * 900, "\U0001f600‍", "don't 12345.67"]
    letters = ["a", "b", "e", "t", "th", "ing", " ", "  ", "▁", "=", "-", ",", ".", "0", "1", "\n", "é", "ß", "中", "\U0001f600", "́", "x" * 9, "er", "A", "Ñ"]
    for _ in range(400):
        yield "".join(rng.choice(letters) for _ in range(rng.choice((3, 12, 60))))
    for _ in range(200):
        yield "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x3000, 0x9000)))) for _ in range(rng.choice((2, 9, 40))))


def test_same_ids_and_texts(model, library):
    for text in texts(random.Random(3)):
        found = ids_of(model, text)
        assert found == library.encode(text), text
        assert model.decode(found) == library.decode(found), text


def test_pieces_of_the_vocabulary_in_a_row(model, library):
    """Pieces strung together are hardest to cut: the longest one is often wrong."""
    rng = random.Random(5)
    names = [n for n, k in zip(model.names, model.kinds, strict=True) if k == pieces.NORMAL]
    for _ in range(2000):
        text = "".join(rng.choice(names) for _ in range(rng.choice((1, 2, 3, 8))))
        assert ids_of(model, text) == library.encode(text), text


def test_backtracking_reaches_what_merging_gives(model):
    rng = random.Random(6)
    went_back = 0
    for _ in range(3000):
        text = "".join(rng.choice("aeinrst lo") for _ in range(rng.choice((5, 14))))
        found = [model.tokens[i] for i in model.cut(text)]
        assert found == model.merged(text)
        greedy, at = [], 0
        while at < len(text):
            size = next(k for k in range(min(20, len(text) - at), 0, -1) if k == 1 or model.more[model.id.get(text[at : at + k], 0)])
            greedy.append(text[at : at + size])
            at += size
        went_back += greedy != found
    assert went_back > 100  # the longest match alone is wrong this often


def test_decoding_of_any_ids(model, library):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(0, 3), rng.randrange(259, 32000), 28705)) for _ in range(rng.choice((1, 2, 5, 20)))]
        assert model.decode(ids) == library.decode(ids), ids


def test_other_kinds_of_models_fail():
    def put(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    piece = put(1, put(1, b"a"))
    with pytest.raises(ValueError):
        pieces.Model(piece + put(2, bytes([3 << 3, 1])) + put(3, bytes([4 << 3, 0])))
    with pytest.raises(ValueError):
        pieces.Model(piece + put(2, bytes([3 << 3, 2])) + put(3, bytes([4 << 3, 1])))


def test_table(spark, library):
    docs = data.frame(spark, clash=True).withColumn("ids", F.lit("clash"))
    rows = pieces.encoded(docs, PATH).collect()
    assert len(rows) == len(data.documents())
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) and r.size == "clash"
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_query(spark, library, tmp_path):
    import hashlib

    data.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op12(spark, str(tmp_path)).collect()}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = set()
    for doc_id, text, *_ in data.documents():
        ids = library.encode(text or "")
        expected.add((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert found == expected
