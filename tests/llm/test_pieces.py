import hashlib
import pickle
import random

import public_tokenizers
import pytest
import sentencepiece

from lodestream.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def tables():
    return pickle.loads(pickle.dumps(pieces.Pieces(PATH))).open()


def test_encodes_as_the_library_does(library, tables):
    r = random.Random(7)
    pool = [*map(chr, range(0x250)), " ", "▁", "　", "漢", "\U0001f600", "\U0010ffff", "<s>", "<0x41>", "  ", "\n\n", "the", "▁▁", "﻿"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(50))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 500, "", " ", " " * 1000, "▁" * 99, "\x00", "word " * 5000, "x" * 40_000]
    found = [pieces.Encoder(tables).encode(t) for t in texts[:50]]
    encoder = pieces.Encoder(tables)
    assert [encoder.encode(t) for t in texts[:50]] == found  # the memo changes nothing
    found = [encoder.encode(t) for t in texts]
    pieces.compare(library, texts, [f[0] for f in found], [f[2] for f in found])
    assert [f[1] for f in found] == [len(library.encode(t)) for t in texts]


def test_memo_is_bounded_and_changes_nothing(library, tables, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 8)
    encoder, r = pieces.Encoder(tables), random.Random(1)
    for _ in range(300):
        text = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(9)) for _ in range(9))
        assert encoder.encode(text)[0] == ",".join(map(str, library.encode(text)))
        assert len(encoder) <= 5


def test_decodes_any_ids_as_the_library_does(library, tables):
    r = random.Random(3)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3), 259, 31_000]) for _ in range(r.randrange(8))]
        assert tables.decode(ids) == library.decode(ids), ids


def test_lists_and_heaps_are_one_agenda(tables, monkeypatch):
    r = random.Random(9)
    chunks = ["".join(r.choice(["a", "b", "th", "e", "▁", "ing", "é", "漢", "er", "on"]) for _ in range(r.randrange(25))) for _ in range(2000)]
    want = [tables.merge(c) for c in chunks]
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [tables.merge(c) for c in chunks] == want


def test_equal_scores_are_merged_from_the_left(tables):
    """Pieces of several marks share one score: the leftmost pair goes first."""
    assert [tables.pieces[k] for k in tables.merge("▁" * 3)] == ["▁▁▁"]
    assert tables.merge("") == []


def test_batches_that_differ_from_the_library_fail(spark, tables, library):
    found = pieces.Encoder(tables).encode("some words")
    with pytest.raises(pieces.Differs):
        pieces.compare(library, ["some words"], [found[0] + ",5"], [found[2]])
    with pytest.raises(pieces.Differs):
        pieces.compare(library, ["some words"], [found[0]], [found[2] + " "])


def test_refuses_models_that_it_does_not_know(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as f:
        model = f.read()

    def refused(change):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        change(proto)
        (tmp_path / "m").write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            pieces.Pieces(str(tmp_path / "m"))

    refused(lambda p: setattr(p.trainer_spec, "model_type", p.trainer_spec.UNIGRAM))
    refused(lambda p: setattr(p.normalizer_spec, "remove_extra_whitespaces", True))
    refused(lambda p: setattr(p.pieces[300], "type", 4))


def test_operator_on_odd_rows(spark, odd, odd_rows, none, library):
    got = pieces.encode(odd, PATH, with_ids=True, with_text=True).collect()
    assert len(got) == len(odd_rows)

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), ids))
    assert sorted(((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got), key=str) == sorted(want, key=str)
    back = pieces.decode(spark.createDataFrame([(1, got[0].ids), (2, None), (3, [])], "doc_id long, ids array<int>"), PATH)
    assert {r.id: r.decoded for r in back.collect()} == {1: got[0].decoded, 2: "", 3: ""}
    assert pieces.encode(none, PATH).count() == 0


def test_a_wrong_vocabulary_does_not_pass_the_check(library):
    other = pieces.Pieces(PATH)
    del other.rank["▁the"]
    found = pieces.Encoder(other).encode("the end")
    with pytest.raises(pieces.Differs):
        pieces.compare(library, ["the end"], [found[0]], [found[2]])
