import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestream.llm import bpe
from lodestream.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return bpe.ByteBpe(PATH).open()


def test_lexicon_finds_its_words_only_and_shares_states(tmp_path):
    words = [b"walk", b"walks", b"walking", b"talk", b"talks", b"talking", b"", b"a\x00b"]
    (tmp_path / "f").write_bytes(compile_lexicon([(w, [k, k + 1]) for k, w in enumerate(words)]))
    lexicon = Lexicon(str(tmp_path / "f"))
    for k, w in enumerate(words):
        assert np.frombuffer(lexicon.get(w), "<u4").tolist() == [k, k + 1]
    assert [lexicon.get(w) for w in (b"wal", b"walkings", b"b", b"talk\x00")] == [None] * 4
    assert lexicon.states < 15  # walk and talk share all but their first letters
    (tmp_path / "g").write_bytes(compile_lexicon([]))
    assert Lexicon(str(tmp_path / "g")).get(b"x") is None


def test_encodes_as_the_library_does(library, tables, tmp_path):
    (tmp_path / "f").write_bytes(compile_lexicon([(w.encode(), tables.merge(w.encode())) for w in (" the", " and", "hello")]))
    encoder = bpe.Encoder(tables, Lexicon(str(tmp_path / "f")))
    r = random.Random(7)
    pool = [*map(chr, range(0x250)), " ", "　", "漢", "\U0001f600", "\U0010ffff", "࢏", "<|endoftext|>", "'s", " the", " and", "\n\n", "  "]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(3000)] + ["a" * 3000, "ab" * 500, "", " ", "hello the and"]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        own = encoder.encode(t)
        assert np.frombuffer(own, "<u4").tolist() == ids, t
        assert tables.decode(own) == library.decode(ids, skip_special_tokens=False), t


def test_every_code_point_is_split_as_the_library_does(library, tables):
    """Each assigned or unassigned code point between letters, digits, spaces and marks."""
    split = library.pre_tokenizer.pre_tokenize_str
    for block in range(0, 0x110000, 0x400):
        if not 0xD800 <= block < 0xE000:
            text = "".join(f"a{chr(c)}a 1{chr(c)}1!{chr(c)}! {chr(c)} " for c in range(block, block + 0x400) if c not in (0x3C, 0x7C, 0x3E))
            assert tables.words(text) == [text[a:b] for _, (a, b) in split(text)], hex(block)


def test_refuses_settings_that_it_does_not_know(tmp_path):
    import json

    for change in ({"dropout": 0.1}, {"byte_fallback": True}, {"ignore_merges": True}, {"end_of_word_suffix": "</w>"}):
        spec = json.loads(open(PATH, encoding="utf-8").read())
        spec["model"] |= change
        (tmp_path / "t.json").write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            bpe.ByteBpe(str(tmp_path / "t.json"))


def test_decodes_any_ids_as_the_library_does(library, tables):
    r = random.Random(8)
    for _ in range(2000):
        ids = [r.randrange(50257) for _ in range(5)]
        assert tables.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_over_odd_rows(odd, odd_rows, library):
    out = bpe.encode(odd, PATH, lexicon_words=50, with_ids=True, with_text=True)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    texts = {}
    for i, t, *_ in odd_rows:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[r.id]]
        assert r.ids in want and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.decoded in texts[r.id]
    back = bpe.decode(out.withColumnRenamed("id", "doc_id"), PATH)
    assert sorted(x.decoded for x in back.collect()) == sorted(t for ts in texts.values() for t in ts)


def test_empty_table(none):
    assert bpe.encode(none, PATH).count() == 0


def test_only_texts_with_a_code_point_classed_otherwise_take_the_slow_pattern(library, tables, monkeypatch):
    split = library.pre_tokenizer.pre_tokenize_str
    taken = []
    slow = tables._split
    monkeypatch.setattr(tables, "_split", lambda text: taken.append(text) or slow(text))
    pieces = [chr(c) for c in range(128)] + ["'re", "  ", "é", "漢", "٣"]
    r = random.Random(3)
    texts = [a + b + "x" for a in pieces for b in pieces] + ["".join(r.choices(pieces, k=30)) for _ in range(500)]
    for text in texts:
        assert tables.words(text) == [text[a:b] for _, (a, b) in split(text)], text
    assert not taken
    assert tables.words("a࢏ b") == [("a࢏ b")[a:b] for _, (a, b) in split("a࢏ b")] and len(taken) == 1
