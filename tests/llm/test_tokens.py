"""BPE and rANS against the tokenizers library."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandql.llm import bpe, rans

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_library(text):
    model = bpe.bpe(BYTE)
    want = byte_library.encode(text, add_special_tokens=False).ids
    assert model.encode_batch([text])[0].tolist() == want
    assert model.decode(want) == byte_library.decode(want, skip_special_tokens=False)


def test_bpe_long_piece_and_cache():
    model = bpe.ByteBpe(BYTE, cache_pieces=3)
    texts = ["ab" * 5000, "a b c d e f g", "<|endoftext|><|endoftext|>x", "h i j", ""]
    for t in texts * 2:
        assert model.encode_batch([t])[0].tolist() == byte_library.encode(t, add_special_tokens=False).ids
    assert model.trees.merge_long(b"hello") == np.frombuffer(model.trees.merge([b"hello"])[0], dtype=np.int32).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_word_encoder_equals_library(texts):
    got = rans._encoder(WORD, "<u2").encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in word_library.encode_batch(texts, add_special_tokens=False)]


def library_ids(texts, library=word_library):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_asks_for_each_piece_once(monkeypatch):
    """Words with marks, digits and capitals beside them share their pieces; the library gets no chunk that can be cut."""
    encoder, asked = rans.WordEncoder(WORD, "<u2"), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: asked.extend(words) or learn(words))
    texts = ["word, WORD. (Word) word42,", "12 21 1.2 déjà-VU Déjà ÀÉß straße, a×b", "word's <|endoftext|>, <|ENDOFTEXT|> 日本 e\u0301,", ""]
    assert [x.tolist() for x in encoder.encode(texts)] == library_ids(texts)
    assert sorted(encoder.known.to_pylist()) == sorted(["", "word", ",", ".", "(", ")", "4", "2", "1", "déjà", "-", "vu", "àéß", "straße", *asked])
    assert sorted(asked) == sorted(["a×b", "word's", "<|endoftext|>,", "<|ENDOFTEXT|>", "日本", "e\u0301,"])


LETTERS = ["a", "Z", "é", "É", "ß", "ÿ", "Þ", "ª", "µ", "×", "÷", "ƒ", "İ", "\u212a", "\u0301", "\u0338", "Σ", "7", "½", "٣", "'", "'s", "'ll", "’", "<", "|", "<|endoftext|>", "<|EndOfText|>", "-", "_", "\0", "\x1c", "\u200b", "日", "😀", " ", "\n", "\x85", "\xa0", "\u3000"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LETTERS), max_size=25).map("".join), max_size=5))
def test_word_encoder_cuts_as_the_pattern(texts):
    assert [x.tolist() for x in rans._encoder(WORD, "<u2").encode(texts)] == library_ids(texts)


def test_word_encoder_full_cache(monkeypatch):
    monkeypatch.setattr(rans, "CACHE_WORDS", 6)
    encoder = rans.WordEncoder(WORD, "<u2")
    for texts in (["one two three, don't"], ["two four's five", "six"], ["seven eight nine ten eleven twelve"], ["one one two, twelve don't"], ["two", ""]):
        assert [x.tolist() for x in encoder.encode(texts)] == library_ids(texts)


def test_word_encoder_other_pattern(tmp_path):
    """A vocabulary with steps of its own: chunks stay whole."""
    spec = json.load(open(WORD, encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["ab12cd!?? it's (x)", "Déjà 2024,"]
    got = [x.tolist() for x in rans.WordEncoder(str(path), "<u2").encode(texts)]
    assert got == library_ids(texts, Tokenizer.from_file(str(path))) and got != library_ids(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=5000))
def test_rans_round_trip(ids):
    ids = np.array(ids)
    t = rans.Tables(rans.frequencies(np.bincount(ids, minlength=301)))
    block = rans.encode_block(ids, t) | {"n_ids": len(ids)}
    assert (rans.decode_block(block, t) == ids).all()


def test_rans_checkpoints_and_checksum():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, rans.LANES * rans.STEPS * 3 + 77)
    t = rans.Tables(rans.frequencies(np.bincount(ids, minlength=51)))
    block = rans.encode_block(ids, t) | {"n_ids": len(ids)}
    parts = rans.segments(block)
    assert len(parts) == 4
    words = np.frombuffer(block["payload"], dtype="<u4").astype(np.uint64)
    last = rans.decode_segment(words, *parts[2], parts[3][0], len(ids), t)  # from a checkpoint alone
    assert (last == ids[parts[2][0] * rans.LANES : parts[3][0] * rans.LANES]).all()
    # segments as rows: each decodes by itself, and holds the documents that it meets
    sizes = [1, rans.LANES * rans.STEPS - 1, 5, rans.LANES * rans.STEPS + 9]
    sizes.append(len(ids) - sum(sizes))
    rows = rans.cut(block | {"shard": 0, "shard_start": 0, "doc_ids": [7, 8, 9, 10, 11], "doc_n_ids": sizes})
    assert [r["doc_ids"] for r in rows] == [[7, 8], [9, 10], [10, 11], [11]]
    got = [rans.decode_segment(np.frombuffer(r["words"], dtype="<u4").astype(np.uint64), r["first"], 0, np.frombuffer(r["states"], dtype="<u8"), r["last"], len(ids), t) for r in rows[::-1]]
    assert (np.concatenate(got[::-1]) == ids).all()
    block["payload"] = b"\1\2\3\4" + block["payload"][4:]
    with pytest.raises(ValueError):
        rans.decode_block(block, t)


def test_frequencies_sum():
    for counts in ([1], [5, 0, 3], [1] * 3000 + [10**9], [10**12, 1, 1]):
        f = rans.frequencies(np.array(counts))
        assert f.sum() == 1 << rans.SCALE and ((f > 0) == (np.array(counts) > 0)).all()
    assert rans.frequencies(np.zeros(3)).sum() == 0


def test_bpe_table(docs, no_docs, texts):
    rows = bpe.round_trip(docs, BYTE).collect()
    assert len(rows) == len(texts)
    got = sorted(((r["doc_id"] or 0), r["n_tokens"], r["decoded"]) for r in rows)
    assert got == sorted(((i or 0), len(byte_library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts)
    assert bpe.round_trip(no_docs, BYTE).count() == 0
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), BYTE), BYTE).collect()
    assert all((r["text"] or "") == r["decoded"] for r in both)
    assert all(r["decoded_equal"] for r in bpe.encoded(docs, BYTE).collect())


def test_rans_table(docs, no_docs, texts):
    rows = rans.round_trip(docs, WORD, 2, 49_408).collect()
    ids = {i: np.array([*word_library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts}
    assert len(rows) == len(texts)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert rans.round_trip(no_docs, WORD, 2, 49_408).count() == 0
    back = rans.round_trip(docs.limit(3), WORD, 2, 49_408, what="ids").collect()
    assert all(r["ids"] == ids[r["doc_id"]].tolist() for r in back)


def test_rans_documents_over_segments(spark):
    """Documents longer than a segment, in blocks of several, come back whole."""
    rows = [(i, " ".join(f"w{i * 7 + k % 50}" for k in range(n))) for i, n in enumerate([0, 3, 140_000, 5, 90_000, 1, 200_000])]
    got = {r["doc_id"]: r for r in rans.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), WORD, 2, 49_408).collect()}
    assert len(got) == len(rows) and max(r["n_tokens"] for r in got.values()) > rans.LANES * rans.STEPS
    for i, t in rows:
        ids = np.array([*word_library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_random_unicode():
    random.seed(4)
    texts = ["".join(chr(random.choice([random.randrange(1, 0xD800), random.randrange(0xE000, 0x20000)])) for _ in range(200)) for _ in range(50)]
    assert [x.tolist() for x in bpe.bpe(BYTE).encode_batch(texts)] == [e.ids for e in byte_library.encode_batch(texts, add_special_tokens=False)]
