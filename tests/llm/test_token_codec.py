import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strikelens.llm import token_codec as codec
from strikelens.llm.common import shared_folder

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_word_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    texts = ["", " ", "a  b", " a", "a ", "a \n b", "x\n y", "<|endoftext|>", "a <|endoftext|> b", "don't.. we'll, x", "　a b"]
    texts += ["".join(rng.choices(" ab1.,\n\t's é字　", k=rng.randrange(16))) for _ in range(4000)]
    for _ in range(2):  # the second time from memory
        for text, raw in zip(texts, codec.WordIds(FILE).encode(texts), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000, 70_000, 200_000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
    freq = codec.quantized(np.bincount(ids, minlength=50_257), 20)
    assert freq.sum() == 1 << 20 and (freq[np.unique(ids)] > 0).all()
    coder = codec.Coder(freq, 20)
    block = coder.encode(ids)
    assert (coder.decode(block, n) == ids).all()
    last = len(block["states"]) - 1  # a checkpoint decodes without what comes before it
    tail = coder.decode_from(block, n, last)
    assert (tail == ids[n - len(tail) :]).all()


def test_a_damaged_block_is_noticed():
    ids = np.arange(5000) % 97
    coder = codec.Coder(codec.quantized(np.bincount(ids, minlength=100), 16), 16)
    block = coder.encode(ids)
    block["words"] = block["words"][:400] + b"\0\1\2\3" + block["words"][404:]
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(block, 5000)


def test_stored_corpus(spark, odd, empty, tokenizer, monkeypatch):
    path = shared_folder(spark, "corpus")
    codec.write_corpus(odd, path, FILE, 2)
    rows = codec.read_corpus(spark, path).orderBy("start").collect()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    at = 0
    for row, (named, doc_id, text) in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert row.doc_id == (doc_id if named else None)
        assert (row.start, row.n_tokens, row.ids) == (at, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    path = shared_folder(spark, "corpus")
    codec.write_corpus(empty, path, FILE, 2)
    assert codec.read_corpus(spark, path).count() == 0


def test_words_by_the_model_equal_the_tokenizer(tokenizer):
    """Latin letters, others, signs behind letters, apostrophes and line breaks."""
    rng = random.Random(2)
    letters = [chr(c) for c in range(0x180, 0x260) if chr(c).isalpha()] + list("ªºµßéñÿœſɐʰλж漢٣²½")
    pieces = ["the", "ing", "Th", "tion", "éa", "ß", "'s", "'", "###", "$", "!!", ".", ",", "\n", "\n", "\t", " ", " ", " ", " ", "7", "_", "\\", "<|", "\x85", "́"]
    texts = ["".join(rng.choices(pieces + rng.sample(letters, 4), k=rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(rng.choices(letters, k=9)) + " " + "".join(rng.choices(letters, k=9)) + "!\n" + "".join(rng.choices(letters, k=5)) for _ in range(500)]
    words = codec.WordIds(FILE)
    for lo in (*range(0, len(texts), 500), 0):  # the last time from memory
        for text, raw in zip(texts[lo : lo + 500], words.encode(texts[lo : lo + 500]), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_byte_has_its_sign(tokenizer):
    signs = codec._byte_signs()
    for text in ["".join(map(chr, range(32, 0x250))), "".join(map(chr, range(32))), "漢字𝒳"]:
        told = "".join(t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text))
        assert text.encode().decode("latin-1").translate(signs) == told


def test_line_breaks_and_signs_make_no_new_words():
    """Two sides of a line break, and a word and its signs, are learned apart."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdeé", k=6)) for _ in range(60)]
    words = codec.WordIds(FILE)
    words.encode([" ".join(["x"] + [f"{a}###\n{b}" for a in names for b in names])])
    assert len(getattr(words, "known", words)) <= 4 * len(names)
