"""What the shared encoder asks of the tokenizer."""

from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_and_marks_are_encoded_once_and_without_the_whole_tokenizer(name, monkeypatch):
    path = public_tokenizers.path(name)
    enc, plain = tokens.TextEncoder(path), Tokenizer.from_file(path)
    texts = ["Thoner$$$ to%%% thoner, thoner. thoner###\nthoner (to) %%%", None, "to%%%", "$$$", "é.. x_y don't <|endoftext|> to"]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_all(texts)] == want
    whole, words = [], []
    run, word = enc._whole, enc._word
    enc.pieces.clear()
    monkeypatch.setattr(enc, "_whole", lambda t: whole.append(t) or run(t))
    monkeypatch.setattr(enc, "_word", lambda t: words.append(t) or word(t))
    assert [x.tolist() for x in enc.encode_all(texts[:3])] == want[:3]
    assert all("(to" in t or "%%%" in t for t in whole) and len(whole) <= 2  # before: every word with such marks
    assert words.count(enc.alphabet[32] + "thoner") <= 1 and words.count("$$$") == words.count("###") == 1


def test_texts_of_many_chunks_stay_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 12)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "a b", "", "a  b", "c\nd", "é 漢", "\t", "x" * 40, "a b"]
    got = [x.tolist() for x in tokens.TextEncoder(path).encode_all(texts)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(tokens.TextEncoder(path).encode_all([])) == []
