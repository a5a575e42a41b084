"""The chunk encoder against the tokenizers library itself."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ontoloom.llm import tokens

PARTS = ["a", "B", "é", "é", " ", "\n", "\t", ".", ",", "!", "'s", "1", "İ", "Σ", "ｆ", "\x00", "Ġ", "-", "wednesday", "'ll"]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoded_equals_library(name, spaces):
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "<|endoftext|> x", "x <|endoftext|> y", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|", "I'LL wait, don't. ŉ ß ẞ", "中文 字\r\nx", "\na\n\nb  c", "word " * 5000]
    texts += [f"q{chr(c)} {chr(c)}q{chr(c)}, {chr(c)}" for c in range(0x21, 0x260)]
    texts += ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(1500)]
    path = tokens.default_path(name)
    library = Tokenizer.from_file(path)
    ids, at = tokens.encoded(pa.array(texts, pa.string()), path, spaces)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
        assert ids[at[i] : at[i + 1]].tolist() == want, text


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_small_cache_changes_nothing(name, spaces, monkeypatch):
    """Generations turn at every call; results stay, and the cache holds what one call meets at most."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1000)
    rng = random.Random(5)
    path = tokens.default_path(name)
    library = Tokenizer.from_file(path)
    encoder = tokens.ChunkEncoder(path, spaces)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(30)} word{rng.randrange(999)}" for _ in range(40)) for _ in range(3)]
        for text, raw in zip(texts, encoder.encode(texts), strict=True):
            assert raw == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
        assert len(encoder._cache) < 400 and len(encoder._old) < 400


def test_no_rows():
    ids, at = tokens.encoded(pa.array([], pa.string()), tokens.default_path("byte_bpe_50k.json"), True)
    assert len(ids) == 0 and at.tolist() == [0]
