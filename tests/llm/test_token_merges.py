"""Pieces are merged together, with the library's ids."""

import os
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from citeflow.llm import tokens
from citeflow.llm.queries import tokenizer_path

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no tokenizers")


def agree(tok, texts):
    got = tok.encode_many(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [tok.full.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_words_are_not_encoded_one_by_one():
    """20,000 different words: only a piece of 80 bytes goes through the model singly."""
    tok, rng, singly = tokens.WordTokenizer(tokenizer_path()), random.Random(5), []
    words = ["".join(rng.choices(["th", "er", "in", "qu", "on", "e", "s", "é"], k=rng.randrange(2, 9))) for _ in range(20_000)]
    model = tok.model
    tok.model = SimpleNamespace(tokenize=lambda p: singly.append(p) or model.tokenize(p))
    agree(tok, [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)] + ["the " + "ab" * 40])
    assert len(singly) == 1


def test_pieces_against_the_library():
    """Endings after signs, digits, letters and each other; pieces around the longest that is merged; equal pairs in a row."""
    tok, rng = tokens.WordTokenizer(tokenizer_path()), random.Random(6)
    agree(tok, ["".join(rng.choices("'''strevldmSLa1.é² ", k=rng.randrange(1, 30))) for _ in range(5000)])
    agree(tok, [c * n for c in ("a", "é", "an", "'", ".'ll", "'s", "1", "in") for n in range(1, 70)])
    agree(tok, [])
    agree(tok, [None, "", " ", "\n \t", "'", "x"])


def test_few_pieces_at_once(monkeypatch):
    """Borders of what is merged together, with long pieces between."""
    monkeypatch.setattr(tokens, "MERGED_PIECES", 3)
    tok, rng = tokens.WordTokenizer(tokenizer_path()), random.Random(7)
    agree(tok, [" ".join("".join(rng.choices("abcdeé", k=rng.choice((1, 2, 5, 31, 32, 33, 80)))) for _ in range(rng.randrange(20))) for _ in range(60)])
