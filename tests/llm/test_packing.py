"""The ids of packing against the tokenizer itself, and what goes through its pre-tokenizer."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from lexgrove.llm import packing

PARTS = [" ", " ", "\n", "\n", "\t", "\r", "\xa0", "\xa0", "\u3000", "a", "b", "Hello", "the", "é", "日本", "я", "ǅ", "ʰ", "\u0301", "1", "²", "'", "'s", "'ll", ",", ".", "###", "|", "-", "_", "\U0001f642", "�", "\x1c", "\x00", "<|endoftext|>", "<|"]
LETTERS = "abcdefghijklmnopqrstuvwxyzéü"


def odd_texts(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def assert_same(encode, tokenizer, texts):
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_where_a_token_spans_white_space(exact):
    """The file has a token of a space, U+00A0, a space and U+00A0."""
    assert_same(packing.Encoder(), exact, ["x" + " \xa0" * n + end for n in range(1, 9) for end in ("", "y", " y", "\ny")])


def test_ids_of_odd_texts(exact):
    rng = random.Random(8)
    texts = odd_texts(rng, 4000) + [t for c in map(chr, range(0x600)) for t in (f"x a{c}a b", f"x\n{c}a, y", f"x a{c}, y", f"{c}a.", f"a\n\n{c}b", f"a\n{c}\n{c}\n b{c}")]
    assert_same(packing.Encoder(), exact, [*texts, *texts[:2000]])
    assert_same(packing.Encoder(most=3000), exact, [*texts[:3000], *texts[:3000]])  # forgets again and again


def test_ids_of_other_files(tmp_path):
    """Tokens that span spaces and newlines, and a pre-tokenizer of another kind."""
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("Ġ", "Ġ"), ("Ċ", "Ġ"), ("Ċ", "Ċ"), ("ĉ", "Ċ"), ("Ġ", "a"), ("ĠĠ", "Ġ"), ("a", "b"), (".", ".")]
    vocab = {t: i for i, t in enumerate([*alphabet, *map("".join, merges)])}
    for k, kind in enumerate([pre_tokenizers.ByteLevel(add_prefix_space=False), pre_tokenizers.ByteLevel(add_prefix_space=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]):
        other = Tokenizer(models.BPE(vocab, merges))
        other.pre_tokenizer = kind
        other.save(path := str(tmp_path / f"{k}.json"))
        assert_same(packing.Encoder(path), other, odd_texts(random.Random(k), 1500))


def test_words_of_letters_and_marks_need_no_pre_tokenizer(exact, monkeypatch):
    """New words are most of what packing does; the whole tokenizer takes several times as long for one as the model alone."""
    taken = []

    class Counted:
        def __init__(self, of):
            self.of = of

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def __getattr__(self, name):
            value = getattr(self.of, name)
            return (lambda x, **more: taken.extend([x] if isinstance(x, str) else x) or value(x, **more)) if name.startswith("encode") else value

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    rng = random.Random(2)
    new = lambda: "".join(rng.choice(LETTERS) for _ in range(9))
    text = "".join(new() + rng.choice([" ", " ", ", ", ".\n", "%%% ", "\n", ",### ", "\n\n"]) for _ in range(3000))
    assert_same(packing.Encoder(), exact, [text, text])
    assert sum(map(len, taken)) < 0.01 * len(text)
