"""The packing's dynamic program beside exhaustive search, and its word cache beside the tokenizer."""

import itertools
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from geomosaic.llm import packing


def cost_of(ends, length, places, penalty, window):
    """What a choice of window ends costs; None where a window is too long."""
    price, total, begin = dict(zip(places, penalty)), 0, 0
    for e in ends:
        n = e - begin
        if n > window:
            return None
        exact = n >= packing.LEAST_POWER and n.bit_count() == 1
        total += (0 if exact or n == window else window - n) + (0 if e == length else price.get(e, packing.HARD_CUT))
        begin = e
    return total


def test_cuts_cost_what_the_best_choice_costs(monkeypatch):
    monkeypatch.setattr(packing, "LEAST_POWER", 4)
    rng = random.Random(4)
    for _ in range(120):
        length = rng.randrange(20, 70)
        places = sorted({*rng.sample(range(1, length), min(length - 1, 9)), length})
        places = sorted({*places, *range(12, length, 12)})  # so that no hard cut is needed
        penalty = [rng.choice([0, 3, 16]) for _ in places]
        found = packing.cuts(length, np.array(places), np.array(penalty), 16)
        assert found[-1] == length and found == sorted(found)
        inner = places[:-1]
        least = min(c for k in range(len(inner) + 1) for some in itertools.combinations(inner, k) if (c := cost_of([*some, length], length, places, penalty, 16)) is not None)
        begin = [0, *found[:-1]]
        # the tail's cuts into powers of two may stand anywhere, so the found choice can only be better than the search's
        price = dict(zip(places, penalty))
        got = 0
        for a, e in zip(begin, found):
            n = e - a
            assert 0 < n <= 16
            got += (0 if n.bit_count() == 1 else 16 - n) + (0 if e == length else price.get(e, packing.HARD_CUT))
        assert got <= least


def test_the_cache_may_forget(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 60)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tok = packing.WordIds(path), Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = random.Random(5)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", ",\n", "!", " "]) for _ in range(40)) for _ in range(3)] + ["", "\n", " "]
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        got = own.ids(texts)
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in got] == want
        for t, (i, ends) in zip(texts, got):
            assert len(ends) == 0 or ends[-1] <= len(i) // 4
        assert len(own.parts.size) < 60 + 200


def test_a_word_is_learnt_once_whatever_its_case_and_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tok = packing.WordIds(path), Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    text = "Élan, élan. ÉLAN!\nélan élan," + " Élan"
    got = own.ids([text])
    assert np.frombuffer(got[0][0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(own.parts.size) == 5  # the empty part, the word and three marks


def test_parts_give_the_tokenizers_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tok = packing.WordIds(path), Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = random.Random(6)
    some = ["a", "Z", "É", "é", "ß", "×", "'", "s", "'re", "H\u0331", "K\u0301", "É\u0301", "1", "日", "\u0301", "\u212a", "İ", " ", "\n", "\t", "\u00a0", ".", ",", "!?", "_", "<|endoftext|>"]
    for _ in range(40):
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(100)]
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in own.ids(texts)] == want
