"""Ids of words by their runs of letters against the whole tokenizer's."""

import numpy as np
from tokenizers import Tokenizer

from runweave.llm import packing

WORDS = "a' a's don't, Å, ŉa! ǅx x~ ~ a| <| a<|b a< é, İa ab-- -- a-b a1. éè!? ʔx ƻa. µ, ªa a…. &&& a&&& a{} ẞ. sS. 漢, word word, word!!".split()


def test_runs_of_letters_have_the_tokenizers_ids():
    path = packing.vocabulary_path()
    coder, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    asked = []
    assert coder.letters is not None
    letters, coder.letters = coder.letters, lambda texts, **k: asked.extend(texts) or letters(texts, **k)
    coder.learn({w.encode() for w in WORDS})
    for w in WORDS:
        assert np.frombuffer(coder.known[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, w
    assert " ".join(asked).split().count("word") == 1 and "don't," not in " ".join(asked)


def test_other_tokenizers_encode_whole_words(tmp_path):
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.normalizer = None
    tokenizer.save(str(tmp_path / "t.json"))
    assert packing.WordEncoder(str(tmp_path / "t.json")).letters is None
