"""What the word encoder remembers."""

import numpy as np
from tokenizers import Tokenizer

from convolens.llm.tokens import MEMORY, WordIds, vocabulary


def test_a_plain_word_is_remembered_once():
    path = vocabulary("word_bpe_49k.json")
    words, library = WordIds(path), Tokenizer.from_file(path)
    texts = [" ".join(f"{a}{b}word" for a in "abcde" for b in "xyzüß"), "It's THE Straße, isn't it? 12a ab_c ÉTÉ\x7f!!"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text), "<u4").tolist() == want
    assert not any(w in words.pieces for w in texts[0].split())
    assert words.words.most + words.pieces.most <= MEMORY + MEMORY // 2
