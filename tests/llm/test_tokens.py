"""Token ids against the tokenizers library, and what is handed to it."""

import random

import numpy as np
from tokenizers import Tokenizer

from seqloom.llm.tokens import TextEncoder, default_tokenizer

END = bytes(4)
BITS = ["a", "the", "The", " ", "  ", "\n", "\n\n", ".", ",", "***", "'s", "é", "ß", "1", "x1", "\t", "%%%", "<|endoftext|>",
        "<|", "|", " ", "日本", "　", "\x1c", "²", "_", "Ⅷ", "don't", "!", "\r\n", "\U0001F600", "\x85", "​"]


def test_ids_equal_those_of_whole_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(14))) for _ in range(4000)] + ["", None, " "]
    whole = Tokenizer.from_file(default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    use = TextEncoder(default_tokenizer())
    got = [x for lo in range(0, len(texts), 500) for x in use.encode(texts[lo:lo + 500], END)]
    assert got == [np.array(e.ids, "<u4").tobytes() + END for e in whole]


class Watched:
    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_known_letters_and_marks_are_not_encoded_again():
    use = TextEncoder(default_tokenizer())
    use.encode(["a onthe*** of&&\nThe", "The"], END)
    use.tokenizer = Watched(use.tokenizer)
    text = "a onthe&&\nThe*** of*** onthe of\nThe"
    assert use.encode([text], END) == [
        np.array(use.tokenizer.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + END]
    assert not use.tokenizer.asked
