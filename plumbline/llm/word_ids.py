"""Token ids by the tokenizers library, piece by piece (``distinct.py``).

New pieces go through the bare model, many to a call, and are told apart by the mark of
a word's end; other new words go through the whole tokenizer.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from plumbline.llm.bpe import byte_characters
from plumbline.llm.distinct import DistinctWords

#: Pieces that the library gets as one text.
TOGETHER = 512


class WordIds(DistinctWords):
    """Ids as the library gives them without special tokens around, truncation and padding."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_str(content)
        self.whole.no_padding()
        self.whole.no_truncation()
        suffix = self.whole.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the tokenizer does not mark the ends of words")
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = {b: c for b, c in enumerate(byte_characters()) if b != 0x20}
        super().__init__()

    def of_words(self, new: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(new, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def of_pieces(self, new: list[str]) -> list[bytes]:
        parts = (" ".join(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER))
        texts = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)])
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(new):
            raise ValueError("the tokenizer does not mark the end of every word")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops)]


@lru_cache(maxsize=2)
def word_ids(content: str) -> WordIds:
    return WordIds(content)
