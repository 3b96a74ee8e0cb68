"""Token ids of a batch of texts from those of its distinct pieces.

For tokenizers that drop white space and mark the ends of words: no id spans a blank, so
the ids of a text are those of its words.  A batch is cut into words, and these into
distinct ones, in Arrow.  A word that is letters of Latin-1 and then punctuation is two
pieces, the letters in lower case and the tail.  How a new piece, or a new word of any
other kind, is encoded is up to the class that does it; their ids are remembered, and
those of a batch are put together by one gather.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.text import REMEMBERED

#: Punctuation that makes one piece behind letters; an apostrophe may begin a piece of its own, "<|" a special token.
TAIL = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_TAIL = "[" + "".join(f"\\{c}" for c in TAIL) + "]"


@dataclass
class Encoded:
    """Ids of texts behind one another, where those of each text stop, and the pieces that they come from."""

    ids: np.ndarray
    stops: np.ndarray
    table: list[bytes]
    used: np.ndarray
    used_stops: np.ndarray

    def of(self, text: int) -> np.ndarray:
        return self.ids[self.stops[text - 1] if text else 0 : self.stops[text]]

    def __len__(self) -> int:
        return len(self.stops)

    def decoded(self, tokens: list[str]) -> list[str]:
        """The tokens of each text, joined by blanks."""
        strings = [" ".join(map(tokens.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in self.table]
        of, used = strings.__getitem__, self.used.tolist()
        starts = [0, *self.used_stops[:-1].tolist()]
        return [" ".join(map(of, used[a:b])) for a, b in zip(starts, self.used_stops.tolist())]


class DistinctWords:
    """Encodes texts by their distinct pieces; subclasses encode those."""

    def __init__(self):
        #: Ids of pieces, and of words as they are.
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        # Another tokenizer may cut or fold letters in its own way; then all words go the long way.
        self.by_pieces = True
        letters = [chr(c) for c in range(0x100) if chr(c).isalpha()]
        trial = [a + b + t for a, b in zip(letters, letters[::-1]) for t in ("", ",", "?!", TAIL)]
        found = self.encode(pa.array(trial))
        self.by_pieces = [found.of(i).tobytes() for i in range(len(trial))] == self.of_words(trial)

    def of_pieces(self, new: list[str]) -> list[bytes]:
        """Ids of distinct pieces: small letters of Latin-1, or punctuation."""
        raise NotImplementedError

    def of_words(self, new: list[str]) -> list[bytes]:
        """Ids of distinct words of any kind."""
        raise NotImplementedError

    @staticmethod
    def _remembered(known: dict[str, bytes], wanted: list[str], learn) -> list[bytes]:
        new = [w for w in wanted if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            known[""] = b""
            new = [w for w in wanted if w]
        if new:
            known.update(zip(new, learn(new)))
        return [known[w] for w in wanted]

    def _table(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct pieces, and for each of some distinct words the places of its two."""
        simple = pc.match_substring_regex(words, f"^[{_LETTERS}]*{_TAIL}*$").to_numpy(zero_copy_only=False) & self.by_pieces
        places = np.zeros((len(words), 2), np.int64)
        short = words.filter(pa.array(simple))
        heads = pc.utf8_lower(pc.replace_substring_regex(short, f"{_TAIL}+$", "")).dictionary_encode()
        tails = pc.replace_substring_regex(short, f"^[{_LETTERS}]+", "").dictionary_encode()
        ids = [b""]
        for column, found in enumerate((heads, tails)):
            places[simple, column] = found.indices.to_numpy() + len(ids)
            ids += self._remembered(self.pieces, found.dictionary.to_pylist(), self.of_pieces)
        others = words.filter(pa.array(~simple)).to_pylist()
        places[~simple, 0] = np.arange(len(others)) + len(ids)
        return ids + self._remembered(self.words, others, self.of_words), places

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of all texts; nulls are empty, malformed bytes become replacement characters."""
        lists = pc.ascii_split_whitespace(pc.fill_null(_as_text(texts), ""))
        found = lists.flatten().dictionary_encode()
        words_to = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        table, places = self._table(found.dictionary)
        flat, sizes = np.frombuffer(b"".join(table), "<u4"), np.array([len(i) // 4 for i in table], np.int64)
        used = places[found.indices.to_numpy()].ravel()
        filled = sizes[used] > 0
        used_stops = np.r_[0, np.cumsum(filled)][2 * words_to]
        used = used[filled]
        n = sizes[used]
        ends = np.cumsum(n)
        starts = (np.cumsum(sizes) - sizes)[used]
        ids = flat[np.repeat(starts - (ends - n), n) + np.arange(int(n.sum()))]
        return Encoded(ids, np.r_[0, ends][used_stops], table, used, used_stops)


def _as_text(texts: pa.Array) -> pa.Array:
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())
