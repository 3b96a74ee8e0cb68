"""Encode and decode whole texts with a given word-level BPE vocabulary.

The vocabulary file is read on the driver from a path that the caller names and
sent to the workers once (1.7 MB).  A batch is cut into distinct words in Arrow
(``distinct.py``); those that are more than letters and punctuation are split at special
tokens, normalised and cut as the file says.  The words that a worker has not
seen lately are merged together: each word is a row of a rank array that holds its
parts and, next to each, the rank of merging it with the part to its right.  One
step takes the smallest rank of every row, deletes that boundary and looks up the
two ranks beside it.  Words too long for that use the same rule with a heap.

Null text is encoded like empty text: no ids.  Very long texts are a batch of their own.
Repeated rows are encoded alike; there is nothing to tie.  An empty table gives an empty
result.  Bytes that are not UTF-8 count as U+FFFD.  Columns to keep travel as
``k_<name>``, so they may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from plumbline.llm.distinct import DistinctWords
from plumbline.llm.text import map_texts

#: Words of up to so many bytes are merged in the rank array.
SHORT = 64
#: Words per rank array, and encoded words that a worker remembers.
ROWS, REMEMBERED = 4096, 250_000
NEVER = np.int32(2**31 - 1)

# Where the Unicode tables of the two regular expression engines and of Python differ.
#: Code points that the vocabulary's own engine does not count as letters, although newer tables do.
NOT_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA
18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96
1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: The same for numbers.
NOT_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: First and last capital and the first small letter, where Python knows no lower case yet.
NEWER_CAPITALS = """
1C89-1C89:1C8A A7CB-A7CB:264 A7CC-A7CC:A7CD A7CE-A7CE:A7CF A7D2-A7D2:A7D3 A7D4-A7D4:A7D5 A7DA-A7DA:A7DB
A7DC-A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB
"""


def _ranges(text: str) -> str:
    """A character class of hexadecimal code points and ranges."""
    ends = [(part.split("-")[0], part.split("-")[-1]) for part in text.split()]
    return "".join(f"\\U{a:0>8}-\\U{b:0>8}" for a, b in ends)


def _newer_capitals() -> dict[int, int]:
    out = {}
    for part in NEWER_CAPITALS.split():
        first, last, small = (int(x, 16) for x in part.replace("-", ":").split(":"))
        out.update({c: small + c - first for c in range(first, last + 1)})
    return out


LOWER = _newer_capitals()
NEWER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file with an end-of-word suffix, ready to encode and decode."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only BPE vocabularies with an end-of-word suffix and no decoder are supported")
        self.form, self.blank, self.lower = self._normalizer(spec["normalizer"])
        self.words = self._word_pattern(spec["pre_tokenizer"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ordered = sorted(added, key=len, reverse=True)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = token
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _normalizer(spec: dict):
        steps = [s["type"] for s in spec["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer {steps}")
        replace = spec["normalizers"][1]
        return "NFC", (regex.compile(replace["pattern"]["Regex"]), replace["content"]), True

    @staticmethod
    def _word_pattern(spec: dict):
        split = spec["pretokenizers"][0]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("unknown pre-tokenizer")
        pattern = split["pattern"]["Regex"]
        classes = ((r"[\p{L}]", "L", NOT_LETTERS), (r"[\p{N}]", "N", NOT_NUMBERS))
        for old, kind, without in classes:
            pattern = pattern.replace(old, rf"[\p{{{kind}}}--[{_ranges(without)}]]")
        both = _ranges(NOT_LETTERS + NOT_NUMBERS)
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{both}]]")
        return regex.compile(pattern, regex.V1)

    def normalise(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize(self.form, text)
        text = self.blank[0].sub(self.blank[1], text)
        if not text.isascii() and NEWER.search(text):
            text = text.translate(LOWER)
        # Lower case is taken letter by letter: a final sigma stays an ordinary one.
        return text.lower() if "Σ" not in text else "σ".join(p.lower() for p in text.split("Σ"))

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of text and special tokens (True), in order."""
        if not self.special or "<" not in text:
            return [(text, False)]
        return [(p, p in self.added) for p in self.special.split(text) if p]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of similar length; one row of the rank array per word."""
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        at = np.arange(width)
        ids = np.where(at < lengths[:, None] - 1, self.inner[flat], self.last[flat])
        ranks = np.full((len(words), width), NEVER)
        pairs = at[:-1] < lengths[:, None] - 1
        ranks[:, :-1][pairs] = self.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        done = np.zeros(len(words), object)
        row = np.arange(len(words))
        while len(row):
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(row)), best]
            ended = lowest == NEVER
            for i in np.flatnonzero(ended):
                done[row[i]] = ids[i, : lengths[i]].astype("<u4").tobytes()
            if ended.any():
                go = ~ended
                row, ids, ranks, lengths, best, lowest = row[go], ids[go], ranks[go], lengths[go], best[go], lowest[go]
            if not len(row):
                break
            r = np.arange(len(row))
            take = np.minimum(at[:width] + (at[:width] > best[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ranks = np.take_along_axis(ranks, take, axis=1)
            ids[r, best] = self.merged[lowest]
            lengths = lengths - 1
            ranks[r, best] = NEVER
            ranks[r, lengths - 1] = NEVER
            right = best + 1 < lengths
            ranks[r[right], best[right]] = self.rank(ids[r[right], best[right]], ids[r[right], best[right] + 1])
            left = best > 0
            ranks[r[left], best[left] - 1] = self.rank(ids[r[left], best[left] - 1], ids[r[left], best[left]])
        return list(done)

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.inner[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        first = self.rank(ids[:-1], ids[1:])
        part = ids.tolist()
        n = len(part)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        now = first.tolist() + [int(NEVER)]
        heap = [(rank, i) for i, rank in enumerate(now) if rank != NEVER]
        heapq.heapify(heap)

        def refresh(i: int) -> None:
            j = after[i]
            now[i] = int(self.rank(np.array([part[i]]), np.array([part[j]]))[0]) if j < n else int(NEVER)
            if now[i] != NEVER:
                heapq.heappush(heap, (now[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or now[i] != rank:
                continue
            j = after[i]
            part[i] = int(self.merged[rank])
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        return np.array([p for p, live in zip(part, alive) if live], "<u4").tobytes()

    def merged_words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of normalised words."""
        coded = sorted(((w, w.encode()) for w in new), key=lambda x: len(x[1]))
        short = [x for x in coded if len(x[1]) <= SHORT]
        found: dict[str, bytes] = {}
        for k in range(0, len(short), ROWS):
            part = short[k : k + ROWS]
            found.update(zip([w for w, _ in part], self._merge_rows([b for _, b in part])))
        return found | {w: self._merge_long(b) for w, b in coded[len(short) :]}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found: list[list] = []
        for text in texts:
            parts: list = []
            for piece, special in self.pieces(text):
                parts.append(self.added[piece] if special else self.words.findall(self.normalise(piece)))
            found.append(parts)
        used = set().union(*[p for parts in found for p in parts if isinstance(p, list)])
        new = used - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = used
        self.known |= self.merged_words(list(new))
        of = self.known.__getitem__
        return [
            b"".join(b"".join(map(of, p)) if isinstance(p, list) else np.array([p], "<u4").tobytes() for p in parts)
            for parts in found
        ]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class RankIds(DistinctWords):
    """Ids of texts by rank arrays over their new pieces."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        super().__init__()

    def of_pieces(self, new: list[str]) -> list[bytes]:
        found = self.bpe.merged_words(new)
        return [found[p] for p in new]

    def of_words(self, new: list[str]) -> list[bytes]:
        return self.bpe.encode_batch(new)


@lru_cache(maxsize=2)
def _tokenizer(content: str) -> RankIds:
    return RankIds(WordBpe(content))


def encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids`` (array of bigint) and ``decoded`` of every text.

    ``vocabulary`` is the path of the tokenizer file on the driver.
    """
    return _run(docs, vocabulary, keep, text, digests=False)


def encode_digests(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 of ids (little-endian, 32 bits) and of the decoded text instead of both."""
    return _run(docs, vocabulary, keep, text, digests=True)


def _run(docs: DataFrame, vocabulary: str, keep: tuple[str, ...], text: str, digests: bool) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    outputs = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"

    def run(batch) -> dict:
        ranks = _tokenizer(content.value)
        coded = ranks.encode(batch.column("_text"))
        decoded = coded.decoded(ranks.bpe.tokens)
        out = {f"k_{c}": batch.column(f"k_{c}") for c in keep} | {"n_tokens": np.diff(coded.stops, prepend=0)}
        if digests:
            out["ids_sha256"] = [hashlib.sha256(coded.of(i).tobytes()).hexdigest() for i in range(len(coded))]
            out["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
        else:
            out["ids"] = [coded.of(i).astype(np.int64) for i in range(len(coded))]
            out["decoded"] = decoded
        return out

    given = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs[text].alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), "n_tokens bigint", outputs])
    coded = map_texts(given, "_text", run, schema)
    return coded.withColumnsRenamed({f"k_{c}": c for c in keep})

