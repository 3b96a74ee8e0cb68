"""Remove passages that occur earlier in the corpus, with an FM-index per shard.

A window is ``WINDOW`` consecutive words.  Every window has an anchor: of the
``GRAM``-word stretches inside it the one with the smallest hash, the leftmost if
equal.  Consecutive windows with the same anchor form a segment.  Equal windows
have equal anchors, so shards made of anchors see all that can match:

1. Anchors are dealt by hash and sorted; only anchors that occur twice go on, and
   those of more than ``RUN`` occurrences are marked.  Anchors that are frequent in
   a sample are marked and sent past this step, so no task gets a hot one.
2. Documents meet their repeated anchors and cut out these segments.  A marked
   anchor's segments are cut further into single windows and dealt by the hash of
   the window, so what stays together is equal or short.  Equal segments of a batch
   travel once.
3. A shard is a run of anchors of bounded size.  Its different segments are put in
   a compressed FM-index, and all of them are streamed through it by backward
   search.  Matching statistics of ``WINDOW`` words give the suffix interval of each
   window and in it the earliest place in the corpus.
4. Documents drop the words of windows that start earlier elsewhere.

Where a sequence starts is ``(doc_id, word)``; null ids come last and count as one
id, as do repeated ids: of two rows with one id neither is earlier than the other at
the same word.  Null or empty text has no words; very long texts are read whole, a
batch of their own; an empty table gives an empty result.  Words are compared byte by
byte, hashes only deal them out.  Only ``doc_id`` and ``text`` are looked at, and other
columns travel as one struct, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh32_intdigest

from plumbline.llm.fmindex import FMIndex
from plumbline.llm.text import WordHashes, map_texts, words

WINDOW, GRAM = 20, 10
#: Occurrences of an anchor from which its windows are dealt one by one.
RUN = 2048
#: Documents in the sample, occurrences in it that make an anchor frequent, and frequent anchors at most.
SAMPLE_ONE_IN, HOT_LEAST, HOT_KEYS = 64, 64, 20_000
#: Words in an index.
SHARD_WORDS = 400_000
KEY_BITS = 48
MARK = 1 << 50
LAST = (1 << 63) - 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Segments:
    """Segments of a batch of texts: document, key, first word and number of windows."""

    def __init__(self, texts: list[list[bytes]], hashes: WordHashes, window: int, gram: int):
        counts = np.array([len(t) for t in texts], np.int64)
        total = int(counts.sum())
        flat = np.concatenate([hashes.of(t) for t in texts]) if total else np.empty(0, np.uint64)
        n = total - window + 1
        if n <= 0:
            self.doc = self.key = self.start = self.windows = np.empty(0, np.int64)
            return
        grams = flat[: total - gram + 1].copy()
        for k in range(1, gram):
            grams *= MULTIPLIER
            grams += flat[k : total - gram + 1 + k]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        span = window - gram + 1
        least = grams[:n].copy()
        for k in range(1, span):
            np.minimum(least, grams[k : n + k], out=least)
        place = np.zeros(n, np.int64)
        for k in range(span - 1, -1, -1):
            place[grams[k : n + k] == least] = k
        place += np.arange(n)
        doc = np.repeat(np.arange(len(texts)), counts)
        base = np.repeat(np.cumsum(counts) - counts, counts)
        whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
        at = place[whole]
        new = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]
        first = whole[new]
        self.doc = doc[first]
        self.start = first - base[first]
        self.windows = np.diff(np.r_[np.flatnonzero(new), len(whole)])
        self.key = (grams[at[new]] >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``k_`` columns, ``text``, ``rk`` (joins a document with its parts) and ``ord`` (its place)."""
    return docs.select(
        *[docs[c].alias(f"k_{c}") for c in keep],
        F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"])).alias("rk"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("ord"),
        docs["text"].cast("binary").alias("text"),
    )


def _anchors(docs: DataFrame, window: int, gram: int, hot=None) -> DataFrame:
    """``key, rk`` of every segment, twice at most per key and document; only known keys where they are hot."""

    def run(batch) -> dict:
        found = Segments([words(t) for t in batch.column("text").to_pylist()], hashes, window, gram)
        rk = np.asarray(batch.column("rk"))[found.doc] if len(found.doc) else np.empty(0, np.int64)
        order = np.lexsort((found.key, rk))
        key, rk = found.key[order], rk[order]
        if len(key):
            # An anchor that a document has more than once is sent twice, and so counts as repeated.
            third = np.zeros(len(key), bool)
            third[2:] = (key[2:] == key[:-2]) & (rk[2:] == rk[:-2])
            key, rk = key[~third], rk[~third]
        if hot is not None:
            key = np.where(np.isin(key, hot.value), key | MARK, key)
        return {"key": key, "rk": rk}

    hashes = WordHashes()
    return map_texts(docs.select("rk", "text"), "text", run, "key bigint, rk bigint")


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs at least twice, marked if it does so more than ``RUN`` times.

    Rows that are marked already stay, and are dealt by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_rk, marked = np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(key, rk):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[starts, len(key)])
            size = np.repeat(size, size)
            go = (size >= 2) | (key >= MARK)
            key = np.where(size > RUN, key | MARK, key)
            return pa.RecordBatch.from_arrays([pa.array(key[go]), pa.array(rk[go])], ["key", "rk"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, rk = np.asarray(batch.column("key")), np.asarray(batch.column("rk"))
            if marked is not None:
                more = int(np.searchsorted(key, marked, "right"))
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(key[:more] | MARK), pa.array(rk[:more])], ["key", "rk"])
                key, rk = key[more:], rk[more:]
                if not len(key):
                    continue
                marked = None
            key, rk = np.r_[held_key, key], np.r_[held_rk, rk]
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield out(key[:cut], rk[:cut])
            held_key, held_rk = key[cut:], rk[cut:]
            if len(held_key) > RUN:
                marked = held_key[0]
                yield out(held_key, held_rk)
                held_key, held_rk = held_key[:0], held_rk[:0]
        if len(held_key):
            yield out(held_key, held_rk)

    dealt = rows.repartition("key", F.when(F.col("key") >= MARK, F.col("rk")))
    return dealt.sortWithinPartitions("key").mapInArrow(run, "key bigint, rk bigint")


def _hot(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Keys that are frequent in a sample of documents; they change the way rows go, never the result."""
    sample = docs.where(F.pmod(F.xxhash64("rk", F.lit(7)), F.lit(SAMPLE_ONE_IN)) == 0)
    counts = _anchors(sample, window, gram).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.col("n").desc(), "key").limit(HOT_KEYS).collect()
    return np.array(sorted(r["key"] for r in rows), np.int64)


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments of repeated anchors.

    ``shard``: what deals them; ``content``: their words, null for a segment whose
    equal with an earlier place is sent by the same batch (neighbours of that kind are
    one row); ``mine``: check of the text.
    """
    hashes = WordHashes()

    def run(batch) -> dict:
        raw = batch.column("text").to_pylist()
        texts = [words(t) for t in raw]
        found = Segments(texts, hashes, window, gram)
        keys = [np.asarray(k, np.int64) for k in batch.column("keys").to_pylist()]
        rk, place = batch.column("rk").to_pylist(), batch.column("ord").to_pylist()
        check = [xxh32_intdigest(t or b"") for t in raw]
        bounds = np.searchsorted(found.doc, np.arange(len(texts) + 1))
        rows: list[tuple] = []
        first: dict[tuple[int, bytes], int] = {}
        for d, text in enumerate(texts):
            part = slice(bounds[d], bounds[d + 1])
            key = found.key[part]
            plain, marked = np.isin(key, keys[d]), np.isin(key | MARK, keys[d])
            pieces = []
            for i in np.flatnonzero(plain | marked).tolist():
                start, n = int(found.start[part][i]), int(found.windows[part][i])
                if marked[i]:
                    pieces += [(None, s, 1) for s in range(start, start + n)]
                else:
                    pieces.append((int(key[i]), start, n))
            for shard, start, n in pieces:
                content = b" ".join(text[start : start + n + window - 1])
                shard = xxh3_64_intdigest(content) >> 1 if shard is None else shard
                other = first.setdefault((shard, content), len(rows))
                row = [shard, content, place[d], start, n, rk[d], check[d]]
                if other < len(rows):
                    here, there = (place[d], start), (rows[other][2], rows[other][3])
                    if here > there:
                        row[1] = None
                    elif here < there:
                        rows[other][1] = None
                        first[shard, content] = len(rows)
                rows.append(row)
        rows = _joined(rows)
        names = ("shard", "content", "ord", "start", "n", "rk", "mine")
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return dict(zip(names, columns))

    schema = "shard bigint, content binary, ord bigint, start int, n int, rk bigint, mine bigint"
    return map_texts(docs, "text", run, schema)


def _joined(rows: list[list]) -> list[list]:
    """Neighbouring settled segments of a document as one."""
    out: list[list] = []
    for row in rows:
        last = out[-1] if out else None
        settled = last and row[1] is None and last[1] is None
        if settled and row[5:] == last[5:] and row[3] == last[3] + last[4]:
            last[4] += row[4]
        else:
            out.append(row)
    return out


def _earlier(distinct: list[tuple[bytes, int, int]], window: int) -> list[int]:
    """For each of different segments (content, ord, start) a bit per window that starts earlier elsewhere."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number) + 1) for w in content.split(b" ")] for content, _, _ in distinct]
    lengths = np.array([len(s) for s in sequences], np.int64)
    flat = np.fromiter((w for s in sequences for w in s), np.int64, int(lengths.sum()))
    index = FMIndex(flat, lengths, window)
    # Places of the index's words: the rank of (ord, word) among all, equal places having equal ranks.
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ord_ = np.repeat(np.array([o for _, o, _ in distinct], np.int64), lengths)
    word = np.repeat(np.array([s for _, _, s in distinct], np.int64), lengths) + within
    order = np.lexsort((word, ord_))
    step = np.r_[0, (ord_[order][1:] != ord_[order][:-1]) | (word[order][1:] != word[order][:-1])]
    when = np.empty(len(flat), np.int64)
    when[order] = np.cumsum(step)
    in_text = np.full(index.n, len(flat), np.int64)
    in_text[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = when
    earliest = np.minimum.reduceat(in_text[index.order], index.starts[window][:-1])

    length, low = index.matches(flat, lengths)
    is_window = (np.repeat(lengths, lengths) - within >= window) & (length >= window)
    late = np.zeros(len(flat), bool)
    at = np.flatnonzero(is_window)
    late[at] = earliest[index.block(low[at])] < when[at]
    bits = np.where(late, np.int64(1) << np.minimum(within, 62), 0)
    return np.bitwise_or.reduceat(bits, np.cumsum(lengths) - lengths).tolist()


def _resolve(segments: DataFrame, window: int) -> DataFrame:
    """``rk, late``: struct of first word, bits of its windows that occur earlier, and text check.

    Minus ``n`` instead of bits says that all of ``n`` windows do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: list[tuple[bytes, int, int]] = []
        members: list[tuple[int, int, int, int, int, int]] = []
        size, key, content = 0, None, None

        def flush() -> pa.RecordBatch:
            nonlocal size
            late = _earlier(distinct, window) if distinct else []
            rows = []
            for which, ord_, start, n, rk, mine in members:
                first = which >= 0 and (ord_, start) == distinct[which][1:]
                bits = late[which] if first else -n
                if bits:
                    rows.append((rk, start, bits, mine))
            distinct.clear()
            members.clear()
            size = 0
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rk", "start", "bits", "mine"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "content", "ord", "start", "n", "rk", "mine")]
            for shard, text, ord_, start, n, rk, mine in zip(*columns):
                if text is None:
                    members.append((-1, ord_, start, n, rk, mine))
                else:
                    if shard != key and size >= SHARD_WORDS:
                        yield flush()
                        content = None
                    if shard != key or text != content:
                        # Sorted by place within equal segments, so the first one is the earliest.
                        distinct.append((text, ord_, start))
                        key, content = shard, text
                        size += n + window - 1
                    members.append((len(distinct) - 1, ord_, start, n, rk, mine))
                if len(members) >= 4 * SHARD_WORDS and text is None:
                    yield flush()
                    key = content = None
        yield flush()

    schema = "rk bigint, start int, bits bigint, mine bigint"
    # Segments that are settled already are dealt by document, the others by shard.
    dealt = segments.repartition(F.coalesce(F.when(F.col("content").isNotNull(), F.col("shard")), F.col("rk")))
    found = dealt.sortWithinPartitions(F.col("content").isNull(), "shard", "content", "ord", "start").mapInArrow(run, schema)
    return found.groupBy("rk").agg(F.collect_set(F.struct("start", "bits", "mine")).alias("late"))


def removed_words(n: int, late: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which of ``n`` words lie in a window that occurs earlier."""
    change = np.zeros(n + 1, np.int64)
    for x in late:
        bits, start = x["bits"], x["start"]
        if bits < 0:
            change[start] += 1
            change[start - bits - 1 + window] -= 1
        while bits > 0:
            low = bits & -bits
            at = start + low.bit_length() - 1
            change[at] += 1
            change[at + window] -= 1
            bits ^= low
    return np.cumsum(change[:n]) > 0


def _judged(docs: DataFrame, keep: list[str], make, outputs: str, window: int, gram: int) -> DataFrame:
    """``keep`` columns and what ``make(words, removed, text)`` gives for each document."""
    keyed = _keyed(docs, keep)
    hot = docs.sparkSession.sparkContext.broadcast(_hot(keyed, window, gram))
    needed = _repeated(_anchors(keyed, window, gram, hot))
    needed = needed.groupBy(F.col("rk").alias("of")).agg(F.collect_set("key").alias("keys"))
    # Both joins read all columns of the same shuffle of documents, so it is written once.
    by_document = keyed.repartition("rk")
    columns = by_document.columns
    segments = _cut(by_document.join(needed, F.col("rk") == F.col("of")).select(*columns, "keys"), window, gram)
    late = _resolve(segments, window).withColumnRenamed("rk", "of")
    found = by_document.join(late, F.col("rk") == F.col("of"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    schema = ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), outputs])

    def run(batch) -> dict:
        rows = []
        for text, entries in zip(batch.column("text").to_pylist(), batch.column("late").to_pylist()):
            found = words(text)
            check = xxh32_intdigest(text or b"") if entries else 0
            rows.append(make(found, removed_words(len(found), [e for e in entries or [] if e["mine"] == check], window), text))
        names = [part.split()[0] for part in outputs.split(", ")]
        return {f"k_{c}": batch.column(f"k_{c}") for c in keep} | dict(zip(names, zip(*rows)))

    return map_texts(found.select(*columns, "late"), "text", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def removal_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and SHA-256 of the kept words joined by spaces."""

    def make(found: list[bytes], removed: np.ndarray, _text) -> tuple:
        kept = b" ".join([w for w, r in zip(found, removed.tolist()) if not r])
        return len(found), int(removed.sum()), hashlib.sha256(kept).hexdigest()

    return _judged(docs, ["doc_id"], make, "n_words bigint, n_removed bigint, kept_sha256 string", window, gram)


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id and the spans of removed words (first, end excluded) of every document."""

    def make(found: list[bytes], removed: np.ndarray, _text) -> tuple:
        edges = np.flatnonzero(np.diff(np.r_[0, removed.astype(np.int8), 0]))
        return len(found), [[int(a), int(b)] for a, b in zip(edges[::2], edges[1::2])]

    return _judged(docs, ["doc_id"], make, "n_words bigint, spans array<array<bigint>>", window, gram)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without the words of repeated windows.

    A text that loses nothing stays as it is; otherwise its kept words are joined
    by single spaces.  A document that loses all its words leaves.
    """
    names = docs.columns

    def make(found: list[bytes], removed: np.ndarray, text) -> tuple:
        if not removed.any():
            return text, len(found), 0
        kept = b" ".join([w for w, r in zip(found, removed.tolist()) if not r])
        return kept, len(found), int(removed.sum())

    others = [c for c in names if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*[docs[c] for c in others]).alias("row"))
    out = _judged(packed, ["row"], make, "kept binary, n_words bigint, n_removed bigint", window, gram)
    out = out.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))))
    return out.select(*[F.col("kept").cast("string").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])
