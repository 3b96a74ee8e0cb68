"""Fill-in-middle: cut a text in three and move the middle to the end.

Texts are stored as seekable compressed frames (``frames.py``).  The two cuts of a
document are drawn from a hash of its id, so a retried task or a rerun cuts alike.
Only the frames that hold a cut are decompressed; all others move to their new place as
they are, so an output is again a list of frames.  Digests stream over the frames in
order, and the text is rebuilt from the output's frames and its form alone.

Everything is a map over rows: no shuffle, and a worker holds one batch of texts.

Null and empty texts stay plain and give an empty output.  A text that holds one of the
markers stays plain, so a marker found in a moved text is a real one.  Very long texts are
many frames.  A null id is drawn as an empty one.  Repeated rows and rows that share an id
are cut alike if their texts agree; there is nothing to tie.  An empty table gives an empty
result.  Columns to keep travel as ``k_<name>``, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import FRAME_BYTES, Frames, compress, decompress
from plumbline.llm.text import map_texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Seed of the draws, the share (percent) of texts to move, and of those the share with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

_MARKER_FRAMES = {m: compress(m) for m in MARKERS}
_STORED = "n bigint, marked boolean, data binary, ends array<bigint>, units array<bigint>, chars array<bigint>"


def draws(doc_id: str, seed: int) -> tuple[int, ...]:
    """Four numbers below 2**32 that depend on the seed and the id only."""
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(found[8 * i : 8 * i + 8], 16) for i in range(4))


def form_of(n: int, marked: bool, h: tuple[int, ...], rate: int, suffix_first: int) -> str:
    if not n or marked or h[2] % 100 >= rate:
        return PLAIN
    return SPM if h[3] % 100 < suffix_first else PSM


def move(text: Frames, form: str, h: tuple[int, ...]) -> tuple[list[bytes], int | None, int | None]:
    """Frames of the output, and the code points of prefix and middle (null if plain)."""
    n = text.n_units
    if form == PLAIN:
        return [text.frame(i) for i in range(len(text.ends))], None, None
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, prefix_chars = text.select(0, first)
    middle, middle_chars = text.select(first, last)
    suffix, _ = text.select(last, n)
    mark = _MARKER_FRAMES
    if form == PSM:
        moved = [mark[PREFIX], *prefix, mark[SUFFIX], *suffix, mark[MIDDLE], *middle]
    else:
        moved = [mark[SUFFIX], *suffix, mark[PREFIX], *prefix, mark[MIDDLE], *middle]
    return moved, prefix_chars, middle_chars


def restored(output: Iterable[bytes], form: str) -> Iterator[bytes]:
    """Pieces of the original text, in order, from the frames of an output and its form.

    The frames between two markers are put back compressed; one is open at a time.
    """
    if form == PLAIN:
        yield from map(decompress, output)
        return
    parts: dict[bytes, list[bytes]] = {m: [] for m in MARKERS}
    now: list[bytes] = []
    for frame in output:
        marker = next((m for m in MARKERS if frame == _MARKER_FRAMES[m]), None)
        if marker:
            now = parts[marker]
        else:
            now.append(frame)
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from map(decompress, parts[marker])


def digest(pieces: Iterable[bytes]) -> str:
    found = hashlib.sha256()
    for piece in pieces:
        found.update(piece)
    return found.hexdigest()


def store(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """``keep`` columns (as ``k_<name>``) and the text as frames with their cumulative counts."""

    def run(batch) -> dict:
        texts = [t or b"" for t in batch.column("_text").to_pylist()]
        found = [Frames.of(t, frame_bytes) for t in texts]
        return {f"k_{c}": batch.column(f"k_{c}") for c in keep} | {
            "n": [f.n_units for f in found],
            # A marker has no blank in it and so lies within one unit, and one frame.
            "marked": [any(m in t for m in MARKERS) for t in texts],
            **{name: [getattr(f, name) for f in found] for name in ("data", "ends", "units", "chars")},
        }

    given = docs.select(*[docs[c].alias(f"k_{c}") for c in keep], docs[text].alias("_text"))
    return map_texts(given, "_text", run, _schema(given, keep, _STORED))


def fill_in_middle(
    stored: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    doc_id: str = "doc_id",
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    digests: bool = False,
) -> DataFrame:
    """From ``store``: ``keep`` columns, n, form, prefix_chars, middle_chars and the output as ``frames``.

    With ``digests``, SHA-256 of the output and of the text rebuilt from it stand instead of
    the frames.  ``doc_id`` has to be one of the columns kept.
    """

    def run(batch) -> dict:
        out: dict = {f"k_{c}": batch.column(f"k_{c}") for c in keep} | {"n": batch.column("n")}
        names = ("form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digests else ("frames",)))
        out |= {name: [] for name in names}
        lists = [batch.column(c).to_pylist() for c in ("_id", "n", "marked", "data", "ends", "units", "chars")]
        for key, n, marked, *parts in zip(*lists):
            h = draws(key, seed)
            form = form_of(n, marked, h, rate, suffix_first)
            frames, prefix_chars, middle_chars = move(Frames(*parts), form, h)
            for name, value in (("form", form), ("prefix_chars", prefix_chars), ("middle_chars", middle_chars)):
                out[name].append(value)
            if digests:
                out["output_sha256"].append(digest(map(decompress, frames)))
                out["restored_sha256"].append(digest(restored(frames, form)))
            else:
                out["frames"].append(frames)
        return out

    outputs = "output_sha256 string, restored_sha256 string" if digests else "frames array<binary>"
    given = stored.withColumn("_id", F.coalesce(F.col(f"`k_{doc_id}`").cast("string"), F.lit("")))
    schema = _schema(stored, keep, f"n bigint, form string, prefix_chars bigint, middle_chars bigint, {outputs}")
    return map_texts(given, "data", run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def texts(moved: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """From ``fill_in_middle``: ``keep`` columns, form, the ``output`` as text and the text ``rebuilt`` from it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                frames, form = row.column("frames").to_pylist()[0], row.column("form").to_pylist()[0]
                output = b"".join(map(decompress, frames)).decode("utf-8", "replace")
                rebuilt = b"".join(restored(frames, form)).decode("utf-8", "replace")
                columns = [*[row.column(f"k_{c}") for c in keep], pa.array([form]), pa.array([output]), pa.array([rebuilt])]
                yield pa.RecordBatch.from_arrays(columns, names=[*[f"k_{c}" for c in keep], "form", "output", "rebuilt"])

    given = moved.select(*[moved[c].alias(f"k_{c}") for c in keep], "form", "frames")
    schema = _schema(given, keep, "form string, output string, rebuilt string")
    return given.mapInArrow(run, schema).withColumnsRenamed({f"k_{c}": c for c in keep})


def _schema(given: DataFrame, keep: tuple[str, ...], rest: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return ", ".join([*(f"`k_{c}` {kinds[f'k_{c}']}" for c in keep), rest])
