"""Fill-in-the-middle examples: two cuts per text, found in a compressed set of boundaries.

The places where a text may be cut are kept as sorted code point offsets in containers of 65,536
values: a sorted array where they are few, a bitmap where they are many, runs where they follow each
other (cuts between single characters). Cumulative cardinalities name the container that holds the
k-th boundary, and a select inside it gives the offset. Texts, cuts and joints are whole: nothing is
looked at by prefix, and only one text at a time has its boundaries in memory.

The rest of an example (form, order of the parts, reading it back) is built-in functions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundscope.llm.blocks import UNSPACED, Block, slices

#: Fixed markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Chances in hundredths: that a text is cut at all, and that the suffix then comes first.
CUT, SUFFIX_FIRST = 50, 80
SEED = 42

SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.values = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit per value, with running counts per 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        word = int(self.words[at])
        for _ in range(k - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """First values of runs of consecutive values, with running lengths."""

    def __init__(self, low: np.ndarray):
        new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first = low[new].astype(np.uint16)
        self.before = new

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


class BoundarySet:
    """A set of sorted distinct offsets from which the k-th is read without a scan."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts].tolist()
        ends = [*starts[1:].tolist(), len(offsets)]
        self.containers = [
            self._smallest(offsets[a:b] & (SPAN - 1)) for a, b in zip(starts.tolist(), ends)
        ]
        #: Cardinality of all containers before each one, then of all.
        self.before = [*starts.tolist(), len(offsets)]

    @staticmethod
    def _smallest(low: np.ndarray):
        """The container that takes the least room for these values."""
        runs = int((np.diff(low) != 1).sum()) + 1
        room = {ArrayContainer: 2 * len(low), BitmapContainer: BITMAP_BYTES, RunContainer: 4 * runs}
        return min(room, key=room.get)(low)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The k-th least offset, counted from 0."""
        at = bisect_right(self.before, k) - 1
        return (self.keys[at] << 16) + self.containers[at].select(k - self.before[at])


def word_boundaries(piece: pa.Array) -> Iterator[np.ndarray]:
    """0 and the ends of each text's tokens, in code points.

    A token is a run of other characters with the blanks before it, or blanks that end a text.
    """
    block = Block(piece)
    words = block.words(UNSPACED)
    points = np.zeros(len(block.bytes) + 1, np.int64)
    np.cumsum((block.bytes & 0xC0) != 0x80, out=points[1:])
    ends = points[words.end]
    for text in range(block.n):
        start, stop = points[block.offsets[text]], points[block.offsets[text + 1]]
        own = ends[words.first[text] : words.first[text + 1]] - start
        length = stop - start
        tail = [length] if length and (not len(own) or own[-1] < length) else []
        yield np.concatenate([[0], own, tail]).astype(np.int64)


def character_boundaries(piece: pa.Array) -> Iterator[np.ndarray]:
    """0 and the end of each character, in code points."""
    block = Block(piece)
    points = block.per_text((block.bytes & 0xC0) != 0x80)
    for n in points.tolist():
        yield np.arange(n + 1, dtype=np.int64)


UNITS = {"word": word_boundaries, "character": character_boundaries}


def _hex_int(digits: Column, group: int) -> Column:
    return F.conv(F.substring(digits, 8 * group + 1, 8), 16, 10).cast("bigint")


def cuts(docs: DataFrame, unit: str = "word", seed: int = SEED) -> DataFrame:
    """``doc_id, text, n, first, second, draw_form, draw_order`` for each row of ``docs``.

    ``n`` counts the units of the whole text; ``first`` and ``second`` are code point offsets of the
    cuts, drawn from a digest of seed and doc_id, so that every run and every retry cuts alike.
    """
    find = UNITS[unit]
    digits = F.sha2(
        F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256
    )
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digits.alias("_h"))
    rows = drawn.select(
        "doc_id", "text",
        *[_hex_int(F.col("_h"), i).alias(name)
          for i, name in enumerate(("draw_a", "draw_b", "draw_form", "draw_order"))],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            n, first, second = [], [], []
            draws = (piece.column(c).to_pylist() for c in ("draw_a", "draw_b"))
            for offsets, a, b in zip(find(piece.column("text")), *draws):
                boundaries = BoundarySet(offsets)
                low, high = sorted((a % len(boundaries), b % len(boundaries)))
                n.append(len(boundaries) - 1)
                first.append(boundaries.select(low))
                second.append(boundaries.select(high))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), piece.column("text").cast(pa.string()),
                 *[pa.array(x, pa.int64()) for x in (n, first, second)],
                 piece.column("draw_form"), piece.column("draw_order")],
                ["doc_id", "text", "n", "first", "second", "draw_form", "draw_order"],
            )

    return rows.mapInArrow(
        run, "doc_id bigint, text string, n bigint, first bigint, second bigint, "
        "draw_form bigint, draw_order bigint",
    )


def _slice(text: str, start: Column, length: Column) -> Column:
    return F.substr(F.col(text), start + 1, length)


def examples(docs: DataFrame, unit: str = "word", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``form`` is plain (the text itself), psm or spm by the order of the parts. Texts that are empty
    or hold a marker stay plain, so a marker in an output is always one that was put there. A null
    text is empty; a null doc_id draws as an empty string would; rows that share a doc_id draw the
    same numbers, equal rows give equal rows. Columns beyond ``doc_id, text`` are not looked at, and
    an empty table gives an empty result. One text has to fit into a task.
    """
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | held | (F.pmod("draw_form", F.lit(100)) >= CUT)
    form = F.when(plain, "plain").when(
        F.pmod("draw_order", F.lit(100)) < SUFFIX_FIRST, "spm"
    ).otherwise("psm")
    prefix = _slice("text", F.lit(0), F.col("first"))
    middle = _slice("text", F.col("first"), F.col("second") - F.col("first"))
    suffix = _slice("text", F.col("second"), F.length("text"))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    return cuts(docs, unit, seed).withColumn("form", form).select(
        "doc_id", "n", "form",
        F.when(F.col("form") != "plain", F.col("first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from, from its output and form alone."""

    def between(start: str, stop: str | None) -> Column:
        begin = F.locate(start, output) + len(start)
        end = F.locate(stop, output) if stop else F.length(output) + 1
        return F.substr(output, begin, end - begin)

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
