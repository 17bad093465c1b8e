"""Benchmark decontamination over a stored positional index of all training tokens.

The index is split by documents: a segment is the inverted index of one block of texts, with every
term of the block, its postings (word positions in the segment) and the documents' borders. It is
written once to the shared folder and read by any number of searches. A search takes the windows of
a bounded block of test items to every segment, starts from the postings of each window's rarest
term there, shifts them by that term's offset and intersects them with the lists of the other terms,
rarest first. A segment without one of the terms is done with the window at once. No postings move
between executors, and documents of any length or number of copies are matched where they lie.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundscope.llm.blocks import ALNUM, Block, slices
from roundscope.session import materialize, work_path

SEGMENT_BYTES = 4 << 20
#: Bytes of text that are looked at once where nothing is stored.
PIECE_BYTES = 512 << 10
WINDOW = 10
#: Words of test items that a search takes along at once; more items are searched in more passes.
QUERY_WORDS = 200_000
#: Candidate places that are intersected at a time.
_CANDIDATES = 2_000_000

SEGMENT_SCHEMA = (
    "segment bigint, doc_ids binary, id_known binary, first binary, terms binary, sizes binary, "
    "postings binary"
)


class Segment:
    """Inverted index of a block of texts: sorted terms, and positions term by term."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray,
                 first: np.ndarray):
        self.terms, self.starts, self.postings, self.first = terms, starts, postings, first

    @classmethod
    def of(cls, column: pa.Array) -> Segment:
        block = Block(column)
        block.lower()
        words = block.words(ALNUM)
        hashes = words.hashes()
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        starts = np.append(np.flatnonzero(new), len(ordered))
        return cls(ordered[new], starts, order.astype(np.int64), words.first)

    def keys(self) -> np.ndarray:
        """Postings as sorted numbers that hold term and position."""
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.starts))
        return (term << 40) | self.postings


def _pack(segment: Segment) -> list[bytes]:
    """Positions as differences within each term, which compress well."""
    steps = np.diff(segment.postings, prepend=0)
    begin = segment.starts[:-1]
    steps[begin] = segment.postings[begin]
    return [
        segment.first.astype("<i8").tobytes(), segment.terms.astype("<u8").tobytes(),
        np.diff(segment.starts).astype("<u4").tobytes(), steps.astype("<u4").tobytes(),
    ]


def _unpack(first: bytes, terms: bytes, sizes: bytes, postings: bytes) -> Segment:
    starts = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64))
    steps = np.frombuffer(postings, "<u4").astype(np.int64)
    total = np.cumsum(steps)
    base = total[starts[:-1]] - steps[starts[:-1]]
    return Segment(
        np.frombuffer(terms, "<u8"), starts, total - np.repeat(base, np.diff(starts)),
        np.frombuffer(first, "<i8"),
    )


def build(docs: DataFrame) -> DataFrame:
    """Write the index of ``doc_id, text`` and return it as a table of segments.

    Null and empty texts are documents without words; repeated rows are documents of their own;
    other columns are not indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SEGMENT_SCHEMA.split(",")]
        number = TaskContext.get().partitionId() << 32
        for piece in slices(batches, "text", SEGMENT_BYTES):
            ids = piece.column("doc_id").cast(pa.int64())
            known = np.array(ids.is_valid())
            columns = [
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                known.tobytes(), *_pack(Segment.of(piece.column("text"))),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.array([c], pa.binary()) for c in columns]], names
            )
            number += 1

    path = work_path(docs.sparkSession, "phrase-index")
    segments = docs.select("doc_id", "text").mapInArrow(run, SEGMENT_SCHEMA)
    segments.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SEGMENT_SCHEMA).parquet(path)


class Windows:
    """Windows of a block of test items, as term hashes grouped by width."""

    def __init__(self, items: list[tuple[object, np.ndarray]], width: int = WINDOW):
        groups: dict[int, tuple[list, list]] = {}
        self.items = [item for item, _ in items]
        for number, (_, hashes) in enumerate(items):
            size = min(width, len(hashes))
            if size:
                rows = np.lib.stride_tricks.sliding_window_view(hashes, size)
                kept = groups.setdefault(size, ([], []))
                kept[0].append(rows)
                kept[1].append(np.full(len(rows), number))
        self.groups = {
            size: (np.concatenate(rows), np.concatenate(numbers))
            for size, (rows, numbers) in groups.items()
        }


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each stretch, end to end."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _candidates(segment: Segment, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Window numbers, their places by the rarest term, and terms of all windows, by and by."""
    found = np.searchsorted(segment.terms, rows)
    found[found == len(segment.terms)] = 0
    present = segment.terms[found] == rows if len(segment.terms) else np.zeros(rows.shape, bool)
    usable = np.flatnonzero(present.all(axis=1))
    if not len(usable):
        return
    found = found[usable]
    often = segment.starts[found + 1] - segment.starts[found]
    order = np.argsort(often, axis=1, kind="stable")
    rare = order[:, 0]
    line = np.arange(len(usable))
    counts = often[line, rare]
    parts = np.searchsorted(np.cumsum(counts), np.arange(
        _CANDIDATES, int(counts.sum()) + _CANDIDATES, _CANDIDATES), "left") + 1
    begin = 0
    for stop in np.minimum(parts, len(usable)).tolist():
        if stop <= begin:
            continue
        some = line[begin:stop]
        which = np.repeat(some, counts[some])
        at = segment.postings[_ragged(segment.starts[found[some, rare[some]]], counts[some])]
        yield usable, found, order, which, at
        begin = stop


def phrase_matches(segment: Segment, windows: Windows) -> tuple[np.ndarray, ...]:
    """First word, width and item number of every place where a whole window stands in order."""
    keys = segment.keys()
    out: list[tuple[np.ndarray, ...]] = []
    for width, (rows, numbers) in windows.groups.items():
        for usable, found, order, which, at in _candidates(segment, rows):
            at = at - order[which, 0]
            fits = (at >= 0) & (at + width <= segment.first[-1])
            which, at = which[fits], at[fits]
            # All words in one document.
            one = np.searchsorted(segment.first, at, "right") == np.searchsorted(
                segment.first, at + width - 1, "right")
            which, at = which[one], at[one]
            for step in range(1, width):
                if not len(at):
                    break
                offset = order[which, step]
                key = (found[which, offset] << 40) | (at + offset)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = keys[place] == key
                which, at = which[same], at[same]
            out.append((at, np.full(len(at), width), numbers[usable[which]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*out))


def near_matches(segment: Segment, windows: Windows, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the rarest term and item number where each other term is at most ``reach`` away.

    Order and number of the words do not matter; all of them lie in one document.
    """
    keys = segment.keys()
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for width, (rows, numbers) in windows.groups.items():
        for usable, found, order, which, at in _candidates(segment, rows):
            text = np.searchsorted(segment.first, at, "right")
            low = np.maximum(at - reach, segment.first[text - 1])
            high = np.minimum(at + reach, segment.first[text] - 1)
            for step in range(1, width):
                term = found[which, order[which, step]] << 40
                place = np.minimum(np.searchsorted(keys, term | low), len(keys) - 1)
                near = (keys[place] >= (term | low)) & (keys[place] <= (term | high))
                which, at, low, high = which[near], at[near], low[near], high[near]
            out.append((at, numbers[usable[which]]))
    if not out:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate([a for a, _ in out]), np.concatenate([n for _, n in out])


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of the spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(span) for span in out]


def _hits(segment: Segment, windows: Windows) -> dict[int, tuple[list, list]]:
    """Merged word spans and items of each document (by number) that holds a window."""
    at, width, item = phrase_matches(segment, windows)
    text = np.searchsorted(segment.first, at, "right") - 1
    order = np.argsort(text, kind="stable")
    numbers, begin = np.unique(text[order], return_index=True)
    out = {}
    for number, own in zip(numbers.tolist(), np.split(order, begin[1:])):
        start = at[own] - segment.first[number]
        items = {windows.items[i] for i in np.unique(item[own]).tolist()}
        out[number] = (
            _merged(start, start + width[own]), sorted(items, key=lambda i: (i is None, i))
        )
    return out


HIT_SCHEMA = (
    "segment bigint, ordinal int, doc_id bigint, n_words bigint, "
    "spans array<struct<start:bigint,end:bigint>>, items array<bigint>"
)


def query_blocks(benchmark: DataFrame) -> tuple[DataFrame | None, Iterator[Windows]]:
    """The test items in blocks of about ``QUERY_WORDS`` words, each small enough to send along.

    If there is one block, its items go by their ids and the first result is None. Of more, each
    list of words is in one block, once; it goes by a key, and the first result has ``key, item_id``.
    Items without words (null, empty, signs only) have no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SEGMENT_BYTES):
            block = Block(piece.column("text"))
            block.lower()
            words = block.words(ALNUM)
            parts = np.split(words.hashes(), words.first[1:-1])
            yield pa.RecordBatch.from_arrays(
                [piece.column("item_id").cast(pa.int64()),
                 pa.array([p.astype("<u8").tobytes() for p in parts], pa.binary()),
                 pa.array([len(p) for p in parts], pa.int64())],
                ["item_id", "hashes", "n"],
            )

    items = benchmark.select("item_id", "text").mapInArrow(
        run, "item_id bigint, hashes binary, n bigint"
    ).filter("n > 0")
    total = items.agg(F.sum("n")).first()[0] or 0
    names = None
    if total > QUERY_WORDS:
        keyed = items.withColumn("key", F.xxhash64("hashes"))
        names = materialize(keyed.select("key", "item_id").distinct(), "item-names")
        items = materialize(keyed.groupBy(F.col("key").alias("item_id")).agg(
            F.first("hashes").alias("hashes"), F.first("n").alias("n")
        ), "item-texts")
        total = items.agg(F.sum("n")).first()[0]
    blocks = -(-total // QUERY_WORDS)

    def windows() -> Iterator[Windows]:
        for block in range(blocks):
            rows = items.filter(F.pmod(F.xxhash64("hashes"), F.lit(blocks)) == block).collect()
            yield Windows([(r["item_id"], np.frombuffer(r["hashes"], "<u8")) for r in rows])

    return names, windows()


def search(segments: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its number of words, the word spans inside windows, and the items they are of.

    A window is ten words of an item in a row, or a shorter item as a whole. Every indexed document
    gives a row, with no spans where nothing is found; an empty benchmark finds nothing. Items that
    repeat, or share an id, each count by their id once per document.
    """
    context = segments.sparkSession.sparkContext
    parts: list[DataFrame] = []

    def add(windows: Windows) -> None:
        shared = context.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    number, ids, known, *packed = (c[row].as_py() for c in batch.columns)
                    segment = _unpack(*packed)
                    ids = np.frombuffer(ids, "<i8")
                    found = _hits(segment, shared.value)
                    spans = [found.get(i, ([], []))[0] for i in range(len(ids))]
                    items = [found.get(i, ([], []))[1] for i in range(len(ids))]
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), number)),
                         pa.array(np.arange(len(ids), dtype=np.int32)),
                         pa.array(ids, mask=~np.frombuffer(known, bool)),
                         pa.array(np.diff(segment.first)),
                         pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind),
                         pa.array(items, pa.list_(pa.int64()))],
                        [part.split()[0] for part in HIT_SCHEMA.split(", ")[:4]]
                        + ["spans", "items"],
                    )

        parts.append(segments.mapInArrow(run, HIT_SCHEMA))

    names, blocks = query_blocks(benchmark)
    for windows in blocks:
        add(windows)
    if not parts:
        add(Windows([]))
    if names is None:
        return parts[0]
    place = ["segment", "ordinal"]
    found = materialize(functools.reduce(DataFrame.union, parts).groupBy(*place).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("keys"),
    ), "hits")
    # An id counts once per document, whichever of its texts, and in whichever blocks, are met.
    ids = found.select(*place, F.explode("keys").alias("key")).join(names, "key").groupBy(
        *place
    ).agg(F.array_sort(F.collect_set(F.struct("item_id"))["item_id"]).alias("items"))
    none = F.array().cast("array<bigint>")
    return found.drop("keys").join(ids, place, "left").withColumn(
        "items", F.coalesce("items", none)
    )


def covered(spans: str = "spans") -> Column:
    """Number of words inside any of the spans, which may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0)))
            .alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no window of any item, with the columns they came with.

    Each task indexes its texts and searches them on the spot, so no text moves between executors.
    """
    context = docs.sparkSession.sparkContext
    for windows in query_blocks(benchmark)[1]:
        shared = context.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "text", PIECE_BYTES):
                clean = np.ones(piece.num_rows, bool)
                clean[list(_hits(Segment.of(piece.column("text")), shared.value))] = False
                yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
