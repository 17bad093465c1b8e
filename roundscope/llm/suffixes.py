"""Removal of repeated 200-byte strings by suffix arrays over groups that hold all their repeats.

One suffix array over everything cannot be shared out, so the windows of 200 bytes are dealt to
groups first, by content alone. Each window picks the last of its 32-byte pieces with the least
hash, its anchor. Equal windows pick equal pieces at equal offsets, so windows that repeat meet under
their anchor's hash. Neighbouring windows with one anchor are a segment. Anchors that occur once in
the corpus are done; segments whose whole content repeats are counted as one text with a weight. A
group with several segments is cut by how far before the anchor a window begins, in steps of
``STEP``: what all windows of a step share is one symbol, and with it two windows are equal if their
suffixes agree in ``STEP`` symbols. The suffix array of each such group (see ``lyndon``) puts equal
windows side by side.

Groups are bounded: an anchor with more than ``MANY`` different segments is cut into single windows,
which are counted as they stream by. What is dealt out are hashes and, for contested segments alone,
up to 40 bytes a step; the texts move twice, compressed, to where spans of their document are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.llm.blocks import Block, mix, slices
from roundscope.llm.lyndon import suffix_order
from roundscope.session import materialize

LENGTH = 200
PIECE = 33
#: Pieces in a window: so many places before an anchor may a window begin.
PLACES = LENGTH - PIECE + 1
STEP = 21
#: Different segments of one anchor that are still compared as groups of ``STEP`` places.
MANY = 1000

_LOW = np.uint64(0xFFFFFFFF)


def segments(block: Block) -> tuple[np.ndarray, ...]:
    """Of each segment: anchor hash, content hash, text, first window, number of windows, anchor.

    The last three count bytes of the block.
    """
    n, width = len(block.bytes), PLACES
    starts = n - LENGTH + 1
    if starts <= 0:
        return tuple(np.zeros(0, kind) for kind in ("u8", "u8", "i8", "i8", "i8", "i8"))
    prefix = block.prefix_hashes()
    at = np.arange(n - PIECE + 1)
    pieces = Block.span_hash(prefix, at, at + PIECE)
    # Least hash, and of equals the last: the low half counts down.
    ranked = (pieces & ~_LOW) | (_LOW - at.astype(np.uint64))
    padded = np.append(ranked, np.full(-len(ranked) % width, np.uint64(2**64 - 1)))
    tiles = padded.reshape(-1, width)
    before = np.minimum.accumulate(tiles, axis=1).ravel()
    after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
    text = np.repeat(np.arange(block.n), np.diff(block.offsets))
    whole = text[:starts] == text[LENGTH - 1 :]
    new, last = whole.copy(), whole.copy()
    change = chosen[1:] != chosen[:-1]
    new[1:] &= change | ~whole[:-1]
    last[:-1] &= change | ~whole[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(last)
    anchor = (_LOW - (chosen[low] & _LOW)).astype(np.int64)
    content = Block.span_hash(prefix, low, high + LENGTH)
    return pieces[anchor], content, text[low], low, high - low + 1, anchor


OCCURRENCE = "anchor bigint, content bigint, doc_id bigint, mark int, low int, n int, ahead int"


def occurrences(docs: DataFrame) -> DataFrame:
    """Every segment of every document: where its windows begin, and how far on its anchor is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            block = Block(piece.column("text"))
            anchor, content, text, low, n, at = segments(block)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                 piece.column("doc_id").take(rows), piece.column("mark").take(rows),
                 pa.array((low - block.offsets[text]).astype(np.int32)),
                 pa.array(n.astype(np.int32)), pa.array((at - low).astype(np.int32))],
                [part.split()[0] for part in OCCURRENCE.split(", ")],
            )

    return docs.mapInArrow(run, OCCURRENCE)


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with compressed texts, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for piece in slices(batches, "text"):
            texts = piece.column("text").cast(pa.binary())
            packed = [codec.compress(t.as_buffer(), asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("mark"),
                 pc.binary_length(texts).cast(pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "mark", "n_bytes", "packed"],
            )

    return docs.mapInArrow(run, "doc_id bigint, mark int, n_bytes bigint, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for packed, size in zip(batch.column("packed"), batch.column("n_bytes").to_pylist()):
        yield codec.decompress(packed.as_buffer(), size, asbytes=True)


def _same_document(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (
        F.col(f"{a}.mark") == F.col(f"{b}.mark")
    )


PART = (
    "group bigint, anchor bigint, content bigint, weight bigint, begin int, size int, "
    "head binary, tail binary"
)


def _parts(text: bytes, wanted: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Cut segments of one text into the steps of their windows; see :data:`PART`."""
    prefix = Block(pa.array([text], pa.binary())).prefix_hashes()
    low, n = wanted["low"].astype(np.int64), wanted["n"].astype(np.int64)
    at = low + wanted["ahead"]
    step = np.where(wanted["many"], 1, STEP)
    # Windows of a segment begin between `near` and `far` places before the anchor.
    near, far = at - low - n + 1, at - low
    count = far // step - near // step + 1
    which = np.repeat(np.arange(len(low)), count)
    number = (near // step)[which] + np.arange(len(which)) - np.repeat(
        np.cumsum(count) - count, count)
    size = step[which]
    first, last = number * size, np.minimum(number * size + size, PLACES) - 1
    own_first, own_last = np.maximum(first, near[which]), np.minimum(last, far[which])
    at = at[which]
    common = Block.span_hash(prefix, at - first, at - last + LENGTH)
    label = wanted["anchor"].view(np.uint64)[which] + mix(
        (number * 256 + size).astype(np.uint64))
    group = mix(label + common)
    return [
        group.view(np.int64), wanted["anchor"][which], wanted["content"][which],
        wanted["weight"][which], (far[which] - own_last).astype(np.int32),
        (last - first + 1).astype(np.int32),
        at - own_last, at - first, at - last + LENGTH, at - own_first + LENGTH,
    ]


def contested_parts(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """Fetch the contested segments from their documents' texts, cut into steps."""
    fields = ["anchor", "content", "weight", "low", "n", "ahead", "many"]
    wanted = contested.groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct(*fields)).alias("wanted")
    )
    rows = _packed(docs).alias("d").join(
        wanted.alias("w"), _same_document("d", "w")
    ).select("d.doc_id", "d.mark", "n_bytes", "packed", "wanted")
    # Rows that share doc_id and text would each bring the segments; one is enough, see below.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PART.split(", ")]
        for batch in batches:
            lists = batch.column("wanted")
            flat = lists.flatten()
            columns = {
                f: flat.field(f).to_numpy(zero_copy_only=False) for f in fields
            }
            stops = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(
                zero_copy_only=False)))
            for i, text in enumerate(_unpacked(batch)):
                own = {f: c[stops[i] : stops[i + 1]] for f, c in columns.items()}
                *out, a, b, c, d = _parts(text, own)
                edges = zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())
                cuts = [(text[p:q], text[r:s]) for p, q, r, s in edges]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x) for x in out],
                     pa.array([x for x, _ in cuts], pa.binary()),
                     pa.array([y for _, y in cuts], pa.binary())], names,
                )

    return rows.mapInArrow(run, PART)


def repeated_windows(
    parts: list[tuple[bytes, bytes, int]], size: int
) -> list[list[tuple[int, int]]]:
    """Of each part: which of its windows, counted from its first, repeat in the group.

    Parts are (bytes before, bytes after, weight) around the symbol they share, all different; the
    weight is how many texts a part stands for. A window is ``size`` symbols, the shared one among
    them. Windows are given in runs, as the first and one past the last.
    """
    counts = [len(head) + len(tail) - size + 2 for head, tail, _ in parts]
    if len(parts) == 1:
        return [[(0, counts[0])] if parts[0][2] > 1 else []]
    symbols: list[int] = []
    owner: list[int] = []
    starts = []
    for i, (head, tail, _) in enumerate(parts):
        starts.append(len(symbols))
        symbols += head
        symbols.append(256)
        symbols += tail
        symbols.append(-1)
        owner += [i] * (len(symbols) - len(owner))
    symbols.append(-2)
    flags = [bytearray(n) for n in counts]
    run: list[tuple[int, int]] = []
    seen: tuple[bytes, bytes] | None = None
    weight = 0
    for place in [*suffix_order(symbols)[1:], -1]:
        if place >= 0:
            i = owner[place]
            t = place - starts[i]
            if t >= counts[i]:
                continue
            head, tail, times = parts[i]
            window = (head[t:], tail[: size - 1 - len(head) + t])
        if place < 0 or window != seen:
            if weight > 1:
                for j, u in run:
                    flags[j][u] = 1
            run, weight = [], 0
        if place >= 0:
            seen = window
            run.append((i, t))
            weight += times
    return [_runs(f) for f in flags]


def _runs(flags: bytes) -> list[tuple[int, int]]:
    out, at = [], flags.find(1)
    while at >= 0:
        end = flags.find(0, at)
        end = len(flags) if end < 0 else end
        out.append((at, end))
        at = flags.find(1, end)
    return out


RANGE = "anchor bigint, content bigint, first int, stop int"


def repeats_in_groups(parts: DataFrame) -> DataFrame:
    """Runs of repeated windows of each contested segment, in windows from its first."""

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        group = segment = None
        held: dict[tuple[bytes, bytes], list] = {}
        # The first window of a group of single windows, until a second one comes.
        single: tuple | None = None
        total = size = 0

        def close() -> None:
            if held:
                keys = list(held)
                weights = [sum(w for *_, w in held[k]) for k in keys]
                found = repeated_windows([(*k, w) for k, w in zip(keys, weights)], size)
                for key, runs in zip(keys, found):
                    for anchor, content, begin, _ in held[key]:
                        out.extend((anchor, content, begin + a, begin + b) for a, b in runs)
                held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            done = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                [part.split()[0] for part in RANGE.split(", ")],
            )
            out.clear()
            return done

        for row in rows_of(batches):
            now, anchor, content, weight, begin, width, head, tail = row
            if now != group:
                close()
                group, segment, single, total, size = now, None, None, 0, width
            if (anchor, content, begin) == segment:
                continue  # The same segment, from a second row with the same document.
            segment = (anchor, content, begin)
            if width > 1:
                held.setdefault((head, tail), []).append((anchor, content, begin, weight))
                continue
            total += weight
            if total < 2:
                single = (anchor, content, begin, begin + 1)
                continue
            if single:
                out.append(single)
                single = None
            out.append((anchor, content, begin, begin + 1))
            if len(out) > 50_000:
                yield batch()
        close()
        yield batch()

    dealt = parts.repartition("group").sortWithinPartitions(
        "group", "anchor", "content", "begin"
    )
    return dealt.mapInArrow(run, RANGE)


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, spans``: byte spans of repeated windows of each document that has any."""
    found = occurrences(docs)
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    live = materialize(found.join(twice.select("anchor"), "anchor"), "repeated-anchors")
    place = F.struct("doc_id", "mark", "low", "n", "ahead")
    distinct = materialize(
        live.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("weight"), F.min(place).alias("place")
        ), "distinct-segments",
    )
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts"))
    known = distinct.join(several, "anchor")
    contested = known.filter("texts > 1").select(
        "anchor", "content", "weight", "place.*", (F.col("texts") > MANY).alias("many")
    )
    whole = known.filter("texts = 1").select(
        "anchor", "content", F.lit(0).alias("first"), F.col("place.n").alias("stop")
    )
    ranges = repeats_in_groups(contested_parts(docs, contested))
    runs = whole.union(ranges).groupBy("anchor", "content").agg(
        F.collect_list(F.struct("first", "stop")).alias("runs")
    )
    return live.join(runs, ["anchor", "content"]).select(
        "doc_id", "mark", "low", F.explode("runs").alias("run")
    ).select(
        "doc_id", "mark",
        F.struct(
            (F.col("low") + F.col("run.first")).alias("a"),
            (F.col("low") + F.col("run.stop") + (LENGTH - 1)).alias("b"),
        ).alias("span"),
    ).groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


def _kept(text: bytes, spans: list) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, and what is left."""
    parts, at, removed, runs = [], 0, 0, 0
    for a, b in spans:
        if a > at or not runs:
            runs += 1
            parts.append(text[at:a])
            removed += b - a
        else:
            removed += max(b - at, 0)
        at = max(at, b)
    return removed, runs, b"".join([*parts, text[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept``.

    ``kept`` has the bytes of the text (null: empty) that no string of 200 bytes covers which
    starts anywhere else too, in this or any other row. Equal rows repeat each other. Rows may
    share a doc_id; other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.hash(text).alias("mark"))
    spans = repeated_spans(docs)
    rows = _packed(docs).alias("d").join(
        spans.alias("s"), _same_document("d", "s"), "left"
    ).select("d.doc_id", "n_bytes", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(_unpacked(batch), batch.column("spans")):
                pairs = sorted((s["a"], s["b"]) for s in spans.as_py() or ())
                out.append(_kept(text, pairs))
            removed, runs, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                [part.split()[0] for part in REMOVED.split(", ")],
            )

    return rows.mapInArrow(run, REMOVED)
