"""Stupid-backoff language model of the corpus, and each document's score under the rest of it.

Texts are packed into blocks, and every block sends its distinct n-grams, with how often they occur
in it, to count tables partitioned by the n-gram's hash. A partition adds the counts up and sends
them back in the order the block listed its n-grams in, so that the block can join them to the
n-grams of its documents, and sum scores per document. An n-gram is one entry per block and table
however frequent it is; the number of partitions follows the size of the corpus.

Widths go upwards, a table each. An n-gram is sent only where both its halves of one word less occur
in another document; any other is in no other document, so nothing is lost. What a table sends back
is kept until the scores are made, its shuffle is not.

A document is scored by the counts of all others: what it contributes itself is taken off first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.llm.blocks import UNSPACED, Block, Words, slices
from roundscope.session import materialize

BLOCK_BYTES = 4 << 20
#: Weight of a score that had to do with a shorter history.
BACKOFF = 0.4
ORDER = 2
#: Bytes of text for each partition of a count table.
PARTITION_BYTES = 16 << 20
PARTITIONS = 16

_PACKED = (
    "block bigint, doc_ids binary, known binary, sizes binary, packed binary, n_bytes bigint, "
    "n_words bigint"
)
_ENTRIES = "block bigint, part int, hashes binary, counts binary"
_TOTALS = "block bigint, width int, part int, totals binary"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def packed_blocks(docs: DataFrame) -> DataFrame:
    """The texts in compressed blocks, written once so that a block stays the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codec = pa.Codec("zstd", 1)
        for piece in slices(batches, "text", BLOCK_BYTES):
            block = Block(piece.column("text"))
            ids = piece.column("doc_id").cast(pa.int64())
            columns = [
                ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(),
                np.array(ids.is_valid()).tobytes(), np.diff(block.offsets).tobytes(),
                codec.compress(block.bytes.tobytes(), asbytes=True),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *[pa.array([c], pa.binary()) for c in columns],
                 pa.array([len(block.bytes)]),
                 pa.array([int(block.words(UNSPACED).count.sum())])], _names(_PACKED),
            )
            number += 1

    blocks = docs.select("doc_id", "text").mapInArrow(run, _PACKED)
    return materialize(blocks, "text-blocks")


def _unpack(row: dict) -> Block:
    data = pa.Codec("zstd").decompress(row["packed"], row["n_bytes"], asbytes=True)
    sizes = np.frombuffer(row["sizes"], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    column = pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    block = Block(column)
    block.lower()
    return block


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Sorted hashes fall into partitions in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    """Integers of eight bytes, compressed by place: high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _expand(packed: bytes | pa.Buffer, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _sizes(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions that sorted hashes fall into, and where each begins (one more edge at the end)."""
    own = _part(hashes, parts)
    edges = np.flatnonzero(np.diff(own, prepend=-1))
    return own[edges], np.append(edges, len(own))


def _wanted(words: Words, hashes: np.ndarray, width: int, alive: np.ndarray | None):
    """First word and hash of the n-grams that can occur in another document.

    ``alive`` marks where an n-gram of one word less begins that another document has; an n-gram
    whose two shorter halves are not both such is in no other document either.
    """
    n = max(len(hashes) - width + 1, 0)
    at = np.flatnonzero(words.text[:n] == words.text[width - 1 :])
    if alive is not None:
        at = at[alive[at] & alive[at + 1]]
    return at, hashes[at] if width == 1 else words.run_hash(hashes, at, width)


def _elsewhere(words, at, hashes, tables: dict[int, bytes], parts: int) -> np.ndarray:
    """How often other documents have each n-gram, from the totals of its partitions."""
    distinct, entry = np.unique(hashes, return_inverse=True)
    own, edges = _sizes(distinct, parts)
    total = [
        _expand(tables[p], int(n)) for p, n in zip(own.tolist(), np.diff(edges))
    ] or [np.zeros(0, np.uint64)]
    total = np.concatenate(total)[entry].astype(np.int64)
    return total - _per_text(words, at, entry, len(distinct) + 1)


def _counts_elsewhere(
    block: Block, upto: int, tables: dict[int, dict[int, bytes]], parts: int
) -> tuple[Words, np.ndarray, list[np.ndarray]]:
    """Words, their hashes, and for each width up to ``upto`` the count in other documents of the
    n-gram that begins at each word."""
    words = block.words(UNSPACED)
    hashes = words.hashes()
    found: list[np.ndarray] = []
    for width in range(1, upto + 1):
        at, grams = _wanted(words, hashes, width, found[-1] > 0 if found else None)
        counts = np.zeros(len(hashes) + 1, np.int64)
        counts[at] = _elsewhere(words, at, grams, tables.get(width, {}), parts)
        found.append(counts)
    return words, hashes, found


def _with_tables(blocks: DataFrame, totals: DataFrame | None) -> DataFrame:
    """The blocks, each with the totals of its n-grams so far."""
    empty = F.array().cast("array<struct<width:int,part:int,totals:binary>>")
    if totals is None:
        return blocks.withColumn("tables", empty)
    per_block = totals.groupBy("block").agg(
        F.collect_list(F.struct("width", "part", "totals")).alias("tables")
    )
    return blocks.join(per_block, "block", "left").withColumn("tables", F.coalesce("tables", empty))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, dict]]:
    for batch in batches:
        for row in range(batch.num_rows):
            record = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
            tables: dict[int, dict[int, bytes]] = {}
            for t in record.pop("tables"):
                tables.setdefault(t["width"], {})[t["part"]] = t["totals"]
            yield record, _unpack(record), tables


def _alive(words, hashes, width: int, tables: dict[int, bytes], parts: int) -> np.ndarray:
    """Where an n-gram begins that another document has, by the totals of this width.

    Among these are the marks of the width before, by which the block chose what to send.
    """
    before = None
    for part, packed in tables.items():
        if part < 0:
            raw = pa.Codec("zstd").decompress(packed, len(hashes) // 8 + 1, asbytes=True)
            before = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(hashes) + 1) > 0
    at, grams = _wanted(words, hashes, width, before)
    alive = np.zeros(len(hashes) + 1, bool)
    alive[at] = _elsewhere(words, at, grams, tables, parts) > 0
    return alive


def _marks(block: int, alive: np.ndarray, parts: int) -> pa.RecordBatch:
    """The marks as an entry of a part below 0, which comes back as it is; dealt over all parts."""
    marks = pa.Codec("zstd", 1).compress(np.packbits(alive).tobytes(), asbytes=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([-1 - (block >> 32) % parts], pa.int32()),
         pa.array([marks], pa.binary()), pa.array([b""], pa.binary())], _names(_ENTRIES),
    )


def _entries(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """What each block sends to the count table of one width, a row for each partition it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for record, block, tables in _records(batches):
            words = block.words(UNSPACED)
            hashes = words.hashes()
            alive = None
            if width > 1:
                alive = _alive(words, hashes, width - 1, tables.get(width - 1, {}), parts)
                yield _marks(record["block"], alive, parts)
            grams = _wanted(words, hashes, width, alive)[1]
            distinct, counts = np.unique(grams, return_counts=True)
            own, edges = _sizes(distinct, parts)
            spans = [slice(*edges[i : i + 2]) for i in range(len(own))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), record["block"])), pa.array(own.astype(np.int32)),
                 pa.array([_squeeze(np.diff(distinct[s], prepend=np.uint64(0))) for s in spans],
                          pa.binary()),
                 pa.array([np.int64(s.stop - s.start).tobytes() + codec.compress(
                     counts[s].astype("<u4").tobytes(), asbytes=True) for s in spans],
                     pa.binary())], _names(_ENTRIES),
            )

    return rows.mapInArrow(run, _ENTRIES)


def _totals(entries: DataFrame, width: int) -> DataFrame:
    """The entries with the counts of the whole corpus in place of their block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        key = None
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def table() -> pa.RecordBatch:
            distinct, place = np.unique(
                np.concatenate([h for _, h, _ in held]), return_inverse=True
            )
            counts = np.concatenate([c for _, _, c in held])
            total = np.bincount(place, counts, len(distinct)).astype("<u8")[place]
            stops = np.cumsum([len(h) for _, h, _ in held])[:-1]
            done = pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in held]),
                 pa.array(np.full(len(held), width, np.int32)),
                 pa.array(np.full(len(held), key, np.int32)),
                 pa.array([_squeeze(t) for t in np.split(total, stops)], pa.binary())],
                _names(_TOTALS),
            )
            held.clear()
            return done

        for batch in batches:
            for block, part, steps, counts in zip(*batch.columns):
                now = part.as_py()
                if now < 0:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.as_py()]), pa.array([width], pa.int32()),
                         pa.array([now], pa.int32()), pa.array([steps.as_py()], pa.binary())],
                        _names(_TOTALS),
                    )
                    continue
                if now != key and held:
                    yield table()
                key = now
                packed = counts.as_py()
                n = int.from_bytes(packed[:8], "little")
                raw = codec.decompress(packed[8:], 4 * n, asbytes=True)
                hashes = np.cumsum(_expand(steps.as_buffer(), n), dtype=np.uint64)
                held.append((block.as_py(), hashes, np.frombuffer(raw, "<u4")))
        if held:
            yield table()

    return entries.repartition("part").sortWithinPartitions("part").mapInArrow(run, _TOTALS)


def _per_text(words: Words, at: np.ndarray, entry: np.ndarray, n: int) -> np.ndarray:
    """How often each n-gram's text has this n-gram."""
    own = np.ones(len(entry), np.int64)
    again = np.flatnonzero(np.bincount(entry, minlength=n)[entry] > 1)
    key = words.text[at[again]] * np.int64(n) + entry[again]
    _, place, many = np.unique(key, return_inverse=True, return_counts=True)
    own[again] = many[place]
    return own


SCORE = "doc_id bigint, n_words bigint, n_backoff bigint, n_unseen bigint, log_score double"


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row: ``doc_id, n_words, n_backoff, n_unseen, log_score, perplexity``.

    Words are runs of non-blanks with A-Z lowered. A word is scored by the longest history of up to
    ``order - 1`` words with which another document has it: its count over the history's, times
    ``BACKOFF`` for each shortening; the shortest score is the word's count over the number of
    words, and a word that no other document has counts as one. ``n_backoff`` counts words scored
    with less than the history they have. Null, empty and blank texts have no words, score 0 and a
    null perplexity. Rows are documents of their own even if they are equal, so that each is seen
    in the other; other columns are not looked at; an empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(PARTITIONS, -(-size // PARTITION_BYTES))
    blocks = packed_blocks(docs)
    totals = now = None
    for width in range(1, order + 1):
        now = materialize(
            _totals(_entries(_with_tables(blocks, now), width, parts), width), "ngram-totals"
        )
        counts = now.filter("part >= 0")
        totals = counts if totals is None else totals.union(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record, block, tables in _records(batches):
            words, _, found = _counts_elsewhere(block, order, tables, parts)
            logs, backoffs, unseen = _score_block(words, found, record["n_total"])
            ids = np.frombuffer(record["doc_ids"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~np.frombuffer(record["known"], bool)),
                 pa.array(words.count), pa.array(backoffs), pa.array(unseen), pa.array(logs)],
                _names(SCORE),
            )

    n_total = blocks.agg(F.sum("n_words")).first()[0] or 0
    rows = _with_tables(blocks, totals).withColumn("n_total", F.lit(n_total))
    return rows.mapInArrow(run, SCORE).withColumn(
        "perplexity",
        F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))),
    )


def _score_block(words: Words, found: list[np.ndarray], n_total: int):
    """Sums for each text of a block, given the counts elsewhere of the n-grams at each word."""
    order = len(found)
    n_words, n = len(words.text), words.block.n
    position = np.arange(n_words) - words.first[words.text]
    logs = np.zeros(n_words)
    done = np.zeros(n_words, bool)
    backed = np.zeros(n_words, np.int64)
    for width in range(order, 0, -1):
        at = np.flatnonzero(found[width - 1][:n_words] > 0) if width > 1 else np.arange(n_words)
        end = at + width - 1
        at, end = at[~done[end]], end[~done[end]]
        elsewhere = found[width - 1][at]
        if width > 1:
            history = found[width - 2][at]
        else:
            history = np.maximum(n_total - words.count, 1)[words.text[end]]
            elsewhere = np.maximum(elsewhere, 1)
        steps = np.minimum(position[end], order - 1) - (width - 1)
        logs[end] = np.log(elsewhere) - np.log(history) + steps * np.log(BACKOFF)
        backed[end] = steps > 0
        done[end] = True
    single = found[0][:n_words]
    return (
        np.bincount(words.text, logs, n).astype(float),
        np.bincount(words.text, backed, n).astype(np.int64),
        np.bincount(words.text, single <= 0, n).astype(np.int64),
    )
