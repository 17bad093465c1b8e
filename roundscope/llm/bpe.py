"""Byte-level BPE by replaying the merges over the distinct words of a block of texts.

The words of a block lie end to end as a linked list of tokens. An inverted index leads from a
token pair to the places where it stands; merges are taken in rank order, each one joins all places
of its pair at once and looks up only the two pairs that touch a joined place. Words met before in
the same task are not replayed. No row moves between executors: only words repeat across documents,
and joining each occurrence of a word back to a table of words would move many times the text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from roundscope.llm.blocks import joined

BLOCK_BYTES = 2 << 20
#: Words that a task remembers before it starts afresh; memory, not results, depends on it.
KNOWN_WORDS = 200_000
#: Rows that are decoded at once.
DECODED_ROWS = 128

#: Up to so many places of a pair are joined one by one, more as arrays; the result is the same.
FEW_PLACES = 10

_NONE = np.int64(1) << np.int64(40)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in order of rank, from a rank file."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class Merges:
    """All pairs of tokens that make a token, and the replay of their merges."""

    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens)}
        self.tokens, self.rank, self.size = tokens, rank, len(tokens)
        self.single = np.full(256, -1, np.int64)
        for value in range(256):
            self.single[value] = rank[bytes([value])]
        pairs = sorted(
            (rank[a] * self.size + rank[b], i)
            for i, token in enumerate(tokens) for cut in range(1, len(token))
            if (a := token[:cut]) in rank and (b := token[cut:]) in rank
        )
        self.by_code = dict(pairs).get
        self.codes = np.array([code for code, _ in pairs] + [np.iinfo(np.int64).max])
        self.ranks = np.array([r for _, r in pairs] + [_NONE])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], _NONE)

    def one_word(self, word: bytes) -> list[int]:
        """Merge the lowest-ranked pair, the first of equals, until none is left."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(
                range(len(parts) - 1),
                key=lambda i: self.rank.get(parts[i] + parts[i + 1], self.size),
            )
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        ends = np.cumsum(sizes)
        # Place n stands for "none" on either side.
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        filled = ends[sizes > 0]
        after[filled - 1] = n
        starts = (ends - sizes)[sizes > 0]
        before[starts] = n
        token = np.append(token, 0)
        pair = np.full(n + 1, _NONE)
        linked = np.flatnonzero(after[:n] < n)
        pair[linked] = self.pair_ranks(token[linked], token[linked + 1])
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        pending: list[int] = []

        def index(at: np.ndarray) -> None:
            found = pair[at]
            at, found = at[found < _NONE], found[found < _NONE]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for k, rank in enumerate(found[edges[:-1]].tolist()):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(pending, rank)
                places[rank].append(at[edges[k] : edges[k + 1]])

        # The same arrays, for single places.
        v_token, v_after, v_before = memoryview(token), memoryview(after), memoryview(before)
        v_pair, v_alive, size, ranks = memoryview(pair), memoryview(alive), self.size, self.by_code

        def put(at: int, rank: int) -> bool:
            found = v_pair[at] = ranks(v_token[at] * size + v_token[v_after[at]], none)
            if found != none:
                if found not in places:
                    places[found] = []
                    heapq.heappush(pending, found)
                places[found].append(at)
            return found < rank

        none = int(_NONE)
        index(linked)
        odd: list[np.ndarray] = []
        while pending:
            rank = heapq.heappop(pending)
            held = places.pop(rank)
            if sum(1 if type(x) is int else len(x) for x in held) <= FEW_PLACES:
                for at in sorted({int(y) for x in held for y in ((x,) if type(x) is int else x)}):
                    if v_pair[at] != rank:
                        continue
                    gone = v_after[at]
                    beyond, left = v_after[gone], v_before[at]
                    v_token[at], v_after[at] = rank, beyond
                    v_alive[gone], v_pair[gone], v_pair[at] = False, none, none
                    if beyond < n:
                        v_before[beyond] = at
                        if put(at, rank):
                            odd.append(np.array([at]))
                    if left < n and put(left, rank):
                        odd.append(np.array([left]))
                continue
            if len(held) > 1:
                at = np.unique(np.concatenate([[x] if type(x) is int else x for x in held]))
            else:
                at = held[0]
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                # Of places that overlap, as in a run of one token, every second one merges.
                follows = np.zeros(len(at), bool)
                follows[1:] = after[at[:-1]] == at[1:]
                if follows.any():
                    number = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(follows, 0, number))
                    at = at[(number - run) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at] = rank
            after[at] = beyond
            alive[gone] = False
            pair[gone] = _NONE
            inner = beyond < n
            before[beyond[inner]] = at[inner]
            pair[at] = _NONE
            right = at[inner]
            pair[right] = self.pair_ranks(token[right], token[beyond[inner]])
            left = before[at]
            left = left[left < n]
            pair[left] = self.pair_ranks(token[left], token[after[left]])
            touched = np.concatenate([left, right])
            low = touched[pair[touched] < rank]
            if len(low):
                odd.append(low)
            index(touched)
        kept = np.flatnonzero(alive)
        counts = np.bincount(
            np.searchsorted(ends, kept, "right"), minlength=len(words)
        ).astype(np.int64)
        ids = token[kept].astype(np.int32)
        if odd:
            # A pair that ranks below the merge that made it: do such words one merge at a time.
            ids, counts = self._again(words, ids, counts, np.searchsorted(
                ends, np.unique(np.concatenate(odd)), "right"))
        return ids, counts

    def _again(self, words, ids, counts, which):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for w in np.unique(which).tolist():
            parts[w] = np.array(self.one_word(words[w]), np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and how many each id has."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.starts[ids] - (ends - lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, lengths)
        return self.bytes[at], lengths


class _Numbers(dict):
    """Gives each new word the next number and keeps it in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Vocabulary:
    """The words that a process has met, with their ids."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        """Replay the merges on all words that have a number but no ids yet."""
        new = self.number.new
        if new:
            ids, counts = self.merges.replay([w.encode() for w in new])
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts
            self.number.new = []

    def encode(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered words end to end, and where each word's ids end."""
        if not len(numbers):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        source = np.repeat(self.starts[numbers] - (ends - counts), counts)
        source += np.arange(int(ends[-1]))
        return self.ids[source], ends


#: What may stand in a text whose letters and blanks are told apart by ranges alone: ASCII without
#: control characters but tab, line feed and return; and the Latin letters up to U+024F.
_LATIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
_PROPERTIES = {r"\p{L}": "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9"}


def splitter(pattern: str):
    """A function that cuts a text by ``pattern``.

    In texts of Latin letters alone the Unicode properties of the pattern are character ranges,
    which the standard library's engine matches faster; others take the full engine.
    """
    full = regex.compile(pattern).findall
    ranges = re.sub(r"(?<!\[)(?<!\[\^)(?<!\[\^\\s)\\p\{[LN]\}\+", lambda m: f"[{m[0][:-1]}]+", pattern)
    for name, characters in _PROPERTIES.items():
        ranges = ranges.replace(name, characters)
    if r"\p" in ranges or r"\P" in ranges:
        return full
    fast, latin = re.compile(ranges).findall, _LATIN.fullmatch
    return lambda text: fast(text) if latin(text) else full(text)


def _shared(docs: DataFrame, path: str):
    """The rank file's tokens for all executors; its size is that of the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


_known: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The vocabulary of this process; tasks that follow each other in it share what they met."""
    tokens = shared.value
    if id(tokens) not in _known:
        _known.clear()
        _known[id(tokens)] = Vocabulary(Merges(tokens))
    return _known[id(tokens)]


def _encoder(shared, pattern: str):
    """What a task does to batches with ``doc_id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared)
        split = splitter(pattern)
        for piece in joined(batches, "text", BLOCK_BYTES):
            if len(known.number) > KNOWN_WORDS:
                known.forget()
            numbers = [known.numbers(split(t.as_py() or "")) for t in piece.column("text")]
            stops = np.append(0, np.cumsum([len(x) for x in numbers]))
            known.learn()
            ids, ends = known.encode(np.concatenate(numbers))
            offsets = np.append(0, ends).astype(np.int32)[stops]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                names=["doc_id", "ids"],
            )

    return run


def _decoder(shared):
    """What a task does to batches with ``doc_id`` and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _vocabulary(shared).merges
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                piece = batch.slice(at, DECODED_ROWS)
                ids = piece.column("ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                stops = np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(
                    zero_copy_only=False)))
                data, lengths = merges.decode(flat)
                offsets = np.append(0, np.cumsum(lengths))[stops].astype(np.int32)
                decoded = pa.Array.from_buffers(
                    pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), ids, decoded], names=["doc_id", "ids", "decoded"]
                )

    return run


_ENCODED = "doc_id bigint, ids array<int>"
_DECODED = f"{_ENCODED}, decoded binary"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each row, without special tokens.

    Null and empty texts have no ids; every row gives a row, repeated ones too; other columns are
    not looked at. ``pattern`` cuts a text into words, which are encoded each on its own.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _encoder(_shared(docs, path), pattern), _ENCODED
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of :func:`encode` with the bytes that their ids stand for, as ``decoded``."""
    return encoded.mapInArrow(_decoder(_shared(encoded, path)), _DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of :func:`encode`, decoded again in the same Python worker.

    :func:`decode` after :func:`encode` gives the same rows, but holds the vocabulary in two workers
    for each task.
    """
    shared = _shared(docs, path)
    encoder, decoder = _encoder(shared, pattern), _decoder(shared)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: decoder(encoder(batches)), _DECODED
    )
