"""Near-duplicates by SetSketch registers: banded, estimated jointly, then verified.

A register keeps the least of exponentially distributed values of a document's shingles on a
logarithmic scale, cut off at both ends; the registers of a union are the larger of each pair.
Registers of similar sets agree often, so bands of them are buckets of candidates; for a candidate
pair, how many registers are larger on either side gives the likelihood of each similarity, and
pairs whose best estimate is hopeless go no further. The rest are compared on their full sets.

Documents with equal shingle sets are one class from the start. Each bucket has a centre, the class
that meets most others in its buckets: the text that copies were made from. A class is compared with
the most met of its centres, and with the others only where that has not joined them. Classes that
no link has joined yet are told from the classes of other components by what sets them apart from a
centre of theirs: two that are linked, though not both with the centre, have some of these
differences in common. Rare differences come first, and only as many are looked at as one in common
must be among. Links between components are all found while pairs inside one, and nearly all pairs
that cannot be linked, are not made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.llm.blocks import UNSPACED, Block, slices
from roundscope.llm.components import stars
from roundscope.session import broadcast_if_bounded, materialize

SHINGLE = 5
ROWS = 4
#: Bands down to a similarity of 0.85, and below it (two texts at 0.8 share no band about once in
#: 2.6 million pairs, as at 0.85 with the fewer bands).
BANDS, MORE_BANDS = 20, 28
REGISTERS = BANDS * ROWS
#: Base of the logarithmic scale and largest register.
SCALE, TOP = 1.02, 4095
#: A pair goes on if its estimated similarity is not this far (in similarity) below the threshold:
#: over five standard deviations of the estimate, which is 0.04 at 0.85 with 80 registers.
SLACK = 0.25
#: Bytes of text whose shingles are made at once.
PIECE_BYTES = 512 << 10
#: Members of one centre that are compared in one group.
GROUP = 500
#: Shingles are counted in so many cells (as a power of 2) to tell rare ones from common ones. Only
#: the order of differences depends on it, no result.
CELL_BITS = 16
#: Wanted documents or classes are marked in so many cells (as a power of 2, 2 MB of bits in rows of
#: 4 KB) before texts or sets are shuffled to them. What passes is joined exactly, so no result depends on them.
MARK_BITS, MARKS_A_ROW = 24, 15

_RANDOM = np.random.Generator(np.random.PCG64(7_2024))
_DRAWN = [
    (_RANDOM.integers(0, 2**64, n, dtype=np.uint64),
     _RANDOM.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    for n in (REGISTERS, (MORE_BANDS - BANDS) * ROWS)
]
_FLIP, _SPREAD = (np.concatenate(part) for part in zip(*_DRAWN))


def bands_for(hundredths: int) -> int:
    return BANDS if hundredths >= 85 else MORE_BANDS


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer words than five, the whole sequence."""
    block = Block(column)
    block.lower()
    words = block.words(UNSPACED)
    hashes = words.hashes()
    at, runs = words.windows(hashes, SHINGLE)
    many = np.maximum(words.count - SHINGLE + 1, 0)
    ends = np.cumsum(many)
    out = []
    for text in range(block.n):
        count, first = int(words.count[text]), int(words.first[text])
        if count >= SHINGLE:
            out.append(np.unique(runs[ends[text] - many[text] : ends[text]]))
        elif count:
            out.append(words.run_hash(hashes, np.array([first]), count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], n: int = REGISTERS) -> np.ndarray:
    """``n`` registers of each set, a row for each; those of an empty set are 0."""
    registers = np.zeros((len(sets), n), np.uint16)
    filled = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(filled):
        return registers
    values = np.concatenate(sets)
    sizes = np.array([len(sets[i]) for i in filled])
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(filled), n), np.uint64)
    for i in range(n):
        spread = values ^ _FLIP[i]
        spread *= _SPREAD[i]
        np.minimum.reduceat(spread, starts, out=least[:, i])
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    level = np.floor(1 - np.log(exponential) / np.log(SCALE))
    registers[filled] = np.clip(level, 1, TOP)
    return registers


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, class binary, registers binary"


def sketches(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """Per document: size of its shingle set, a digest of the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            sets = shingle_sets(piece.column("text"))
            registers = sketch(sets, bands * ROWS)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([digest(s) for s in sets], pa.binary()),
                 pa.array([r.astype("<u2").tobytes() for r in registers], pa.binary())],
                ["doc_id", "n_shingles", "class", "registers"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH_SCHEMA)


def buckets(classes: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """``bucket, class`` for each band of a class's registers."""
    size = 2 * ROWS
    bands = F.array(*[
        F.xxhash64(F.lit(band), F.substring("registers", band * size + 1, size))
        for band in range(n_bands)
    ])
    return classes.select(F.explode(bands).alias("bucket"), "class")


def _equal_share(x: np.ndarray) -> np.ndarray:
    """Chance that one register exceeds another, by the share that is on its side alone."""
    return -np.log1p(-x * (SCALE - 1) / SCALE) / np.log(SCALE)


def likeliest(
    above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n: int = REGISTERS
) -> np.ndarray:
    """Similarity of the greatest likelihood, given in how many of ``n`` registers a and b are larger.

    ``n_a`` and ``n_b`` are the sizes of the sets. The logarithm of the likelihood has one top; it
    is closed in on by thirds.
    """
    share_a, share_b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    equal = n - above - below

    def value(j: np.ndarray) -> np.ndarray:
        over = np.clip(_equal_share(share_a - share_b * j), 1e-12, 1)
        under = np.clip(_equal_share(share_b - share_a * j), 1e-12, 1)
        same = np.clip(1 - over - under, 1e-12, 1)
        return above * np.log(over) + below * np.log(under) + equal * np.log(same)

    low = np.zeros(len(above))
    high = np.minimum(share_a / share_b, share_b / share_a)
    for _ in range(40):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        better = value(left) < value(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose jointly estimated similarity is at least ``least``."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("class").alias(name), F.col("n_shingles").alias(f"n_{name}"),
            F.col("registers").alias(f"r_{name}"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue

            def registers(name: str) -> np.ndarray:
                joined = b"".join(batch.column(name).to_pylist())
                return np.frombuffer(joined, "<u2").reshape(batch.num_rows, -1)

            r_a, r_b = registers("r_a"), registers("r_b")
            n_a, n_b = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b")
            )
            best = likeliest((r_a > r_b).sum(1), (r_a < r_b).sum(1), n_a, n_b, r_a.shape[1])
            yield batch.select(["a", "b"]).filter(pa.array(best >= least))

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(run, "a binary, b binary")


def marked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` shares its cell with one of ``wanted``: all that are wanted,
    and of the others about the share of cells that are marked."""
    kind = wanted.schema[key].dataType

    def spot(rows: DataFrame) -> DataFrame:
        cell = F.shiftrightunsigned(F.xxhash64(F.col(key).cast(kind)), 64 - MARK_BITS)
        return rows.withColumns({
            "_row": F.shiftright(cell, MARKS_A_ROW),
            "_bit": cell.bitwiseAND(F.lit((1 << MARKS_A_ROW) - 1)),
        })

    marks = spot(wanted.select(key)).groupBy("_row").agg(
        F.bitmap_construct_agg("_bit").alias("_marks")
    )
    byte = F.substring("_marks", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    met = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), F.pmod("_bit", F.lit(8)))
    near = spot(df).join(
        broadcast_if_bounded(marks, 1 << (MARK_BITS - MARKS_A_ROW)), "_row"
    )
    return near.filter(met == 1).select(*[f"`{c}`" for c in df.columns])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, shingles`` of the wanted classes, taken from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            sets = shingle_sets(piece.column("text"))
            same = [digest(s) == c.as_py() for s, c in zip(sets, piece.column("class"))]
            kept = [i for i, ok in enumerate(same) if ok]
            yield pa.RecordBatch.from_arrays(
                [piece.column("class").take(pa.array(kept, pa.int64())),
                 pa.array([sets[i].astype("<u8").tobytes() for i in kept], pa.binary())],
                ["class", "shingles"],
            )

    rows = marked(docs.select("doc_id", "text"), wanted, "doc_id").join(
        wanted.select("doc_id", "class"), "doc_id"
    )
    # A doc_id that repeats with one text gives one set more than once.
    sets = rows.select("class", "text").mapInArrow(run, "class binary, shingles binary")

    def nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            found = [s for s in shingle_sets(piece.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in found], pa.binary()),
                 pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())],
                ["class", "shingles"],
            )

    # Classes that no row with a doc_id is in are found by their digest.
    without = docs.filter("doc_id is null").select("text").mapInArrow(
        nameless, "class binary, shingles binary"
    ).join(wanted.filter("doc_id is null").select("class"), "class", "left_semi")
    return sets.unionByName(without.groupBy("class").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The pairs ``a, b`` with ``100 * intersection >= hundredths * union`` on full sets.

    The partners of a class ``a`` come to it in groups of about ``GROUP``, each led by the set of
    ``a`` itself, and stream past it: no group has to fit anywhere as a whole. A pair may come out
    more than once.
    """
    groups = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select(
        "a", F.ceil(F.col("n") / GROUP).cast("int").alias("groups")
    )
    led = groups.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"),
        F.col("a").alias("class"), F.lit(0).alias("rank"),
    )
    partners = pairs.join(groups, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"),
        F.col("b").alias("class"), F.lit(1).alias("rank"),
    )
    both = pairs.select(F.col("a").alias("class")).union(pairs.select("b"))
    rows = led.union(partners).join(marked(sets, both, "class"), "class").select("a", "part", "rank", "class", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for a, rank, b, shingles in zip(*(
                batch.column(c) for c in ("a", "rank", "class", "shingles")
            )):
                values = np.frombuffer(shingles.as_buffer(), "<u8")
                if rank.as_py() == 0:
                    leader, lead = a.as_py(), values
                    continue
                if a.as_py() != leader:
                    raise ValueError("a group without its leader")
                at = np.minimum(np.searchsorted(lead, values), len(lead) - 1)
                common = int((lead[at] == values).sum())
                if 100 * common >= hundredths * (len(lead) + len(values) - common):
                    found.append((leader, b.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.binary()),
                 pa.array([y for _, y in found], pa.binary())], ["a", "b"],
            )

    streamed = rows.repartition("a", "part").sortWithinPartitions("a", "part", "rank")
    return streamed.mapInArrow(run, "a binary, b binary")


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles * _SPREAD[0]) >> np.uint64(64 - CELL_BITS)


def commonness(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each of ``2 ** CELL_BITS`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for piece in slices([batch], "shingles", PIECE_BYTES):
                values = np.frombuffer(b"".join(piece.column("shingles").to_pylist()), "<u8")
                seen += np.bincount(_cell(values), minlength=len(seen))
        filled = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled), pa.array(seen[filled])], ["cell", "n"]
        )

    counted = sets.select("shingles").mapInArrow(run, "cell bigint, n bigint").groupBy(
        "cell"
    ).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out


def edits(centred: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """``meet, class, root, n, x, left``: the first differences of each class from its centres.

    ``centred`` has ``class, root, a``, a class, its component and a centre. Differences are the
    shingles in one set only, rare ones first; ``meet`` stands for one of them and the centre, ``x``
    is their number, ``left`` how many there are from this one on, ``n`` the size of the class's set.
    Two classes with a link differ in at most ``(100 - hundredths) / (100 + hundredths)`` of the sum
    of their sizes, so those left out cannot be the first that they have in common.
    """
    common = sets.sparkSession.sparkContext.broadcast(commonness(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch], "shingles", PIECE_BYTES):
                met, many, sizes, left = [], [], [], []
                for key, own, centre in zip(*(
                    piece.column(c) for c in ("key", "shingles", "centre")
                )):
                    mine, other = (np.frombuffer(x.as_buffer(), "<u8") for x in (own, centre))
                    added = np.setdiff1d(mine, other, assume_unique=True)
                    removed = np.setdiff1d(other, mine, assume_unique=True)
                    # What most classes have, few have removed.
                    added = added[np.lexsort((added, common.value[_cell(added)]))]
                    removed = removed[np.lexsort((removed, -common.value[_cell(removed)]))]
                    differ = np.concatenate([added, removed])
                    first = differ[: len(mine) * (100 - hundredths) // hundredths + 1]
                    met.append((first * _SPREAD[1]).view(np.int64) ^ np.int64(key.as_py()))
                    many.append(len(first))
                    sizes.append((len(mine), len(differ)))
                    left.append(len(differ) - np.arange(len(first)))
                at = np.repeat(np.arange(piece.num_rows), many)
                n, x = np.array(sizes, np.int64).reshape(-1, 2)[at].T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(met)), piece.column("class").take(pa.array(at)),
                     piece.column("root").take(pa.array(at)), pa.array(n), pa.array(x),
                     pa.array(np.concatenate(left))],
                    ["meet", "class", "root", "n", "x", "left"],
                )

    of_centres = marked(sets, centred.select(F.col("a").alias("class")), "class").select(
        F.col("class").alias("a"), F.col("shingles").alias("centre")
    )
    both = centred.join(marked(sets, centred, "class"), "class").join(of_centres, "a")
    return both.select(
        F.xxhash64("a").alias("key"), "class", F.xxhash64("root").alias("root"), "shingles", "centre"
    ).mapInArrow(
        run, "meet bigint, class binary, root bigint, n bigint, x bigint, left bigint"
    )


def alike(edited: DataFrame, hundredths: int) -> DataFrame:
    """The pairs ``a, b`` of classes in different components whose differences from one centre
    leave a link possible: enough of them would have to be common to both."""

    def side(name: str) -> DataFrame:
        return edited.select("meet", *[
            F.col(c).alias(f"{c}_{name}") for c in ("class", "root", "n", "x", "left")
        ])

    both = 100 + hundredths
    # Twice the common differences that a link takes, in units of ``both``.
    needed = both * (F.col("x_a") + F.col("x_b")) - (100 - hundredths) * (
        F.col("n_a") + F.col("n_b")
    )
    return side("a").join(side("b"), "meet").filter(
        (F.col("class_a") < F.col("class_b")) & (F.col("root_a") != F.col("root_b"))
        & (2 * both * F.least("left_a", "left_b") >= needed)
        & (100 * F.least("n_a", "n_b") >= hundredths * F.greatest("n_a", "n_b"))
    ).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, hundredths: int = 85) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * |A & B| >= hundredths * |A | B|`` on their sets of five-word
    shingles; ``component_id`` is the least doc_id that links lead to. Null, empty and blank texts
    have no shingles and stay alone. Rows that share a doc_id are told apart by their text; equal
    rows get equal results. Other columns are not looked at; an empty table gives an empty result.
    """
    bands = bands_for(hundredths)
    rows = materialize(sketches(docs, bands), "sketches")
    classes = materialize(
        rows.filter("n_shingles > 0").groupBy("class").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
        ), "classes",
    )
    banded = buckets(classes, bands)
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(banded.join(shared, "bucket"), "bucket-members")
    met = members.groupBy("class").agg(F.sum("n").alias("met"))
    centres = materialize(members.join(met, "class").groupBy("bucket").agg(
        F.max(F.struct("met", F.col("class").alias("a"))).alias("centre")
    ).select("bucket", "centre.*"), "bucket-centres")
    least = hundredths / 100 - SLACK
    # Each class meets one centre at first, the one that meets most others.
    one_each = members.join(centres, "bucket").filter(F.col("class") != F.col("a")).groupBy(
        F.col("class").alias("b")
    ).agg(F.max(F.struct("met", "a"))["a"].alias("a")).select("a", "b")
    first = materialize(estimated(one_each, classes, least), "candidates")
    wanted = members.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    sets = materialize(full_sets(docs, wanted), "shingle-sets")
    links = materialize(verified(first, sets, hundredths).distinct(), "links")
    # A class has one centre here, which may have one too. Two classes with one root are in one
    # component; of two in one component that have not, some are compared without need.
    centre = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = materialize(centre.join(
        links.select(F.col("b").alias("root"), F.col("a").alias("next")), "root", "left"
    ).select("node", F.coalesce("next", "root").alias("root")), "roots")

    def placed_classes() -> DataFrame:
        return members.select("bucket", "class").join(
            roots.withColumnRenamed("node", "class"), "class", "left"
        ).select("bucket", "class", F.coalesce("root", "class").alias("root"))

    # Then the centres of its other buckets, where it is not linked with them yet.
    led = centres.select("bucket", "a").join(
        roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left"
    ).select("bucket", "a", F.coalesce("root_a", "a").alias("root_a"))
    others = materialize(placed_classes().join(led, "bucket").filter(
        F.col("root") != F.col("root_a")
    ).select("a", F.col("class").alias("b")).distinct(), "other-centres")
    other = materialize(estimated(others, classes, least), "candidates")
    hung = stars(links.unionByName(verified(other, sets, hundredths)))
    roots = hung.select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = first.union(others)
    # Classes of one bucket that are in different components, and have not been compared yet.
    rest = placed_classes().join(centres.select("bucket", "a"), "bucket").filter(
        F.col("class") != F.col("a")
    )
    mixed = rest.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high")
    ).filter("low != high").select("bucket")
    centred = materialize(
        rest.join(mixed, "bucket").select("class", "root", "a").distinct(), "open-classes"
    )
    edited = materialize(edits(centred, sets, hundredths), "edits")
    across = alike(edited, hundredths).join(
        first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")),
        ["a", "b"], "left_anti",
    )
    second = materialize(estimated(across, classes, least), "candidates")
    joined = stars(hung.unionByName(verified(second, sets, hundredths)))
    named = classes.select("class", "doc_id").join(
        joined.select(F.col("a").alias("class"), F.col("b").alias("root")), "class", "left"
    ).withColumn("root", F.coalesce("root", "class"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(ids, "root").select("class", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", "class").join(labels, "class", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id") == component).alias("kept"),
    )


def representatives(docs: DataFrame, hundredths: int = 85) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id, as it came.

    Rows that share a doc_id are one document here and stay or go together; rows without a doc_id
    stay.
    """
    dropped = near_duplicates(docs, hundredths).groupBy("doc_id").agg(
        F.max("kept").alias("kept")
    ).filter("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
