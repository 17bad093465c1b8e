"""Quality rules that vote or abstain, weighed by expectation-maximisation.

No rule decides alone. Each one says good (1), bad (-1) or nothing (0) of a document; how often a
rule that speaks is right about good and about bad documents is estimated from all documents
without labels, and the posterior probability of being good replaces the demand that all rules
pass. A rule that turns down many documents which the others praise is found to be unreliable and is
overruled. Documents with the same votes are alike to the model, so it sees one row for each pattern
of votes: at most three to the number of rules, however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roundscope.llm.blocks import UNSPACED, Block, mix, slices
from roundscope.session import materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WORDS = 5

STATS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_lines bigint, n_upper bigint, n_letters bigint, n_distinct bigint"
)

ROUNDS = 200
#: Bytes of text that votes are taken from at once.
PIECE_BYTES = 512 << 10
#: Before any document is seen, a rule is taken to be right about this share of the good and of the
#: bad documents it speaks of. That weighs as much as ``PSEUDO`` documents and no more.
BELIEF_GOOD, BELIEF_BAD, PSEUDO = 0.9, 0.5, 4
#: First guess of being good by the number of votes against: none, one, or two and more that agree.
FIRST_GUESS = (0.9, 0.6, 0.1)


def _repeated(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which entries share their (text, value) with another."""
    key = mix(values + mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _later(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of the same text."""
    key = mix(values + mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    later = np.zeros(len(key), bool)
    later[order[1:][ordered[1:] == ordered[:-1]]] = True
    return later


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """The figures of :data:`STATS` for each text of a block."""
    data, n = block.bytes, block.n
    words = block.words(UNSPACED)
    prefix = block.prefix_hashes()
    hashes = words.hashes(prefix)
    out = {
        "n_words": words.count,
        "word_chars": block.per_text(UNSPACED[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(SYMBOLS[data]),
        "n_upper": block.per_text((data >= 0x41) & (data <= 0x5A)),
        "n_letters": block.per_text(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)),
    }
    # Lines: from the start of a text or after a line feed, up to the next or the text's end.
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    text = np.searchsorted(block.offsets, start, "right") - 1
    end = np.append(start[1:], len(data))
    if len(data):
        end -= (end > start) & (data[np.maximum(end, 1) - 1] == 0x0A)
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[filled], end[filled], text[filled]
    again = _later(text, Block.span_hash(prefix, start, end))
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = np.bincount(text[again], minlength=n)
    at, runs = words.windows(hashes, REPEAT_WORDS)
    at = at[_repeated(words.text[at], runs)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WORDS, -1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(words.text[covered], minlength=n)
    out["n_distinct"] = np.bincount(
        words.text[~_later(words.text, hashes)], minlength=n
    )
    return out


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of figures for each document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in STATS.split(",")]
        for piece in slices(batches, "text", PIECE_BYTES):
            found = block_stats(Block(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64())]
                + [pa.array(found[name].astype(np.int64)) for name in names[1:]],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, STATS)


def with_stats(docs: DataFrame, name: str) -> DataFrame:
    """The rows as they are, and their figures in one more column, a struct called ``name``."""
    fields = T.StructType.fromDDL(STATS).fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            found = block_stats(Block(piece.column("text")))
            stats = pa.StructArray.from_arrays(
                [pa.array(found[f.name].astype(np.int64)) for f in fields],
                [f.name for f in fields],
            )
            yield pa.RecordBatch.from_arrays([*piece.columns, stats], [*piece.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(fields))])
    return docs.mapInArrow(run, schema)


def _vote(bad: Column, good: Column) -> Column:
    """-1, 1 or, where neither holds, 0."""
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(stat: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The vote of each rule as a column of -1, 0 or 1; ``stat`` gives the column of a figure.

    Every rule can speak for a document as well as against it, and abstains between the two bounds
    or where a text is too short to tell. ``variety`` compares logarithms of the numbers of distinct
    and of all words, as their plain ratio falls with the length of any text.
    """

    def ratio(part: str, whole: str) -> Column:
        return stat(part) / F.greatest(stat(whole), F.lit(1))

    words, lines = stat("n_words"), stat("n_lines")
    mean_word = ratio("word_chars", "n_words")
    symbols = ratio("n_symbols", "n_words")
    marks = ratio("n_symbols", "word_chars")
    dup_lines = ratio("n_dup_lines", "n_lines")
    repeats = ratio("n_repeat_words", "n_words")
    upper = ratio("n_upper", "n_letters")
    variety = F.log(F.greatest(stat("n_distinct"), F.lit(1))) / F.log(F.greatest(words, F.lit(2)))
    long = words >= 10
    return {
        "length": _vote(words < 50, words >= 100),
        "word_length": _vote((mean_word < 3) | (mean_word > 10), mean_word.between(4, 8)),
        "symbols": _vote(symbols > 0.1, long & (symbols < 0.02)),
        "marks": _vote(long & (marks > 0.03), long & (marks < 0.005)),
        "dup_lines": _vote((lines >= 4) & (dup_lines > 0.3), (lines >= 4) & (dup_lines < 0.1)),
        "repeats": _vote(repeats > 0.2, (words >= 30) & (repeats < 0.05)),
        "capitals": _vote(long & (upper > 0.3), long & (upper < 0.1)),
        "variety": _vote((words >= 20) & (variety < 0.75), (words >= 20) & (variety > 0.85)),
    }


def _failed(stat: Callable[[str], Column]) -> Column:
    return (stat("n_words") < 10) | (100 * stat("n_repeat_words") > 20 * stat("n_words"))


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of good documents, and log-odds of each rule's three votes, by EM.

    ``patterns`` has a row of votes for each pattern, ``counts`` how many documents show it. Given
    whether a document is good, rules that speak are right independently of each other; a rule that
    abstains tells nothing. The first guess doubts documents that two rules agree against, and
    leaves open what a single rule says; from there on estimated accuracies decide.
    """
    n_rules = patterns.shape[1]
    if not counts.sum():
        return 0.5, np.zeros((n_rules, 3))
    against, favour = (patterns < 0).astype(float), (patterns > 0).astype(float)
    good = np.asarray(FIRST_GUESS)[np.minimum(against.sum(axis=1), 2).astype(int)]
    for _ in range(ROUNDS):
        share = ((counts * good).sum() + 2) / (counts.sum() + 4)
        heard = (counts * good) @ (against + favour)
        right = ((counts * good) @ favour + BELIEF_GOOD * PSEUDO) / (heard + PSEUDO)
        heard = (counts * (1 - good)) @ (against + favour)
        caught = ((counts * (1 - good)) @ against + BELIEF_BAD * PSEUDO) / (heard + PSEUDO)
        odds = np.stack([
            np.log(1 - right) - np.log(caught), np.zeros(n_rules),
            np.log(right) - np.log(1 - caught),
        ], axis=1)
        logit = math.log(share / (1 - share)) + against @ odds[:, 0] + favour @ odds[:, 2]
        now = 1 / (1 + np.exp(-logit))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return share, odds


def estimate(stats: DataFrame) -> tuple[float, dict[str, tuple[float, ...]]]:
    """Fit the model to the votes on all rows of ``stats``: share of good, odds of each vote."""
    votes = rules()
    # At most 3 ** 8 patterns, whatever the number of documents.
    seen = stats.groupBy(*[v.alias(n) for n, v in votes.items()]).count().collect()
    seen = sorted(tuple(r) for r in seen)
    patterns = np.array([r[:-1] for r in seen], int).reshape(-1, len(votes))
    share, odds = fit(patterns, np.array([r[-1] for r in seen], float))
    return float(share), {n: tuple(o) for n, o in zip(votes, odds.tolist())}


def posterior(model: tuple[float, dict], stat: Callable[[str], Column] = F.col) -> Column:
    """Probability that a document is good, from its votes."""
    share, odds = model
    logit = F.lit(math.log(share / (1 - share)))
    for name, vote in rules(stat).items():
        bad, none, good = odds[name]
        logit = logit + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    return 1 / (1 + F.exp(-logit))


def label(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Figures, votes, posterior quality and verdict of each document.

    Null and empty texts have no words and fail the base rule; repeated rows each get a row; other
    columns are not looked at. An empty table gives an empty result. ``kept`` is false for a
    document of under ten words or with over a fifth of its words in repeated runs, else whether
    the posterior reaches ``threshold``.
    """
    stats = materialize(document_stats(docs), "quality-stats")
    return (
        stats.select(
            "*", *[v.alias(f"vote_{n}") for n, v in rules().items()],
            posterior(estimate(stats)).alias("posterior"), _failed(F.col).alias("base_failed"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that the rules keep (see :func:`label`), with the columns they came with.

    Rows with a null or empty text go; repeated rows and rows without a doc_id are judged like any
    other; an empty table stays empty. Columns of any name pass through.

    The figures are taken twice, once to fit the model and once beside the text, as that moves no
    text between executors.
    """
    name = "_stats"
    while name in docs.columns:
        name += "_"

    def stat(figure: str) -> Column:
        return F.col(f"{name}.{figure}")

    model = estimate(document_stats(docs))
    good = ~_failed(stat) & (posterior(model, stat) >= threshold)
    return with_stats(docs, name).filter(good).select(*[f"`{c}`" for c in docs.columns])
