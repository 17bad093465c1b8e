"""Co-training of a text classifier and a page-metadata classifier for document quality.

Both see the same documents through different features: the text view which words occur, the
metadata view source, language and length. In each round each classifier labels all documents
without a sampled label where it is confident, and the other one trains on these labels too. The
scores of both are calibrated on labelled documents that neither was trained on, and combined as
independent evidence.

Only the labelled sample is bounded (``LABELLED`` ids, chosen by hash, one row each). All other
documents are scored in every round by a Spark job with broadcast weights of fixed size; what comes
back of their pseudo-labels are sums per feature, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundscope.llm.blocks import ALNUM, Block, mix, slices
from roundscope.session import materialize

#: Labelled documents that are gathered; all documents take part without their labels.
LABELLED = 12_000
#: Of this many labelled documents one is held out for calibration.
HELD_OUT = 5
TEXT_FEATURES, META_FEATURES = 1 << 16, 1 << 10
ROUNDS = 3
#: A pseudo-label needs this probability, and counts as so much of a label; all of a round together
#: count as much as the labelled documents at most.
CONFIDENT, PSEUDO = 0.98, 0.5
STEPS, RATE, RIDGE = 300, 0.1, 1e-5
#: Steps of a round, each over all pseudo-labels, that go on from the weights of the round before.
TAUGHT_STEPS = 20
#: Residuals are summed as whole numbers of this unit, so that sums do not depend on their order.
UNIT = 2.0**-20
#: A feature counts if its share differs between the classes by so many standard errors.
LEAST_Z = 4.0


#: Features kept for style: tenths of upper-case letters, of distinct words and of marks.
STYLES = 33


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of each distinct word (hashed) and of each text's style."""
    block = Block(column)
    upper = block.per_text((block.bytes >= 0x41) & (block.bytes <= 0x5A))
    block.lower()
    letters = block.per_text((block.bytes >= 0x61) & (block.bytes <= 0x7A))
    marks = block.per_text(~ALNUM[block.bytes] & (block.bytes > 0x20))
    words = block.words(ALNUM)
    hashed = (words.hashes() % np.uint64(TEXT_FEATURES - STYLES)).astype(np.int64)
    key = np.unique(words.text * TEXT_FEATURES + hashed)
    text, feature = key // TEXT_FEATURES, key % TEXT_FEATURES
    distinct = np.bincount(text, minlength=block.n)
    styles = [
        TEXT_FEATURES - STYLES + 11 * i + (10 * part // np.maximum(whole, 1)).clip(0, 10)
        for i, (part, whole) in enumerate(
            ((upper, letters), (distinct, words.count), (marks, words.count)))
    ]
    text = np.concatenate([text, *[np.arange(block.n)] * 3])
    feature = np.concatenate([feature, *styles])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def meta_features(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashed source, language, both together, and the length in powers of two."""
    n = piece.num_rows
    length = piece.column("length").fill_null(0).to_numpy(zero_copy_only=False)
    size = np.log2(np.maximum(length, 1)).astype(int)
    codes = np.empty((n, 4), np.int64)
    for i, (source, lang) in enumerate(zip(
        piece.column("source").to_pylist(), piece.column("lang").to_pylist()
    )):
        names = (f"s:{source}", f"l:{lang}", f"b:{source}:{lang}", f"n:{size[i]}")
        block = Block(pa.array(names))
        prefix = block.prefix_hashes()
        hashes = Block.span_hash(prefix, block.offsets[:-1], block.offsets[1:])
        codes[i] = (hashes % META_FEATURES).astype(np.int64)
    return np.repeat(np.arange(n), 4), codes.ravel()


class Rows:
    """Sparse rows of ones."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int, width: int):
        self.row, self.feature, self.n, self.width = row, feature, n, width

    @classmethod
    def of(cls, lists: list[np.ndarray], width: int) -> Rows:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        feature = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        return cls(row, feature.astype(np.int64), len(lists), width)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Weights are one per feature, then the constant; long texts count as short ones do."""
        return np.bincount(self.row, weights[self.feature], self.n) + weights[-1]

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        slope = np.bincount(self.feature, residual[self.row], self.width)
        return np.append(slope, residual.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(rows: Rows, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which features are more frequent in one class than chance explains."""
    good, bad = weight * label, weight * (1 - label)
    n_good, n_bad = max(good.sum(), 1.0), max(bad.sum(), 1.0)
    in_good = np.bincount(rows.feature, good[rows.row], rows.width)
    in_bad = np.bincount(rows.feature, bad[rows.row], rows.width)
    return differing(in_good, in_bad, n_good, n_bad)


def differing(
    in_good: np.ndarray, in_bad: np.ndarray, n_good: float, n_bad: float
) -> np.ndarray:
    """:func:`telling` by the sums of each class."""
    share = (in_good + in_bad + 0.5) / (n_good + n_bad + 1)
    error = np.sqrt(share * (1 - share).clip(1e-9) * (1 / n_good + 1 / n_bad))
    return np.abs(in_good / n_good - in_bad / n_bad) >= LEAST_Z * error


def fit_logistic(rows: Rows, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on the telling features, by Adam steps over all rows."""
    weights = np.zeros(rows.width + 1)
    if not weight.sum():
        return weights
    kept = telling(rows, label, weight)
    number = np.cumsum(kept) - 1
    own = kept[rows.feature]
    part = Rows(rows.row[own], number[rows.feature[own]], rows.n, int(kept.sum()))
    small = np.zeros(part.width + 1)
    mean, square = np.zeros_like(small), np.zeros_like(small)
    share = weight / weight.sum()
    for step in range(1, STEPS + 1):
        residual = share * (_sigmoid(part.scores(small)) - label)
        slope = part.gradient(residual) + RIDGE * small
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        small -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights[np.append(kept, True)] = small
    return weights


class Pool:
    """Features of all documents without a sampled label, stored by blocks of documents."""

    def __init__(self, docs: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, "text"):
                text, feature = text_features(piece.column("text"))
                count = np.bincount(text, minlength=piece.num_rows)
                packed = (count.astype("<u4"), feature.astype("<u2"),
                          meta_features(piece)[1].astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in packed],
                    ["counts", "words", "meta"],
                )

        schema = "counts binary, words binary, meta binary"
        self.blocks = materialize(docs.mapInArrow(run, schema), "pool-features")

    def sums(
        self, teachers: list[np.ndarray], students: list[np.ndarray | None] | None = None
    ) -> list[np.ndarray]:
        """Sums over all documents of which the other view is sure, for each view as a student.

        Without students: a row for surely bad and one for surely good documents, with how many have
        each feature, and their number last. With them: one row, the gradient of the students' loss.
        """
        shared = self.blocks.sparkSession.sparkContext.broadcast((teachers, students))
        widths = (TEXT_FEATURES, META_FEATURES)
        rows = 2 if students is None else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            teachers, students = shared.value
            total = [np.zeros((rows, width + 1)) for width in widths]
            for batch in batches:
                for counts, *features in zip(*(c.to_pylist() for c in batch.columns)):
                    counts = np.frombuffer(counts, "<u4")
                    n = len(counts)
                    words, meta = (np.frombuffer(f, "<u2").astype(np.int64) for f in features)
                    number = np.arange(n)
                    views = [Rows(np.repeat(number, counts), words, n, TEXT_FEATURES),
                             Rows(np.repeat(number, 4), meta, n, META_FEATURES)]
                    for student, view in enumerate(views):
                        p = _sigmoid(views[1 - student].scores(teachers[1 - student]))
                        good, bad = p >= CONFIDENT, p <= 1 - CONFIDENT
                        if students is None:
                            for row, sure in enumerate((bad, good)):
                                total[student][row] += view.gradient(sure.astype(float))
                        elif students[student] is not None:
                            residual = _sigmoid(view.scores(students[student])) - good
                            whole = np.rint(np.where(good | bad, residual, 0.0) / UNIT)
                            total[student][0] += view.gradient(whole)
            for student, sums in enumerate(total):
                row, feature = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), student)), pa.array(row), pa.array(feature),
                     pa.array(sums[row, feature].astype(np.int64))],
                    ["student", "row", "feature", "value"],
                )

        schema = "student bigint, row bigint, feature bigint, value bigint"
        found = self.blocks.mapInArrow(run, schema).groupBy("student", "row", "feature").agg(
            F.sum("value").alias("value")
        ).toArrow()
        shared.destroy()
        out = [np.zeros((rows, width + 1)) for width in widths]
        student, row, feature, value = (c.to_numpy() for c in found.columns)
        for i, sums in enumerate(out):
            own = student == i
            sums[row[own], feature[own]] = value[own]
        return out if students is None else [sums * UNIT for sums in out]


def co_train(
    views: list[Rows], label: np.ndarray, known: np.ndarray, pool: Pool
) -> list[np.ndarray]:
    """Weights of one classifier per view; ``known`` marks the labelled rows to train on."""
    label, weight = np.where(known, label, 0.0), known.astype(float)
    weights = [fit_logistic(v, label, weight) for v in views]
    for _ in range(ROUNDS):
        counts = pool.sums(weights)
        # A teacher that is sure of one class alone would only shift the share.
        taught = [i for i in (0, 1) if counts[i][:, -1].min() > 0]
        if not taught:
            break
        each, kept = {}, {}
        for i in taught:
            each[i] = min(PSEUDO, weight.sum() / counts[i][:, -1].sum())
            bad, good = each[i] * counts[i] + np.stack(
                [views[i].gradient(weight * (1 - label)), views[i].gradient(weight * label)])
            kept[i] = np.append(
                differing(good[:-1], bad[:-1], max(good[-1], 1.0), max(bad[-1], 1.0)), True)
        now = [weights[i] * kept[i] if i in taught else None for i in (0, 1)]
        moments = {i: (np.zeros_like(weights[i]), np.zeros_like(weights[i])) for i in taught}
        for step in range(1, TAUGHT_STEPS + 1):
            slopes = pool.sums(weights, now)
            for i in taught:
                own = views[i].gradient(weight * (_sigmoid(views[i].scores(now[i])) - label))
                all_weight = weight.sum() + each[i] * counts[i][:, -1].sum()
                slope = (own + each[i] * slopes[i][0]) / all_weight + RIDGE * now[i]
                slope *= kept[i]
                mean, square = moments[i]
                mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
                moments[i] = mean, square
                now[i] = now[i] - RATE * (mean / (1 - 0.9**step)) / (
                    np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights = [w if n is None else n for w, n in zip(weights, now)]
    return weights


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and constant that turn a score into log-odds, by Newton steps."""
    a, b = 1.0, 0.0
    if not len(z) or label.min() == label.max():
        return a, b
    # Two made-up outcomes keep separable scores finite.
    z = np.append(z, [z.mean(), z.mean()])
    label = np.append(label, [0.0, 1.0])
    scale = max(np.abs(z).max(), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    w = np.array([scale, 0.0]) * 0.1
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        w = w - np.linalg.solve(hessian, x.T @ (p - label) + 0.01 * w)
    return float(max(w[0], 0.0) / scale), float(w[1])


class Model:
    """Weights and calibration of both views, and the share of good documents."""

    def __init__(self, weights, scale, share):
        self.weights, self.scale, self.share = weights, scale, share

    def log_odds(self, views: list[Rows]) -> list[np.ndarray]:
        return [a * v.scores(w) + b for v, w, (a, b) in zip(views, self.weights, self.scale)]


def _inputs(docs: DataFrame) -> DataFrame:
    """The columns that the views read; absent ones count as null."""
    def column(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)

    return docs.select(
        "doc_id", "text", column("source", "string").alias("source"),
        column("lang", "string").alias("lang"), F.length("text").cast("bigint").alias("length"),
    )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample and all other documents. A document is good if its quality is 1 and it is not toxic.

    Labels that repeat a document count as the worst of them; labels without a document and null
    labels are left out. Without labels of both classes every document scores the share of good
    ones.
    """
    good = (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        good.cast("int").alias("good")
    )
    order = F.xxhash64("doc_id", F.lit("sample"))
    # At most a constant number of ids, so they can be sent to every task.
    labelled = materialize(known.orderBy(order, "doc_id").limit(LABELLED), "labelled")
    inputs = _inputs(docs)
    rows = inputs.join(F.broadcast(labelled), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            text, feature = text_features(piece.column("text"))
            cuts = np.searchsorted(text, np.arange(1, piece.num_rows))
            words = [w.astype("<u2").tobytes() for w in np.split(feature, cuts)]
            meta = meta_features(piece)[1].reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), piece.column("good"),
                 pa.array(words, pa.binary()),
                 pa.array([m.astype("<u2").tobytes() for m in meta], pa.binary())],
                ["doc_id", "good", "words", "meta"],
            )

    schema = "doc_id bigint, good int, words binary, meta binary"
    # Of the rows that share a doc_id one is taken, so that the bound holds for rows too.
    one_each = rows.mapInArrow(run, schema).groupBy("doc_id").agg(
        F.min(F.struct("words", "meta", "good")).alias("row")
    ).select("doc_id", "row.*")
    sample = sorted(one_each.collect(), key=lambda r: r["doc_id"])
    views = [
        Rows.of([np.frombuffer(r[c], "<u2") for r in sample], width)
        for c, width in (("words", TEXT_FEATURES), ("meta", META_FEATURES))
    ]
    ids = np.array([r["doc_id"] for r in sample], np.int64)
    label = np.array([r["good"] for r in sample], float)
    turn = mix(ids.view(np.uint64)) % np.uint64(HELD_OUT) if len(ids) else ids
    held = turn == 0
    share = float((label.sum() + 1) / (len(label) + 2))
    both = len(set(label[~held].tolist())) == 2
    if not both:
        empty = [np.zeros(v.width + 1) for v in views]
        return Model(empty, [(0.0, np.log(share / (1 - share)))] * 2, share)
    pool = Pool(inputs.join(F.broadcast(labelled), "doc_id", "left_anti"))
    weights = co_train(views, label, ~held, pool)
    scale = [calibrate(v.scores(w)[held], label[held]) for v, w in zip(views, weights)]
    return Model(weights, scale, share)


SCORED = "doc_id bigint, text_score double, meta_score double, score double"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: the calibrated probability of being good by either view and by both, and ``kept``.

    Null and empty texts are scored without words, null metadata as a value of its own; equal rows
    score alike; other columns are not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        prior = np.log(model.share / (1 - model.share))
        for piece in slices(batches, "text"):
            n = piece.num_rows
            views = [
                Rows(*text_features(piece.column("text")), n, TEXT_FEATURES),
                Rows(*meta_features(piece), n, META_FEATURES),
            ]
            text, meta = model.log_odds(views)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(_sigmoid(text)),
                 pa.array(_sigmoid(meta)), pa.array(_sigmoid(text + meta - prior))],
                ["doc_id", "text_score", "meta_score", "score"],
            )

    return _inputs(docs).mapInArrow(run, SCORED).withColumn("kept", F.col("score") >= threshold)
