"""Edge cases worked by hand, and brute-force checks on small random inputs."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from roundscope.functions import hashing, numeric
from roundscope.functions.tables import parameter_table
from roundscope.operators import correlate, inactivity, mask, rounds, score, sketch, summary
from roundscope.operators.schedule import episodes, in_episode, schedule
from roundscope.sources import results

MESSAGE = "ts_us bigint, job_id int, round_id int, worker_id int, chunk_id int, size double, seq bigint"


def messages(spark, rows):
    """Rows of (ts_us, job, round, worker, chunk), numbered in arrival order."""
    return spark.createDataFrame(
        [(t, j, r, w, c, 1.0, i) for i, (t, j, r, w, c) in enumerate(rows)], MESSAGE
    )


# --- inactivity ----------------------------------------------------------------------------

CASES = [
    ([], (5000, 0, "missing-round")),
    ([(0, 20)], None),
    ([(5000, 20)], None),
    ([(5001, 20)], (5000, 0, "missing-round")),
    ([(1000, 10), (6000, 10)], None),
    ([(1000, 10), (6001, 10)], (6000, 10, "premature-timeout")),
    ([(1000, 10), (6001, 5)], (6000, 10, "missing-pairs")),
    ([(1000, 10)], (6000, 10, "missing-pairs")),
    ([(1000, 10), (4000, 0), (8000, 10)], None),
    ([(1000, 20), (90000, 1)], None),
]


def plan_of(spark, n, timeout, expected, start=0, end=100_000):
    return parameter_table(
        spark,
        "job_id int, round_id int, start_us bigint, end_us bigint, expected bigint, "
        "timeout_us bigint",
        [(0, r, start, end, expected, timeout) for r in range(n)],
    )


def alerts_of(spark, timelines, timeout, expected, width=None, **plan):
    rows = [(0, r, t, n) for r, line in enumerate(timelines) for t, n in line]
    events = spark.createDataFrame(rows, "job_id int, round_id int, ts_us bigint, n bigint")
    buckets = inactivity.activity_buckets(events, width or timeout, weight="n")
    found = inactivity.inactivity_alerts(
        buckets, plan_of(spark, len(timelines), timeout, expected, **plan)
    )
    return {r.round_id: (r.detected_us, r.observed, r.reason) for r in found.collect()}


def test_inactivity_cases(spark):
    found = alerts_of(spark, [c[0] for c in CASES], 5000, 20)
    assert found == {i: c[1] for i, c in enumerate(CASES) if c[1] is not None}


def first_silence(line, start, timeout, expected):
    """By definition: the earliest gap that is too long while too little came before it."""
    moments = [start, *sorted({t for t, _ in line})]
    came = [sum(n for t, n in line if t in moments[1 : i + 1]) for i in range(len(moments))]
    gaps = {
        (moment, before) for moment, until, before in
        zip(moments, [*moments[1:], float("inf")], came)
        if until - moment > timeout and before < expected
    }
    if not gaps:
        return None
    moment, before = min(gaps, key=lambda gap: moments.index(gap[0]))
    late = "premature-timeout" if came[-1] >= expected else "missing-pairs"
    return moment + timeout, before, late if before else "missing-round"


@pytest.mark.parametrize("width", [50, 17, 1])
def test_inactivity_equals_definition_for_any_bucket_width(spark, width):
    rng = random.Random(width)
    lines = [
        [(rng.randrange(-20, 600), rng.randrange(0, 3)) for _ in range(rng.randrange(0, 14))]
        for _ in range(300)
    ]
    found = alerts_of(spark, lines, 50, 9, width=width)
    expected = {i: first_silence(line, 0, 50, 9) for i, line in enumerate(lines)}
    assert found == {i: a for i, a in expected.items() if a is not None}


def test_untimed_activity_arrives_at_round_end(spark):
    rng = random.Random(5)
    lines = [
        [(rng.choice([None, rng.randrange(0, 200)]), 1) for _ in range(rng.randrange(0, 8))]
        for _ in range(200)
    ]
    found = alerts_of(spark, lines, 40, 5, end=100)
    timed = [[(100 if t is None else t, n) for t, n in line] for line in lines]
    expected = {i: first_silence(line, 0, 40, 5) for i, line in enumerate(timed)}
    assert found == {i: a for i, a in expected.items() if a is not None}


def test_deadline_alerts(spark):
    jobs = parameter_table(
        spark,
        "job_id int, n_workers int, n_chunks int, n_rounds int, start_offset_us bigint, "
        "round_duration_us bigint, inter_round_gap_us bigint",
        [(0, 2, 2, 3, 100, 1000, 500)],
    )
    totals = parameter_table(spark, "job_id int, round_id int, observed bigint",
                             [(0, 0, 4), (0, 1, 3)])
    found = inactivity.deadline_alerts(totals, schedule(jobs, timeout_us=7)).orderBy("round_id")
    assert [tuple(r) for r in found.collect()] == [
        (0, 1, 100 + 1500 + 1000 + 7, 3, 4, "missing-pairs"),
        (0, 2, 100 + 3000 + 1000 + 7, 0, 4, "missing-round"),
    ]


# --- per-round questions -------------------------------------------------------------------

def test_straggler_tie_goes_to_first_arrival(spark):
    tie = [(10, 0, 0, 3, 0), (10, 0, 0, 1, 0), (5, 0, 0, 2, 0)]
    clear = [(7, 0, 1, 4, 0), (9, 0, 1, 6, 0), (9, 0, 1, 6, 1)]
    found = rounds.straggler(messages(spark, tie + clear)).collect()
    assert {r.round_id: r.worker_id for r in found} == {0: 3, 1: 6}
    found = rounds.straggler(messages(spark, clear)).collect()
    assert {r.round_id: r.worker_id for r in found} == {1: 6}


def test_straggler_with_more_ties_than_a_broadcast_takes(spark, monkeypatch):
    monkeypatch.setattr(rounds, "BROADCAST_ROW_LIMIT", 1)
    ties = [(10, 0, r, w, 0) for r in range(3) for w in (5 - r, 1 + r)]
    found = rounds.straggler(messages(spark, ties)).collect()
    assert {r.round_id: r.worker_id for r in found} == {0: 5, 1: 4, 2: 3}


def test_lossy_worker_tie_and_full_rounds(spark):
    counts = parameter_table(
        spark, "job_id int, round_id int, worker_id int, cnt bigint",
        [(0, 0, 5, 1), (0, 0, 2, 1), (0, 0, 1, 4), (0, 1, 1, 4), (0, 1, 2, 4)],
    )
    jobs = parameter_table(spark, "job_id int, expected_chunks int", [(0, 4)])
    assert [tuple(r) for r in rounds.lossy_worker(counts, jobs).collect()] == [(0, 0, 2, 1)]


def test_incomplete_counts_duplicates_once_and_skips_absent_rounds(spark):
    df = messages(spark, [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 2, 0, 0), (4, 0, 2, 0, 1)])
    found = {r.round_id: (r.pairs, r.incomplete) for r in
             rounds.incomplete_rounds(df, 2).collect()}
    assert found == {0: (1, True), 2: (2, False)}


def test_gap_rounds(spark):
    counts = parameter_table(
        spark, "job_id int, round_id int, worker_id int, cnt bigint",
        [(0, 0, 0, 10), (0, 0, 1, 10), (0, 0, 2, 9)],
    )
    assert rounds.gap_rounds(counts, 2, 1).count() == 1
    assert rounds.gap_rounds(counts, 2, 2).count() == 0
    assert rounds.gap_rounds(counts, 1, 1).count() == 0


def test_distinct_first_and_tail_keep_whole_rows(spark):
    df = messages(spark, [(9, 0, 0, 1, 7), (3, 0, 0, 1, 8), (3, 0, 0, 1, 9)])
    assert rounds.distinct_first(df, ["worker_id"]).collect()[0].chunk_id == 8
    assert rounds.worker_tail(df).collect()[0].chunk_id == 7


def test_merge_keeps_time_stream_and_arrival_order(spark):
    a = messages(spark, [(5, 0, 0, 0, 0), (1, 0, 0, 0, 0)])
    b = messages(spark, [(5, 1, 0, 0, 0), (3, 1, 0, 0, 0)])
    merged = rounds.merge_ordered([a, b]).collect()
    assert [(r.ts_us, r.stream_id) for r in merged] == [(1, 0), (3, 1), (5, 0), (5, 1)]


@pytest.mark.parametrize("piece,levels", [(4, 3), (16, 1), (4096, 2)])
def test_fold_is_ordered_for_any_piece_size(spark, piece, levels):
    """Concatenation does not commute, so it shows that order survives the pieces."""
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    folded = rounds.fold_by_key(
        df, ["k"], "seq", F.array(F.col("seq")), merge=lambda a, b: F.concat(a, b),
        finish=lambda acc: acc, piece_rows=piece, levels=levels,
    )
    assert {r.k: r.value for r in folded.collect()} == {
        k: list(range(k, 300, 3)) for k in range(3)
    }


def test_named_reducers(spark):
    df = messages(spark, [(4, 0, 0, 2, 1), (9, 0, 0, 5, 0), (1, 0, 0, 3, 1)])
    def one(value, reducer):
        return rounds.reduce_by_key(df, ["job_id"], value, reducer).collect()[0]
    assert one("ts_us", "sum").value == 14
    assert one("ts_us", "count").value == 3
    assert (one("ts_us", "min_max").lo, one("ts_us", "min_max").hi) == (1, 9)
    assert one("ts_us", "arg_max").value == 5
    assert one("chunk_id", "set_union").value == [0, 1]


# --- schedule ------------------------------------------------------------------------------

@pytest.mark.parametrize("n,expected", [
    (9, [(3, 9)]), (20, [(4, 8), (12, 16)]), (50, [(10, 20), (30, 40)]),
])
def test_episodes(spark, n, expected):
    jobs = parameter_table(spark, "job_id int, n_rounds int", [(0, n)])
    found = episodes(jobs).orderBy("start_round").collect()
    assert [(r.start_round, r.end_round) for r in found] == expected


def test_schedule_expands_beyond_one_block(spark):
    jobs = parameter_table(
        spark,
        "job_id int, n_workers int, n_chunks int, n_rounds int, start_offset_us bigint, "
        "round_duration_us bigint, inter_round_gap_us bigint",
        [(0, 1, 1, 140_000, 0, 2, 1), (1, 1, 1, 0, 0, 2, 1)],
    )
    got = schedule(jobs).agg(
        F.count("*"), F.countDistinct("round_id"), F.max("round_id"), F.max("start_us")
    ).collect()[0]
    assert tuple(got) == (140_000, 140_000, 139_999, 139_999 * 3)


def test_in_episode_is_half_open(spark):
    rows = parameter_table(spark, "job_id int, round_id int", [(0, r) for r in range(6)])
    spans = parameter_table(
        spark, "job_id int, start_round int, end_round int", [(0, 1, 3), (0, 2, 4)]
    )
    got = in_episode(rows, spans, ["job_id"]).orderBy("round_id").collect()
    assert [r.round_id for r in got] == [1, 2, 3]


# --- correlation ---------------------------------------------------------------------------

def correlation(xs, ys):
    """0.0 for a constant series."""
    return 0.0 if len(set(xs)) == 1 or len(set(ys)) == 1 else statistics.correlation(xs, ys)


def test_safe_corr_of_constant_and_single(spark):
    df = parameter_table(spark, "k int, x double, y double",
                         [(0, 0.1, 1.0), (0, 0.1, 2.0), (0, 0.1, 4.0), (1, 3.0, 4.0)])
    got = df.groupBy("k").agg(numeric.safe_corr("x", "y").alias("c")).collect()
    assert {r.k: r.c for r in got} == {0: 0.0, 1: 0.0}


@pytest.mark.parametrize("tiles", [1, 4])
def test_pairwise_needs_three_common_rounds(spark, tiles):
    rows = [(0, 0, 5), (0, 1, 9), (0, 2, 1), (1, 0, 4), (1, 1, 8), (1, 2, 3), (2, 0, 1), (2, 1, 2)]
    lat = parameter_table(spark, "job_id int, round_id int, latency_us bigint", rows)
    got = correlate.pairwise_corr(lat).collect()
    assert [(r.job_a, r.job_b, r.rounds) for r in got] == [(0, 1, 3)]
    assert got[0]["corr"] == round(correlation([5, 9, 1], [4, 8, 3]), 6)
    pairs = correlate.pair_rounds(lat, lat.withColumnRenamed("latency_us", "other"), tiles)
    assert sorted((r.job_a, r.job_b, r.round_id) for r in pairs.collect()) == sorted(
        (a[0], b[0], a[1]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0]
    )


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_sliding_window_is_exact_across_blocks(spark, block):
    rng = random.Random(block)
    series = {
        key: sorted(rng.sample(range(200), n)) for key, n in {(0, 1): 40, (0, 2): 8, (1, 2): 7}.items()
    }
    rows = [
        (a, b, r, rng.random(), float(rng.random() < 0.4))
        for (a, b), observed in series.items() for r in observed
    ]
    df = spark.createDataFrame(rows, "job_a int, job_b int, round_id int, x double, y double")
    got = correlate.sliding_corr(df, F.col("x"), F.col("y"), 8, block_rounds=block).collect()
    expected = {}
    for pair in series:
        mine = [r for r in rows if r[:2] == pair]
        for i in range(7, len(mine)):
            last = mine[i - 7: i + 1]
            expected[(*pair, mine[i][2])] = correlation([r[3] for r in last], [r[4] for r in last])
    assert {(r.job_a, r.job_b, r.round_id) for r in got} == set(expected)
    for r in got:
        assert r.score == pytest.approx(expected[(r.job_a, r.job_b, r.round_id)], abs=2e-6)


def test_configured_pairs(spark):
    lat = parameter_table(spark, "job_id int, round_id int, x double",
                          [(j, r, float(j)) for j in range(3) for r in range(2)])
    pairs = parameter_table(spark, "job_a int, job_b int", [(2, 0)])
    got = correlate.configured_pairs(lat, lat.withColumnRenamed("x", "y"), pairs)
    assert sorted((r.job_a, r.job_b, r.round_id) for r in got.collect()) == [(2, 0, 0), (2, 0, 1)]


def test_first_detection_window(spark):
    alerts = parameter_table(spark, "job_a int, round_id int, detected_us bigint",
                             [(0, 3, 30), (0, 9, 90), (0, 14, 140)])
    spans = parameter_table(spark, "job_a int, start_round int, end_round int",
                            [(0, 4, 6), (0, 20, 22)])
    got = correlate.first_detections(alerts, spans, 8, ["job_a"]).collect()
    assert [(r.start_round, r.alert_round, r.detections) for r in got] == [(4, 9, 1)]


# --- sketches ------------------------------------------------------------------------------

def bucket_and_sign(key, row, seed, width):
    digest = hashlib.md5(f"{key}-{row}-{seed}".encode()).digest()
    return int.from_bytes(digest[:4], "little") % width, 1 if digest[4] & 1 else -1


def test_sketch_hash(spark):
    df = spark.range(1).select(
        hashing.key_text(F.lit(1), F.lit(2), F.lit(3)).alias("key"),
        hashing.key_text(F.lit(7)).alias("one"),
    )
    digest = hashing.sketch_digest(F.col("key"), F.lit(0), F.lit(42))
    got = df.select("one", (hashing.u32(digest) % 512).alias("b"), hashing.sign(digest).alias("s"))
    assert tuple(got.collect()[0]) == ("(7,)", 426, -1)
    assert bucket_and_sign("(1, 2, 3)", 0, 42, 512) == (426, -1)


def test_sketch_estimates_and_merge(spark):
    rng = random.Random(1)
    weights = {f"({i},)": rng.randrange(1, 50) for i in range(400)}
    width, depth = 64, 5
    # In each row, a key's estimate is what all keys of its cell weigh, by the signs they share.
    places = {key: [bucket_and_sign(key, row, 42, width) for row in range(depth)] for key in weights}
    expected = {
        key: max(0, statistics.median_high(
            sum(n * sign * places[k][row][1] for k, n in weights.items() if places[k][row][0] == cell)
            for row, (cell, sign) in enumerate(own)
        ))
        for key, own in places.items()
    }
    df = spark.createDataFrame(list(weights.items()), "key string, cnt bigint").repartition(8)
    cells = sketch.sketch_table(df, width=width)
    got = sketch.point_estimates(
        df.withColumn("id", F.col("key")), cells, ["id"], width=width
    ).collect()
    assert {r.id: r.est for r in got} == expected
    # Linearity: the tables of two halves add up to the table of the whole.
    half = F.crc32("key") % 2 == 0
    parts = sketch.sketch_table(df.filter(half), width=width).unionByName(
        sketch.sketch_table(df.filter(~half), width=width)
    )
    merged = parts.groupBy("depth_row", "idx").agg(F.sum("v").alias("v"))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in cells.collect()}


def test_sampling_level(spark):
    keys = [f"({i}, {i % 7})" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.level for r in
           df.select("key", hashing.sampling_level(F.col("key"), 8).alias("level")).collect()}
    for key in keys:
        h = int.from_bytes(hashlib.md5(key.encode()).digest()[:4], "little")
        zeros = 0
        while zeros < 32 and not h >> zeros & 1:
            zeros += 1
        assert got[key] == min(zeros, 7)


# --- masks ---------------------------------------------------------------------------------

@pytest.mark.parametrize("bins", [1, 8, 4096])
def test_sampled_rounds_have_exact_size_and_smallest_draws(spark, bins):
    rows = [(0, r) for r in range(137)] + [(1, r) for r in range(4)] + [(2, 0)]
    df = spark.createDataFrame(rows, "job_id int, round_id int").withColumn("seed", F.lit(3))
    got = {(r.job_id, r.round_id) for r in
           mask.sample_rounds(df, 0.1, ["seed", "job_id"], F.col("seed"), bins).collect()}
    def draw(job, rnd):
        return hashlib.md5(f"round-{job}-{rnd}-3".encode()).digest()[:4]
    expected = set()
    for job, k in ((0, 14), (1, 1), (2, 1)):
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: draw(*r))
        expected |= set(mine[:k])
    assert got == expected


def test_masks(spark):
    df = messages(spark, [(t, 0, t // 10, t % 3, t % 2) for t in range(60)])
    losses = parameter_table(spark, "worker_id int, prob double", [(1, 1.0)])
    dropped = mask.drop_rows(df, losses, seed=0)
    assert dropped.count() == 40 and dropped.filter("worker_id = 1").count() == 0
    everything = mask.drop_rows(df, losses, seed=0, baseline=1.0)
    assert everything.count() == 0
    gone = parameter_table(spark, "job_id int, round_id int", [(0, 2)])
    assert mask.remove_rounds(df, gone).count() == 50
    faults = parameter_table(spark, "job_id int, round_id int", [(0, 4)])
    kept = mask.intermittent_drops(df, faults, F.lit(1), 0.0, 0)
    lost = df.join(kept.select("seq"), "seq", "left_anti").collect()
    assert [(r.round_id, r.worker_id) for r in lost] == [(4, 1)]


# --- scoring and summaries -----------------------------------------------------------------

def test_precision_recall_guards(spark):
    df = parameter_table(spark, "tp int, pp int, ap int", [(0, 0, 0), (1, 2, 3)])
    got = score.with_precision_recall(df).orderBy("tp").collect()
    assert [(r.precision, r.recall) for r in got] == [(0.0, 0.0), (0.5, 0.333)]


def test_set_flags(spark):
    p = parameter_table(spark, "k int", [(1,), (2,)])
    a = parameter_table(spark, "k int", [(2,), (3,), (4,)])
    got = score.set_score(score.set_flags(p, a, ["k"]), []).collect()[0]
    assert (got.tp, got.pp, got.ap, got.fp) == (1, 2, 3, 1)


def test_lowest_worker_scores_count_only_the_given_worker(spark):
    rows = [(0, 7, 0, 0, 7, 1, 9), (0, 7, 0, 0, 8, 5, 3), (0, 7, 0, 1, 7, 2, 2), (0, 7, 0, 1, 8, 4, 4)]
    df = parameter_table(
        spark, "seed int, bad int, job_id int, round_id int, worker_id int, cnt bigint, est bigint",
        rows)
    got = score.lowest_worker_scores(df, ["seed"], "bad", "cnt", {"m": F.col("est")}).collect()[0]
    assert (got.tp, got.pp, got.ap, got["keys"]) == (1, 1, 2, 4)


def test_confidence_intervals(spark):
    df = parameter_table(spark, "g string, v double",
                         [("one", 0.5), ("two", 0.0), ("two", 1.0), ("none", None)])
    mean, low, high = numeric.ci95("v", unit_interval=True)
    got = df.groupBy("g").agg(mean.alias("m"), low.alias("l"), high.alias("h")).collect()
    assert {r.g: (r.m, r.l, r.h) for r in got} == {
        "one": (0.5, 0.5, 0.5), "two": (0.5, 0.0, 1.0), "none": (None, None, None)
    }
    _, raw_low, raw_high = numeric.ci95("v")
    raw = df.filter("g = 'two'").agg(raw_low.alias("l"), raw_high.alias("h")).collect()[0]
    assert (raw.l, raw.h) == (-0.48, 1.48)


def test_scalar_helpers(spark):
    df = spark.range(1)
    got = df.select(
        numeric.half_even(F.lit(2.5)).alias("a"), numeric.half_even(F.lit(3.5)).alias("b"),
        *[numeric.ceil_log2(F.lit(v)).alias(f"l{v}") for v in (0, 1, 2, 3, 32)],
        numeric.safe_div(F.lit(1), F.lit(0)).alias("d"),
        F.sort_array(F.array(*map(F.lit, (5, -2, 7, 9, 0))))[2].alias("median"),
    ).collect()[0]
    assert tuple(got) == (2.0, 4.0, 1, 1, 1, 2, 5, 0.0, 5)


def test_numeric_or_null(spark):
    values = {"1": "1.0", " 2.5 ": "2.5", "1e3": "1000.0", "-.5": "-0.5", "3.": "3.0",
              "1_000": "1000.0", "inf": "inf", "-Infinity": "-inf", "nan": "nan"}
    blanks = ["", " ", "1__0", "0x1", "7d", "2f", "abc", "1e", None]
    df = spark.createDataFrame(list(enumerate([*values, *blanks])), "i int, t string")
    got = df.select("i", numeric.numeric_or_null(F.col("t")).alias("v")).orderBy("i").collect()
    assert [repr(r.v) for r in got] == [*values.values(), *["None"] * len(blanks)]


def test_is_false(spark):
    df = spark.createDataFrame([("False",), ("FALSE",), ("true",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(numeric.is_false(F.col("t"))).collect()]
    assert got == [True, True, False, False, False]


def test_csv_round_trip_and_preference(spark, tmp_path):
    a = parameter_table(spark, "b int, a string", [(1, "x")])
    b = parameter_table(spark, "b int, c double", [(2, 0.5)])
    rows = results.append_rows([a, b])
    assert rows.columns == ["a", "b", "c"]
    raw, short = str(tmp_path / "raw"), str(tmp_path / "summary")
    results.write_csv(rows, raw)
    text = results.read_csv(spark, raw)
    assert dict(text.dtypes) == {"a": "string", "b": "string", "c": "string"}
    assert {tuple(r) for r in text.collect()} == {("x", "1", None), (None, "2", "0.5")}
    assert results.read_preferred(spark, short, raw).count() == 2
    results.write_csv(rows.limit(1), short)
    assert results.read_preferred(spark, short, raw).count() == 1


def test_summary_skips_blank_values(spark):
    rows = summary.result_rows(parameter_table(
        spark, "workload string, seed int, precision double, alerts bigint",
        [("w", 1, 0.5, None), ("w", 4, None, None)],
    ))
    got = summary.summarize(rows).collect()[0]
    assert (got.n_samples, got.seed_min, got.seed_max, got.precision_mean) == (2, 1, 4, 0.5)
    assert got.alerts_mean is None and got.recall_ci95_low is None
