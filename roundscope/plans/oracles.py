"""SQL counterparts of the named queries, for an independent engine on the same tables.

Each statement is written from the definition of its question: joins on keys, ranks and
ordered frames, without the buckets, tiles, bins and salts that the Spark plans use to scale.
"""

from __future__ import annotations

from roundscope.operators.summary import GROUP_FIELDS, METRIC_FIELDS, UNIT_METRICS
from roundscope.plans import settings as S
from roundscope.sources.bindings import DAY_US, EVENT_START_US


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def half_even(value: str, digits: int) -> str:
    return f"(round_even({value}, {digits}) + CAST(0 AS DOUBLE))"


def u32(digest: str) -> str:
    text = " || ".join(f"substr({digest}, {pos}, 2)" for pos in (7, 5, 3, 1))
    return f"CAST(CAST('0x' || {text} AS UBIGINT) AS BIGINT)"


def draw32(*parts: str) -> str:
    digest = "md5(concat_ws('-', " + ", ".join(parts) + "))"
    return f"CAST(CAST('0x' || substr({digest}, 1, 8) AS UBIGINT) AS BIGINT)"


def uniform(*parts: str) -> str:
    return f"(CAST({draw32(*parts)} AS DOUBLE) / {d(4294967296.0)})"


def seeded_worker(label: str, n: int) -> str:
    return f"CAST({draw32(repr(label), 'seed')} % {n} AS INTEGER)"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def unnested(values, name: str) -> str:
    return f"(SELECT unnest({listed(values)}) AS {name})"


def ratio(num: str, den: str) -> str:
    return half_even(f"CASE WHEN {den} = 0 THEN 0 ELSE CAST({num} AS DOUBLE) / {den} END", 3)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


WORKER = "job_id, round_id, worker_id"
KEY = "'(' || job_id || ', ' || round_id || ', ' || worker_id || ')'"


def job(name: str, table: str) -> str:
    """Rank of a name among those of its table, from 0; -1 without a name."""
    names = f"(SELECT list_sort(list(DISTINCT {name})) FROM {table})"
    return f"CAST(coalesce(list_position({names}, {name}), 0) - 1 AS INTEGER)"


PK = f"""pk AS (
  SELECT epoch_us(ts) AS ts_us,
         {job('event_type', 'events')} AS job_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS round_id,
         CAST(user_id % 8 AS INTEGER) AS worker_id,
         CAST(hour(ts) // 12 AS INTEGER) AS chunk_id,
         value AS size, event_id AS seq, event_type
  FROM events)"""
PL = f"""pl AS (
  SELECT epoch_us(l_shipdate) AS ts_us,
         {job('l_returnflag', 'lineitem')} AS job_id,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS round_id,
         CAST(l_suppkey % 16 AS INTEGER) AS worker_id,
         CAST(l_linenumber AS INTEGER) AS chunk_id,
         l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem)"""
CNT = f"cnt AS (SELECT {WORKER}, count(*) AS cnt FROM pk GROUP BY ALL)"
def all_counts(messages: str, workers: int) -> str:
    return f"""c AS (
  SELECT r.job_id, r.round_id, CAST(w AS INTEGER) AS worker_id, count(m.seq) AS cnt
  FROM (SELECT DISTINCT job_id, round_id, unnest(range({workers})) AS w FROM {messages}) r
  LEFT JOIN {messages} m ON m.job_id = r.job_id AND m.round_id = r.round_id AND m.worker_id = r.w
  GROUP BY ALL)"""


#: Workers below the median of their job; the lowest count of a round first.
BELOW = "below AS (SELECT * FROM c JOIN (SELECT job_id, median(cnt) AS usual FROM c GROUP BY 1) USING (job_id) WHERE cnt < usual)"
JOBS = """jobs AS (SELECT job_id, CAST(max(round_id) + 3 AS INTEGER) AS n_rounds FROM pk GROUP BY 1)"""
SCHED = f"""sched AS (
  SELECT job_id, CAST(r AS INTEGER) AS round_id,
         {EVENT_START_US} + r * {DAY_US} AS start_us,
         {EVENT_START_US} + (r + 1) * {DAY_US} AS end_us,
         CAST({S.EXPECTED_ROUND} AS BIGINT) AS expected
  FROM (SELECT job_id, unnest(range(n_rounds)) AS r FROM jobs))"""
METRICS = """metrics AS (
  SELECT job_id, round_id, max(ts_us) - min(ts_us) AS latency_us, count(*) AS n
  FROM pk GROUP BY ALL)"""
EPISODES = """episodes AS (
  SELECT job_id, n_rounds, CAST(greatest(0, n_rounds // 3) AS INTEGER) AS start_round,
         n_rounds AS end_round
  FROM jobs WHERE n_rounds < 10
  UNION ALL
  SELECT job_id, n_rounds, s1, e1 FROM bounds
  UNION ALL
  SELECT job_id, n_rounds, s2, least(n_rounds, s2 + greatest(3, n_rounds // 5)) FROM bounds
  WHERE s2 < least(n_rounds, s2 + greatest(3, n_rounds // 5)))"""
BOUNDS = """bounds AS (
  SELECT *, least(n_rounds - 1, greatest(e1 + 2, (3 * n_rounds) // 5)) AS s2
  FROM (SELECT *, least(n_rounds, s1 + greatest(3, n_rounds // 5)) AS e1
        FROM (SELECT job_id, n_rounds, greatest(1, n_rounds // 5) AS s1
              FROM jobs WHERE n_rounds >= 10)))"""


def inactivity(name: str, activity: str, planned: str, keys: str) -> str:
    """Event-by-event inactivity rule: ``activity`` (keys, t, n), ``planned`` (keys, start_us,
    expected, timeout_us)."""
    on = " AND ".join(f"p.{k.strip()} = a.{k.strip()}" for k in keys.split(","))
    pk = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""{name}_w AS (
  SELECT {pk}, p.start_us, p.expected, p.timeout_us, a.t, coalesce(a.n, 0) AS n,
         coalesce(sum(a.n) OVER w, 0) AS seen, coalesce(lag(a.t) OVER o, p.start_us) AS idle_from
  FROM {planned} p LEFT JOIN {activity} a ON {on}
  WINDOW o AS (PARTITION BY {pk} ORDER BY a.t, a.n),
         w AS (PARTITION BY {pk} ORDER BY a.t, a.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_r AS (
  SELECT {keys}, any_value(start_us) AS start_us, any_value(expected) AS expected,
         min(idle_from + timeout_us) FILTER (WHERE seen < expected AND t > idle_from + timeout_us) AS gap_us,
         min(seen) FILTER (WHERE seen < expected AND t > idle_from + timeout_us) AS gap_seen,
         coalesce(max(t), any_value(start_us)) + any_value({'timeout_us'}) AS end_fire, sum(n) AS total
  FROM {name}_w GROUP BY {keys}),
{name} AS (
  SELECT {keys}, start_us, expected, CAST(total AS BIGINT) AS total,
         CASE WHEN gap_us IS NOT NULL THEN gap_us WHEN total < expected THEN end_fire END AS detected_us,
         CAST(coalesce(gap_seen, total) AS BIGINT) AS observed,
         CASE WHEN gap_us IS NULL AND total >= expected THEN NULL
              WHEN coalesce(gap_seen, total) = 0 THEN 'missing-round'
              WHEN total >= expected THEN 'premature-timeout'
              ELSE 'missing-pairs' END AS reason
  FROM {name}_r)"""


ROUND_KEYS = "job_id, round_id"
PLANNED = f"planned AS (SELECT *, {S.TIMEOUT_US} AS timeout_us FROM sched)"
ALERTS = "SELECT job_id, round_id, detected_us, observed, expected, reason FROM st WHERE detected_us IS NOT NULL"

FLAT_CORR = (
    "CASE WHEN max(x) {o} = min(x) {o} OR max(y) {o} = min(y) {o} THEN 0 "
    "ELSE covar_pop(x, y) {o} / (stddev_pop(x) {o} * stddev_pop(y) {o}) END"
)
PAIRS = f"""pairs AS (
  SELECT a.job_id AS job_a, b.job_id AS job_b, a.round_id,
         a.latency_us / {d(1e6)} AS x, CASE WHEN b.n > u.usual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
         {EVENT_START_US} + (a.round_id + 1) * {DAY_US} AS detected_us
  FROM metrics a JOIN metrics b ON a.round_id = b.round_id AND a.job_id <> b.job_id
  JOIN (SELECT job_id, median(n) AS usual FROM metrics GROUP BY 1) u ON u.job_id = b.job_id)"""


def sliding(source: str, keys: str = "job_a, job_b", extra: str = ", detected_us") -> str:
    size = S.CORR_WINDOW
    return f"""scores AS (
  SELECT {keys}, round_id{extra}, {half_even(FLAT_CORR.format(o='OVER w'), 6)} AS score,
         count(*) OVER w AS rows_seen
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY round_id ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)),
full_scores AS (SELECT * FROM scores WHERE rows_seen = {size})"""


CORR_ALERTS = f"""alerts AS (
  SELECT job_a, job_b, round_id, detected_us + {S.EXPORT_LATENCY_US} AS detected_us, score
  FROM full_scores WHERE score >= {d(S.CORR_THRESHOLD)})"""


def hashed(source: str, columns: str, seed: str = "42") -> str:
    digest = f"md5(key || '-' || depth_row || '-' || ({seed}))"
    return f"""(SELECT {columns}, depth_row, {u32('h')} AS hv,
      CASE WHEN substr(h, 10, 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END AS sgn
    FROM (SELECT *, {digest} AS h FROM (SELECT *, unnest(range({S.SKETCH_DEPTH})) AS depth_row FROM {source})))"""


def sketch(name: str, source: str, width: int | str, by: str = "", seed: str = "42",
           ident: str = WORKER) -> str:
    """Cells ``{name}_t`` and estimates ``{name}_e`` of keyed counts ``source`` (key, cnt)."""
    lead = by + ", " if by else ""
    match = "".join(f" AND p.{k.strip()} = t.{k.strip()}" for k in by.split(",") if k.strip())
    cols = f"{lead}{ident}, cnt"
    pcols = ", ".join("p." + c.strip() for c in cols.split(","))
    return f"""{name}_h AS (SELECT {cols}, depth_row, CAST(hv % ({width}) AS INTEGER) AS idx, sgn FROM {hashed(source, cols, seed)}),
{name}_t AS (SELECT {lead}CAST(depth_row AS INTEGER) AS depth_row, idx, CAST(sum(sgn * cnt) AS BIGINT) AS v
  FROM {name}_h GROUP BY ALL),
{name}_e AS (SELECT {cols}, CAST(greatest(0, list_sort(list(sgn * v))[{S.SKETCH_DEPTH // 2 + 1}]) AS BIGINT) AS est
  FROM (SELECT {pcols}, p.sgn, t.v FROM {name}_h p JOIN {name}_t t ON p.depth_row = t.depth_row AND p.idx = t.idx{match})
  GROUP BY {cols})"""


KEYED = f"keyed AS (SELECT *, {KEY} AS key FROM cnt)"

SAMPLE_SEEDS = f"seeds AS (SELECT unnest({listed(S.SEEDS)})::INTEGER AS seed)"


def sample(fraction: float) -> str:
    return f"""drawn AS (
  SELECT seed, job_id, round_id, {uniform("'round'", 'job_id', 'round_id', 'seed')} AS u
  FROM (SELECT DISTINCT job_id, round_id FROM pk), seeds),
sampled AS (
  SELECT seed, job_id, round_id FROM (
    SELECT *, row_number() OVER (PARTITION BY seed, job_id ORDER BY u, round_id) AS rk,
           count(*) OVER (PARTITION BY seed, job_id) AS n FROM drawn)
  WHERE rk <= greatest(1, round_even(n * {d(fraction)}, 0)))"""


PROBS = "(VALUES " + ", ".join(f"({d(p)})" for p in S.LOSS_PROBS) + ") AS probs(loss_prob)"
LOSS = f"""masked AS (
  SELECT seed, lossy_worker, loss_prob, {WORKER},
         CAST(sum(CASE WHEN u >= {d(1.0)} - ({d(1.0)} - CASE WHEN worker_id = lossy_worker THEN loss_prob ELSE {d(0.0)} END)
                       * ({d(1.0)} - loss_prob * {d(S.BASELINE_FRACTION)}) THEN 1 ELSE 0 END) AS BIGINT) AS cnt
  FROM (SELECT *, {uniform('seq', 'seed')} AS u, {seeded_worker('lossy', S.N_WORKERS)} AS lossy_worker
        FROM pk, seeds), {PROBS}
  GROUP BY ALL),
mkeyed AS (SELECT *, {KEY} AS key FROM masked)"""
LOSS_SCORES = f"""{sketch('ms', 'mkeyed', S.SKETCH_WIDTH, 'seed, loss_prob', ident='lossy_worker, ' + WORKER)},
lowest AS (
  SELECT seed, loss_prob, lossy_worker, job_id, round_id, count(*) AS keys,
         arg_min(worker_id, cnt * 1000 + worker_id) AS truth,
         arg_min(worker_id, cnt * 1000 + worker_id) AS dataflow,
         arg_min(worker_id, cnt * 1000 + worker_id) FILTER (WHERE cnt < {S.EXPECTED_WORKER}) AS schedule_aware,
         arg_min(worker_id, est * 1000 + worker_id) AS sketch
  FROM ms_e GROUP BY ALL),
long_pred AS (
  {' UNION ALL '.join(f"SELECT '{s}' AS system, seed, loss_prob, lossy_worker, keys, truth, {s} AS pred FROM lowest" for s in ('dataflow', 'schedule_aware', 'sketch'))}),
loss_scores AS (
  SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall FROM (
    SELECT system, seed, loss_prob, lossy_worker, CAST(sum(keys) AS BIGINT) AS keys,
           count(*) FILTER (WHERE truth = lossy_worker AND pred = lossy_worker) AS tp,
           count(*) FILTER (WHERE pred = lossy_worker) AS pp,
           count(*) FILTER (WHERE truth = lossy_worker) AS ap
    FROM long_pred GROUP BY ALL))"""
SCORE_SELECT = 'SELECT system, seed, loss_prob, lossy_worker, tp, pp, ap, "precision", recall FROM loss_scores '
LOSS_ALL = [PK, SAMPLE_SEEDS, LOSS, LOSS_SCORES]

STRAGGLER = f"""delayed AS (
  SELECT seed, delay_ms, straggler, job_id, round_id, worker_id,
         ts_us + CASE WHEN worker_id = straggler THEN CAST(delay_ms AS BIGINT) * 1000 ELSE 0 END AS t, seq
  FROM (SELECT *, {seeded_worker('straggler', S.N_WORKERS)} AS straggler FROM pk, seeds),
       {unnested(S.DELAYS_MS, 'delay_ms')}),
last_rows AS (
  SELECT *, row_number() OVER (PARTITION BY seed, delay_ms, job_id, round_id ORDER BY t DESC, seq) AS rk,
         max(CASE WHEN worker_id = straggler THEN 1 ELSE 0 END) OVER (PARTITION BY seed, delay_ms, job_id, round_id) AS present
  FROM delayed),
straggler_scores AS (
  SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall
  FROM (
    SELECT seed, CAST(delay_ms AS INTEGER) AS delay_ms, straggler, count(*) AS observed_rounds,
           count(*) FILTER (WHERE worker_id = straggler) AS tp,
           count(*) FILTER (WHERE worker_id = straggler) AS pp,
           count(*) FILTER (WHERE present = 1) AS ap
    FROM last_rows WHERE rk = 1 GROUP BY ALL))"""

FAULTS = f"""grid AS (SELECT * FROM seeds, {unnested(S.FAULT_TYPES, 'fault_type')}),
truth AS (
  SELECT p.*, g.seed, g.fault_type, s.seed IS NOT NULL AND g.fault_type <> 'healthy' AS actual
  FROM planned p CROSS JOIN grid g
  LEFT JOIN sampled s ON s.seed = g.seed AND s.job_id = p.job_id AND s.round_id = p.round_id),
act AS (
  SELECT t.seed, t.fault_type, e.job_id, e.round_id, e.ts_us AS t, 1 AS n
  FROM pk e JOIN truth t ON t.job_id = e.job_id AND t.round_id = e.round_id
  WHERE NOT (t.actual AND (t.fault_type = 'failed_round' OR (t.fault_type = 'missing_chunks' AND e.chunk_id = 1)))),
{inactivity('st', 'act', 'truth', 'seed, fault_type, job_id, round_id')},
fs AS (
  SELECT st.*, t.actual, st.detected_us IS NOT NULL AS predicted
  FROM st JOIN truth t USING (seed, fault_type, job_id, round_id))"""
FAULT_ALL = [PK, JOBS, SCHED, PLANNED, SAMPLE_SEEDS, sample(S.FAULT_FRACTION), FAULTS]

FPR = "{fp} / CAST(greatest({n}, 1) AS DOUBLE)"


def ms(value: str) -> str:
    return half_even(f"coalesce(avg({value} / {d(1000.0)}), 0)", 3)


MODES = (
    ("worker", "worker_id", "'(' || worker_id || ',)'"),
    ("job_worker", "job_id, worker_id", "'(' || job_id || ', ' || worker_id || ')'"),
    ("job_round_worker", WORKER, KEY),
)


def key_modes(source: str, by: str = "") -> tuple[list[str], str]:
    """CTEs and a union giving shared-back estimates of every key mode over ``source``."""
    ctes, bodies = [], []
    lead = by + ", " if by else ""
    for order, (mode, columns, key) in enumerate(MODES):
        name = f"m{order}"
        ids = lead + columns
        on = " AND ".join(f"c.{k.strip()} = e.{k.strip()}" for k in ids.split(","))
        ctes.append(f"""{name} AS (SELECT {ids}, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS fanout FROM {source} GROUP BY {ids}),
{name}k AS (SELECT *, {key} AS key FROM {name}),
{sketch(name + 's', name + 'k', S.SKETCH_WIDTH, by=by, ident=columns + ', fanout')}""")
        bodies.append(f"""SELECT '{mode}' AS key_mode, {order} AS mode_order, {'c.' + lead if lead else ''}c.job_id, c.round_id, c.worker_id, c.cnt,
  CAST(greatest(0, round_even(e.est / CAST(e.fanout AS DOUBLE), 0)) AS BIGINT) AS est
FROM {source} c JOIN {name}s_e e ON {on}""")
    return ctes, "\nUNION ALL\n".join(bodies)


_MODE_CTES, _MODE_BODY = key_modes("cnt")
_SEED_CTES, _SEED_BODY = key_modes("left_counts", "seed")

CELLS = S.SKETCH_WIDTH * S.SKETCH_DEPTH


def _profile() -> str:
    """Each model's size written out: (query, system, key_mode, window, state, bits, keys, ops)."""
    w, c, n = "n_workers", "n_chunks", "n_jobs * n_rounds * n_workers"
    win = S.CORR_WINDOW * 64 + S.CORR_WINDOW
    fixed = "fixed sketch registers; logical keys jobs*rounds*workers"
    rows = [
        ("Q1", "dataflow", None, None, "round_keys", "round_keys * 32", "round_keys", 1, "state_entries"),
        ("Q2", "dataflow", None, None, "worker_keys", "worker_keys * 32", "worker_keys", 1, "rounds*workers"),
        ("Q2", "schedule_aware", None, None, f"{w} + 1", f"({w} + 1) * 32", f"{w} + 1", 1,
         "active-round worker counters + round metadata"),
        ("Q2", "sketch", "worker", None, CELLS, CELLS * 32, w, 5, "workers"),
        ("Q2", "sketch", "job_worker", None, CELLS, CELLS * 32, f"n_jobs * {w}", 5, "jobs*workers"),
        ("Q2", "sketch", "job_round_worker", None, CELLS, CELLS * 32, n, 5, "jobs*rounds*workers"),
        ("Q2", "sketch", "job_round_worker_chunk", None, CELLS, CELLS * 32, f"{n} * {c}", 5,
         "jobs*rounds*workers*chunks"),
        ("Q2", "sketch", "levels", None, CELLS * S.SKETCH_LEVELS, CELLS * S.SKETCH_LEVELS * 32, n, 5, fixed),
        ("Q3", "dataflow", None, None, "round_keys", "round_keys * (64 + 3)", "round_keys", 2,
         "rounds with timestamp+argmax worker"),
        ("Q3", "schedule_aware", None, None, "1", "64 + 3", "1", 2, "active-round timestamp+argmax worker"),
        ("Q3", "sketch", None, None, None, None, None, None, "not expressible"),
        ("Q4", "dataflow", None, None, "round_keys", "round_keys", "round_keys", 2,
         "workers*chunks expected-set bitmap"),
        ("Q4", "dataflow_pairs", None, None, "pair_keys", "pair_keys", "pair_keys", 2,
         "workers*chunks expected-set bitmap"),
        ("Q4", "dataflow_windowed", None, None, f"greatest({w} * {c}, {S.EXPECTED_ROUND})",
         f"greatest({w} * {c}, {S.EXPECTED_ROUND})", f"greatest({w} * {c}, {S.EXPECTED_ROUND})", 2,
         "workers*chunks expected-set bitmap"),
        ("Q4", "schedule_aware", None, None, f"{w} + {c}", f"{w} * 32 + {c}", f"{w} + {c}", 2,
         "active-round worker counters + chunk bitmap"),
        ("Q5", "dataflow_external_windowed", None, S.CORR_WINDOW, 2 * S.CORR_WINDOW, win, S.CORR_WINDOW, 2,
         "window_size downstream correlation state"),
        ("Q5", "schedule_aware", None, S.CORR_WINDOW, 2 * S.CORR_WINDOW, win, S.CORR_WINDOW, 2,
         "job-round correlation window"),
    ]

    def sql(value, kind: str) -> str:
        return "CAST(" + ("NULL" if value is None else str(value)) + f" AS {kind})"

    selects = [
        f"""SELECT n_jobs, n_rounds, n_workers, n_chunks, '{q}' AS query, '{s}' AS system,
  {'NULL' if m is None else repr(m)}::VARCHAR AS key_mode, {sql(win_, 'INTEGER')} AS window_size,
  {sql(state, 'BIGINT')} AS state_entries, {sql(bits, 'BIGINT')} AS counter_bits,
  CAST(ceil({sql(bits, 'DOUBLE')} / 8) AS BIGINT) AS register_bytes, {sql(keys, 'BIGINT')} AS keys_tracked,
  {sql(ops, 'BIGINT')} AS per_packet_ops, '{scaling}' AS scaling_model,
  CAST(n_workers * n_chunks * n_rounds * n_jobs AS BIGINT) AS packets FROM measured"""
        for q, s, m, win_, state, bits, keys, ops, scaling in rows
    ]
    measured = f"""measured AS (
  SELECT CAST(count(DISTINCT job_id) AS INTEGER) AS n_jobs,
         (SELECT CAST(max(r) AS INTEGER) FROM (SELECT count(DISTINCT round_id) AS r FROM pk GROUP BY job_id)) AS n_rounds,
         {S.N_WORKERS} AS n_workers, {S.N_CHUNKS} AS n_chunks,
         count(DISTINCT (job_id, round_id)) AS round_keys,
         count(DISTINCT (job_id, round_id, worker_id)) AS worker_keys,
         count(DISTINCT (job_id, round_id, worker_id, chunk_id)) AS pair_keys
  FROM pk)"""
    return with_(PK, measured) + "\nUNION ALL\n".join(selects)


def _control_ctes() -> list[str]:
    gap = f"""SELECT job_id, round_id FROM (
      SELECT job_id, round_id, max(cnt) - min(cnt) AS spread, arg_min(worker_id, cnt * 1000 + worker_id) AS low
      FROM cnt GROUP BY ALL) WHERE spread >= {S.CONTROL_GAP} AND low = 0"""
    return [
        PK, CNT,
        f"""clean AS (SELECT job_id, round_id FROM pk GROUP BY ALL
  HAVING count(DISTINCT (worker_id, chunk_id)) >= {S.EVENT_PAIRS})""",
        """tail AS (SELECT job_id, round_id, ts_us, lead(ts_us) OVER o AS before, row_number() OVER o AS rk
  FROM pk WINDOW o AS (PARTITION BY job_id, round_id ORDER BY ts_us DESC))""",
        f"""marks AS (
  SELECT 'Q2' AS query, 'complete_rounds' AS control_type, job_id, 1 AS r, 0 AS a FROM clean
  UNION ALL SELECT 'Q2', 'complete_rounds', job_id, 0, 1 FROM ({gap}) SEMI JOIN clean USING (job_id, round_id)
  UNION ALL SELECT 'Q3', 'complete_rounds', job_id, 1, 0 FROM clean
  UNION ALL SELECT 'Q3', 'complete_rounds', job_id, 0, 1 FROM tail SEMI JOIN clean USING (job_id, round_id)
    WHERE rk = 1 AND ts_us - before >= {S.TAIL_GAP_US})""",
    ]


CONTROL_CTES = _control_ctes()


def _controls() -> str:
    rate = half_even("CAST(sum(a) AS DOUBLE) / greatest(sum(r), 1)", 6)
    return with_(*CONTROL_CTES) + f"""
SELECT query || ' ' || control_type AS control, job_id, {rate} AS false_positive_rate
FROM marks GROUP BY query, control_type, job_id"""


FAULT_SCORES = f"""fault_scores AS (
  SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall,
         {half_even(FPR.format(fp='fp', n='healthy_rounds'), 6)} AS false_positive_rate FROM (
    SELECT seed, fault_type, count(*) FILTER (WHERE predicted AND actual) AS tp,
           count(*) FILTER (WHERE predicted) AS pp, count(*) FILTER (WHERE actual) AS ap,
           count(*) FILTER (WHERE predicted AND NOT actual) AS fp,
           count(*) FILTER (WHERE NOT actual) AS healthy_rounds,
           {ms('CASE WHEN predicted AND actual THEN detected_us - start_us END')} AS time_to_detection_ms,
           max(total) AS largest_round
    FROM fs GROUP BY seed, fault_type))"""

SHIFTED = f"""shifted AS (
  SELECT job_id, seed, CAST(greatest(0, start_round + sh) AS INTEGER) AS start_round,
         CAST(least(n_rounds, end_round + sh) AS INTEGER) AS end_round
  FROM (SELECT *, {seeded_worker('shift', 5)} - 2 AS sh FROM episodes, seeds))"""
ACTIVITY = f"""activity AS (
  SELECT seed, job_id, round_id, {uniform("'active'", 'job_id', 'round_id', 'seed')} < {d(S.EPISODE_ACTIVE_PROB)} AS active
  FROM (SELECT DISTINCT job_id, round_id FROM pk) o, seeds
  WHERE EXISTS (SELECT 1 FROM shifted x WHERE x.job_id = o.job_id AND x.seed = seeds.seed
                AND o.round_id >= x.start_round AND o.round_id < x.end_round))"""
_EXTERNAL, _AWARE = "dataflow_external_windowed", "schedule_aware"
INTERFERENCE = f"""base AS (
  SELECT m.job_id, m.round_id, s.seed, coalesce(a.active, false) AS active,
         m.latency_us + CASE WHEN a.active THEN {S.INTERFERENCE_DELAY_US} ELSE 0 END AS lat,
         {EVENT_START_US} + (CAST(m.round_id AS BIGINT) + 1) * {DAY_US} AS end_us
  FROM metrics m CROSS JOIN seeds s
  LEFT JOIN activity a ON a.seed = s.seed AND a.job_id = m.job_id AND a.round_id = m.round_id),
fed AS (
  SELECT '{_AWARE}' AS system, *, end_us AS detected_us FROM base
  UNION ALL
  SELECT '{_EXTERNAL}', *, end_us + {S.EXPORT_LATENCY_US} FROM base
  WHERE {uniform("'export'", 'job_id', 'round_id', 'seed')} >= {d(S.EXPORT_DROP_PROB)}),
fed_xy AS (SELECT *, lat / {d(1e6)} AS x, CASE WHEN active THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM fed),
{sliding('fed_xy', 'system, seed, job_id')},
hits AS (SELECT system, seed, job_id, round_id, detected_us FROM full_scores WHERE score >= {d(S.INTERFERENCE_THRESHOLD)}),
truth AS (SELECT system, seed, job_id, round_id FROM base, {unnested((_EXTERNAL, _AWARE), 'system')} WHERE active),
both_sides AS (
  SELECT system, seed, h.detected_us IS NOT NULL AS p, t.is_true IS NOT NULL AS a
  FROM hits h FULL JOIN (SELECT *, true AS is_true FROM truth) t USING (system, seed, job_id, round_id)),
firsts AS (
  SELECT h.system, h.seed, h.job_id, e.start_round, e.end_round, min(h.detected_us) AS first_us
  FROM hits h JOIN shifted e ON e.seed = h.seed AND e.job_id = h.job_id
   AND h.round_id >= e.start_round AND h.round_id < e.end_round + {S.CORR_WINDOW}
  GROUP BY ALL),
ttd AS (
  SELECT system, seed, count(*) AS episodes_found,
         {ms(f'(first_us - ({EVENT_START_US} + CAST(start_round AS BIGINT) * {DAY_US}))')} AS t
  FROM firsts GROUP BY system, seed),
interference_scores AS (
  SELECT s.*, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall,
         coalesce(ttd.episodes_found, 0) AS episodes_found, coalesce(ttd.t, {d(0.0)}) AS time_to_detection_ms
  FROM (SELECT system, seed, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p) AS pp,
               count(*) FILTER (WHERE a) AS ap, count(*) FILTER (WHERE p AND NOT a) AS fp
        FROM both_sides GROUP BY system, seed) s LEFT JOIN ttd USING (system, seed))"""
INTERFERENCE_ALL = [PK, METRICS, JOBS, BOUNDS, EPISODES, SAMPLE_SEEDS, SHIFTED, ACTIVITY, INTERFERENCE]

WIDTH = f"""mone AS (SELECT * FROM mkeyed WHERE loss_prob = {d(S.SWEEP_LOSS_PROB)}),
wide AS (SELECT *, CAST(unnest({listed(S.SKETCH_WIDTHS)}) AS INTEGER) AS sketch_width FROM mone),
{sketch('ws', 'wide', 'sketch_width', by='seed, sketch_width', ident='lossy_worker, ' + WORKER)},
width_low AS (
  SELECT seed, sketch_width, lossy_worker, job_id, round_id, count(*) AS keys, sum(abs(est - cnt)) AS ae,
         arg_min(worker_id, cnt * 1000 + worker_id) AS truth, arg_min(worker_id, est * 1000 + worker_id) AS pred
  FROM ws_e GROUP BY ALL),
width_scores AS (
  SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall,
         {ratio('ap', 'ap')} AS exact_precision, {ratio('ap', 'ap')} AS exact_recall
  FROM (
    SELECT seed, sketch_width, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(ae) AS BIGINT) AS abs_error,
           count(*) FILTER (WHERE truth = lossy_worker AND pred = lossy_worker) AS tp,
           count(*) FILTER (WHERE pred = lossy_worker) AS pp,
           count(*) FILTER (WHERE truth = lossy_worker) AS ap
    FROM width_low GROUP BY seed, sketch_width))"""
WIDTH_ALL = [PK, SAMPLE_SEEDS, LOSS, WIDTH]

KEY_MODE = f"""lost AS (
  SELECT seed, {WORKER}, greatest(1, count(*) FILTER (WHERE {uniform('seq', 'seed')} < {d(S.INTERMITTENT_PROB)})) AS lost
  FROM pk, seeds WHERE worker_id = {S.FAULT_WORKER} GROUP BY ALL),
actual AS (SELECT * FROM lost SEMI JOIN sampled USING (seed, job_id, round_id)),
left_counts AS (
  SELECT seed, {WORKER}, cnt - coalesce(lost, 0) AS cnt
  FROM (SELECT * FROM cnt, seeds) LEFT JOIN actual USING (seed, {WORKER})),
{", ".join(_SEED_CTES)},
estimates AS ({_SEED_BODY}
  UNION ALL SELECT 'job_round_worker_chunk', 3, seed, {WORKER}, cnt, cnt FROM left_counts),
predicted AS (
  SELECT key_mode, mode_order, seed, job_id, round_id FROM estimates GROUP BY ALL
  HAVING max(est) - min(est) >= {S.CONTROL_GAP} AND arg_min(worker_id, est * 1000 + worker_id) = {S.FAULT_WORKER}),
mode_truth AS (
  SELECT key_mode, mode_order, seed, job_id, round_id FROM actual, (SELECT DISTINCT key_mode, mode_order FROM estimates)),
mode_scores AS (
  SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall FROM (
    SELECT key_mode, mode_order, seed, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p) AS pp,
           count(*) FILTER (WHERE a) AS ap, count(*) FILTER (WHERE p AND NOT a) AS fp
    FROM (SELECT key_mode, mode_order, seed, coalesce(p, false) AS p, coalesce(a, false) AS a
          FROM (SELECT *, true AS p FROM predicted)
          FULL JOIN (SELECT *, true AS a FROM mode_truth) USING (key_mode, mode_order, seed, job_id, round_id))
    GROUP BY ALL))"""
KEY_MODE_ALL = [PK, CNT, SAMPLE_SEEDS, sample(S.INTERMITTENT_FRACTION), KEY_MODE]

ROUND_KEY_COUNT = S.N_JOBS * S.N_ROUNDS * S.N_WORKERS
FIXED = "fixed sketch registers; logical keys jobs*rounds*workers"
WINDOW_BITS = S.CORR_WINDOW * 65


def config(workload: str, query: str, n_jobs: int | str = S.N_JOBS) -> str:
    return (
        f"'{workload}' AS workload, {query} AS query, {n_jobs} AS n_jobs, {S.N_ROUNDS} AS n_rounds, "
        f"{S.N_WORKERS} AS n_workers, {S.N_CHUNKS} AS n_chunks"
    )


def _loss_rows() -> str:
    return with_(*LOSS_ALL) + f"""SELECT {config('packet_loss', "'Q2'")}, system, true AS expressible, loss_prob, seed,
  "precision", recall, state_entries, state_entries * 32 AS counter_bits,
  CASE system WHEN 'sketch' THEN {ROUND_KEY_COUNT} ELSE state_entries END AS keys_tracked,
  CASE system WHEN 'sketch' THEN 5 ELSE 1 END AS per_packet_ops,
  CASE system WHEN 'dataflow' THEN 'rounds*workers'
              WHEN 'schedule_aware' THEN 'active-round worker counters + round metadata'
              ELSE '{FIXED}' END AS scaling_model
FROM (SELECT *, CASE system WHEN 'dataflow' THEN keys WHEN 'schedule_aware' THEN {S.N_WORKERS + 1}
                ELSE {CELLS} END AS state_entries FROM loss_scores)"""


def _width_rows() -> str:
    return with_(*WIDTH_ALL) + f"""SELECT {config('sketch_budget', "'Q2'")}, 'sketch' AS system, true AS expressible,
  {d(S.SWEEP_LOSS_PROB)} AS loss_prob, sketch_width, seed, "precision", recall, sketch_width * 5 AS state_entries,
  sketch_width * 160 AS counter_bits, {ROUND_KEY_COUNT} AS keys_tracked, 5 AS per_packet_ops, '{FIXED}' AS scaling_model
FROM width_scores
UNION ALL
SELECT {config('sketch_budget', "'Q2'")}, 'dataflow', true, {d(S.SWEEP_LOSS_PROB)}, NULL, seed, exact_precision, exact_recall,
  keys, keys * 32, keys, 1, 'rounds*workers'
FROM width_scores WHERE sketch_width = {min(S.SKETCH_WIDTHS)}"""


def _key_mode_rows() -> str:
    return with_(*KEY_MODE_ALL) + f"""SELECT {config('sketch_key_sensitivity', "'Q2'")}, 'sketch' AS system, true AS expressible,
  {d(S.INTERMITTENT_PROB)} AS loss_prob, key_mode, seed, "precision", recall, pp AS alerts,
  {CELLS} AS state_entries, {CELLS * 32} AS counter_bits,
  CASE key_mode WHEN 'worker' THEN {S.N_WORKERS} WHEN 'job_worker' THEN {S.N_JOBS * S.N_WORKERS}
    WHEN 'job_round_worker' THEN {ROUND_KEY_COUNT} ELSE {ROUND_KEY_COUNT * S.N_CHUNKS} END AS keys_tracked,
  5 AS per_packet_ops,
  CASE key_mode WHEN 'worker' THEN 'workers' WHEN 'job_worker' THEN 'jobs*workers'
    WHEN 'job_round_worker' THEN 'jobs*rounds*workers' ELSE 'jobs*rounds*workers*chunks' END AS scaling_model
FROM mode_scores"""


def _straggler_rows() -> str:
    return with_(PK, SAMPLE_SEEDS, STRAGGLER) + f"""SELECT {config('straggler', "'Q3'")}, system, system <> 'sketch' AS expressible,
  CAST(delay_ms AS DOUBLE) AS delay_ms, seed, observed_rounds,
  CASE WHEN system <> 'sketch' THEN "precision" END AS "precision",
  CASE WHEN system <> 'sketch' THEN recall END AS recall,
  CASE system WHEN 'dataflow' THEN observed_rounds WHEN 'schedule_aware' THEN 1 END AS state_entries,
  CASE system WHEN 'dataflow' THEN observed_rounds * 67 WHEN 'schedule_aware' THEN 67 END AS counter_bits,
  CASE system WHEN 'dataflow' THEN observed_rounds WHEN 'schedule_aware' THEN 1 END AS keys_tracked,
  CASE WHEN system <> 'sketch' THEN 2 END AS per_packet_ops,
  CASE system WHEN 'dataflow' THEN 'rounds with timestamp+argmax worker'
              WHEN 'schedule_aware' THEN 'active-round timestamp+argmax worker'
              ELSE 'not expressible' END AS scaling_model,
  CASE system WHEN 'sketch' THEN 'a sketch keeps no argmax over keys' END AS reason
FROM straggler_scores, {unnested(('dataflow', 'schedule_aware', 'sketch'), 'system')}"""


def _fault_rows() -> str:
    shown = ", ".join(
        f'CASE WHEN system <> \'sketch\' THEN "{m}" END AS "{m}"'
        for m in ("precision", "recall", "false_positive_rate", "time_to_detection_ms")
    )
    windowed = f"greatest(largest_round, {max(S.EXPECTED_ROUND, S.N_WORKERS * S.N_CHUNKS)})"
    own = S.N_WORKERS + S.N_CHUNKS
    return with_(*FAULT_ALL, FAULT_SCORES) + f"""SELECT {config('round_failure', "'Q4'")}, system, system <> 'sketch' AS expressible,
  fault_type, {d(S.TIMEOUT_US / 1000.0)} AS timeout_ms, seed, {shown},
  CASE WHEN system <> 'sketch' THEN pp END AS alerts,
  CASE system WHEN 'dataflow_windowed' THEN {windowed} WHEN 'schedule_aware' THEN {own} END AS state_entries,
  CASE system WHEN 'dataflow_windowed' THEN {windowed} WHEN 'schedule_aware' THEN {S.N_WORKERS * 32 + S.N_CHUNKS} END AS counter_bits,
  CASE system WHEN 'dataflow_windowed' THEN {windowed} WHEN 'schedule_aware' THEN {own} END AS keys_tracked,
  CASE WHEN system <> 'sketch' THEN 2 END AS per_packet_ops,
  CASE system WHEN 'dataflow_windowed' THEN 'workers*chunks expected-set bitmap'
              WHEN 'schedule_aware' THEN 'active-round worker counters + chunk bitmap'
              ELSE 'not expressible' END AS scaling_model,
  CASE system WHEN 'sketch' THEN 'a sketch cannot be compared with an expected set' END AS reason
FROM fault_scores, {unnested(('dataflow_windowed', 'schedule_aware', 'sketch'), 'system')}"""


def _interference_rows() -> str:
    common = f"""{config('interference', "'Q5'", 2)}, {S.CORR_WINDOW} AS window_size,
  {d(S.INTERFERENCE_DELAY_US / 1000.0)} AS interference_delay_ms, seed"""
    return with_(*INTERFERENCE_ALL) + f"""SELECT {common}, system, true AS expressible, "precision", recall,
  time_to_detection_ms, pp AS alerts, {2 * S.CORR_WINDOW} AS state_entries, {WINDOW_BITS} AS counter_bits,
  {S.CORR_WINDOW} AS keys_tracked, 2 AS per_packet_ops,
  CASE system WHEN '{_AWARE}' THEN 'job-round correlation window'
              ELSE 'window_size downstream correlation state' END AS scaling_model, NULL AS reason
FROM interference_scores
UNION ALL
SELECT {common}, s, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not expressible',
  'correlation across jobs is outside the model'
FROM seeds, {unnested(('dataflow', 'sketch'), 's')}"""


def _control_rows() -> str:
    return with_(*CONTROL_CTES) + f"""SELECT {config('negative_control', 'query')}, control_type, true AS expressible, 0 AS seed,
  alerts, {half_even(FPR.format(fp='alerts', n='rounds'), 6)} AS false_positive_rate,
  'dataflow_control' AS system,
  CASE query WHEN 'Q3' THEN rounds ELSE rounds * {S.N_WORKERS} END AS state_entries,
  CASE query WHEN 'Q3' THEN rounds * 67 ELSE rounds * {S.N_WORKERS * 32} END AS counter_bits,
  CASE query WHEN 'Q3' THEN rounds ELSE rounds * {S.N_WORKERS} END AS keys_tracked,
  CASE query WHEN 'Q2' THEN 1 ELSE 2 END AS per_packet_ops,
  CASE query WHEN 'Q3' THEN 'rounds with timestamp+argmax worker'
             ELSE 'rounds*workers' END AS scaling_model
FROM (SELECT query, control_type, CAST(sum(r) AS BIGINT) AS rounds, CAST(sum(a) AS BIGINT) AS alerts
      FROM marks GROUP BY query, control_type)"""


JOB_SIZES = f"""sizes AS (
  SELECT DISTINCT n_jobs, keys FROM (
    SELECT CAST(count(DISTINCT job_id) AS INTEGER) AS n_jobs, count(*) AS keys
    FROM cnt, {unnested((*S.JOB_COUNTS, 2**31), 'first_jobs')}
    WHERE job_id >= 0 AND job_id < first_jobs GROUP BY first_jobs))"""
JOB_STATE = f"""
SELECT 'dataflow' AS system, n_jobs, keys AS state_entries, keys * 32 AS counter_bits,
       keys * 4 AS register_bytes, keys AS keys_tracked, 1::BIGINT AS per_packet_ops,
       'jobs*rounds*workers' AS scaling_model
FROM sizes UNION ALL
SELECT 'sketch', n_jobs, {CELLS}, {CELLS * 32}, {CELLS * 4}, n_jobs * {S.N_ROUNDS * S.N_WORKERS}, 5, '{FIXED}'
FROM sizes"""


def _job_rows() -> str:
    return with_(PK, CNT, JOB_SIZES, f"js AS ({JOB_STATE})") + f"""
SELECT * EXCLUDE (n_jobs, register_bytes), {config('multitenant', "'Q2'", 'n_jobs')}, true AS expressible, 0 AS seed FROM js"""


def _run_rows(*parts: str) -> str:
    """CTE ``run_rows``: the complete result rows of the given experiments."""
    fields = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in GROUP_FIELDS.items())
    computed = {
        "register_bytes": f"ceil(counter_bits / {d(8.0)})",
        "packets": "n_workers * n_chunks * n_rounds * n_jobs",
    }
    metrics = ", ".join(
        f'CAST({computed.get(m, chr(34) + m + chr(34))} AS DOUBLE) AS "{m}"' for m in METRIC_FIELDS
    )
    # A part without rows that names every column, so that each one exists in the union.
    names = [*GROUP_FIELDS, "seed", *(m for m in METRIC_FIELDS if m not in computed), "reason",
             "counter_bits"]
    kinds = {**GROUP_FIELDS, "seed": "int", "reason": "string"}
    blank = ", ".join(
        f'CAST(NULL AS {kinds.get(n, "double")}) AS "{n}"' for n in dict.fromkeys(names)
    )
    union = "\nUNION ALL BY NAME\n".join(
        f"SELECT * FROM ({sql})" for sql in (f"SELECT {blank} WHERE false", *parts)
    )
    return f"""WITH run_rows AS (
SELECT {fields}, CAST(seed AS INTEGER) AS seed, {metrics}, reason FROM ({union}))
"""


def ci(metric: str, prefix: str, names: tuple[str, str, str], unit: bool) -> str:
    col = f'CAST("{metric}" AS DOUBLE)'
    mean = f"avg({col})"
    half = f"{d(1.96)} * coalesce(stddev_samp({col}), 0) / sqrt(count({col}))"
    low, high = f"{mean} - {half}", f"{mean} + {half}"
    if unit:
        low = f"CASE WHEN {mean} IS NOT NULL THEN greatest({low}, {d(0.0)}) END"
        high = f"CASE WHEN {mean} IS NOT NULL THEN least({high}, {d(1.0)}) END"
    values = zip((mean, low, high), names, strict=True)
    return ", ".join(f'{half_even(v, 6)} AS "{prefix}_{n}"' for v, n in values)


def _all_rows() -> str:
    return _run_rows(
        _loss_rows(), _width_rows(), _key_mode_rows(), _straggler_rows(), _fault_rows(),
        _interference_rows(), _control_rows(), _job_rows(),
    )


def _summary() -> str:
    metrics = ",\n  ".join(
        ci(m, m, ("mean", "ci95_low", "ci95_high"), m in UNIT_METRICS) for m in METRIC_FIELDS
    )
    fields = ", ".join(GROUP_FIELDS)
    return _all_rows() + f"""SELECT {fields}, count(*) AS n_samples, min(seed) AS seed_min, max(seed) AS seed_max,
  {metrics}
FROM run_rows GROUP BY {fields}"""


def _series() -> str:
    metrics = ", ".join(
        ci(m, m, ("mean", "low", "high"), m in UNIT_METRICS) for m in ("precision", "recall", "state")
    )
    return _run_rows(_loss_rows()) + f"""SELECT system, n_workers AS workers, loss_prob AS x, {metrics}
FROM (SELECT *, coalesce(register_bytes, state_entries) AS state FROM run_rows)
GROUP BY system, n_workers, loss_prob"""


PK_SELECT = "SELECT ts_us, job_id, round_id, worker_id, chunk_id, size, seq FROM pk"

ORACLES: dict[str, str] = {
    "scan_events": with_(PK) + PK_SELECT,
    "results_csv_roundtrip": with_(PK, all_counts("pk", S.N_WORKERS), BELOW) + f"""
SELECT 'Q1' AS query, job_id, round_id, max(ts_us) - min(ts_us) AS latency_us,
       NULL::INTEGER AS worker_id, NULL::BIGINT AS cnt FROM pk GROUP BY job_id, round_id
UNION ALL
SELECT 'Q2', job_id, round_id, NULL, arg_min(worker_id, cnt * 1000 + worker_id), min(cnt)
FROM below GROUP BY job_id, round_id""",
    "merge_ordered": with_(PK, PL) + """
SELECT ts_us, job_id, round_id, worker_id, chunk_id, seq, 0 AS stream_id FROM pk
UNION ALL SELECT ts_us, job_id, round_id, worker_id, chunk_id, seq, 1 FROM pl
ORDER BY ts_us, stream_id, seq""",
    "q2_from_counts": with_(PL) + f"SELECT {WORKER}, count(*) AS cnt FROM pl GROUP BY ALL",
    "round_tail": with_(PK) + f"""SELECT * EXCLUDE (rk, event_type) FROM (
  SELECT *, row_number() OVER (PARTITION BY {WORKER} ORDER BY ts_us DESC, seq) AS rk FROM pk) WHERE rk = 1""",
    "flt_events": with_(PK) + PK_SELECT + " WHERE size > 20 AND event_type IN ('click', 'view')",
    "map_events": with_(PK) + "SELECT '(' || job_id || ', ' || round_id || ')' AS key, ts_us AS value FROM pk",
    "round_schedule": with_(PK, JOBS, SCHED)
    + f"SELECT job_id, round_id, start_us, end_us, end_us + {S.TIMEOUT_US} AS deadline_us, expected FROM sched",
    "sketch_key_modes": with_(PK, CNT, *_MODE_CTES) + _MODE_BODY,
    "rounds_in_episode": with_(
        PK, JOBS, BOUNDS, EPISODES, SAMPLE_SEEDS, SHIFTED, ACTIVITY) + "SELECT * FROM activity",
    "safe_numeric": r"""
SELECT event_id, TRY_CAST(txt AS DOUBLE) AS num, lower(flag) = 'false' AS is_false FROM (
  SELECT event_id,
    CASE event_type WHEN 'error' THEN '' WHEN 'view' THEN props
      WHEN 'signup' THEN '-' || regexp_replace(props, '[^0-9]', '', 'g') || '.5e1'
      WHEN 'purchase' THEN regexp_replace(props, '[^0-9]', '', 'g') || 'd'
      ELSE regexp_replace(props, '[^0-9]', '', 'g') END AS txt,
    CASE user_id % 3 WHEN 0 THEN 'False' WHEN 1 THEN 'FALSE ' ELSE CAST(user_id AS VARCHAR) END AS flag
  FROM events)""",
    "q4_failures_from_counts": with_(PK, JOBS, SCHED, METRICS) + f"""
SELECT s.job_id, s.round_id, s.end_us + {S.TIMEOUT_US} AS detected_us, coalesce(m.n, 0) AS observed, s.expected,
       CASE WHEN coalesce(m.n, 0) = 0 THEN 'missing-round' ELSE 'missing-pairs' END AS reason
FROM sched s LEFT JOIN metrics m USING (job_id, round_id) WHERE coalesce(m.n, 0) < s.expected""",
    "q2_lossy_worker": with_(PK, all_counts("pk", S.N_WORKERS), BELOW) + f"""
SELECT job_id, round_id, arg_min(worker_id, cnt * 1000 + worker_id) AS worker_id, min(cnt) AS cnt
FROM below GROUP BY job_id, round_id""",
    "q5_pairwise_corr": with_(PK, METRICS, """p AS (
  SELECT a.job_id AS job_a, b.job_id AS job_b, a.latency_us::DOUBLE AS x, b.latency_us::DOUBLE AS y
  FROM metrics a JOIN metrics b ON a.round_id = b.round_id AND a.job_id < b.job_id)""") + f"""
SELECT job_a, job_b, count(*) AS rounds, {half_even(FLAT_CORR.format(o=''), 6)} AS corr
FROM p GROUP BY job_a, job_b HAVING count(*) >= 3""",
    "score_lossy_worker": with_(*LOSS_ALL) + SCORE_SELECT + "WHERE system <> 'schedule_aware'",
    "score_lossy_expected": with_(*LOSS_ALL) + SCORE_SELECT + "WHERE system = 'schedule_aware'",
    "score_sets": with_(*FAULT_ALL, FAULT_SCORES) + """
SELECT seed, fault_type, tp, pp, ap, fp, "precision", recall FROM fault_scores""",
    "score_labels": f"""
SELECT *, {ratio('tp', 'pp')} AS "precision", {ratio('tp', 'ap')} AS recall FROM (
  SELECT lang, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p) AS pp,
         count(*) FILTER (WHERE a) AS ap, count(*) FILTER (WHERE p AND NOT a) AS fp
  FROM (SELECT lang, n_chars >= {S.LONG_CHARS} AS p, quality = 1 AS a
        FROM documents JOIN labels USING (doc_id))
  GROUP BY lang)""",
    "score_fpr": with_(*FAULT_ALL, FAULT_SCORES) + """
SELECT seed, fault_type, fp, healthy_rounds, false_positive_rate FROM fault_scores""",
    "score_ttd": with_(*FAULT_ALL, FAULT_SCORES) + """
SELECT seed, fault_type, tp AS detections, time_to_detection_ms FROM fault_scores""",
    "episode_first_detection": with_(
        PK, METRICS, JOBS, BOUNDS, EPISODES, PAIRS, sliding("pairs"), CORR_ALERTS) + f"""
SELECT job_a, job_b, start_round, end_round, count(*) AS detections,
       arg_min(alert_round, detected_us) AS alert_round, min(detected_us) AS detected_us,
       (min(detected_us) - ({EVENT_START_US} + CAST(start_round AS BIGINT) * {DAY_US})) / {d(1000.0)} AS ttd_ms
FROM (SELECT a.job_a, a.job_b, CAST(e.start_round AS INTEGER) AS start_round, CAST(e.end_round AS INTEGER) AS end_round,
             a.round_id AS alert_round, a.detected_us
      FROM alerts a JOIN episodes e ON a.job_a = e.job_id
       AND a.round_id >= e.start_round AND a.round_id < e.end_round + {S.CORR_WINDOW})
GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY job_a, job_b, start_round, end_round"),
    "sketch_table": with_(PK, CNT, KEYED, sketch("s", "keyed", S.SKETCH_WIDTH)) + "SELECT * FROM s_t",
    "sketch_point_estimate": with_(PK, CNT, KEYED, sketch("s", "keyed", S.SKETCH_WIDTH))
    + f"SELECT {WORKER}, cnt, est FROM s_e",
    "sketch_heavy_hitters": with_(PK, CNT, KEYED, sketch("s", "keyed", S.SKETCH_WIDTH))
    + f"SELECT {WORKER}, est FROM s_e WHERE est >= {S.HEAVY_THRESHOLD}",
    "sketch_levels": with_(PK, """jw AS (
  SELECT job_id, worker_id, count(*) AS cnt, '(' || job_id || ', ' || worker_id || ')' AS key
  FROM pk GROUP BY job_id, worker_id)""", f"""leveled AS (
  SELECT job_id, worker_id, cnt, key, CAST(unnest(range(lvl + 1)) AS INTEGER) AS level FROM (
    SELECT *, least({S.SKETCH_LEVELS - 1}, CASE WHEN hv = 0 THEN 32
      ELSE length(bin(hv)) - length(rtrim(bin(hv), '0')) END) AS lvl
    FROM (SELECT *, {u32('md5(key)')} AS hv FROM jw)))""",
        sketch("s", "leveled", S.SKETCH_WIDTH, by="level", seed="42 + level", ident="job_id, worker_id"))
    + "SELECT * FROM s_t",
    "sketch_width_sweep": with_(*WIDTH_ALL) + f"""SELECT seed, sketch_width, "precision", recall, exact_precision, exact_recall,
  abs_error, CAST(sketch_width * {S.SKETCH_DEPTH} AS BIGINT) AS state_entries FROM width_scores""",
    "timeout_sweep": with_(
        PK, JOBS, SCHED,
        f"planned AS (SELECT * FROM sched, {unnested(S.SWEEP_TIMEOUTS_US, 'timeout_us')})",
        f"act AS (SELECT job_id, round_id, timeout_us, ts_us AS t, 1 AS n FROM pk, {unnested(S.SWEEP_TIMEOUTS_US, 'timeout_us')})",
        inactivity("st", "act", "planned", "job_id, round_id, timeout_us").replace(
            "p.start_us, p.expected, p.timeout_us, a.t", "p.start_us, p.expected, a.t").replace(
            "any_value(timeout_us)", "timeout_us")) + f"""
SELECT *, {half_even(FPR.format(fp='false_positives', n='healthy_rounds'), 6)} AS false_positive_rate FROM (
  SELECT timeout_us, count(detected_us) AS alerts,
         count(*) FILTER (WHERE reason = 'missing-round') AS missing_round,
         count(*) FILTER (WHERE reason = 'premature-timeout') AS premature_timeout,
         count(*) FILTER (WHERE reason = 'missing-pairs') AS missing_pairs,
         count(*) FILTER (WHERE total >= expected) AS healthy_rounds,
         count(*) FILTER (WHERE total >= expected AND detected_us IS NOT NULL) AS false_positives,
         {ms('CASE WHEN total < expected THEN detected_us - start_us END')} AS lag_ms
  FROM st GROUP BY timeout_us)""",
    "reduce_by_key_fold": with_(PK, METRICS) + "SELECT job_id, round_id, latency_us FROM metrics",
    "q1_round_latency": with_(PK, METRICS) + "SELECT job_id, round_id, latency_us FROM metrics",
    "q2_worker_counts": with_(PL) + f"SELECT {WORKER}, count(*) AS cnt FROM pl GROUP BY ALL",
    "q3_straggler": with_(PK) + """SELECT job_id, round_id, worker_id FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, round_id ORDER BY ts_us DESC, seq) AS rk FROM pk) WHERE rk = 1""",
    "q4_incomplete_rounds": with_(PK, PL) + f"""
SELECT job_id, round_id, count(DISTINCT (worker_id, chunk_id)) AS pairs,
       count(DISTINCT (worker_id, chunk_id)) < {S.EVENT_PAIRS} AS incomplete, 'events' AS source
FROM pk GROUP BY job_id, round_id
UNION ALL
SELECT job_id, round_id, count(DISTINCT (worker_id, chunk_id)),
       count(DISTINCT (worker_id, chunk_id)) < {S.LINE_PAIRS}, 'lineitem'
FROM pl GROUP BY job_id, round_id""",
    "q4_conversation_gaps": """
SELECT conv_id AS round_id, count(DISTINCT turn) AS turns, max(turn) + 1 AS expected,
       count(DISTINCT turn) < max(turn) + 1 AS incomplete
FROM conversations GROUP BY conv_id""",
    "q2_gap_rounds": with_(PL, all_counts("pl", S.N_LINE_WORKERS)) + """
SELECT job_id, round_id, max(cnt) AS max_cnt, min(cnt) AS min_cnt FROM c GROUP BY job_id, round_id
HAVING max(cnt) - min(cnt) >= 2 AND arg_min(worker_id, cnt * 1000 + worker_id) = 7""",
    "summary_ci95": _summary(),
    "score_key_modes": with_(*KEY_MODE_ALL) + "SELECT * FROM mode_scores",
    "score_interference": with_(*INTERFERENCE_ALL) + "SELECT * FROM interference_scores",
    "result_rows": _all_rows() + "SELECT * FROM run_rows",
    "state_totals": f"""SELECT system, count(state_entries) AS models, CAST(sum(state_entries) AS BIGINT) AS state_entries,
  CAST(sum(register_bytes) AS BIGINT) AS register_bytes FROM ({_profile()}) GROUP BY system""",
    "state_profile": _profile(),
    "q3_tail_gap": with_(PK) + f"""
SELECT job_id, round_id, ts_us - before AS gap_us, ts_us - before >= {S.TAIL_GAP_US} AS alert FROM (
  SELECT job_id, round_id, ts_us, lead(ts_us) OVER o AS before, row_number() OVER o AS rk FROM pk
  WINDOW o AS (PARTITION BY job_id, round_id ORDER BY ts_us DESC)) WHERE rk = 1 AND before IS NOT NULL""",
    "q5_sliding_corr": with_(PK, METRICS, PAIRS, sliding("pairs"))
    + "SELECT job_a, job_b, round_id, score FROM full_scores",
    "q5_sliding_corr_lossy": with_(
        PK, METRICS, PAIRS,
        f"kept AS (SELECT * FROM pairs WHERE {uniform(repr('export'), 'job_a', 'job_b', 'round_id')} >= {d(S.EXPORT_DROP_PROB)})",
        sliding("kept")) + "SELECT job_a, job_b, round_id, score FROM full_scores",
    "q5_corr_alerts": with_(PK, METRICS, PAIRS, sliding("pairs"), CORR_ALERTS) + "SELECT * FROM alerts",
    "q4_inactivity_alerts": with_(
        PK, JOBS, SCHED, PLANNED, "act AS (SELECT job_id, round_id, ts_us AS t, 1 AS n FROM pk)",
        inactivity("st", "act", "planned", ROUND_KEYS)) + ALERTS,
    "q4_inactivity_default_time": with_(
        PK, JOBS, SCHED, PLANNED, """act AS (
  SELECT pk.job_id, pk.round_id,
         CASE WHEN chunk_id = 1 AND worker_id % 2 = 1 THEN end_us ELSE ts_us END AS t, 1 AS n
  FROM pk JOIN sched USING (job_id, round_id))""",
        inactivity("st", "act", "planned", ROUND_KEYS)) + ALERTS,
    "distinct_first": with_(PK) + f"""SELECT * EXCLUDE (rk, event_type) FROM (
  SELECT *, row_number() OVER (PARTITION BY {WORKER}, chunk_id ORDER BY ts_us, seq) AS rk FROM pk) WHERE rk = 1""",
    "sample_rounds": with_(PK, SAMPLE_SEEDS, sample(S.FAULT_FRACTION)) + "SELECT * FROM sampled",
    "metric_series": _series(),
    "score_straggler": with_(PK, SAMPLE_SEEDS, STRAGGLER) + "SELECT * FROM straggler_scores",
    "negative_controls": _controls(),
    "state_by_jobs": with_(PK, CNT, JOB_SIZES) + JOB_STATE,
    "na_systems": _run_rows(_straggler_rows(), _fault_rows(), _interference_rows()) + """
SELECT workload, 'N/A: ' || array_to_string(list_sort(list(DISTINCT system)), ', ') || ' not expressible' AS note
FROM run_rows WHERE NOT expressible GROUP BY workload""",
    "mask_drop": with_(PK) + f"""SELECT seq, {WORKER} FROM pk
WHERE {uniform('seq', '0')} >= {d(1.0)} - ({d(1.0)} - CASE worker_id WHEN 3 THEN {d(0.2)} WHEN 5 THEN {d(0.05)} ELSE {d(0.0)} END)
      * ({d(1.0)} - {d(0.02)})""",
    "mask_skip": with_(PK) + f"""SELECT seq, {WORKER}, chunk_id FROM pk
WHERE (worker_id, chunk_id) NOT IN ((3, 0), (5, 1), (6, 1))""",
    "mask_rounds": with_(PK, SAMPLE_SEEDS, sample(S.FAULT_FRACTION)) + f"""SELECT seq, {WORKER} FROM pk
ANTI JOIN (SELECT * FROM sampled WHERE seed = 0) USING (job_id, round_id)""",
    "mask_delay": with_(PK) + f"""SELECT seq, {WORKER},
  ts_us + CASE worker_id WHEN 2 THEN {S.HOUR_US} WHEN 7 THEN 90000000 ELSE 0 END AS ts_us FROM pk""",
    "mask_intermittent": with_(PK, SAMPLE_SEEDS, sample(S.INTERMITTENT_FRACTION), f"""marked AS (
  SELECT pk.*, s.seed IS NOT NULL AS fault_round,
         min(seq) FILTER (WHERE worker_id = 7) OVER (PARTITION BY pk.job_id, pk.round_id) AS first_seq
  FROM pk LEFT JOIN (SELECT * FROM sampled WHERE seed = 0) s ON s.job_id = pk.job_id AND s.round_id = pk.round_id)""") + f"""
SELECT {WORKER}, count(*) AS cnt, fault_round FROM marked
WHERE NOT (fault_round AND worker_id = 7 AND (seq = first_seq OR {uniform('seq', '0')} < {d(0.3)}))
GROUP BY ALL""",
}

ORACLES |= {
    "stream_scan_events": ORACLES["scan_events"],
    "stream_q1_latency": ORACLES["q1_round_latency"],
    "stream_q2_counts": with_(PK, CNT) + f"SELECT {WORKER}, cnt FROM cnt",
    "stream_q3_straggler": ORACLES["q3_straggler"],
    "stream_distinct": with_(PK) + f"""SELECT * EXCLUDE (rk, event_type) FROM (
  SELECT *, row_number() OVER (PARTITION BY {WORKER} ORDER BY ts_us, seq) AS rk FROM pk) WHERE rk = 1""",
    "stream_tumbling_counts": with_(PK) + f"""
SELECT {EVENT_START_US} + CAST(round_id AS BIGINT) * {DAY_US} AS start_us, job_id, count(*) AS n
FROM pk GROUP BY round_id, job_id""",
    "stream_inactivity_alerts": ORACLES["q4_inactivity_alerts"],
    "stream_corr_alerts": ORACLES["q5_corr_alerts"],
    "reduce_by_key_named": with_(PK) + """
SELECT job_id, round_id, CAST(sum(chunk_id) AS BIGINT) AS total, count(chunk_id) AS n,
       min(chunk_id) AS lo, max(chunk_id) AS hi,
       arg_max(worker_id, (ts_us, -seq)) AS last_worker,
       array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunks
FROM pk GROUP BY ALL""",
    "fold_in_order": with_(PK) + f"""
SELECT job_id, round_id, list_reduce(
  list_prepend(1::BIGINT, list(worker_id::BIGINT ORDER BY seq)),
  lambda x, digit: (x * {S.FOLD_BASE} + digit) % {S.FOLD_PRIME}) AS digest
FROM pk GROUP BY ALL""",
    "stream_sketch_table": ORACLES["sketch_table"],
    "stream_sketch_estimate": ORACLES["sketch_point_estimate"],
    "stream_sketch_levels": ORACLES["sketch_levels"],
    "stream_state_entries": with_(PK, CNT, KEYED, sketch("s", "keyed", S.SKETCH_WIDTH)) + """
SELECT 'dataflow' AS system, count(*) AS entries FROM cnt
UNION ALL SELECT 'dataflow_windowed', 0 UNION ALL SELECT 'sketch', count(*) FROM s_t""",
    "stream_scheduled_rounds": with_(PK, f"""planned AS (
  SELECT job_id, CAST(r AS INTEGER) AS round_id,
         {EVENT_START_US} + job_id * {S.HOUR_US} + r * {S.GAP_DURATION_US + S.GAP_US} AS start_us
  FROM (SELECT DISTINCT job_id, unnest(range({S.GAP_ROUNDS})) AS r FROM pk WHERE job_id >= 0))""") + f"""
SELECT p.job_id, p.round_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(ts_us) AS n
FROM planned p LEFT JOIN pk ON pk.job_id = p.job_id
  AND ts_us >= start_us AND ts_us < start_us + {S.GAP_DURATION_US}
GROUP BY ALL""",
    "stream_deadline_alerts": ORACLES["q4_failures_from_counts"],
    "stream_episode_detection": ORACLES["episode_first_detection"],
    "stream_configured_pair": f"""SELECT * FROM ({ORACLES["q5_corr_alerts"]})
WHERE job_a = {S.CONFIGURED_PAIR[0]} AND job_b = {S.CONFIGURED_PAIR[1]}""",
}
