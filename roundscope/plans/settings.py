"""Parameters of the named queries, shared by the plans and their SQL counterparts."""

from __future__ import annotations

from roundscope.sources.bindings import DAY_US, EVENT_START_US  # noqa: F401 - read as settings

HOUR_US = 3_600_000_000

#: Expected messages of an event round, and of one worker in it.
EXPECTED_ROUND = 60
EXPECTED_WORKER = 8
#: Expected distinct (worker, chunk) pairs: 8 x 2 for events, 16 x 7 for line items.
EVENT_PAIRS = 16
LINE_PAIRS = 112
N_JOBS, N_ROUNDS, N_WORKERS, N_CHUNKS = 5, 30, 8, 2
N_LINE_WORKERS = 16

TIMEOUT_US = 2 * HOUR_US
#: A schedule with gaps: length of a round, gap after it, rounds per job.
GAP_DURATION_US, GAP_US, GAP_ROUNDS = 9 * HOUR_US + 30, 3 * HOUR_US - 7, 61
SWEEP_TIMEOUTS_US = (HOUR_US // 2, HOUR_US, 2 * HOUR_US, 3 * HOUR_US)

CORR_WINDOW = 8
CORR_THRESHOLD = 0.5
#: Latency of the first job against activity of the second.
CONFIGURED_PAIR = (0, 4)
#: Silence after which a stream forgets a pair of jobs.
RETIRE_US = 30 * DAY_US
EXPORT_LATENCY_US = 50_000
EXPORT_DROP_PROB = 0.25
EPISODE_ACTIVE_PROB = 0.85

SKETCH_WIDTH = 512
SKETCH_DEPTH = 5
SKETCH_WIDTHS = (32, 128, 512, 2048, 8192, 32768)
SKETCH_LEVELS = 8
HEAVY_THRESHOLD = 12
KEY_MODES = ("worker", "job_worker", "job_round_worker")

SEEDS = (0, 1, 2, 3, 4)
LOSS_PROBS = (0.001, 0.01, 0.05)
SWEEP_LOSS_PROB = 0.01
BASELINE_FRACTION = 0.4
DELAYS_MS = (60_000, 3_600_000, 14_400_000)
FAULT_FRACTION = 0.10
INTERMITTENT_FRACTION = 0.20
INTERMITTENT_PROB = 0.3
FAULT_WORKER = 7
FAULT_TYPES = ("failed_round", "missing_chunks", "healthy")

INTERFERENCE_DELAY_US = 30 * 60_000_000
INTERFERENCE_THRESHOLD = 0.75

TAIL_GAP_US = 10 * 60_000_000
CONTROL_GAP = 1
#: Base and modulus of an ordered fold.
FOLD_BASE, FOLD_PRIME = 31, 1_000_003
LONG_CHARS = 1000
JOB_COUNTS = (1, 2, 4)
