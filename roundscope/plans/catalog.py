"""All named queries."""

from __future__ import annotations

from roundscope.plans import correlation, masks, per_round, reports, scoring, sketches, stream

BATCH = {
    **per_round.QUERIES, **correlation.QUERIES, **sketches.QUERIES, **masks.QUERIES,
    **scoring.QUERIES, **reports.QUERIES,
}
STREAM = stream.QUERIES
QUERIES = {**BATCH, **STREAM}
