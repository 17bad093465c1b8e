"""Prefix trie, fill-in-the-middle cuts and exact deduplication against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from roundscope.llm import exact, middle, oracles, prefixes, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TURNS = "conv_id bigint, turn bigint, role string, text string"
DOCS = "doc_id bigint, text string, n int, form string, digest string, file string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def same(found, expected):
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


# --- prefix trie ---------------------------------------------------------------------------

def plain_trie(sequences: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def saved(node):
        return (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0

    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            len(children[node]), sum(not children[n] for n in below), sum(map(saved, below)),
            sha(ends),
        ))
    return out


def sequences_of(rows) -> dict[int, list[tuple[str, str]]]:
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}:{text}"), role, text))
    return {c: [(r[3], r[4]) for r in sorted(turns)] for c, turns in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def talk():
    """Copies, shared beginnings, ties, nulls, negative ids, one long conversation and its copy."""
    draw = random.Random(3)
    rows = [(7, None, "user", "first"), (7, 1, None, None), (7, 1, "user", "é漢"), (7, 1, "user", "é漢"),
            (None, 0, "user", "nobody"), (12, 0, "user", ""), (12, 1, "", "user")]
    for conv in range(20, 90):
        for turn in range(draw.randint(1, 7)):
            said = f"{draw.choice('abc')}" * (turn + 1) if conv % 3 else "the same"
            rows.append((conv, turn, ("user", "assistant")[turn % 2], said))
    for conv in (200, 201, 202, 300):
        rows += [(conv, t, "user", f"turn {t}") for t in range(120 + conv % 2)]
    return rows


@pytest.mark.parametrize("limit", [prefixes.GROUP_TURNS, 12])
def test_trie(spark, talk, limit, monkeypatch):
    monkeypatch.setattr(prefixes, "GROUP_TURNS", limit)
    monkeypatch.setattr(prefixes, "LIST_IDS", 3)
    table = spark.createDataFrame(talk, TURNS).withColumn("depth", F.lit("x")).withColumn(
        "key", F.lit(1)
    )
    convs = sequences_of(talk)
    if limit > 12:  # few rounds above the groups, as deep ones share their beginnings
        same(prefixes.conversation_trie(table).collect(), plain_trie(convs))
    short = {c: t for c, t in convs.items() if len(t) < 20}
    few = table.filter(F.col("conv_id").isin(list(short)))
    again = prefixes.trie(prefixes.rebuilt(prefixes.ordered_turns(few)))
    same(again.collect(), plain_trie(plain_rebuilt(short)))


def test_deep_copies_are_split_below_what_they_share(spark, monkeypatch):
    """More turns than a group may hold share 40 turns: rounds above, groups below."""
    monkeypatch.setattr(prefixes, "GROUP_TURNS", 100)
    rows = [(c, t, "u", f"{t}" if t < 40 else f"{c} {t}") for c in range(6) for t in range(41 + c)]
    nodes = prefixes.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    same(nodes, plain_trie(sequences_of(rows)))


def test_trie_of_nothing(spark):
    assert prefixes.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert prefixes.conversation_trie(nobody).collect() == []


def test_peeling_keeps_whole_groups_together():
    step = [bytes([i]) * prefixes.KEY + (3).to_bytes(8, "big") for i in range(4)]
    nodes = prefixes.peel([
        (step[0] + step[1], 2, 1, 9, 2), (step[0], 1, 1, 4, 1), (step[2] + step[3], 2, 2, 5, 1),
    ])
    found = {(n[0], n[1]): n[2:7] for n in nodes}
    assert found == {(9, 2): (4, 2, 0, 1, 3), (4, 1): (None, 3, 1, 1, 9), (5, 2): (None, 1, 0, 1, 0)}


# --- fill in the middle --------------------------------------------------------------------

@pytest.mark.parametrize("make", [
    lambda r: np.unique(r.integers(0, 400_000, 3_000)),  # arrays
    lambda r: np.unique(r.integers(0, 300_000, 90_000)),  # bitmaps
    lambda r: np.arange(70_000, 210_001),  # runs
    lambda r: np.unique(np.concatenate([np.arange(9), r.integers(0, 2**30, 50), np.arange(65_530, 131_080)])),
    lambda r: np.array([0]),
])
def test_select_in_boundary_sets(make):
    offsets = make(np.random.default_rng(1)).astype(np.int64)
    boundaries = middle.BoundarySet(offsets)
    assert len(boundaries) == len(offsets)
    places = range(len(offsets)) if len(offsets) < 5_000 else range(0, len(offsets), 37)
    assert all(boundaries.select(k) == offsets[k] for k in [*places, len(offsets) - 1])


def test_each_kind_of_container_is_used():
    kinds = {
        type(c).__name__ for offsets in (np.arange(0, 400, 3), np.arange(0, 60_000, 2), np.arange(60_000))
        for c in middle.BoundarySet(offsets.astype(np.int64)).containers
    }
    assert kinds == {"ArrayContainer", "BitmapContainer", "RunContainer"}


TEXTS = [
    None, "", " ", " \n\t", "one", "one ", " one", "a b c d e f", "é漢 ß\x0bx\r\n  y  ", "has <P> in it",
    "nearly <P a < S> <<M", "x" * 50, *[f"{'word ' * i}<" for i in range(2, 40)], "a " * 70_000,
]


def plain_cut(doc, text, unit):
    text = text or ""
    units = (re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text) if unit == "word" else list(text))
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return (doc, len(units), "plain", None, None, text)
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc, len(units), "spm" if spm else "psm", len(p), len(m), out)


@pytest.mark.parametrize("unit", ["word", "character"])
def test_cuts(spark, unit):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "without an id at all"), (3, "twice x")]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], DOCS)
    made = middle.examples(docs, unit)
    same(made.collect(), [plain_cut(*r, unit) for r in rows])
    back = made.select(middle.restored(F.col("output"), F.col("form")).alias("text"))
    same(back.collect(), [(t or "",) for _, t in rows])
    assert middle.examples(spark.createDataFrame([], DOCS), unit).count() == 0


# --- exact deduplication -------------------------------------------------------------------

def plain_classes(rows):
    """``rows`` in the order in which they are stored."""
    groups = defaultdict(list)
    for place, (doc, text) in enumerate(rows):
        norm = re.sub(r"[ \t-\r]", "", text or "")
        groups[norm].append((-len(text or ""), doc is None, doc or 0, place, doc))
    out = []
    for norm, group in groups.items():
        best = min(group)
        out += [(g[4], best[4], len(group), g is best, sha(norm)) for g in group]
    return out


COPIES = [
    (5, "a text"), (3, "atext "), (9, "a  text"), (4, "a\ttext"), (1, None), (2, ""), (8, " \n"),
    (None, "a te xt"), (6, "other"), (6, "other"), (None, "other"), (7, "漢 é"), (10, "漢é "), (11, "x" * 9000),
]


def stored(spark, path, rows):
    frame = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], DOCS)
    frame.coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: F.substring(exact.sha256(text), 1, 0),
                                    lambda text: F.length(text)])
def test_classes_by_bytes_whatever_the_digest(spark, tmp_path, digest):
    """A digest that everything or every length shares changes nothing."""
    path = f"{tmp_path}/docs"
    for part in range(0, len(COPIES), 3):
        stored(spark, path, COPIES[part : part + 3])
    found = exact.deduplicate(spark, path, digest=digest)
    same(found.collect(), plain_classes(COPIES))


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, store = f"{tmp_path}/docs", f"{tmp_path}/store"
    stored(spark, path, COPIES[:4])
    same(exact.deduplicate(spark, path, store).collect(), plain_classes(COPIES[:4]))
    retained = {r["digest"]: r["first"] for r in exact.classes(spark, store).collect()}
    stored(spark, path, COPIES[4:])
    same(exact.deduplicate(spark, path, store).collect(), plain_classes(COPIES))
    now = {r["digest"]: r["first"] for r in exact.classes(spark, store).collect()}
    assert retained and all(now[d] == first for d, first in retained.items())


def test_no_documents(spark, tmp_path):
    stored(spark, f"{tmp_path}/docs", [])
    assert exact.deduplicate(spark, f"{tmp_path}/docs").collect() == []


@pytest.mark.parametrize("name", ["op11_prefixes", "op12_middle", "op13_exact"])
def test_queries_against_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(oracles.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert compare(frame.columns, frame.collect(), names, cursor.fetchall()) == ""
