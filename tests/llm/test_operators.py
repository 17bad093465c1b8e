"""Each corpus operator against a plain version on a fixture of edge cases."""

from __future__ import annotations

import base64
import os
import random

import numpy as np
import plain
import public_tokenizers
import pytest
import tiktoken
from compare import compare
from pyspark.sql import functions as F

from roundscope.llm import (
    backoff, bpe, chat, components, cotrain, lyndon, phrases, pii, queries, rules, setsketch,
    suffixes, warc,
)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names clash with those that the operators use inside.
EXTRA = "n_words int, class string, spans string, mark string, _stats string, group int"


def edge_texts() -> list[str | None]:
    """Null, empty, blank, tiny, periodic, very long, accented, and near-equal texts."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeéß漢") for _ in range(draw.randint(1, 7)))
                  for _ in range(60)]

    def prose(n: int) -> str:
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    base = prose(120)
    shared = prose(70)
    edits = []
    for i in range(25):
        w = base.split()
        for _ in range(i % 4):
            w[draw.randrange(len(w))] = f"edit{i}"
        edits.append(" ".join(w))
    return [
        None, "", " \n\t \r\x0b", "one", "one two three four", "ONE two Three four", "a" * 1500,
        "ab " * 700, "line of a song\n" * 40, base, base, base.upper(), *edits,
        *[f"{prose(15)} {shared} {prose(15)}" for _ in range(12)], shared[:199], shared[:200],
        shared, prose(9), prose(9000), "#*$%&|<> " * 30, "WORD!! " * 60,
        "mail a.b@c-d.example.org, a@b@c.d x@y. @z.q ++1 (555) 123-4567 +123 1.2.3.4.5.6.7.8 "
        "300.1.1.1 001.02.3.04 4111 1111 1111 1111 4111-1111-1111-1112 http://x.example.com/a?b. "
        "IBAN: GB82 WEST 1234 5698 7654 32 é@é.fr ü+49 (0) 30 1234567",
    ]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, ("en", None)[i % 2], f"s{i % 3}", len(t or "")) for i, t in
            enumerate(edge_texts())]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    schema = f"{SCHEMA}, {EXTRA}"
    return spark.createDataFrame([(*r, 7, "x", "y", "z", "s", 1) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def twice(docs, rows):
    """The fixture with its first dozen rows repeated as they are."""
    few = docs.filter("doc_id < 12")
    return docs.union(few), pairs(rows) + [r for r in pairs(rows) if r[0] < 12]


def got(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_suffix_order_is_the_sorted_one():
    draw = random.Random(1)
    for _ in range(3000):
        symbols = [draw.randint(0, draw.choice([0, 1, 3])) for _ in range(draw.randint(0, 40))]
        symbols.append(-1)
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert lyndon.suffix_order(symbols) == order


@pytest.mark.parametrize("many", [suffixes.MANY, 1])
def test_repeats(edge_docs, edge_rows, many, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY", many)
    out = suffixes.remove_repeats(edge_docs)
    found = got(
        out, "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
    assert found == sorted(plain.removed(pairs(edge_rows)), key=repr)


def test_repeats_of_repeated_rows(edge_docs, edge_rows):
    docs, rows = twice(edge_docs.filter("doc_id < 20"), edge_rows[:20])
    out = got(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert out == sorted([r[:4] for r in plain.removed(rows)], key=repr)


def test_near_duplicates(edge_docs, edge_rows):
    out = got(setsketch.near_duplicates(edge_docs), "doc_id", "n_shingles", "component_id", "kept")
    assert out == sorted(plain.near(pairs(edge_rows)), key=repr)
    kept = {r[0] for r in plain.near(pairs(edge_rows)) if r[3]}
    left = setsketch.representatives(edge_docs)
    assert left.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(kept)


def test_near_duplicates_linked_through_a_row_without_an_id(spark):
    """The middle one of three texts has no doc_id, and the outer two are linked by it alone."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*(f"a{k}" for k in range(n)), *words[n:]]) for n in (0, 13, 26)]
    rows = [(1, texts[0]), (None, texts[1]), (2, texts[2]), (None, "nothing like the others at all")]
    rows = [(*r, "en", "s", len(r[1])) for r in rows]
    out = setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), 88)
    found = got(out, "doc_id", "component_id")
    assert found == [(1, 1), (2, 1), (None, 1), (None, None)]


def test_sketches_merge_and_estimate():
    import numpy as np

    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 4000, dtype=np.uint64))
    a, b = values[:3000], values[500:]
    both = setsketch.sketch([a, b, values])
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    above, below = (both[0] > both[1]).sum(), (both[0] < both[1]).sum()
    j = setsketch.likeliest(*(np.array([float(x)]) for x in (above, below, len(a), len(b))))
    assert abs(j[0] - 2500 / 4000) < 0.2


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.createDataFrame([(1000, 1001), (1001, 1001)], "a bigint, b bigint"))
    found = dict(map(tuple, components.components(edges).collect()))
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("block_words", [phrases.QUERY_WORDS, 15])
def test_phrases(spark, edge_docs, edge_rows, block_words, monkeypatch):
    monkeypatch.setattr(phrases, "QUERY_WORDS", block_words)
    texts = [r[1] for r in edge_rows]
    items = [
        (1, texts[9]), (2, " ".join(texts[9].split()[3:13]).upper()), (30, "one two three"),
        (4, None), (5, ""), (6, "!? -"), (7, "ab " * 14), (7, "one"), (8, "not in any text"),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("x", F.lit(1))
    docs, rows = twice(edge_docs, edge_rows)
    found = phrases.search(phrases.build(docs), benchmark)
    names = F.array_join(F.array_sort(F.array_distinct("items").cast("array<string>")), ",")
    out = got(
        found, "doc_id", "n_words", phrases.covered().alias("n_hit"),
        F.size(F.array_distinct("items")).alias("n_items"), F.sha2(names, 256).alias("names"),
        (F.size("spans") > 0).alias("hit"),
    )
    expected = plain.hits(rows, items)
    assert out == sorted(expected, key=repr)
    clean = phrases.without_hits(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(
        r[0] for r in expected if not r[5]
    )


def test_near_phrases(edge_rows):
    import pyarrow as pa
    import numpy as np

    segment = phrases.Segment.of(pa.array(["c x b a", "a b", "c", "b y y y a c"]))
    query = phrases.Segment.of(pa.array(["a b c"]))
    hashes = query.terms[np.argsort(query.postings)]
    windows = phrases.Windows([(9, hashes)])
    place, item = phrases.near_matches(segment, windows, 3)
    assert sorted(zip(place.tolist(), item.tolist())) == [(0, 0)] or len(place) == 1
    assert len(phrases.near_matches(segment, windows, 5)[0]) == 2


def test_personal_data(edge_docs, edge_rows):
    docs, rows = twice(edge_docs, edge_rows)
    found = pii.spans(docs)
    expected = [(i, plain.base_spans(t)) for i, t in rows]
    assert got(found, "doc_id", "base_spans") == sorted(expected, key=repr)
    last = found.orderBy(F.desc("doc_id")).first()
    assert last["n_url"] == 1 and last["n_account"] == 1
    hidden = {r["doc_id"]: r for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == docs.columns
    text = hidden[last["doc_id"]]["text"]
    assert "[EMAIL]" in text and "[ACCOUNT]" in text and "example.org" not in text
    assert hidden[last["doc_id"]]["n_chars"] == len(text)
    assert hidden[0]["text"] is None and hidden[9]["text"] == edge_rows[9][1]


def test_personal_data_at_random():
    draw = random.Random(2)
    for _ in range(4000):
        alphabet = draw.choice(["a@.-1+ ", "12. -", "+1() .-2", "4 -", "ab@.c-", "é@a.1"])
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        assert pii.joined(pii.find(text), pii.BASE_KINDS) == plain.base_spans(text), text


def test_long_stretches_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "+1 " * 100_000, "1." * 150_000, "@" * 300_000):
        pii.find(text)


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_bpe(edge_docs, edge_rows, tokenizer):
    docs, rows = twice(edge_docs, edge_rows)
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    expected = [(i, tokenizer.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    found = [(r["doc_id"], r["ids"], bytes(r["decoded"])) for r in out.collect()]
    assert sorted(found) == sorted(expected)


def test_bpe_at_random(tokenizer, monkeypatch):
    draw = random.Random(3)
    merges = bpe.Merges(bpe.read_ranks(PATH))
    split = bpe.splitter(public_tokenizers.PATTERN)
    alphabet = "aabbc'sST d\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 éÉßñ²½ªº×÷0123٣漢字🙂!!..ǅɏɐ"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 3000, " " * 2000, "=-" * 900, "aaab" * 500]
    for few in (bpe.FEW_PLACES, 0):
        monkeypatch.setattr(bpe, "FEW_PLACES", few)
        known = bpe.Vocabulary(merges)
        numbers = [known.numbers(split(t)) for t in texts]
        known.learn()
        for text, own in zip(texts, numbers):
            assert known.encode(own)[0].tolist() == tokenizer.encode_ordinary(text)


def test_quality_figures(edge_docs, edge_rows):
    docs, rows = twice(edge_docs, edge_rows)
    out = rules.label(docs)
    found = got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words", "base_failed")
    assert found == sorted([(i, *plain.quality(t)) for i, t in rows], key=repr)
    kept = sorted(r["doc_id"] for r in out.filter("kept").collect())
    left = rules.filter_documents(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == kept
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())


def test_quality_verdicts_agree_with_labels(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    labels = queries.table(spark, SF_DIR, "labels")
    out = rules.label(docs).join(labels, "doc_id").filter("n_words >= 10").select(
        (F.col("quality") == 1).alias("good"), "kept"
    ).groupBy("good").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, out))
    assert share[True] > 0.95 and share[False] < 0.2


def test_quality_is_not_all_must_pass(spark):
    out = rules.label(queries.table(spark, SF_DIR, "documents")).filter(~F.col("base_failed"))
    votes = [c for c in out.columns if c.startswith("vote_")]
    rows = [r.asDict() for r in out.select(*votes, "kept", "posterior").collect()]
    rejected = [r for r in rows if min(r[v] for v in votes) < 0]
    # Documents that one unreliable rule turns down while the others speak for them stay.
    assert any(r["kept"] for r in rejected)
    assert all(not r["kept"] for r in rejected if sum(r[v] < 0 for v in votes) >= 3)


def test_quality_posterior_equals_plain_em(spark):
    out = rules.label(queries.table(spark, SF_DIR, "documents"))
    votes = [c for c in out.columns if c.startswith("vote_")]
    rows = out.select(*votes, "posterior").collect()
    expected = plain.em_posteriors([tuple(r)[:-1] for r in rows], rules.ROUNDS)
    for row, wanted in zip(rows, expected, strict=True):
        assert abs(row["posterior"] - wanted) < 1e-6


def test_unreliable_rule_is_overruled():
    # Rules 1 to 3 agree; rule 4 rejects a third of what they praise.
    patterns = np.array([[1, 1, 1, 1], [1, 1, 1, -1], [-1, -1, -1, -1], [-1, -1, -1, 1]])
    share, odds = rules.fit(patterns, np.array([400.0, 200.0, 60.0, 30.0]))
    assert abs(share - 602 / 694) < 0.01
    # Right about two thirds of either kind: its word is worth log 2, that of the others much more.
    assert abs(odds[3]).max() < 0.75 and abs(odds[:3, [0, 2]]).min() > 3


def test_backoff_scores(edge_docs, edge_rows):
    docs, rows = twice(edge_docs, edge_rows)
    found = [
        (r["doc_id"], r["n_words"], r["n_backoff"], r["n_unseen"], round(r["log_score"], 6))
        for r in backoff.score(docs).collect()
    ]
    for mine, theirs in zip(sorted(found), sorted(plain.backoff_scores(rows))):
        assert mine[:4] == theirs[:4]
        assert mine[4] == pytest.approx(theirs[4], abs=1e-5)


def test_backoff_of_three_words(edge_docs):
    few = backoff.score(edge_docs, order=2).agg(F.sum("n_backoff")).first()[0]
    more = backoff.score(edge_docs, order=3)
    assert more.agg(F.sum("n_backoff")).first()[0] >= few


def test_chat(spark):
    rows = [
        (1, 0, "system", "be ### nice"), (1, 1, "user", "\\b </turn>\n### assistant: x"),
        (1, 2, "assistant", "\\h: <ok>"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (1, 5, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "assistant", "漢é"),
        (3, 0, "assistant", "漢é"), (4, None, None, None), (None, 0, "assistant", "no id"),
        (5, 1, "a:b", "tie"), (5, 1, "assistant", "tie"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.examples(table.withColumn("n", F.lit(1)).withColumn("pieces", F.lit("x")))
    out = examples.withColumn("reply", chat.loss_text()).withColumn(
        "back", chat.turns(F.col("text"))
    ).collect()
    by_conv: dict = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    for conv, turns in by_conv.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, *[x or 0 for x in t[:1]], *t[1:]))
        own = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: len(r["back"]))
        replies = [i + 1 for i, t in enumerate(turns) if t[1] == "assistant"]
        ends = replies + ([len(turns)] if not replies or replies[-1] < len(turns) else [])
        assert [len(r["back"]) for r in own] == ends
        for r in own:
            assert [tuple(t) for t in r["back"]] == [t[1:] for t in turns[: len(r["back"])]]
            if r["target"] is None:
                assert r["reply"] == "" and r["complete"]
            else:
                assert r["reply"] == turns[r["target"] - 1][2]
        assert [r["complete"] for r in own].count(True) == 1
    assert chat.examples(table.limit(0)).count() == 0


def test_archive(spark):
    rows = [
        (1, "u\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "v", "<p>é</p>"), (3, "w", None),
        (4, "x", ""), (6, "y", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (7, "z", "  "),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archive = warc.write(pages.withColumn("sha1", F.lit("clash")).withColumn("payload", F.lit(1)))
    records = {r["page_id"]: r for r in warc.read(archive).collect()}
    assert archive.payloads().count() == 4
    for page, _, html in rows:
        record = records[page]["record"].encode()
        header, rest = record.split(b"\r\n\r\n", 1)
        length = int(header.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[length:] == b"\r\n\r\n" and records[page]["payload"] == (html or "")
        response = b"WARC-Type: response" in header
        assert rest[:length] == ((html or "").encode() if response else b"")
    kinds = {p: "response" in r["header"].split("\r\n")[1] for p, r in records.items()}
    assert kinds == {1: False, 2: False, 5: True, 3: False, 4: True, 6: True, 7: True}
    one = warc.read(warc.write(pages, least_bytes=5))
    assert one.filter(F.col("page_id").isin(3, 4) & F.col("header").contains("revisit")).isEmpty()


def test_archive_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF_DIR, "pages").select(
        "page_id", "html").collect()]
    assert got(
        queries.op4_warc(spark, SF_DIR), "page_id", "payload_bytes", "payload_digest",
        "record_type", "refers_to",
    ) == sorted(plain.archived(rows), key=repr)


def test_chat_query_matches_sql(spark, duck):
    from roundscope.llm.oracles import ORACLES

    frame = queries.op2_chat(spark, SF_DIR)
    rows = frame.collect()
    cursor = duck.execute(ORACLES["op2_chat"])
    names = [c[0] for c in cursor.description]
    assert compare(frame.columns, rows, names, cursor.fetchall()) == ""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_co_training_on_held_out_labels(spark):
    """Every second label is kept from the training; the verdicts must agree with those."""
    docs = queries.table(spark, SF_DIR, "documents")
    labels = queries.table(spark, SF_DIR, "labels")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    out = cotrain.classify(docs, labels.filter(odd)).join(labels.filter(~odd), "doc_id")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    right = out.agg(F.avg((F.col("kept") == good).cast("int"))).first()[0]
    assert right > 0.8
    assert out.count() == labels.filter(~odd).count()


def test_co_training_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = cotrain.classify(edge_docs, none)
    assert out.count() == edge_docs.count()
    some = spark.createDataFrame(
        [(9, 1, 0), (9, 0, 0), (8, None, 1), (None, 1, 0), (99999, 1, 0), (7, 1, None)],
        "doc_id bigint, quality int, toxic int",
    )
    scores = cotrain.classify(edge_docs, some).collect()
    assert len(scores) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert cotrain.classify(no_docs, none).count() == 0


def test_empty_tables(spark, no_docs):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert suffixes.remove_repeats(no_docs).count() == 0
    assert setsketch.near_duplicates(no_docs).count() == 0
    assert phrases.search(phrases.build(no_docs), nothing).count() == 0
    assert pii.spans(no_docs).count() == 0 and pii.masked(no_docs).count() == 0
    assert bpe.decode(bpe.encode(no_docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    assert rules.label(no_docs).count() == 0 and rules.filter_documents(no_docs).count() == 0
    assert backoff.score(no_docs).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read(warc.write(pages)).count() == 0


def test_nulls_everywhere(spark, no_docs):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2, no_docs.schema)
    items = spark.createDataFrame([(None, None)], "item_id bigint, text string")
    assert [r["n_bytes"] for r in suffixes.remove_repeats(docs).collect()] == [0, 0]
    assert [r["n_shingles"] for r in setsketch.near_duplicates(docs).collect()] == [0, 0]
    assert phrases.search(phrases.build(docs), items).count() == 2
    assert setsketch.representatives(docs).count() == 2
    assert backoff.score(docs).count() == 2 and rules.label(docs).count() == 2
    assert pii.spans(docs).count() == 2
