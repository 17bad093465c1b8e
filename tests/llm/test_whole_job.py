"""The registered queries do their whole job: small inputs on which a cut would show."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roundscope.llm import backoff, bpe, components, cotrain, phrases, pii, queries, setsketch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def backoff_scores(texts, order: int) -> list[tuple]:
    """Words scored with less than the history they have, and log score, counted one by one."""
    docs = [plain.words(t) for t in texts]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1)
                   for i in range(len(w) - n + 1)) for w in docs]
    everywhere = sum(own, Counter())
    out = []
    for w, mine in zip(docs, own):
        others = max(sum(map(len, docs)) - len(w), 1)
        total, short = 0.0, 0
        for k in range(len(w)):
            full = min(k, order - 1)
            for n in range(full, -1, -1):
                gram = tuple(w[k - n : k + 1])
                count = everywhere[gram] - mine[gram]
                if count > 0 or not n:
                    break
            history = everywhere[gram[:-1]] - mine[gram[:-1]] if n else others
            total += math.log(max(count, 1) / history) + (full - n) * math.log(0.4)
            short += n < full
        out.append((short, total))
    return out


def test_backoff_query_scores_by_four_words_of_history(spark, tmp_path):
    sentence = "the quick brown fox jumps over the lazy dog and runs away"
    texts = [
        sentence, sentence, "quick the brown fox over jumps the dog lazy", "fox", "",
        "brown fox jumps over a wall and the lazy dog sleeps", "new words only here",
    ]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_backoff(spark, str(tmp_path)).orderBy("doc_id").collect()
    for row, (short, total) in zip(found, backoff_scores(texts, 5), strict=True):
        assert row["n_backoff"] == short
        assert row["log_score"] == pytest.approx(total, abs=1e-6)


def test_backoff_loses_no_count_to_pruning(spark):
    """Texts of few words in many blocks, so that n-grams end at every width, some within one text."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 6, draw.integers(0, 40))) for _ in range(60)]
    texts += [texts[3], "a b a b a b a b", "only here only here only here", texts[7] + " a b"]
    docs = documents(spark, texts).repartition(7)
    found = backoff.score(docs, 5).orderBy("doc_id").collect()
    for row, (short, total) in zip(found, backoff_scores(texts, 5), strict=True):
        assert row["n_backoff"] == short
        assert row["log_score"] == pytest.approx(total, abs=1e-6)


def test_pipeline_links_near_copies_from_a_similarity_of_80(spark):
    base = [f"w{i}" for i in range(100)]

    def edited(n):
        """A copy whose last words are others, so that 96 - n shingles of five words are shared."""
        return " ".join(base[: 100 - n] + [f"x{n}y{i}" for i in range(n)])

    def similarity(n):
        a, b = (setsketch.shingle_sets(pa.array([t]))[0] for t in (" ".join(base), edited(n)))
        return len(np.intersect1d(a, b)) / len(np.union1d(a, b))

    assert 0.80 <= similarity(9) < 0.85 and similarity(12) < 0.80
    docs = documents(spark, [" ".join(base), edited(9), "another text of more than five words"])
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2]
    docs = documents(spark, [" ".join(base), edited(12)])
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2


def test_bands_suffice_at_the_threshold_of_the_pipeline():
    bands = setsketch.bands_for(corpus_pipeline.NEAR_HUNDREDTHS)
    assert (1 - 0.8**setsketch.ROWS) ** bands < 1e-6
    assert setsketch.bands_for(85) == setsketch.BANDS == 20


def test_pairs_of_near_copies_grow_with_their_number_and_lose_no_link(spark, monkeypatch):
    """Copies of one text, each too far from it, of which few share so much that they are linked."""
    draw = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    places = draw.permutation(np.repeat(np.arange(2, 148), 2))

    def edited():
        words = list(base)
        for i in draw.choice(200, 3, replace=False):
            words[places[i]] = f"x{i}"
        return " ".join(words)

    texts = [" ".join(base), *(edited() for _ in range(240))]
    plainly = plain.near(list(enumerate(texts)))
    assert len({row[2] for row in plainly}) > 100 and any(0 < row[2] < row[0] for row in plainly)
    compared, estimated = [], setsketch.estimated

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return estimated(pairs, *rest)

    monkeypatch.setattr(setsketch, "estimated", counting)
    out = setsketch.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out]
    assert found == sorted(plainly)
    # All pairs are 28,680.
    assert sum(compared) < 20 * len(texts)


def test_few_texts_beside_the_wanted_ones_are_shuffled_for_full_sets(spark, monkeypatch):
    texts = [f"text {i} of some six words" for i in range(3000)]
    docs = documents(spark, texts).withColumn("doc_id", F.col("doc_id").cast("int"))
    rows = setsketch.sketches(docs)
    wanted = rows.filter("doc_id % 100 = 0").select("doc_id", "class")
    passed, marked = [], setsketch.marked

    def counting(*tables):
        passed.extend(r["doc_id"] for r in marked(*tables).collect())
        return marked(*tables)

    monkeypatch.setattr(setsketch, "marked", counting)
    sets = setsketch.full_sets(docs, wanted).collect()
    assert {r["class"] for r in sets} == {r["class"] for r in wanted.collect()}
    assert len(sets) == 30 and {*range(0, 3000, 100)} <= {*passed} and len(passed) < 60


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    written, materialize = [], components.materialize
    monkeypatch.setattr(
        components, "materialize", lambda df, label: written.append(label) or materialize(df, label)
    )
    hung = [(a, 10 * (a // 10)) for a in range(200) if a % 10]
    found = components.components(spark.createDataFrame(hung, "a bigint, b bigint"))
    assert dict(map(tuple, found.collect())) == {a: 10 * (a // 10) for a in range(200)}
    assert len(written) == 1
    draw = np.random.default_rng(5)
    edges = [tuple(map(int, draw.integers(0, 300, 2))) for _ in range(170)]
    least = {x: x for edge in edges for x in edge if edge[0] != edge[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert dict(map(tuple, found.collect())) == least


def test_tokens_take_one_python_worker_for_each_task(spark):
    """Encoding and its check hold the vocabulary once, and more rows than are decoded at once agree."""
    texts = ["", "One text, 12 words.", "\u00e9t\u00e9 \u2014 \u6c34 \U0001f600", *(f"row {i} of  many\n" * (i % 5) for i in range(300))]
    docs = documents(spark, texts).coalesce(1)
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    apart = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    known = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in apart.collect()}
    found = out.collect()
    assert len(found) == len(texts)
    for r in found:
        ids, decoded = known[r["doc_id"]]
        assert r["ids"] == ids and decoded == texts[r["doc_id"]].encode()
        assert r["decoded_sha256"] == plain.sha(texts[r["doc_id"]])


def test_co_training_learns_from_documents_outside_every_sample(spark, monkeypatch):
    """A kind of junk that no sampled document holds is known to the text view by its sources."""
    monkeypatch.setattr(cotrain, "LABELLED", 200)
    # The sample of unlabelled documents that there was once, made empty.
    monkeypatch.setattr(cotrain, "POOL", -200, raising=False)
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        word = "reason" if good else "casino"
        rows.append((i, f"some common words {word} n{i % 7}", "en", "wiki" if good else "dump"))
        labels.append((i, good, 0))
    for i in range(200, 1000):
        good = i % 2
        word = "harvest" if good else "lottery"
        rows.append((i, f"some common words {word} n{i % 7}", "en", "wiki" if good else "dump"))
    rows += [(5000, "some common words lottery", "en", None),
             (5001, "some common words harvest", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = cotrain.classify(docs, known).filter("doc_id >= 5000").orderBy("doc_id").collect()
    assert out[0]["text_score"] < 0.2 and out[1]["text_score"] > 0.8


@pytest.mark.parametrize(("before", "number", "after"), [
    ("IBAN ", "ES9121000418450200051332", " BIC CAIXESBB"),
    ("IBAN: ", "BE68539007547034", " SWIFT"),
    ("iban ", "BE68 5390 0754 7034", " SWIFT"),
    ("IBAN number: ", "GB82 WEST 1234 5698 7654 32", "."),
    ("account no. ", "GB82WEST12345698765432", ""),
    ("İ iBAN ", "AT611904300234573201", " OR CASH"),
    ("Bank account of the payee is ", "NO9386011117947", ", thanks"),
])
def test_accounts_by_any_cue_and_country_length(before, number, after):
    text = before + number + after
    assert pii.find(text)["account"] == [(len(before), len(before) + len(number))]
    assert number not in pii.mask(text) and "[ACCOUNT]" in pii.mask(text)


def test_accounts_need_their_check_digits():
    assert pii.find("IBAN ES9121000418450200051333 BIC CAIXESBB")["account"] == []


def test_items_count_once_however_many_blocks_the_benchmark_has(spark, monkeypatch):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    texts = [" ".join(words[i : i + 12]) for i in range(0, 48, 12)]
    # One id on four texts, and one text under many ids.
    items = [(7, t) for t in texts] + [(i, texts[0]) for i in range(100, 140)] + [(None, texts[1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, [" ".join(words), "nothing of it", texts[0]])

    def found():
        out = phrases.search(phrases.build(docs), benchmark).orderBy("doc_id")
        return [(r["doc_id"], r["n_words"], r["n"], r["items"]) for r in out.select(
            "doc_id", "n_words", phrases.covered().alias("n"), F.col("items")).collect()]

    whole = found()
    assert len(whole[0][3]) == 42 and whole[1][3] == [] and len(whole[2][3]) == 41
    monkeypatch.setattr(phrases, "QUERY_WORDS", 13)
    assert found() == whole
    sizes = [len(w.items) for w in phrases.query_blocks(benchmark)[1]]
    assert sum(sizes) == 4
    left = phrases.without_hits(docs, benchmark).collect()
    assert [r["doc_id"] for r in left] == [1]
