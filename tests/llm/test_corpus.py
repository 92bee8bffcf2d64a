"""Decontamination, the pipeline and the registry."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

import __spark_entry__ as driver
import corpus_pipeline
from rotorwatch.llm import decontaminate
from rotorwatch.llm.queries import ORACLE_SQL, QUERIES

RND = random.Random(12)
WORDS = ["".join(RND.choice("aeioustrnl") for _ in range(RND.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(RND.choice(WORDS[:60]) if RND.random() < 0.5 else RND.choice(WORDS) for _ in range(n))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(-1, 4), max_size=14), st.integers(0, 11))
def test_common_subsequence(item, words, first):
    first = min(first, len(item) - 1)
    part, table = item[first:], np.zeros((len(item) + 1, len(words) + 1), int)
    for i, a in enumerate(part):
        for j, b in enumerate(words):
            table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
    assert decontaminate.Matcher(np.array(item), first).common(words, first) == table[len(part), len(words)]


def test_contaminated(spark):
    items = [(i, prose(n) + ". " + prose(8) + ".") for i, n in enumerate([12, 20, 30, 45, 60, 200])] + [(9, None), (10, "  ")]
    docs, wanted = [(i, prose(RND.randint(1, 300)), "e") for i in range(300)], set()
    for k, (item, text) in enumerate(items[:6]):
        docs.append((1000 + k, prose(100) + " " + text + " " + prose(100), "e"))
        docs.append((1100 + k, text.upper().replace(".", " ;"), "e"))
        changed = text.split()
        for at in range(0, len(changed) - 9, 9):
            changed[at] = "changedword"
        docs.append((1200 + k, prose(40) + "\n" + " ".join(changed) + "\n" + prose(5000), "e"))
        wanted |= {(1000 + k, item), (1100 + k, item), (1200 + k, item)}
    clean = prose(80)
    docs += [(2000, None, "e"), (2001, "", "e"), (None, items[1][1], "e"), (1000, docs[300][1], "e"), (None, clean, "e"), (None, None, "e"), (1000, clean, "e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, t, "b") for i, t in items + items[:1]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, benchmark).collect()}
    assert got == wanted | {(None, 1)}
    kept = decontaminate.clean(frame, benchmark)
    assert kept.columns == frame.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*range(300), 2000, 2001, None, None, 1000]))
    assert {r.text for r in kept.filter("doc_id IS NULL OR doc_id = 1000").collect()} == {None, clean}
    assert decontaminate.clean(frame, benchmark.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(frame.limit(0), benchmark).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents that each stage has something to do with, and the numbers that must go or stay."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    insult, leak, shared = "vilebadword nastyterm", prose(40) + ".", prose(60)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        docs.append((i, prose(90) + (f" {insult} " if toxic else " ") + prose(10), "en", "s", 0))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs += [(1000, docs[1][1], "en", "s", 0), (1001, docs[3][1] + " end", "en", "s", 0), (1002, prose(80) + " " + leak + " " + prose(80), "en", "s", 0),
             (1003, prose(90) + "\n" + shared, "de", "s", 0), (1004, prose(90) + "\n" + shared + " tail", "de", "s", 0), (1005, None, "en", "s", None), (1006, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", driver_length()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def driver_length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")


def test_pipeline(spark, corpus):
    folder, docs = corpus
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    gone = {i for i in range(0, 400, 8)} | {1000, 1001, 1002}
    # the texts of 1005 and 1006 are equal to nothing, and to the emptied 1000: one document of that class stays
    assert sorted(ids) == sorted(({d[0] for d in docs} - gone - {1005, 1006}) | {1000})
    assert all(r.round_trip for r in rows)
    texts = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        texts = stage(spark, texts, folder)
        assert texts.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r.text for r in texts.filter("doc_id in (1003, 1004)").collect()}
    assert "\n" in left[1003] and "\n" not in left[1004].rstrip("\n")


def test_pipeline_of_nothing(spark, corpus):
    empty = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus[0]).count() == 0


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLE_SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_queries_cover_their_tables(spark, key):
    """Each query over a whole small table: one row per document (page, line), none lost and none doubled."""
    folder = "/root/testdata/sf0.001"
    rows = QUERIES[key](spark, folder)
    name, column = {"op1": ("pages", "page_id"), "op11": ("conversations", "conv_id"), "op12": ("embeddings", "vec_id")}.get(
        key.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{folder}/{name}.parquet").select(column).collect()}
    got = [r[0] for r in rows.collect()]
    if key.startswith("op5_"):
        assert set(got) < ids
    elif key.startswith("op8_"):
        assert set(got) == ids
    else:
        assert sorted(got) == sorted(ids)


def test_crc_of_shards(spark):
    rows = QUERIES["op3_sampled_splitter_shards"](spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_contaminated_without_the_rare_words(spark):
    """A paraphrase that swaps the rare words of an item and keeps its everyday words and its answer is found."""
    rnd = random.Random(17)
    everyday = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items, docs = [], [(i, " ".join(rnd.choice(everyday) for _ in range(300))) for i in range(200)]
    for k in range(5):
        own = [rnd.choice(everyday) for _ in range(28)]
        places = rnd.sample(range(28), 8)
        as_stated = [f"rare{k}x{i}" if i in places else w for i, w in enumerate(own)]
        answer = " ".join(rnd.choice(everyday) for _ in range(6))
        items.append((k, " ".join(as_stated) + ". " + answer + "."))
        changed = ["otherword" if i in places else w for i, w in enumerate(own)]
        docs.append((1000 + k, " ".join(rnd.choice(everyday) for _ in range(50)) + " " + " ".join(changed) + ". " + answer + "."))
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, benchmark).collect()}
    assert got == {(1000 + k, k) for k in range(5)}


def plain_hits(search, texts):
    """Every candidate of the cosine, overlapping ones as one stretch, checked over all stretches without any bound."""
    blocks, out = decontaminate.Blocks(texts, search.weights), {}
    own = np.stack([np.zeros(search.rows.shape[1], np.float32), *[sum((search.rows[w] for w in t[at:at + decontaminate.BLOCK] if w >= 0), np.zeros(search.rows.shape[1], np.float32))
                                                                   for t in texts for at in range(0, len(t), decontaminate.BLOCK)]])[1:]
    for i, matcher in enumerate(search.matchers):
        m = -(-matcher.n // decontaminate.BLOCK) + 1
        for text, words in enumerate(texts):
            first, end, spans = blocks.first[text], blocks.first[text + 1], []
            for start in range(first, max(first, end - m) + 1 if end > first else first):
                stop = min(start + m, end)
                passage = own[start:stop].sum(0)
                if passage @ search.queries[i] >= decontaminate.CANDIDATE_FROM * max(np.linalg.norm(passage), 1e-6):
                    if spans and start - first <= spans[-1][1]:
                        spans[-1][1] = stop - first
                    else:
                        spans.append([start - first, stop - first])
            for a, b in spans:
                part = words[max(0, a - 1) * decontaminate.BLOCK:(b + 1) * decontaminate.BLOCK].tolist()
                size, step = matcher.stretch
                for at in range(0, max(1, len(part) - size + step), step):
                    covered = matcher.common(part[at:at + size]) / matcher.n
                    answered = matcher.common(part[at:at + size], matcher.answer) >= decontaminate.ANSWERED * (matcher.n - matcher.answer)
                    if covered >= decontaminate.COPIED or covered >= decontaminate.PARAPHRASED and answered:
                        out[text, i] = max(out.get((text, i), 0.0), covered)
    return out


def test_counts_before_the_check_lose_nothing(monkeypatch):
    """Texts of few, very frequent words: counting finds what the check of every candidate finds, and leaves most candidates unchecked."""
    rnd = random.Random(23)
    few = [f"w{i}" for i in range(300)]
    line = lambda n: [rnd.choice(few[:8]) if rnd.random() < 0.5 else rnd.choice(few) for _ in range(n)]
    rows = [(i, " ".join(line(n)) + ". " + " ".join(line(6)) + ".") for i, n in enumerate([1, 3, 9, 14, 20, 26, 33, 42, 53, 90, 300])]
    items = decontaminate.Items.of(rows)
    texts = [" ".join(line(n)) for n in [0, 1, 15, 16, 17, 47, 48, 49, 130, 700, 2000]]
    for _, text in rows:
        words = text.split()
        texts += [" ".join([*line(37), *(w if rnd.random() < keep else "other" for w in words), *line(59)]) for keep in (1, 0.85, 0.7, 0.6)]
    texts = [decontaminate.term_numbers(items, t) for t in texts]
    weights = np.linspace(1, 2, items.size, dtype=np.float32)
    search = decontaminate.Search(items, weights, np.eye(items.size, dtype=np.float32))
    checked, verdict = [], decontaminate.Matcher.verdict
    monkeypatch.setattr(decontaminate.Matcher, "verdict", lambda self, words: checked.append(self.n) or verdict(self, words))
    got, wanted = search.hits(texts), plain_hits(search, texts)
    assert got == wanted and len(wanted) > 20
    assert len(checked) < 0.5 * len(items.words) * len(texts)


def test_sums_of_runs():
    rnd = np.random.default_rng(3)
    for n, size in [(0, 4), (1, 1), (500, 7), (300, 200)]:
        keys, rows, at = np.sort(rnd.integers(0, size, n)), rnd.integers(0, 9, (30, 5)), rnd.integers(0, 30, n)
        wanted = np.zeros((size, 5), int)
        np.add.at(wanted, keys, rows[at])
        assert (decontaminate.run_sums(keys, rows, at, size) == wanted).all()
