"""Operators that judge one row or shard rows, against plain code."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rotorwatch.llm import pii_crf, sharding, toxicity_fm, url_templates, weak_quality


def test_shards(spark):
    rnd = random.Random(4)
    texts = ["w" * rnd.randint(0, 400) for _ in range(600)] + ["copy"] * 300 + [None, "", "ä" * 5000]
    docs = [(i, t, "e") for i, t in enumerate(texts)] + [(None, "x", "e"), (5, texts[5], "e"), (5, texts[5], "e")]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string, shard string"), 7).collect()
    assert len(rows) == len(docs)
    assert all(r["size"] == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
               for r in rows for t in ([texts[r.doc_id]] if r.doc_id is not None else ["x"]))
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(7)) and max(loads.values()) - min(loads.values()) <= 10016 + 2 * 416
    for shard in loads:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    copies = sorted(r.shard for r in rows if r.doc_id is not None and 600 <= r.doc_id < 900)
    assert copies[-1] - copies[0] <= 1  # copies lie side by side
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    again = sharding.shard_documents(spark.createDataFrame(docs[::-1], "doc_id long, text string, shard string").repartition(5), 7).collect()
    assert sorted((r.shard, r["size"]) for r in again) == sorted((r.shard, r["size"]) for r in rows)


def test_shards_of_nothing_and_of_one(spark):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert sharding.shard_documents(one.limit(0)).count() == 0
    assert [(r.slot, 0 <= r.shard < 40) for r in sharding.shard_documents(one).collect()] == [(0, True)]


def test_overfull_ranges_are_cut(spark, monkeypatch):
    """With a thin first sample, the exact counts find overfull ranges and cut them."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    rows = spark.range(4000).selectExpr("id % 3 AS _key", "id AS _tie", "cast(10 as bigint) AS _size")
    placed, starts = sharding.cut_rows(rows, 2)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 8 * 4000 / 64 and starts.count() == len(sizes)


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_quality(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(3, 8)))
    prose = [" ".join(word() for _ in range(rnd.randint(120, 200))) + "." for _ in range(200)]
    junk = [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(12)] + [" ".join(word() + "###" for _ in range(120)) for _ in range(12)]
    odd = [None, "", "  ", "a b a b a b a b a b", "x\ny\nx\n\n\nx", "é ñ 日本 #|<>\x0b\x0c\r\n\t z", "one two three one two three", "w " * 20000]
    texts = prose + junk + odd
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, w string")
    got = {r.doc_id: r for r in weak_quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_figures(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(200)) and not any(got[i].kept for i in range(200, 224))
    assert weak_quality.judge(docs.limit(0)).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.NET/EN/2?x=1#y", "http://example.com/de/3.html", "http://xexample.com/de/3", "ftp://a.org/fr/",
            "http://net/", "http://net", "http://a.net?x=/b", "://", "a://?q", "no scheme", "", None, "http://b.com/x\ny/z", "http://É.com/a://b", "http://h/" + "s/" * 4000]
    bad = [f"http://m.com/news/{i}" for i in range(40)] + [f"http://m.com/spam/{i}" for i in range(40)]
    pages = [(i, u, "h") for i, u in enumerate(urls + bad)] + [(None, "http://n.com/a", "h"), (0, urls[0], "h")]
    labels = [(len(urls) + i, int(i >= 40)) for i in range(0, 80, 2)]
    frame = spark.createDataFrame(pages, "page_id long, url string, template string")
    got = url_templates.judge_urls(frame, spark.createDataFrame(labels, "page_id long, bad int"), RULES).collect()
    assert len(got) == len(pages)
    by_url = dict((i, u) for i, u, _ in pages)
    for r in got:
        host, path, rule = plain_url(by_url[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule and rule[0]) and (rule is None or r.verdict == rule[1])
        if host == "m.com":
            assert (r.template, r.verdict) == (("/spam/*", "block") if "/spam/" in path else ("/news/*", "allow"))
    empty = url_templates.judge_urls(frame.limit(0), spark.createDataFrame([], "page_id long, bad int"), RULES)
    assert empty.count() == 0
    assert url_templates.judge_urls(frame, spark.createDataFrame([], "page_id long, bad int"), []).filter("verdict <> 'allow'").count() == 0


def plain_spans(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii_crf.passes_luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a_.-%+@01259 ()é\n", max_size=80))
def test_base_spans(text):
    assert pii_crf.base_spans(text)[0] == plain_spans(text)


def test_luhn():
    assert pii_crf.passes_luhn("4111111111111111") and not pii_crf.passes_luhn("4111111111111112")


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "a.b@" * 40_000, "+1 " * 60_000, "1.2.3." * 40_000, "9 " * 100_000])
def test_scans_are_linear(text):
    start = time.time()
    pii_crf.base_spans(text)
    assert time.time() - start < 5


def test_skip_chain_adds_repeats(spark):
    rnd = random.Random(9)
    number = lambda: f"+1 ({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
    texts = [f"call {number()} or mail u{i}@host.example.org from 10.0.{i % 250}.7 now, in {1900 + i} pieces" for i in range(300)]
    texts += ["Call +1 (875) 555-8822 today. As said, 1 875 555 8822 is the number, not 1 875 555 8823.", None, "", "no data at all", "año 2020"]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii_crf.find(docs).collect()}
    wanted = {i: ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(t or "")) for i, t in enumerate(texts)}
    text = texts[300]
    at = text.index("1 875 555 8822")
    assert got[300].spans == f"phone:5:22,phone:{at}:{at + 14}" and got[300].n_phone == 1
    assert all(got[i].spans == wanted[i] for i in wanted if i != 300)
    assert pii_crf.find(docs.limit(0)).count() == 0


def test_toxicity(spark):
    """A pair of terms is toxic, each alone is not; labels of held-out rows are never used."""
    rnd = random.Random(1)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(1600):
        words = rnd.sample(plain, 8)
        kind = i % 4
        words += [["badword"], ["group"], ["badword", "group"], []][kind]
        rnd.shuffle(words)
        docs.append((i, " ".join(words), "e"))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(kind == 2) if not held else rnd.randint(0, 1)))
    docs += [(9001, None, "e"), (9002, "", "e"), (None, "badword group", "e"), (9003, "badword group " * 20000, "e")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string")
    rows = toxicity_fm.score_documents(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == int(r.doc_id % 4 == 2) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1600]
    assert sum(right) >= 0.97 * len(right)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    kept = toxicity_fm.clean(frame, spark.createDataFrame(labels, "doc_id long, toxic int").filter("doc_id % 5 > 0"))
    assert kept.columns == frame.columns and 0 < kept.count() < len(docs)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity_fm.score_documents(docs, none).collect()] == [0, 0]
    assert toxicity_fm.score_documents(docs.limit(0), none).count() == 0


def test_toxicity_of_a_pair_of_neutral_terms():
    """Two terms are equally frequent in both classes and toxic only together; a third is toxic alone."""
    rnd = random.Random(3)
    plain = [f"w{i}" for i in range(60)]
    extra = [["alpha", "bravo"]] * 2 + [["slur"]] * 3 + [["alpha"]] * 2 + [["bravo"]] * 2 + [[]]
    rows = [(int(i % 10 < 5), " ".join(rnd.sample(plain, 8) + extra[i % 10])) for i in range(1600)]
    machine = toxicity_fm.fit([y for y, _ in rows[:1200]], [toxicity_fm.text_terms(t) for _, t in rows[:1200]])
    assert {zlib.crc32(b"alpha"), zlib.crc32(b"bravo")} <= set(machine.terms.tolist())
    assert sum((machine.score(t) >= 0.5) == y for y, t in rows[1200:]) >= 0.98 * 400


def test_fit_holds_few_bytes_a_term():
    """Terms of 32 bits, places of 32 bits, no sorting by index: a fit fits beside the others on an executor."""
    import tracemalloc

    draw, n, size = np.random.default_rng(3), 1000, 400
    frame = pd.DataFrame({"toxic": np.arange(n) % 2, "terms": [np.unique(draw.integers(0, 1 << 32, size)) for _ in range(n)]})
    tracemalloc.start()
    (got,) = toxicity_fm.fit_frames(iter([frame]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and peak < 50 * n * size
    every, terms = np.array([3, 5, 9], np.uint32), np.array([1, 3, 4, 5, 9, 10, 5], np.uint32)
    assert toxicity_fm.places(every, terms, 2).tolist() == [-1, 0, -1, 1, 2, -1, 1]
    assert toxicity_fm.places(every[:0], terms).tolist() == [-1] * 7
