"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (letters, digits, underscore; lower case) and the starts of its longer
words, hashed to 32 bits. A machine of low rank scores single terms and all pairs of terms at once: a pair weighs
as the product of two short vectors, so a combination such as insult with group mention counts for more than its
parts. It is fitted on a bounded sample of labelled rows; scoring covers every text whole.

Null and empty texts get the score of a text without terms. Without labelled rows of both kinds the score is the smoothed
share of toxic rows.
"""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import use_python

WORDS = re.compile(r"\w+")
PREFIX = 5
# Labelled rows that a fit may use, documents a term must be in, least z of its difference between the classes; terms that differ
# less are used for their pairs.
TRAIN_ROWS, LEAST_DOCS, LEAST_Z = 20_000, 4, 3.5
RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 6, 30, 128, 0.3, 1e-5, 7
CACHED_WORDS = 150_000


def hash_terms(word: str) -> list[int]:
    """Hashes of a word and of its start."""
    found = [zlib.crc32(word.encode())]
    return found + [zlib.crc32(b"^" + word[:PREFIX].encode())] if len(word) > PREFIX else found


def text_terms(text: str | None) -> np.ndarray:
    return np.unique(np.fromiter((h for w in set(WORDS.findall((text or "").lower())) for h in hash_terms(w)), np.int64))


class Machine:
    """Terms in order of their hash, one weight and one vector each."""

    def __init__(self, bias=0.0, terms=(), weights=(), vectors=()):
        self.bias, self.terms = float(bias), np.asarray(terms, np.int64)
        self.weights = np.asarray(weights, np.float32)
        self.vectors = np.asarray(vectors, np.float32).reshape(len(self.terms), RANK)
        self.place, self.cache = {int(t): i for i, t in enumerate(self.terms)}, {}

    def known(self, word: str) -> tuple:
        found = self.cache.get(word)
        if found is None:
            found = tuple(i for i in map(self.place.get, hash_terms(word)) if i is not None)
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def score(self, text: str | None) -> float:
        at = sorted({i for w in set(WORDS.findall((text or "").lower())) for i in self.known(w)})
        odds = self.bias
        if at:
            v = self.vectors[at]
            total = v.sum(0)
            odds += float(self.weights[at].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def paired(y: np.ndarray, owner: np.ndarray, where: np.ndarray, df: np.ndarray, bad: np.ndarray, block: int = 512) -> np.ndarray:
    """Terms of a pair whose documents are toxic more (or less) often than those of both its terms, whatever each is alone.

    The evidence of a pair is Chernoff's bound for its toxic documents at the nearer of the two shares; it must pass the
    logarithm of the number of pairs. All pairs are counted, block by block, but those of terms too rare to reach it with any partner.
    """
    n, limit = len(y), np.log(max(len(df) ** 2 / 2, 2.0))
    out = np.zeros(len(df), bool)
    share = np.clip(bad / np.maximum(df, 1), 1e-9, 1 - 1e-9)
    most = np.maximum(-bad * np.log(share), -(df - bad) * np.log(1 - share))
    chosen = np.flatnonzero(most >= limit)
    place = np.full(len(df), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    column, row = place[where], owner
    order = np.flatnonzero(column >= 0)
    order = order[np.argsort(column[order], kind="stable")]
    column, row = column[order], row[order]

    def dense(at):
        first, last = np.searchsorted(column, (at, at + block))
        x = np.zeros((n, min(block, len(chosen) - at)), np.float32)
        x[row[first:last], column[first:last] - at] = 1
        return x

    toxic = np.flatnonzero(y > 0)
    for i in range(0, len(chosen), block):
        x = dense(i).T
        a = chosen[i:i + block]
        for j in range(i, len(chosen), block):
            z, b = dense(j), chosen[j:j + block]
            both, hurt = x @ z, x[:, toxic] @ z[toxic]
            high, low = np.maximum.outer(share[a], share[b]), np.minimum.outer(share[a], share[b])
            r, c = np.nonzero((both >= LEAST_DOCS) & ((hurt > high * both) | (hurt < low * both)))
            k, t = both[r, c].astype(np.float64), hurt[r, c].astype(np.float64)
            near = np.where(t > high[r, c] * k, high[r, c], low[r, c])
            q = np.clip(t / k, 1e-12, 1 - 1e-12)
            found = k * (q * np.log(q / near) + (1 - q) * np.log((1 - q) / (1 - near))) >= limit
            out[a[r[found]]] = out[b[c[found]]] = True
    return out


def places(every: np.ndarray, terms: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Where each term stands in the sorted ``every``, -1 if nowhere; block by block, in 32 bits."""
    out = np.full(len(terms), -1, np.int32)
    for at in range(0, len(terms) if len(every) else 0, block):
        part = terms[at:at + block]
        found = np.minimum(np.searchsorted(every, part), len(every) - 1)
        same = every[found] == part
        out[at:at + block][same] = found[same]
    return out


def fit(labels: np.ndarray, rows: list[np.ndarray]) -> Machine:
    """AdaGrad on logistic loss over the terms that differ between the classes, alone or in a pair."""
    y = np.asarray(labels, np.float32)
    n_bad, n = float(y.sum()), len(y)
    if not 0 < n_bad < n:
        share = (n_bad + 1) / (n + 2) if n else 0.0
        return Machine(np.log(share / (1 - share)) if n else -50.0)
    counts = np.array([len(r) for r in rows])
    terms = np.concatenate(rows) if counts.sum() else np.empty(0, np.int64)
    del rows  # the caller's only reference, if it gave its own away
    every, df = np.unique(terms, return_counts=True)
    every, df = every[df >= LEAST_DOCS], df[df >= LEAST_DOCS]  # rarer ones are never used
    where = places(every, terms)
    held = where >= 0
    owner, where = np.repeat(np.arange(n, dtype=np.int32), counts)[held], where[held]
    del terms, held
    bad = np.bincount(where, y[owner], minlength=len(every))
    p = df / n
    z = (bad / n_bad - (df - bad) / (n - n_bad)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_bad + 1 / (n - n_bad)))
    used = np.abs(z) >= LEAST_Z
    used[paired(y, owner, where, df, bad)] = True
    place = np.cumsum(used) - 1
    keep = used[where]
    owner, where = owner[keep], place[where[keep]]
    starts = np.searchsorted(owner, np.arange(n + 1))
    m, draw = int(used.sum()), np.random.default_rng(SEED)
    b, w, v = float(np.log(n_bad / (n - n_bad))), np.zeros(m, np.float32), draw.normal(0, 0.05, (m, RANK)).astype(np.float32)
    gb, gw, gv = 1e-6, np.full(m, 1e-6, np.float32), np.full((m, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS if m else 0):
        order = draw.permutation(n)
        for at in range(0, n, BATCH):
            rows_at = order[at:at + BATCH]
            lengths = starts[rows_at + 1] - starts[rows_at]
            x = np.zeros((len(rows_at), m), np.float32)
            picked = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows_at]) if lengths.sum() else np.empty(0, int)
            x[np.repeat(np.arange(len(rows_at)), lengths), where[picked]] = 1
            total = x @ v
            odds = b + x @ w + 0.5 * ((total * total).sum(1) - x @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y[rows_at]) / len(rows_at)
            xg = x.T @ g
            dw, dv, db = xg + DECAY * w, x.T @ (g[:, None] * total) - xg[:, None] * v + DECAY * v, float(g.sum())
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            b -= RATE * db / gb**0.5
            w -= RATE * dw / np.sqrt(gw)
            v -= 0.3 * RATE * dv / np.sqrt(gv)
    return Machine(b, every[used], w, v)


def fit_frames(frames):
    """One task: the bounded sample comes in, the machine goes out as rows (term, weight, vector); term -1 holds the bias."""
    labels, rows = [np.empty(0)], []
    for f in frames:  # none: a machine that scores nothing as toxic
        if len(f):
            labels.append(f["toxic"].to_numpy())
            rows += [np.asarray(t, np.uint32) for t in f["terms"]]  # hashes of 32 bits; the frames go
    given = [rows]
    del rows
    machine = fit(np.concatenate(labels), given.pop())
    yield pd.DataFrame({
        "term": [-1, *machine.terms.tolist()], "weight": [machine.bias, *machine.weights.tolist()],
        "vector": [[], *machine.vectors.tolist()],
    })


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most about ``rows`` labelled documents (docs: doc_id, text; labels: doc_id, toxic), drawn by a hash of doc_id.

    The drawn labels are at most ``rows`` and a little more, so they are broadcast to find their texts.
    """
    use_python(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    share = min(1.0, rows / max(count, 1))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    terms = F.pandas_udf(lambda s: s.map(text_terms), "array<bigint>")
    sample = texts.select("toxic", terms("text").alias("terms")).repartition(1)
    out = sample.mapInPandas(fit_frames, "term long, weight double, vector array<double>").collect()
    found = sorted((r for r in out if r["term"] >= 0), key=lambda r: r["term"])
    bias = next((r["weight"] for r in out if r["term"] < 0), -50.0)
    return Machine(bias, [r["term"] for r in found], [r["weight"] for r in found], [r["vector"] for r in found])


_machines: dict[str, Machine] = {}  # per worker, kept over tasks


def scores_of(key: str, shared, texts: pd.Series) -> pd.Series:
    if key not in _machines:
        _machines.clear()
        _machines[key] = shared.value
    machine = _machines[key]
    return pd.Series([machine.score(t) for t in texts], dtype="float64")


def scorer(spark, machine: Machine):
    """A column function: toxicity of a text, 0 to 1."""
    use_python(spark)
    shared = spark.sparkContext.broadcast(machine)
    key = f"{spark.sparkContext.applicationId} {id(shared)} {machine.bias}"

    def score(texts: pd.Series) -> pd.Series:
        return scores_of(key, shared, texts)

    return F.pandas_udf(score, "double")


def held_out(doc_id="doc_id"):
    """Rows kept from learning: crc32 of the number as text leaves no rest by 5 (a null number counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labelled rows that are not held out."""
    learn = labels.filter(~held_out())
    score = scorer(docs.sparkSession, train(docs, learn))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, with all columns, without the documents that are predicted toxic. Learns from all of ``labels``."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.filter(score(docs["text"]) < 0.5)
