"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans (email, ip, card, phone) are found by pattern and check; they always stay. Tokens with a digit or an at
sign are the nodes of a random field: neighbouring nodes share a transition potential, and tokens that carry the
same digits or the same address, however far apart, share an agreement potential through one hub per group, so
a group of n tokens costs n messages, not n squared. Loopy message passing then gives each token's label
distribution given the tokens that base patterns settle. A repeated number that is written differently from the one a base
pattern has found thus gets that one's label.

The field is trained in pieces on a bounded sample of documents, with base spans as labels: token weights by softmax
regression, transitions and agreement by counts. Null text counts as empty; a text without digits or at signs has no spans.
All scans are linear in the text.
"""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.common import use_python

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can't begin inside a run of digits, for it would then begin at the start of that run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@]")
CORE = re.compile(r"[+(]?[0-9A-Za-z](?:.*[0-9A-Za-z])?", re.S)
# Documents a fit may draw from; feature buckets; steps and rate of the fit; passes of messages; probability that adds a span;
# digits that make a number of its own, and how many of its last digits make two numbers similar.
TRAIN_DOCS, BUCKETS, STEPS, RATE, PASSES, ADD_FROM = 20_000, 1 << 12, 200, 0.5, 12, 0.9
LEAST_DIGITS, SIMILAR_DIGITS = 7, 9
DECAY = 1e-3


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, one look at each at sign: the local part is the longest run before it since the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list, list]:
    """(start, end, kind) of all base spans in order, and of the pattern matches that failed their check."""
    good, failed = [(a, b, "email") for a, b in emails(text)], []
    for m in IP.finditer(text):
        # compared as text, so that a run of many digits is no huge number
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))
        (good if fits else failed).append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19:  # other numbers say nothing about cards
            (good if passes_luhn(digits) else failed).append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        fits = 9 <= sum(c.isdigit() for c in m[0]) <= 15
        (good if fits else failed).append((m.start(), m.end(), "phone"))
    good.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return good, failed


class Nodes:
    """Tokens of one text that have a digit or an at sign, with features, groups and settled labels."""

    def __init__(self, text: str, good, failed):
        tokens = [m.span() for m in NODE.finditer(text)]
        marked = [i for i, (a, b) in enumerate(tokens) if MARKED.search(text, a, b)]
        self.text, self.spans = text, [tokens[i] for i in marked]
        self.beside = np.array([j for j in range(1, len(marked)) if marked[j] == marked[j - 1] + 1], int)
        self.settled = np.full(len(marked), -1)
        owner, at = np.array([a for a, _ in self.spans]), np.array([b for _, b in self.spans])
        for kind_of, spans in ((lambda _: 0, failed), (LABELS.index, reversed(good))):
            for a, b, kind in spans:
                self.settled[np.searchsorted(at, a, "right"):np.searchsorted(owner, b, "left")] = kind_of(kind)
        self.features = [self._features(tokens, i) for i in marked]
        self.groups = self._groups()

    def _features(self, tokens, i) -> list[int]:
        a, b = tokens[i]
        word = self.text[a:b]
        shape = re.sub(r"9+", "9", re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", word[:64]))))
        before = self.text[tokens[i - 1][0]:tokens[i - 1][1]].lower()[-12:] if i else "^"
        digits = sum(c.isdigit() for c in word[:64])
        names = ("bias", f"s{shape}", f"d{min(digits, 20)}", f"n{min(len(word), 40) // 3}", f"p{before}", f"b{before[-1]}",
                 f"@{'@' in word}", f".{min(word.count('.'), 4)}", f"+{word[0]}", f"-{min(word.count('-'), 4)}")
        return [zlib.crc32(n.encode()) % BUCKETS for n in names]

    def _groups(self) -> np.ndarray:
        """A number per node: nodes with the same address or the same last digits share one; others have -1.

        A number may stretch over neighbouring nodes, so the digits of a run of nodes are read together.
        """
        keys, group = {}, np.full(len(self.spans), -1)
        runs, beside = [], set(self.beside.tolist())
        for i in range(len(self.spans)):
            if i in beside and not any(c.isalpha() for c in self.text[slice(*self.spans[i])]):
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            word = self.text[self.spans[run[0]][0]:self.spans[run[-1]][1]]
            if "@" in word and len(run) == 1:
                key = CORE.search(word)
                key = key and key[0].lower()
            else:
                digits = re.sub("[^0-9]", "", word)
                letters = sum(c.isalpha() for c in word)
                key = digits[-SIMILAR_DIGITS:] if len(digits) >= LEAST_DIGITS and letters == 0 else None
            if key:
                group[run] = keys.setdefault(key, len(keys))
        return group


class Field:
    """Token weights, and how much an equal label is worth to neighbours and to members of a group."""

    def __init__(self, weights=None, transition=1.0, agreement=2.0):
        self.weights = np.zeros((BUCKETS, len(LABELS))) if weights is None else weights
        self.transition, self.agreement = transition, agreement

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Label probabilities of every node by loopy sum-product in log space, all messages of a pass at once."""
        n, size = len(nodes.spans), len(LABELS)
        own = np.array([self.weights[f].sum(0) for f in nodes.features]) if n else np.zeros((0, size))
        settled = nodes.settled >= 0
        own[settled] = -60.0
        own[settled, nodes.settled[settled]] = 0.0
        right, left = nodes.beside, nodes.beside - 1
        grouped = np.flatnonzero(nodes.groups >= 0)
        hub, fixed = nodes.groups[grouped], settled[grouped]
        ahead, back, to_hub, from_hub = np.zeros((n, size)), np.zeros((n, size)), np.zeros((len(hub), size)), np.zeros((n, size))
        agree, follow = self.agreement * np.eye(size), self.transition * np.eye(size)
        for _ in range(PASSES):
            belief = own + ahead + back + from_hub
            new_ahead, new_back = np.zeros_like(ahead), np.zeros_like(back)
            new_ahead[right] = through(belief[left] - back[left], follow)
            new_back[left] = through(belief[right] - ahead[right], follow)
            to_hub = through(belief[grouped] - from_hub[grouped], agree)
            to_hub[fixed] = own[grouped[fixed]]  # what a base pattern has settled is certain for its group too
            total = np.zeros((hub.max() + 1 if len(hub) else 0, size))
            np.add.at(total, hub, to_hub)
            ahead, back = new_ahead, new_back
            from_hub[grouped] = through(total[hub] - to_hub, agree)
        belief = own + ahead + back + from_hub
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def through(message: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Log messages across an edge, normalised."""
    out = np.logaddexp.reduce(message[:, :, None] + potential[None], axis=1)
    return out - np.logaddexp.reduce(out, axis=1, keepdims=True)


def fit(texts) -> Field:
    """Piecewise training with the base labels of the texts."""
    rows, labels = [], []
    size = len(LABELS)
    same, other, kept, changed = 1.0, 1.0, 1.0, 1.0
    for text in texts:
        nodes = Nodes(text, *base_spans(text))
        gold = np.maximum(nodes.settled, 0)
        rows += nodes.features
        labels += gold.tolist()
        equal = int((gold[nodes.beside - 1] == gold[nodes.beside]).sum())
        kept, changed = kept + equal, changed + len(nodes.beside) - equal
        for g in np.unique(nodes.groups[nodes.groups >= 0]):
            held = gold[(nodes.groups == g) & (nodes.settled >= 0)]
            if len(held) > 1:
                most = np.bincount(held).max()
                same, other = same + most - 1, other + len(held) - most
    if not rows:
        return Field()
    x, y = np.array(rows), np.array(labels)
    weights = np.zeros((BUCKETS, size))
    for _ in range(STEPS):
        odds = weights[x].sum(1)
        p = np.exp(odds - np.logaddexp.reduce(odds, axis=1, keepdims=True))
        p[np.arange(len(y)), y] -= 1
        grad = np.zeros_like(weights)
        for k in range(size):
            grad[:, k] = np.bincount(x.ravel(), np.repeat(p[:, k], x.shape[1]), BUCKETS)
        touched = np.maximum(np.bincount(x.ravel(), minlength=BUCKETS), 1)[:, None]
        weights -= RATE * (grad / touched + DECAY * weights)
    worth = lambda yes, no, most: float(np.clip(np.log(yes / no), 0.5, most))
    return Field(weights, worth(kept, changed, 3.0), worth(same * (size - 1), other, 8.0))


def added_spans(field: Field, text: str, good, failed) -> list:
    """Spans of nodes that no base pattern settles and whose label is nearly sure; neighbours of one label are one span.

    Only tokens tied to a settled one of their group are added: the agreement is what the base patterns lack.
    """
    nodes = Nodes(text, good, failed)
    tied = set(nodes.groups[(nodes.settled > 0) & (nodes.groups >= 0)].tolist())
    open_nodes = [i for i in range(len(nodes.spans)) if nodes.settled[i] < 0 and nodes.groups[i] in tied]
    if not open_nodes:
        return []
    p, out, beside = field.marginals(nodes), [], set(nodes.beside.tolist())
    for i in open_nodes:
        k = int(p[i].argmax())
        if not k or p[i, k] < ADD_FROM:
            continue
        a, b = nodes.spans[i]
        core = CORE.search(text[a:b])
        if core:
            span = (a + core.start(), a + core.end(), LABELS[k])
            if out and i in beside and out[-1][1] >= nodes.spans[i - 1][0] and out[-1][2] == LABELS[k]:
                out[-1] = (out[-1][0], span[1], LABELS[k])
            else:
                out.append(span)
    return out


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def spans_of(field: Field, text: str | None) -> tuple[list, list]:
    """Base spans and all spans of a text, each by start, then kind."""
    if not text or not MARKED.search(text):
        return [], []
    good, failed = base_spans(text)
    more = added_spans(field, text, good, failed) if good else []
    return good, sorted({*good, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """Fit on about ``rows`` documents at most, drawn by a hash of doc_id and text, in one task."""
    share = min(1.0, rows / max(docs.count(), 1))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))).filter(F.col("text").rlike("[0-9@]"))

    def one(frames):
        field = fit([t for f in frames for t in f["text"]])
        used = np.flatnonzero(np.abs(field.weights).sum(1))
        yield pd.DataFrame({"bucket": [-1, -2, *used.tolist()], "values": [[field.transition], [field.agreement], *field.weights[used].tolist()]})

    got = {r["bucket"]: r["values"] for r in drawn.select("text").repartition(1).mapInPandas(one, "bucket long, values array<double>").collect()}
    if not got:
        return Field()
    weights = np.zeros((BUCKETS, len(LABELS)))
    for bucket, values in got.items():
        if bucket >= 0:
            weights[bucket] = values
    return Field(weights, got[-1][0], got[-2][0])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of every document (columns doc_id and text are read)."""
    spark = docs.sparkSession
    use_python(spark)
    shared = spark.sparkContext.broadcast(train(docs))

    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            good, every = spans_of(shared.value, text)
            counts = [sum(s[2] == k for s in good) for k in KINDS]
            out.append((*counts, hashlib.sha256(written(good).encode()).hexdigest(), written(every)))
        return pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    found = F.pandas_udf(scan, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")
