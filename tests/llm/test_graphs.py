"""Components, link search, SimHash classes and line classes against union-find over all pairs."""

import random
import re
import time
from itertools import combinations

import pytest
import xxhash

from pyspark.sql import functions as F

from rotorwatch.llm import common, line_dedup, simhash_dedup
from rotorwatch.llm import components as link_search
from rotorwatch.llm.components import components, linked


def classes(nodes, links):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(99, i) for i in range(40)],
    [(random.Random(3).randrange(80), random.Random(i).randrange(80)) for i in range(60)],
])
def test_components(spark, links):
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for e in links if e[0] != e[1] for n in e}
    assert got == classes(nodes, [e for e in links if e[0] != e[1]])


def test_linked_misses_no_link_between_components(spark):
    """Neighbouring numbers are links; a cell holds numbers whose only links are to others than its hub."""
    members = [("x", 0), ("x", 10), ("x", 11), ("x", 12), ("y", 12), ("y", 13), ("z", 40), ("z", 42), ("z", 41), ("x", 5)]
    near = lambda a, b: (a("id") - b("id")).between(-1, 1)
    got = {r.id: r.root for r in linked(spark.createDataFrame(members, "cell string, id long"), near).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 10, 40: 40, 41: 40, 42: 40}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_equal_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdefgh ÄÉ\t\n") for _ in range(rnd.choice([3, 30, 900]))) for _ in range(40)]
    texts = base + [t + " x" for t in base] + [t.upper() for t in base] + [None, "", "  \n", "one", "ONE two", base[0]]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base[1], "y")]
    rows = simhash_dedup.near_copies(spark.createDataFrame(docs, "doc_id long, text string, id string")).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert len(rows) == len(docs) and prints == {i: plain_fingerprint(t) for i, t, _ in docs}
    points = set(prints.values())
    root = classes(points, [(a, b) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[root[prints[i]]] = min(i, least.get(root[prints[i]], i))
    assert {r.doc_id: r.component_id for r in rows} == {i: least[root[p]] for i, p in prints.items()}


def test_dense_fingerprints(spark):
    """Hundreds of fingerprints a few bits around one centre, and some far ones."""
    rnd = random.Random(8)
    points = {rnd.getrandbits(64) for _ in range(30)}
    centre = rnd.getrandbits(64)
    for _ in range(250):
        points.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash_dedup.fingerprint_classes(spark.createDataFrame([(signed(p),) for p in points], "id long")).collect()
    links = [(signed(a), signed(b)) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 3]
    assert {r.id: r.root for r in got} == classes({n for e in links for n in e}, links)


def test_first_of_class(spark):
    docs = spark.createDataFrame(
        [(3, "a b c d e f", 1), (1, "a b c d e f", 2), (1, "a b c d e f", 2), (2, "completely other words are in this one", 3),
         (None, "A B C D E F", 4), (None, "words that are nowhere else at all in here", 5), (7, "", 6), (8, None, 7)],
        "doc_id long, text string, id int")
    kept = simhash_dedup.first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["id"] for r in kept.collect()) == [2, 2, 3, 4, 5, 6]  # nameless documents are one, first of its other class
    assert simhash_dedup.first_of_class(docs.limit(0)).count() == 0


def shingles(line):
    words = line.lower().split(" ")
    return {" ".join(s)[:line_dedup.SHINGLE] for s in zip(words, [*words[1:], ""], [*words[2:], "", ""])}


def plain_lines(docs):
    """(doc_id, line number): first of its class, over all pairs of lines."""
    lines = {}
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines.setdefault(line, []).append((i, n))
    sets = {line: shingles(line) for line in lines}
    links = [(a, b) for a, b in combinations(lines, 2) if len(sets[a] & sets[b]) >= line_dedup.SIMILAR * len(sets[a] | sets[b])]
    root = classes(lines, links)
    members = {}
    for line, at in lines.items():
        members.setdefault(root[line], []).extend(at)
    return {p: min(at) for at in members.values() for p in at}


def line_fixture():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    docs = []
    for i in range(80):
        own = []
        for _ in range(rnd.randint(1, 6)):
            line = rnd.choice(lines).split(" ")
            if len(line) > 24 and rnd.random() < 0.5:
                line[rnd.randrange(len(line))] = rnd.choice(words)
            own.append(" ".join(line))
        docs.append((i, "\n".join(own)))
    return docs + [(200, None), (201, ""), (202, " \n\t\n"), (203, "HELLO\n\nhello\n"), (204, "x" * 30000), (205, "x" * 30000)]


def test_line_classes_equal_brute_force(spark):
    docs = line_fixture()
    rows = line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in rows}
    wanted = plain_lines(docs)
    assert set(got) == set(wanted) and len(rows) == len(got)
    # bands find a link with probability 0.997 at least; classes here rest on links well above the bound
    assert sum(got[k] == wanted[k] for k in wanted) >= 0.99 * len(wanted)
    assert all(r.kept == ((r.doc_id, r.line_no) == got[r.doc_id, r.line_no]) for r in rows)


def test_dedup_lines(spark):
    docs = spark.createDataFrame(
        [(2, "same line here\n\nown words of two", "e", 5, "q"), (1, "first\nsame line here", "e", 5, "q"), (None, "same line here", "e", 5, "q"),
         (4, None, "e", None, "q"), (5, "same line here\nsame line here", "e", 5, "q"), (6, "nothing repeated in this one", "e", 28, "q"),
         (6, "nothing repeated in this one", "e", 28, "q")],
        "doc_id long, text string, lang string, n_chars long, id string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(
        [(0, "same line here", 5), (1, "first", 5), (2, "\nown words of two", 17), (4, None, None), (5, "", 0),
         (6, "nothing repeated in this one", 28), (6, "nothing repeated in this one", 28)], key=repr)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def character_shingles(line):
    low = line.lower()
    return {low[i:i + 5] for i in range(len(low) - 4)} or {low}


def same_class(spark, *lines):
    """Class numbers of lines, each the only one of its document."""
    rows = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    return [r.first_doc_id for r in sorted(rows, key=lambda r: r.doc_id)]


def test_lines_with_one_typo(spark):
    """Short and medium lines with one changed character or word, against all pairs of the runs of five characters."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(4, 8))) for _ in range(400)]
    lines = []
    for n in [10] * 40 + [20] * 40:
        own = [rnd.choice(words) for _ in range(n)]
        at = rnd.randrange(1, n - 1)
        lines += [" ".join(own), " ".join([*own[:at], own[at][:-1] + "z", *own[at + 1:]])]
    lines += ["\U0001F600 twice the same line \U0001F601", "\U0001F600 Twice the same line \U0001F601", "abc", "ABC", "abd", "\U0001F600"]
    sets = [character_shingles(line) for line in lines]
    numbers = range(len(lines))
    links = [(a, b) for a, b in combinations(numbers, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, got = classes(numbers, links), same_class(spark, *lines)
    assert len(links) > 60 and sum(got[i] == root[i] for i in numbers) >= 0.97 * len(lines)
    assert all(root[got[i]] == root[i] for i in numbers)


def test_lines_without_spaces(spark):
    """Lines that differ only behind their first twenty characters are different lines."""
    start = "".join(chr(0x4E00 + 7 * i) for i in range(20))
    lines = ["https://example.com/a/1", "https://example.com/b/2", "2024-01-01\t00:00:00\t17.5", "2024-01-01\t00:00:00\t99.1",
             start + "".join(chr(0x5E00 + i) for i in range(15)), start + "".join(chr(0x6E00 + i) for i in range(15))]
    assert same_class(spark, *lines) == list(range(6))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(docs).collect()) == sorted(lines)


def test_links_in_crowded_bands(spark):
    """Lines of one long passage share bands with hundreds of others; their links, little over the bound, are found all the same."""
    rnd = random.Random(21)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage, lines = letters(354), []
    for _ in range(200):
        own = letters(32)
        lines += [passage + own + letters(42), passage + own + letters(42)]
    sets = [character_shingles(line) for line in lines]
    numbers = range(len(lines))
    links = [(a, b) for a, b in combinations(numbers, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert links == [(a, a + 1) for a in numbers[::2]]
    got = same_class(spark, *lines)
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)


def test_four_shingles_against_five(spark):
    """A line of four shingles is similar to one of five that holds them all."""
    rnd = random.Random(4)
    short = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(150)]
    lines = [line for s in short for line in (s, s + rnd.choice("0123456789"))]
    got = same_class(spark, *lines)
    assert sum(got[i] == i - i % 2 for i in range(len(lines))) >= 0.98 * len(lines)


def test_shingles_by_chunks(spark):
    """Every run of five characters once, wherever the cuts fall."""
    rnd = random.Random(5)
    lines = ["".join(rnd.choice("abcXYZ \U0001F600é") for _ in range(n)) for n in [1, 4, 5, 6, 59, 60, 61, 63, 64, 65, 119, 120, 124, 125, 3001]]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    cut = df.select("line", F.explode(line_dedup.chunks(F.col("line"))).alias("c")).select(
        "line", "c", F.explode(line_dedup.positions(F.col("c"))).alias("at")).selectExpr("line", "substring(c, at, 5) AS s")
    got = {}
    for r in cut.collect():
        got.setdefault(r.line, []).append(r.s)
    low = {x: x.lower() for x in lines}
    assert {x: sorted(v) for x, v in got.items()} == {x: sorted([low[x][i:i + 5] for i in range(len(x) - 4)] or [low[x]]) for x in lines}
    sizes = {r.line: r.n for r in df.select("line", F.size(line_dedup.shingle_set(F.col("line"))).alias("n")).collect()}
    assert sizes == {x: len(character_shingles(x)) for x in lines}


def test_shingles_by_slices(spark):
    """The slices of a line's code points are its runs of five characters, and nothing of the text is walked again for each of them."""
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcXYZ \U0001F600\u00e9\u4e00") for _ in range(n)) for n in [1, 4, 5, 6, 60, 3001]] + ["", "\u0130\u00df" * 9]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("low", F.lower("line")).withColumn("points", line_dedup.code_points(F.col("line")))
    cut = df.select("line", "low", "points", F.explode(line_dedup.starts(F.col("points"))).alias("at"))
    got, low = {x: [] for x in lines}, {}
    for r in cut.select("line", "low", line_dedup.shingle(F.col("points"), F.col("at")).alias("s")).collect():
        got[r.line].append(bytes(r.s).decode("utf-32-be"))
        low[r.line] = r.low
    assert got == {x: [low[x][i:i + 5] for i in range(len(low[x]) - 4)] or [low[x]] for x in lines}
    # bands of a line come from these slices; case makes no difference, other lines share none
    bands = {r.id: r["keys"] for r in line_dedup.bands(spark.createDataFrame([(1, "Some words \U0001F600 of a line"), (2, "sOME WORDS \U0001F600 OF A LINE"), (3, "quite another")], "id long, line string")).collect()}
    assert bands[1] == bands[2] and not set(bands[1]) & set(bands[3])


def test_bands_of_lines_of_one_language(spark):
    """Lines made of the same syllables have many shingles in common; few of them share a band, and lines of similarity 0.8 do."""
    rnd = random.Random(31)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"][:14]
    lines = ["".join(rnd.choice(syllables) + rnd.choice(["", "", " "]) for _ in range(450)) for _ in range(150)]
    low, near = [character_shingles(x) for x in lines], []
    three = sum(1 - (1 - (len(a & b) / len(a | b)) ** 3) ** 8 for a, b in combinations(low, 2))  # pairs expected of 8 bands of three hashes
    assert three > 50
    for line, own in zip(lines, low):  # its end is changed for as long as it stays similar
        at = len(line)
        while len(own & (new := character_shingles(line[:at - 4] + "Z" * (len(line) - at + 4)))) >= 0.8 * len(own | new):
            at -= 4
        near.append(line[:at] + "Z" * (len(line) - at))
    rows = spark.createDataFrame(list(enumerate(lines + near)), "id long, line string")
    keys = {r.id: set(r["keys"]) for r in line_dedup.bands(rows).collect()}
    n = len(lines)
    assert sum(bool(keys[i] & keys[i + n]) for i in range(n)) >= 0.98 * n
    assert sum(bool(keys[a] & keys[b]) for a, b in combinations(range(n), 2)) < 0.4 * three


def test_bitmaps_of_lines_that_repeat_themselves(spark):
    """The bound of a line that repeats itself is its number of distinct shingles, not of positions, so that unlike ones are told apart."""
    rnd = random.Random(32)
    plain = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(700))
    lines = ["of " * 200, "it " * 200, plain, "abc", "x" * 30000]
    rows = {r.id: r for r in line_dedup.bitmaps(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    assert [rows[i].n for i in range(5)] == [3, 3, 700, 1, 1]
    marks = spark.createDataFrame([rows[0]]).select(
        *[F.col(c).alias(f"a_{c}") for c in rows[0].asDict()]).crossJoin(spark.createDataFrame([rows[1]]).select(*[F.col(c).alias(f"b_{c}") for c in rows[1].asDict()]))
    assert marks.filter(line_dedup.possible(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).count() == 0


def test_bitmaps_tell_long_unlike_lines_apart(spark):
    """Unlike lines of 1,200 characters never reach the exact test; similar ones do."""
    rnd = random.Random(33)
    lines = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1200)) for _ in range(12)]
    lines += [line[:1100] + "Z" * 100 for line in lines]
    marks = line_dedup.bitmaps(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    a, b = (marks.select(*[F.col(c).alias(f"{end}_{c}") for c in marks.columns]) for end in "ab")
    near = a.crossJoin(b).filter("a_id < b_id").filter(line_dedup.possible(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    assert sorted((r.a_id, r.b_id) for r in near.collect()) == [(i, i + 12) for i in range(12)]


def test_links_in_slices(spark, monkeypatch):
    """Links that need the comparison of all members, a few rows at a time, with and without a second test; a pair is confirmed once."""
    monkeypatch.setattr(link_search, "SLICE_ROWS", 30)
    rnd = random.Random(9)
    members = sorted({(rnd.randrange(4), n) for n in rnd.sample(range(60), 30) for _ in range(2)})
    links = [(a, b) for (c, a), (d, b) in combinations(members, 2) if c == d and abs(a - b) == 1]
    rows, near, asked = spark.createDataFrame(members, "cell int, id long"), lambda a, b: F.abs(a("id") - b("id")) <= 2, []

    def confirm(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.filter("abs(a - b) = 1")

    want = classes({n for e in links for n in e}, links)
    assert {r.id: r.root for r in linked(rows, near, None, confirm).collect()} == want
    assert len(asked) == len(set(asked))
    assert {r.id: r.root for r in linked(rows, lambda a, b: F.abs(a("id") - b("id")) == 1).collect()} == want


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        return sum("shuffle_" in f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())))

    before = shuffled()
    table = common.landed(spark.range(1000).groupBy(F.xxhash64("id")).count(), "counts")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert table.count() == 1000
    common.dropped(table, None)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0]).count()
