"""Each operator against a brute-force version, and on awkward tables: nulls, empty and very long texts, ties, repeated
rows, no rows, and extra columns with clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumachron.llm import cotraining, decontaminate, jaccard_join, line_dedup, piece_tokens, quality_rules, sharding, shared, token_files, url_filter, warc, words

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
BLANK_WORDS, LETTER_WORDS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["ta", "ri", "mo", "ne", "é", "Su"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts."""
    r = random.Random(seed)
    texts: list[str | None] = [prose(r, r.randrange(1, 120)) for _ in range(n)]
    for k in range(0, n, 7):
        near = (texts[k] or "").split(" ")
        near[len(near) // 2] = "changed"
        texts += [texts[k], " ".join(near), (texts[k] or "").upper()]
    return list(enumerate([*texts, None, "", "   \n ", "one", "one two", "one two", prose(r, 9000), "x" * 30_000, "a b " * 4000]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").persist()


def clashing(df):
    """df with columns named like those that operators make."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("n_words", "kept", "rule", "ids", "key", "c0", "site", "words", "cell", "n", "host", "range", "places")])


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# words


def test_words():
    r = random.Random(1)
    texts = ["".join(r.choice("aB éß漢\t\n\x0b\x00.,0Z") for _ in range(r.randrange(30))) for _ in range(500)] + ["", None, " "]
    for separators, pattern in ((words.BLANKS, BLANK_WORDS), (words.SIGNS, LETTER_WORDS)):
        found = words.split_words(pa.array(texts, pa.string()).slice(3), separators)
        spelled = [w.decode() for w in found.words.to_pylist()]
        for i, t in enumerate(texts[3:]):
            assert spelled[found.at[i] : found.at[i + 1]] == re.findall(pattern, (t or "").translate(LOWER))


# 1: url filters


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key")).union(spark.createDataFrame([(None,)], "key string"))
    listed = spark.range(-50, 5000, 9).select(F.col("id").cast("string").alias("key"))
    filters, buckets = url_filter.cascade(universe, listed, bucket_keys=700)
    universe = universe.union(spark.range(3000).select(F.lit("9").alias("key")))  # a frequent key
    for most in (1 << 20, 0):  # by one broadcast, and dealt to where their filters are
        got = url_filter.with_membership(universe, filters, buckets, "key", most_bytes=most).collect()
        want = {r["key"] for r in listed.collect()}
        assert len(got) == 8001 and all(r["listed"] == (r["key"] in want) for r in got)


def test_urls(spark):
    urls = [None, "", "no host", "http://COM/", "https://a.Example.com/en/x?q#f", "http://www.example.com/en/1", "http://xexample.com/en/", "ftp://b.net/es/?x", "http://c.net/fr", "http://d.org#x", "http://d.org/p" + "q" * 10_000, "http://u://v/w", "http://b.net\n/es/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    listed = spark.createDataFrame([("d.org",), (None,), ("nowhere",)], "key string")
    key = F.when(F.col("host") != "", F.col("host"))
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judged_urls(pages, rules, listed, key).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("com", "/", "com/", "allow") and got[4] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[6][2] == "com/" and got[7][2:] == ("net/es/", "block")
    assert got[8] == ("c.net", "/fr", None, "allow") and got[9] == ("d.org", "", None, "block") and got[10][3] == "block"
    assert got[11][:2] == ("u:", "//v/w")
    assert url_filter.judged_urls(pages.limit(0), rules, listed, key).count() == 0
    assert url_filter.judged_urls(pages, [], listed.limit(0), key).where("verdict = 'block'").count() == 0


# 2: quality rules


def counts_by_hand(text):
    text = text or ""
    w = re.findall(BLANK_WORDS, text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(BLANK_WORDS, x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_statistics(spark, docs):
    extra = spark.createDataFrame([(1000, "a\nb\n\na\n \n \n# <b>|\ta\x0bb"), (1001, "u v w x y " * 3 + "z " + "u v w x y")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = {r["doc_id"]: r for r in quality_rules.judged(rows, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in texts_of(rows).items():
        want = counts_by_hand(t)
        assert tuple(got[i][c] for c in quality_rules.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed)


def test_repeated_words_of_long_texts(spark):
    """Words in repeated windows, where few bits of a hash are left and where a text has over a million words."""
    r = random.Random(12)
    texts = [" ".join(r.choice(["a", "b", "c", "d"]) for _ in range(n)) for n in (300, 2000)] + [prose(r, 500)]
    long = [f"w{k}" for k in range(1_100_000)]
    long[700_000:700_012] = long[10:22]
    texts.append(" ".join(long))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["kept_columns"]["doc_id"]: x["n_repeat_words"] for x in quality_rules.text_statistics(df, "doc_id").collect()}
    assert got == {i: counts_by_hand(t)[4] for i, t in enumerate(texts)} and got[3] == 24
    words_of = F.array_remove(F.split("text", " "), "")
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(5)]))
    few = df.where("doc_id < 3").select("doc_id", words_of.alias("words")).select("doc_id", windows.alias("windows"))
    for spare in (0, 40, 52):
        assert {x["doc_id"]: x["n"] for x in few.select("doc_id", quality_rules.repeated("windows", 5, spare).alias("n")).collect()} == {i: got[i] for i in range(3)}


def test_learned_rules(spark):
    r = random.Random(4)
    rows = [(k, prose(r, 60) if k % 3 else " ".join(w + r.choice(["$$", "%%"]) for w in prose(r, 60).split(" ")), int(k % 3 > 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.where("doc_id % 2 = 0").select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None), (999_999, 0)], "doc_id long, quality int"))
    got = quality_rules.judged(df, labels).join(df.select("doc_id", "quality"), "doc_id").where("not base_failed")
    assert got.where("kept <> (quality = 1)").count() <= 6 and got.where("kept and quality = 0").count() <= 6 and got.where("rule is not null").count() > 150
    kept = quality_rules.good_documents(clashing(df.select("doc_id", "text")), labels)
    assert kept.columns == clashing(df.select("doc_id", "text")).columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.where("kept").collect()}
    assert quality_rules.judged(df.limit(0), labels).count() == 0


# 3: n-gram Jaccard join


def classes_by_hand(texts, size=5, percent=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(BLANK_WORDS, (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_classes(spark, docs):
    assert classes_of(clashing(docs)) == classes_by_hand(texts_of(docs))
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == jaccard_join.one_of_each(docs.limit(0)).count() == 0


def classes_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df).collect()}


@pytest.mark.parametrize("small", [2, 1000])
def test_large_group_of_near_copies(spark, monkeypatch, small):
    """Families whose members link in chains or not at all: as rows, and in several blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LEAST_BLOCK", 16)
    r = random.Random(5)
    base = prose(r, 90).split(" ")
    rows = []
    for k in range(140):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"w{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = classes_of(df), classes_by_hand(dict(rows))
    assert got == want and len({c for _, c in want.values()}) > 3


def test_pages_of_one_template(spark, monkeypatch):
    """Thousands of pages that share most of their text but aren't similar: two rounds, and no pairs."""
    rounds, pairs = [], []
    similar, near = jaccard_join.similar, jaccard_join.near_enough
    monkeypatch.setattr(jaccard_join, "similar", lambda *a: rounds.append(1) or similar(*a))
    monkeypatch.setattr(jaccard_join, "near_enough", lambda p, *a: pairs.append(p.count()) or near(p, *a))
    r = random.Random(8)
    base = prose(r, 75).split(" ")
    rows = [(k, " ".join([*base, *(f"p{k}w{j}" for j in range(25))])) for k in range(2000)]
    rows += [(5000 + k, f"{rows[k][1]} more") for k in range(0, 2000, 500)]
    got = classes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {i: c for i, (_, c) in got.items()} == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    assert len(rounds) <= 2 and pairs[0] < 2 * len(rows)


def test_classes_of_repeated_and_null_ids(spark):
    one, two, other = "a b c d e f g h i j k l", "m n o p q r s t u v w x", "nothing like the others here at all in this text"
    rows = [(1, one), (1, two), (1, two), (2, two), (None, one.upper()), (None, other), (None, other), (3, None), (3, ""), (4, one), (4, one)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, k string")
    got = jaccard_join.jaccard_classes(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(1, 8, 1), (1, 8, 1), (1, 8, 1), (2, 8, 1), (None, 8, 1), (None, 6, None), (None, 6, None), (3, 0, 3), (3, 0, 3), (4, 8, 1), (4, 8, 1)])
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(1, one, "z"), (1, two, "z"), (None, other, "z"), (3, None, "z"), (3, "", "z")])


def test_equal_halves_of_fingerprints(spark):
    """Two texts whose fingerprints share their first half stay two nodes."""
    rows = [(1, 7, 1, 3), (2, 7, 1, 3), (3, 7, 2, 4), (4, 8, 1, 5)]
    nodes = {r["doc_id"]: r["node"] for r in jaccard_join.with_nodes(spark.createDataFrame(rows, "doc_id long, one long, two long, n_shingles long")).collect()}
    assert nodes[1] == nodes[2] and len(set(nodes.values())) == 3


def test_pigeonhole():
    """Similar sets always share a chosen cell, and a rare one if both are distinct."""
    r, seen = np.random.default_rng(6), 0
    for _ in range(600):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b, share = a, r.random()
        for _ in range(4):
            drop = r.random(len(b)) < r.random() * 0.15
            more = r.integers(0, 2**63, int(r.integers(0, len(a) // 8 + 1))).astype(np.uint64)
            b = np.unique(np.append(b[~drop], more))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                common = a[r.random(len(a)) < share]
                x, y = (jaccard_join.chosen_cells(s, common, 80) for s in (a, b))
                apart = x[2] and y[2]
                seen += apart
                assert set(x[0].tolist()) & set(y[0].tolist()) or not apart and set(x[1].tolist()) & set(y[1].tolist())
                far = jaccard_join.distances([jaccard_join.dense_sketch(a)], [jaccard_join.dense_sketch(b)])[0]
                assert far <= len(a) + len(b) - 2 * both
    assert seen > 20


def test_folded_sketches():
    found = [np.unique(np.random.default_rng(k).integers(0, 2**63, n).astype(np.uint64)) for k, n in ((1, 900), (2, 1300))]
    narrow, wide = (jaccard_join.dense_sketch(x) for x in found)
    assert len(wide) == 2 * len(narrow)
    bits = np.bincount((words.mixed(found[1] + np.uint64(11)) % np.uint64(8 * len(narrow))).astype(int), minlength=8 * len(narrow)) & 1
    assert jaccard_join.folded([wide], len(narrow)).tobytes() == np.packbits(bits.astype(np.uint8)).tobytes()


def test_classes_of_links(spark):
    r = random.Random(7)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for link in links for x in link}
    for _ in range(50):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in jaccard_join.classes(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(k == v or k in got for k, v in root.items())


# 4: benchmark decontamination


def hits_by_hand(texts, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(LETTER_WORDS, (t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = {}
    for i, t in texts.items():
        w = re.findall(LETTER_WORDS, (t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if its := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= its
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination(spark, docs, monkeypatch):
    texts = texts_of(docs)
    parts = lambda i, a, b: " ".join((texts[i] or "").split()[a:b])
    long = next(i for i, t in texts.items() if t and len(t.split()) > 60)
    items = [(1, parts(long, 10, 40)), (2, "one"), (3, "One, TWO"), (4, None), (5, " ,;"), (6, parts(long, 10, 40)), (7, "a b a b a b a b a b a b a b a b"), (None, parts(long, 30, 55)), (8, "nowhere at all")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = hits_by_hand(texts, items)
    for most in (1 << 20, 150):  # at once, and in blocks
        monkeypatch.setattr(decontaminate, "MOST_TEST_BYTES", most)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in decontaminate.contamination(clashing(docs), tests).collect()}
        assert got == want
    monkeypatch.undo()
    assert decontaminate.contamination(docs.limit(0), tests).count() == 0
    assert decontaminate.contamination(docs, tests.limit(0)).where("n_hit > 0").count() == 0


def test_index_and_proximity(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the mat, the cat"), (3, None)]
    index = decontaminate.positional_index(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["word"], r["doc_id"]): r["positions"] for r in index.collect()}[("the", 1)] == [0, 4]
    phrases = spark.createDataFrame([("p", ["cat", "mat"]), ("q", ["sat", "dog"])], "phrase_id string, words array<string>")
    got = lambda n: {(r["phrase_id"], r["doc_id"]) for r in decontaminate.proximity_matches(index, phrases, n).collect()}
    assert got(2) == {("p", 2)} and got(4) == {("p", 1), ("p", 2)}


def test_proximity_of_null_and_repeated_ids(spark):
    """Rows that share an id or have none aren't merged, and a repeated row doesn't lose its match."""
    rows = [(1, "red x blue"), (1, "red only"), (1, "blue only"), (None, "red here"), (None, "blue here"), (2, "blue red"), (2, "blue red")]
    index = decontaminate.positional_index(spark.createDataFrame(rows, "doc_id long, text string"))
    phrases = spark.createDataFrame([(7, ["red", "blue"])], "phrase_id int, words array<string>")
    got = decontaminate.proximity_matches(index, phrases, 2).select("doc_id", "position").collect()
    assert sorted(map(tuple, got)) in ([(1, 0), (2, 0)], [(1, 0), (2, 1)], [(1, 2), (2, 0)], [(1, 2), (2, 1)])


# 5: line dedup


@pytest.mark.parametrize("most", [0, 200_000])
def test_line_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_LINES", most)
    rows = [(k, f"header\n\nown {k}\nheader\nfooter {k % 40}", "a") for k in range(60)] + [(100, "header\nx", "b"), (101, None, "a"), (102, "", "a"), (103, "header", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.lit("clash"))
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup.without_boilerplate(df, ratio=0.1, least=5).collect()}
    assert all(got[k] == (f"\nown {k}\nfooter {k % 40}", 2) for k in range(60))
    assert got[100] == ("header\nx", 0) and got[101] == (None, 0) and got[102] == ("", 0) and got[103] == ("header", 0)
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0
    # null and repeated ids: each row is judged by its own site and text; clashing columns stay
    rows = [(None, f"header\nown {k}", "a", 7) for k in range(20)] + [(5, "header\nb only", "b", 7), (5, "header\na too", "a", 7), (5, "header\na too", "a", 7)]
    found = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, x long").withColumn("dropped", F.lit("clash")))
    assert found.columns == ["doc_id", "text", "source", "x", "dropped", "n_dropped"]
    want = [(None, f"own {k}", 1) for k in range(20)] + [(5, "header\nb only", 0), (5, "a too", 1), (5, "a too", 1)]
    assert Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in found.collect()) == Counter(want)


# 6: WARC


def test_warc(spark):
    html = [None, "", "é\r\n\r\nx", "same", "same", "z" * 3_000_000, *[f"<p>{k} some page text that repeats itself</p>" * 20 for k in range(200)], "same"]
    rows = [(k, None if k % 3 == 0 else f"http://h/{k}\n", h) for k, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = shared.new_folder(spark, "archives")
    warc.write_archives(pages.repartition(3), path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    first = {}
    for k, h in enumerate(html):
        b = (h or "").encode()
        f = first.setdefault(b, k)
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r["record_type"], r["refers_to"], r["payload"]) == (("response", None, b) if f == k else ("revisit", f, None))
    assert len(got) == len(html)
    path = shared.new_folder(spark, "archives")
    warc.write_archives(pages.where("page_id in (3, 4)"), path, least=5)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}
    path = shared.new_folder(spark, "archives")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archive_frames(spark):
    """Each file leads with a skippable frame that holds the dictionary; each record can be read alone from its offset, and
    the whole file by a plain reader; files are bounded in payload bytes."""
    import glob
    import struct

    import zstandard

    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k} é漢 text that repeats itself in every page</p>" * 30) for k in range(300)] + [(7, "http://h/again", "x")], "page_id long, url string, html string")
    path = shared.new_folder(spark, "archives")
    warc.write_archives(pages, path, file_bytes=100_000)
    files, seen = glob.glob(f"{path.removeprefix('file://')}/part-*"), []
    assert len(files) >= 5
    for file in files:
        blob = open(file, "rb").read()
        magic, size = struct.unpack_from("<II", blob)
        assert magic == warc.DICTIONARY_MAGIC and magic >> 4 == 0x184D2A5
        dictionary = zstandard.ZstdCompressionDict(blob[8 : 8 + size])
        at, offsets = 8 + size, []
        while at < len(blob):
            if blob[at : at + 8] == warc.EMPTY_FRAME.encode("latin-1"):
                at += 8
                continue
            unpacker = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            whole = unpacker.decompress(blob[at:])
            assert unpacker.eof and whole.startswith(warc.VERSION.encode())
            offsets.append((at, whole))
            at = len(blob) - len(unpacker.unused_data)
        for at, whole in offsets[::-7]:  # any record, without those before it
            assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(blob[at:]) == whole
        seen += [re.search(rb"WARC-Record-ID: <urn:page:(\d+)>", whole)[1] for _, whole in offsets]
    assert Counter(int(x) for x in seen) == Counter(r["page_id"] for r in pages.collect())
    again = warc.read_archives(spark, path).where("page_id = 7").collect()
    assert {r["record_type"] for r in again} == {"response"} and len(again) == 2


# 7: sharding


def test_sharding(spark, docs):
    copies = spark.range(3000).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same text").alias("text"))
    rows = docs.select("doc_id", "text").union(copies).union(docs.select("doc_id", "text").limit(3))
    got = sharding.assigned(clashing(rows), 6).collect()
    assert len(got) == rows.count()
    texts = texts_of(rows)
    largest = max(len((t or "").encode()) for t in texts.values()) + 8
    by = defaultdict(list)
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 8, zlib.crc32(b))
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in by[k]) for k in range(6)]
    assert max(sizes) - min(sizes) <= 2 * largest
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    assert sharding.assigned(docs.limit(0), 6).count() == 0


def test_shards_of_equal_rows(spark):
    """Rows that are equal in id and text are divided, and written once each, with all columns."""
    same = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("equal").alias("text"), F.lit("z").alias("row"))
    some = spark.createDataFrame([(None, None, "a"), (None, "b c", "b"), (1, "", "c")], "doc_id long, text string, row string")
    rows = same.union(some)
    got = sharding.assigned(rows, 4)
    assert {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()}.keys() == {0, 1, 2, 3}
    sizes = [r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 2 * 13
    path = shared.new_folder(spark, "shards")
    sharding.write_shards(rows, path, 4)
    back = spark.read.parquet(path)
    assert Counter(map(tuple, back.select("doc_id", "text", "row").collect())) == Counter(map(tuple, rows.collect()))
    for r in back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d")).collect():
        assert r["n"] == r["d"] == r["last"] + 1


# 8: quality classifier


def test_cotraining(spark):
    r = random.Random(8)
    rows = [(k, prose(r, 50) if k % 3 else "#" + "%%% ".join(prose(r, 50).split(" ")), "good" if k % 3 else "bad", int(k % 3 > 0)) for k in range(900)]
    df = spark.createDataFrame([*rows, (9000, None, None, None), (9001, "", "good", None)], "doc_id long, text string, source string, quality int").withColumn("n_chars", F.length("text")).withColumn("y", F.lit("clash"))
    labels = df.where("doc_id % 2 = 0 and quality is not null").select("doc_id", "quality")
    got = cotraining.score_quality(df, labels, ("source", "n_chars")).join(df.select("doc_id", "quality"), "doc_id")
    held = got.where("doc_id % 2 = 1 and quality is not null")
    assert held.where("kept = (quality = 1)").count() >= 0.98 * held.count() and got.count() == 902
    none = cotraining.score_quality(df, labels.limit(0), ("source", "n_chars"))
    assert none.where("kept and score = 1").count() == 902
    assert cotraining.score_quality(df.limit(0), labels, ("source", "n_chars")).count() == 0
    again = cotraining.score_quality(df.union(df.where("doc_id < 50")).repartition(7), labels, ("source", "n_chars"))
    assert again.count() == 952 and again.distinct().count() == 902


def test_slopes_are_those_of_all_documents():
    """Sums by blocks are the sums by hand, and cuts are right in the share asked for."""
    r = np.random.default_rng(3)
    views = [r.random((500, 6), np.float32), r.random((500, 3), np.float32)]
    judges, learners = ([r.standard_normal(x.shape[1] + 1).astype(np.float32) for x in views] for _ in range(2))
    lesson = cotraining.Lesson(judges, [(-0.2, 0.3), (-0.1, 0.4)], learners)
    slopes = cotraining.Slopes(lesson)
    for at in range(0, 500, 77):
        slopes.add([x[at : at + 77] for x in views])
    for k in (0, 1):
        z, (low, high) = views[1 - k] @ judges[1 - k][:-1] + judges[1 - k][-1], lesson.sure[1 - k]
        for label, rows in ((0, z <= low), (1, z >= high)):
            wrong = 1 / (1 + np.exp(-(views[k][rows] @ learners[k][:-1] + learners[k][-1]))) - label
            assert slopes.count[k][label] == rows.sum()
            assert np.allclose(slopes.total[k][label] / cotraining.UNIT, np.append(wrong @ views[k][rows], wrong.sum()), atol=1e-3)
    z, y = r.standard_normal(400), r.random(400)
    y = (y < 1 / (1 + np.exp(-4 * z))).astype(np.float32)
    low, high = cotraining.sure_from(z, y)
    assert low < 0 < high and (y[z <= low] == 0).mean() >= 0.95 and (y[z >= high] > 0).mean() >= 0.95
    assert cotraining.sure_from(z, 1 - y)[0] == -np.inf


def test_steps_go_down():
    """Newton steps with another set's slope come to the weights that are best for both sets."""
    r = np.random.default_rng(4)
    x, more = r.standard_normal((400, 5)).astype(np.float32), r.standard_normal((900, 5)).astype(np.float32)
    w0 = np.array([2, -1, 0.5, 0, 1])
    y, label = ((v @ w0 + r.standard_normal(len(v)) > 0).astype(np.float32) for v in (x, more))
    wide = np.concatenate([more, np.ones((900, 1))], 1)
    w = cotraining.fitted(x, y)
    for _ in range(25):
        w = cotraining.newton_step(x, y, w, wide.T @ (1 / (1 + np.exp(-wide @ w)) - label) / 900, (more, np.full(900, 1 / 900)))
    want = cotraining.fitted(np.concatenate([x, more]), np.concatenate([y, label]), np.concatenate([np.full(400, 1 / 400), np.full(900, 1 / 900)]), steps=4000)
    assert w == pytest.approx(want, abs=0.05)


def test_views_teach_each_other(spark):
    """Bad texts of a kind that no label shows are found, as their source is known as bad."""
    r = random.Random(9)
    rows = []
    for k in range(1600):
        kind = k % 4
        text = prose(r, 40) if kind > 1 else "".join(r.choice("0123456789:;") for _ in range(200)) if kind else " ".join("%%$$##"[r.randrange(5) :] for _ in range(60))
        rows.append((k, text, "good" if kind > 1 else "bad", int(kind > 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int").withColumn("n_chars", F.lit(100))
    labels = df.where("doc_id < 800 and doc_id % 4 <> 1").select("doc_id", "quality")
    score = lambda: cotraining.score_quality(df, labels, ("source", "n_chars")).where("doc_id % 4 = 1").agg(F.avg((F.col("text_score") < 0.5).cast("int"))).first()[0]
    assert score() > 0.95


# 9: token files


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path, model = shared.new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    extra = spark.createDataFrame([(5000, "It's <|endoftext|> a.b,C 12½ <|ENDOFTEXT|> Σας ﬁ"), (5001, "don't.stop!now é̈")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    token_files.write_token_files(clashing(rows), model, path)
    got = {r["doc_id"]: r for r in token_files.with_starts(token_files.document_sums(spark, path)).collect()}
    stored = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, path).collect()}
    library, start = Tokenizer.from_file(model), 0
    for i, t in sorted(texts_of(rows).items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert stored[i] == ids
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"] for r in token_files.read_token_files(spark, path, ("doc_id",), 3, 5).collect()} == {3, 4, 5}
    path = shared.new_folder(spark, "tokens")
    token_files.write_token_files(rows.limit(0), model, path)
    assert token_files.with_starts(token_files.document_sums(spark, path)).count() == 0


def test_token_files_of_repeated_and_null_ids(spark, monkeypatch):
    """Rows of one id or none lie in several files; starts follow one another all the same."""
    monkeypatch.setattr(token_files, "FILE_BYTES", 300)
    rows = [(i, f"text {k} of id {i}") for k in range(40) for i in (None, 3, 3, k)]
    path = shared.new_folder(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), path)
    found = token_files.with_starts(token_files.document_sums(spark, path)).collect()
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in found)
    assert len({r["file"] for r in found}) > 4 and len(got) == len(rows)
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, n, _ in got])[:-1].tolist()] and [i for *_, i in got] == sorted(i for *_, i in got)


def test_token_files_by_another_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    model = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.by_words(public_tokenizers.path("word_bpe_49k.json")) and not token_files.by_words(model)
    path, library = shared.new_folder(spark, "tokens"), Tokenizer.from_file(model)
    token_files.write_token_files(docs, model, path)
    stored = {r["doc_id"]: r["ids"] for r in token_files.read_token_files(spark, path).collect()}
    assert stored == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts_of(docs).items()}


# 10: SentencePiece


def test_pieces(spark, docs):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(9)
    odd = ["".join(r.choice("aebtTh  ▁\n\t'éß漢😀\x00<s>in 01") for _ in range(r.randrange(60))) for _ in range(300)] + [" " * 400 + "x", "ABCabc" * 200, "a" * 5000]
    # words of any length merge in rounds
    odd += ["".join(r.choice(letters) for _ in range(n)) for letters in ("a", "anan ", "=-", "eth", "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for n in (191, 193, 700, 4000)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, 5000)), "doc_id long, text string"))
    coded = piece_tokens.with_piece_ids(clashing(rows), model)
    for row in piece_tokens.with_decoded(coded.select("doc_id", "text", "ids"), model).collect():
        want = library.encode(row["text"] or "")
        assert row["ids"] == want and row["decoded"] == library.decode(want)
    broken = spark.createDataFrame([(1, [3 + 0xC3, 300]), (2, None), (3, [1, 2, 0])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in piece_tokens.with_decoded(broken, model).collect()}
    assert got == {1: library.decode([3 + 0xC3, 300]), 2: "", 3: library.decode([1, 2, 0])}
    assert piece_tokens.with_piece_ids(rows.limit(0), model).count() == 0


def test_piece_ids_take_bounded_memory():
    """What a task needs for a batch of many new words stays far below what merge rounds over the whole batch take; the model comes by broadcast."""
    import tracemalloc
    from types import SimpleNamespace

    import public_tokenizers
    import sentencepiece
    from pyspark.sql import types as T

    sent = []
    context = SimpleNamespace(broadcast=lambda model: sent.append(model) or SimpleNamespace(value=model))
    docs = SimpleNamespace(columns=["text"], schema=T.StructType([T.StructField("text", T.StringType())]), sparkSession=SimpleNamespace(sparkContext=context))
    docs.select, docs.mapInArrow = lambda *c: docs, lambda run, schema: run
    path = public_tokenizers.path("piece_bpe_32k.model")
    run = piece_tokens.with_piece_ids(docs, path)
    letters = np.random.default_rng(0).integers(97, 123, (1000, 4000), dtype=np.uint8)
    letters[:, ::9] = 32
    texts = [x.tobytes().decode() for x in letters]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 1000 and peak < 120, peak
    assert len(sent) == 1
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [x for part in run(iter([batch.slice(0, 20)])) for x in part.column(1).to_pylist()]
    assert ids == [library.encode(x) for x in texts[:20]]
