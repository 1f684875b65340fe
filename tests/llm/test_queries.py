"""The registered queries themselves against brute-force versions, on tables with null and repeated ids, repeated rows,
empty and long texts, and columns named like those that operators make; and on empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumachron.llm import queries
from test_operators import BLANK_WORDS, LOWER, classes_by_hand, counts_by_hand, hits_by_hand, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHES = ("node", "cell", "row", "x", "y", "words", "ids", "level", "site", "dropped", "k", "u", "verdict", "digest", "first")
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables():
    r = random.Random(21)
    items = [(k, prose(r, 20)) for k in range(5)] + [(5, "two words"), (6, None), (None, prose(r, 15)), (7, ""), (0, prose(r, 18))]
    texts = [prose(r, r.randrange(12, 90)) for _ in range(60)]
    for k in range(0, 60, 6):
        near = texts[k].split(" ")
        near[-1] = "Changed"
        texts += [texts[k].upper(), " ".join(near), f"{texts[k + 1]} {items[k % 5][1]}", f"menu line\n{texts[k + 2]}\nmenu line"]
    texts += [f"menu line\n{texts[k]}\n\nmenu line" for k in range(0, 60, 2)]
    texts += [None, "", " \n", "one", "# a\nb\nb\n*|*", "a b c d e " * 40, "long " + prose(r, 4000), "y" * 5000, "Two  WORDS here", "It's <|endoftext|> 1½"]
    docs = [(None if k % 11 == 0 else k % 70, t, ["en", "fr", None][k % 3], f"src{k % 3}" if k % 5 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    docs += docs[:9] + [docs[-3]] * 3
    urls = [None, "none", "http://A.EXAMPLE.com/en/x?q", "http://www.example.com/en/", "http://ÄB.net/es/1", "x://c.net/fr/#f", "http://casino.org/p", "http://spam-farm.com", "ftp://d.org"]
    pages = [(None if k % 13 == 0 else k % 40, urls[k % len(urls)], [None, "", "same", f"<p>{k}</p> é"][k % 4] if k % 7 else "<b>large</b>" * 300) for k in range(90)]
    return {"documents": docs, "benchmark": items, "pages": pages}


KINDS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    for name, kind in KINDS.items():
        df = spark.createDataFrame(tables.get(name, []), kind)
        df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def found(spark, folder):
    cached = {}

    def rows(name):
        if name not in cached:
            cached[name] = queries.QUERIES[name](spark, folder).collect()
        return cached[name]

    return rows


def test_op1(found, tables):
    def judged(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(rule), rule, verdict) for rule, verdict in RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fits:
            return host, path, *max(fits)[1:]
        return host, path, None, "block" if set(host.split(".")) & {"spam-farm", "casino", "adult"} else "allow"

    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found("op1_url_filter"))
    assert got == Counter((i, *judged(u)) for i, u, _ in tables["pages"])


def test_op2(found, tables):
    want = Counter()
    for i, t, *_ in tables["documents"]:
        c = counts_by_hand(t)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in found("op2_quality_rules")) == want


def test_op3(found, tables):
    docs = tables["documents"]
    classes = classes_by_hand(dict(enumerate(t for _, t, *_ in docs)))
    least = defaultdict(list)
    for k, (_, root) in classes.items():
        least[root] += [docs[k][0]] if docs[k][0] is not None else []
    want = Counter((docs[k][0], n, min(least[root], default=None) if n else docs[k][0]) for k, (n, root) in classes.items())
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found("op3_jaccard_join")) == want


def test_op4(found, tables):
    docs = tables["documents"]
    hits = hits_by_hand(dict(enumerate(t for _, t, *_ in docs)), tables["benchmark"])
    want = Counter((docs[k][0], n, hit, len(ids), sha(",".join(ids)), bad) for k, (n, hit, ids, bad) in hits.items())
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found("op4_decontaminate")) == want
    assert any(k[0] is None and k[5] for k in want)


def test_op5(found, tables):
    docs = tables["documents"]
    site = lambda d: d[3] or ""
    wordy = lambda x: re.search(BLANK_WORDS, x)
    total, having = Counter(map(site, docs)), Counter()
    for d in docs:
        having.update((site(d), x) for x in set((d[1] or "").split("\n")) if wordy(x))
    often = {k for k, n in having.items() if n >= 5 and n > 0.1 * total[k[0]]}

    def cleaned(d):
        if d[1] is None:
            return None, 0
        lines = d[1].split("\n")
        kept = [x for x in lines if (site(d), x) not in often]
        return "\n".join(kept), len(lines) - len(kept)

    assert often and Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in found("op5_line_dedup")) == Counter((d[0], *cleaned(d)) for d in docs)


def test_op6(found, tables):
    first = {}
    for i, _, html in tables["pages"]:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = Counter()
    for i, _, html in tables["pages"]:
        b = (html or "").encode()
        least = first.get(html or "")
        refers = least if least is not None and i is not None and least != i else None
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", refers)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found("op6_warc")) == want


def test_op7(found, tables):
    rows, docs = found("op7_sharding"), tables["documents"]
    sizes = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, *sizes(t)) for i, t, *_ in docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)} and {r["shard"] for r in rows} <= set(range(24))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in by[k]) - total / 24) <= largest for k in range(24))


def test_op8(found, tables):
    """Without labels every row is kept."""
    assert Counter((r["doc_id"], r["score"], r["kept"]) for r in found("op8_cotraining")) == Counter((i, 1.0, True) for i, *_ in tables["documents"])


def test_op9(found, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in tables["documents"]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    rows = sorted(found("op9_token_files"), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)


def test_op10(found, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t, *_ in tables["documents"]:
        ids = library.encode(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found("op10_piece_tokens")) == want


def test_empty_tables(spark, tmp_path):
    for name, kind in KINDS.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
