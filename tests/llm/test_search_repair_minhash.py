"""Ranked search, conversation repair and MinHash near-dedup against brute-force versions, on awkward tables: nulls, empty and very
long texts, ties, repeated rows, no rows, clashing columns, and groups of any size."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumachron.llm import conversations, minhash, queries, ranked_search
from test_operators import LETTER_WORDS, LOWER, classes_by_hand, clashing, corpus, prose


# ranked search


def ranking_by_hand(docs, items, k=10):
    """Counter of (item_id, rank, doc_id, score); docs and items are rows."""
    terms = lambda t: re.findall(LETTER_WORDS, (t or "").translate(LOWER))
    rows = [(i, Counter(w)) for i, t in docs if (w := terms(t))]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in rows:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out.update((item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1))
    return out


@pytest.mark.parametrize("shard", [40, 100_000])
def test_ranked_search(spark, monkeypatch, shard):
    """In one shard or many, in one block of items or several."""
    monkeypatch.setattr(ranked_search, "POSTINGS_A_SHARD", shard)
    monkeypatch.setattr(ranked_search, "MOST_ITEM_BYTES", 500 if shard == 40 else 1 << 20)
    r = random.Random(2)
    docs = corpus(3, 60) + [(None, "ta ri mo"), (None, "ta ri mo"), (5, "ta ri mo"), (5, "É é ta")]
    items = [(k, prose(r, 25)) for k in range(8)] + [(8, "ta"), (9, "nowhere"), (10, None), (11, ""), (None, "ri mo"), (3, "É"), (12, docs[3][1])]
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    found = ranked_search.ranked(table, clashing(spark.createDataFrame(items, "item_id long, text string")), 10).collect()
    assert Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found) == ranking_by_hand(docs, items)


def test_sequential_reads_end_when_intervals_are_closed():
    """Equal to sorting all scores, whatever the first depth, with ties; and a list with one great impact isn't read to its end."""
    r = np.random.default_rng(5)
    for trial in range(200):
        n, lists = int(r.integers(1, 60)), []
        for _ in range(int(r.integers(0, 6))):
            docs = r.permutation(n)[: int(r.integers(1, n + 1))]
            lists.append((docs, np.sort(r.integers(1, 6 if trial % 2 else 1000, len(docs)))[::-1].astype(float)))
        total = np.zeros(n)
        for docs, x in lists:
            total[docs] += x
        want = [d for d in np.lexsort((np.arange(n), -total)).tolist() if total[d] > 0][:10]
        top, score, _ = ranked_search.best_of(lists, n, 10, int(r.integers(1, 8)))
        assert top.tolist() == want and score.tolist() == total[want].astype(int).tolist()
    many = np.arange(5000)
    top, _, entries = ranked_search.best_of([(many, np.concatenate((np.arange(1000, 980, -1), np.ones(4980))))], 5000, 10, 16)
    assert top.tolist() == list(range(10)) and entries < 100


# conversation repair

AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMED = {"u": "user", "a": "assistant"}


def repair_by_hand(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of damaged rows (turn, role, text), all audits as strings."""
    seen, flags, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        wordy = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 0 if not wordy else 1 if (role, text) in seen else 2 if wordy[-1] not in ".!?" else None
        seen.add((role, text))
        flags.append(fault)
        if fault is not None:
            n[fault] += 1

    def put(states, state, found):
        if state not in states or found[:2] < states[state][:2]:
            states[state] = found

    def inserts(states):
        found = dict(states)
        for _ in range(3):
            for state, (cost, audit, out) in list(found.items()):
                put(found, AFTER[state], (cost + 2, audit + "I", (*out, NAMED[AFTER[state]] + ":")))
        return found

    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, flags):
        new = {}
        for state, (cost, audit, out) in inserts(states).items():
            put(new, state, (cost + 3, audit + "D", out))
            if fault not in (0, 1):
                more = int(fault == 2)
                if role[:1] == AFTER[state] or (state == "" and role[:1] == "s"):
                    put(new, role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}")))
                put(new, AFTER[state], (cost + 2 + more, audit + "R", (*out, f"{NAMED[AFTER[state]]}:{text}")))
        states = new
    ends = inserts(states)
    cost, audit, out = min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def text_hash(text):
    x = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return x - (1 << 64) if x >> 63 else x


def reports_by_hand(rows):
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        own = damaged[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: repair_by_hand(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1], text_hash(x[2])))) for c, own in damaged.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def awkward_conversations():
    r = random.Random(7)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "tool", ""], ["a.", "b", "", "c!", "d", None, " x? ", "é.\n", "long " * 3000]
    rows = [(None if c == 3 else c, None if r.random() < 0.1 else r.randrange(60), r.choice(roles), r.choice(texts)) for c, n in ((1, 150), (2, 5), (3, 60), (4, 300), (5, 1), (6, 1), (7, 40)) for _ in range(n)]
    return rows + rows[:6] + [(8, None, "user", "q?")] * 30 + [(9, t, ["user", "assistant"][t % 2], f"fine {t}.") for t in range(20)]


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_conversation_repair(spark, monkeypatch, most):
    """The same whether a conversation is one piece or as many as it has rows."""
    monkeypatch.setattr(conversations, "ROWS_A_RANGE", 37)
    rows = awkward_conversations()
    given = clashing(spark.createDataFrame(rows, KIND)).repartition(4)
    found = conversations.repair_report(given, conversations.damaged(given), most).collect()
    assert {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in found} == reports_by_hand(rows)


def flagged(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append((role[:1], text == "" or (role, text) in seen, text in ("b", "d")))
        seen.add((role, text))
    return out


def test_audits_and_their_pieces():
    r = random.Random(3)
    for _ in range(1500):
        rows = [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b", "", "c!", "d"])) for _ in range(r.randrange(9))]
        want = repair_by_hand([(None, *x) for x in rows])[5:7]
        flags = flagged(rows)
        assert conversations.repaired_whole(flags) == want
        cuts = sorted({0, len(flags), *(r.randrange(len(flags) + 1) for _ in range(3))})
        pieces = [conversations.transfers(flags[a:b]) for a, b in zip(cuts, cuts[1:])]
        cost, chain, tail = conversations.composed(pieces)
        audit = "".join(next(w["audit"] for w in p if (w["start"], w["end"]) == ends) for p, ends in zip(pieces, chain)) + tail
        assert (cost, audit) == want


@pytest.mark.parametrize("prime", [conversations.PRIME, 7])
def test_ties_by_common_prefixes(monkeypatch, prime):
    """Order of linked strings is that of the strings, also where rolling hashes collide all the time."""
    monkeypatch.setattr(conversations, "PRIME", prime)
    audits, r, nodes = conversations.Audits(), random.Random(4), [0]
    for _ in range(600):
        nodes.append(audits.add(r.choice(nodes), r.choice("DIKR")))
    for _ in range(4000):
        a, b = r.choice(nodes), r.choice(nodes)
        if a != b:
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_repaired_rows(spark):
    """Real output: turns in order, inserted ones empty, deleted ones marked."""
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "B?"), (1, 3, "assistant", "C."), (1, 4, "user", "B?")]
    got = [tuple(x) for x in conversations.repaired(spark.createDataFrame(rows, KIND)).collect()]
    assert got == [(1, "K", 0, "system", "S."), (1, "I", None, "user", ""), (1, "K", 1, "assistant", "A."), (1, "K", 2, "user", "B?"), (1, "K", 3, "assistant", "C."), (1, "D", 4, "user", "B?")]
    assert conversations.repaired(spark.createDataFrame([], KIND)).count() == 0


# MinHash near-dedup


def minhash_rows(df):
    return Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in df.collect())


def classes_of_rows(docs, size, percent):
    classes = classes_by_hand(dict(enumerate(t for _, t in docs)), size, percent)
    least = defaultdict(list)
    for k, (_, root) in classes.items():
        least[root] += [docs[k][0]] if docs[k][0] is not None else []
    return Counter((docs[k][0], n, min(least[root], default=None) if n else docs[k][0]) for k, (n, root) in classes.items())


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash_classes(spark, size, percent):
    docs = corpus(6, 70)
    docs += [(None, docs[0][1]), (None, None), (3, docs[5][1]), (3, docs[5][1]), (None, "alone here now and then")]
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    assert minhash_rows(minhash.minhash_classes(table, size, percent)) == classes_of_rows(docs, size, percent)


def near_copies(seed, groups, members, edits):
    """Groups of texts, each text with some words of its group's base changed; chains, where copies are copied."""
    r, out = random.Random(seed), []
    for g in range(groups):
        base = prose(r, 90).split(" ")
        for m in range(members):
            words = (out[-1][1].split(" ") if m and r.random() < 0.3 else base)[:]
            for _ in range(r.randrange(edits + 1)):
                words[r.randrange(len(words))] = f"w{g}x{r.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_classes_of_near_copies(spark, monkeypatch, block):
    """Members of a bucket that don't link with its pivot still find each other, in blocks or packed with other families."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    monkeypatch.setattr(minhash, "SMALL", 20 if block == 7 else 512)
    monkeypatch.setattr(minhash, "PACKED", 50)
    docs = near_copies(8, 5, 60, 7)
    want = classes_of_rows(docs, 3, 85)
    assert 10 < len({c for _, _, c in want}) < len(docs) - 20
    assert minhash_rows(minhash.minhash_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 3, 85)) == want


def test_minima_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 30_000, np.uint64)
    a, b = minhash.minima(pool[:20_000]), minhash.minima(pool[5_000:25_000])
    assert (a == b).mean() == pytest.approx(0.6, abs=0.15)
    assert (minhash.minima(pool[:20_000][::-1]) == a).all() and (minhash.bands_of(a) == minhash.bands_of(a.copy())).all()
    pairs = [(s := r.permutation(pool)[:2200], minhash.minima(s[:2000]), minhash.minima(s[160:2160])) for _ in range(200)]  # similarity 0.852
    assert all((x.astype(np.uint8) == y.astype(np.uint8)).sum() >= minhash.fewest_equal(85) for _, x, y in pairs)
    assert all((minhash.bands_of(x) == minhash.bands_of(y)).any() for _, x, y in pairs)
    assert (1 - 0.85**minhash.BAND_ROWS) ** minhash.BANDS < 1e-12


# the registered queries


def test_queries(spark, tmp_path):
    docs, items = corpus(9, 40), [(k, prose(random.Random(k), 20)) for k in range(5)]
    docs += [(None, docs[1][1]), (2, docs[3][1])]
    for name, rows, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string"), ("conversations", awkward_conversations(), KIND)):
        clashing(spark.createDataFrame(rows, kind)).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    found = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert Counter((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found("op11_ranked_search")) == ranking_by_hand(docs, items)
    assert {x["conv_id"]: tuple(x[c] for c in COLUMNS) for x in found("op12_conversation_repair")} == reports_by_hand(awkward_conversations())
    rows = found("op13_minhash_dedup")
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows) == classes_of_rows(docs, 3, 85)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in rows)
