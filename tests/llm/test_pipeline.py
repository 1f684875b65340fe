"""The pipeline on a small folder of tables, stage by stage, against brute-force versions."""

import pytest
from pyspark.sql import functions as F

from test_operators import classes_by_hand, counts_by_hand, hits_by_hand, prose, texts_of

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    r, at = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    items = [prose(r, 30) for _ in range(4)]
    rows = []
    for k in range(120):
        text = prose(r, r.randrange(30, 90))
        if k % 10 == 1:
            text = f"{text} {items[k % 4]}"
        if k % 10 == 2:
            text = rows[-2][1]
        if k % 10 == 3:
            text = " ".join([*rows[-3][1].split(" ")[:-1], "end"])
        if k % 10 == 4:
            text = "short text"
        if k % 3 == 0:
            text = f"site header\n{text}"
        rows.append((k, text, "en", "src0" if k % 2 else "src1", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "piece_tokens"]

    kept = stages["quality_rules"](spark, docs, folder).persist()
    bad = {i for i, t in texts_of(docs).items() if (c := counts_by_hand(t))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert kept.columns == columns and set(texts_of(kept)) == set(texts_of(docs)) - bad

    cleaned = stages["line_dedup"](spark, kept, folder).persist()
    before, after = texts_of(kept), texts_of(cleaned)
    assert cleaned.columns == columns and after == {i: "\n".join(x for x in t.split("\n") if x != "site header") for i, t in before.items()}
    assert cleaned.where(F.col("n_chars") != F.length("text")).count() == 0

    single = stages["jaccard_join"](spark, cleaned, folder).persist()
    want = {i for i, (_, root) in classes_by_hand(after).items() if root == i}
    assert single.columns == columns and set(texts_of(single)) == want and len(want) < len(after)

    clean = stages["decontamination"](spark, single, folder).persist()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = hits_by_hand(texts_of(single), items)
    assert clean.columns == columns and set(texts_of(clean)) == {i for i, h in hits.items() if not h[3]} and any(h[3] for h in hits.values())

    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    tokens = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in stages["piece_tokens"](spark, clean, folder).collect()}
    assert tokens == {i: (len(x := library.encode(t)), x) for i, t in texts_of(clean).items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in pipeline.run(spark, folder).collect()} == tokens


def test_learned_rules_and_awkward_tables(spark, tmp_path):
    """Labels that teach a rule; null and repeated ids, repeated rows and clashing columns; empty tables."""
    import random
    from collections import Counter

    r = random.Random(12)
    bad = lambda k: k % 4 == 0
    rows = [(k, " ".join(r.choice(["##", "%%", "$$$", "|*"]) + w for w in prose(r, 40).split()) if bad(k) else prose(r, 40), f"s{k % 7}") for k in range(480)]
    labels = [(k, 0 if bad(k) else 1, 0) for k in range(360)]
    twin = prose(r, 50)
    rows += [(None, prose(r, 30), "s1"), (None, prose(r, 30), "s2"), (7, prose(r, 30), "s1"), (None, twin, "s1"), (900, twin, "s2"), (901, twin, "s2"), (901, twin, "s2")]
    kind = "doc_id long, text string, source string"
    clash = {c: F.lit("clash") for c in ("n_words", "kept", "rule", "node", "row", "k", "x", "dropped", "contaminated", "c0", "words")}
    docs = spark.createDataFrame(rows, kind).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), **clash})
    tests = spark.createDataFrame([(1, "nothing of this is anywhere in the documents at all here now")], "item_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for folder, n in (("some", None), ("none", 0)):
        for name, df in (("documents", docs), ("benchmark", tests), ("labels", marks)):
            (df if n is None else df.limit(n)).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    got = Counter(x["doc_id"] for x in pipeline.run(spark, f"{tmp_path}/some").collect())
    want = Counter(k for k in range(480) if not bad(k)) + Counter([None, None, 7, 900])
    assert got == want
    kept = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/some").persist()
        assert kept.columns == docs.columns and kept.where("kept <> 'clash' or node <> 'clash' or x <> 'clash'").count() == 0
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
