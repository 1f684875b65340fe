"""A benchmark that is searched in blocks gives each document row the result that one block gives it."""

from lumachron.llm import decontaminate


def test_rows_with_one_id_or_none_stay_apart(spark, monkeypatch):
    say = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    docs = spark.createDataFrame([(1, say(1)), (1, say(2) + " and more"), (1, say(1)), (None, "no match"), (None, "none here either at all"), (None, say(4)), (2, say(3))], "doc_id long, text string")
    tests = spark.createDataFrame([(str(k), say(k)) for k in range(6)], "item_id string, text string")

    def found():
        rows = decontaminate.benchmark_matches(docs, tests).collect()
        return sorted((str(r["doc_id"]), r["n_words"], sorted((x["item_id"], x["start"], x["length"]) for x in r["spans"])) for r in rows)

    whole = found()
    assert len(whole) == 7 and [x for x in whole if x[0] == "None" and x[2]] == [("None", 20, [("4", 0, 20)])]
    monkeypatch.setattr(decontaminate, "MOST_TEST_BYTES", 200)
    assert found() == whole
