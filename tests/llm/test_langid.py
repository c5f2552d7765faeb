from quarry.llm.langid import language_id

import messy

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_awkward_rows(spark):
    out = language_id(messy.table(spark)).collect()
    assert len(out) == len(messy.rows())
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert und == {9, 10, 11, 15, 20, None}  # null, empty, white space, no letter; of the null ids one has no text
    assert {r["lang_pred"] for r in out} <= {"und", "en", "fr", "de"}


def test_nothing_to_learn(spark):
    data = [(1, "abc", None, None, 3, "", 0, "", "")]
    assert [(r["lang_pred"], r["score"]) for r in language_id(messy.table(spark, data)).collect()] == [("und", 0.0)]
    assert language_id(messy.table(spark, [])).count() == 0
