"""Learned abbreviations (G2), subword counts (G4) and the hooks of sentence chunking."""

import random

from pyspark.sql import functions as F

from quarry.operators import chunking, sentences, subwords

TRAINING = (
    ["We met Dr. Ames and Prof. Bell at noon. They sat down.", "See e.g. the old mill. It is here.", "Fruit, e.g. apples, is sold by Mr. Cole. He is nice.",
     "Dr. Dunn came in. She saw the mill.", "The mill is old. We sat at noon.", "Prof. Earl said it. Mr. Cole came."] * 6
    + ["They sat at the mill and she came in.", "It is nice down here.", "He said noon.", "At noon he sat in here by the old and nice mill, down there."] * 8
)


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _split(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["sent_pos"])):
        out.setdefault(r["doc_id"], []).append(r["sentence"])
    return out


def test_abbreviations_are_learned_and_kept_together_in_held_out_texts(spark):
    types = sentences.learn_abbreviations(_docs(spark, TRAINING))
    found = {r["type"] for r in types.collect()}
    assert {"dr", "prof", "mr", "e.g"} <= found and not found & {"mill", "noon", "down", "in", "here", "nice"}
    texts = ["Ask Dr. Gray today. Use e.g. (e.g. twice)  a pen!  Why?\tBecause Prof. Hill\nsaid so. ", "The end is noon. Next", "", None, "Mr. ", "x\u0001y. Z", " . ! "]
    want = {
        0: ["Ask Dr. Gray today.", "Use e.g. (e.g. twice)  a pen!", "Why?", "Because Prof. Hill\nsaid so."],
        1: ["The end is noon.", "Next"], 4: ["Mr."], 5: ["x\u0001y.", "Z"], 6: [".", "!"],
    }
    docs = _docs(spark, texts)
    assert _split(sentences.split_sentences_learned(docs, types)) == want
    assert _split(sentences.split_sentences_learned(docs, types, listed=1)) == want  # by joins
    none = types.where("score < 0")
    plain = _split(sentences.split_sentences_learned(docs, none))
    assert plain == _split(chunking.explode_sentences(docs))
    assert sentences.abbreviation_types(docs.where("doc_id < 0")).count() == 0


def test_hooks_of_sentence_chunks(spark):
    docs = _docs(spark, ["Ask Dr. Gray now. Then go home."])

    def chunks(**hooks):
        return [r["chunk_text"] for r in chunking.chunk_sentences(docs, **hooks).orderBy("chunk_pos").collect()]

    assert chunks(limit=1) == ["Ask Dr.", "Gray now.", "Then go home."]
    assert chunks(limit=1, splitter=sentences.abbreviation_splitter(["Dr"])) == ["Ask Dr. Gray now.", "Then go home."]
    assert chunks(limit=20, counter=lambda s: F.length(s)) == ["Ask Dr. Gray now.", "Then go home."]
    pieces = ["Ask", "Dr", "##.", "Gray", "now", "Then", "go", "home"]
    split = sentences.abbreviation_splitter(["Dr"])
    assert chunks(limit=10, splitter=split, measure=subwords.subword_counter(spark, pieces)) == ["Ask Dr. Gray now. Then go home."]
    assert chunks(limit=9, splitter=split, measure=subwords.subword_counter(spark, pieces)) == ["Ask Dr. Gray now.", "Then go home."]


def _brute(text, pieces, limit=512):
    total = 0
    for word in (text or "").split():
        at, n = 0, 0
        while at < len(word) <= subwords.LONGEST_WORD:
            ends = [e for e in range(at + 1, len(word) + 1) if (("##" if at else "") + word[at:e]) in pieces]
            if not ends:
                break
            at, n = max(ends), n + 1
        total += n if at == len(word) else 1
    return min(limit, total)


def test_subword_counts_equal_a_brute_force(spark):
    rng = random.Random(3)
    letters = "abé中"
    pieces = {("##" if rng.random() < 0.6 else "") + "".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(40)}
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "  \n", "a" * 5000, "ab " * 3000, "## #"]
    got = subwords.count_subwords(_docs(spark, texts), pieces).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: _brute(t, pieces) for i, t in enumerate(texts)}
    assert subwords.count_subwords(_docs(spark, texts), pieces, limit=7).agg(F.max("n_tokens")).first()[0] == 7


def test_arrow_steps_equal_the_column_functions(spark):
    """Chunks and learned sentences from the Arrow step are those of the column functions; words are counted once for each spelling."""
    from quarry.functions import text as T

    rng = random.Random(11)
    marks = ["a", "Dr", "e.g", "x3", "Ä.b", ".", "!", "?", " ", "  ", "\n", "　", "\x1c", "\x85", "(", "Prof", "\U0001f600", "​"]
    docs = _docs(spark, ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(400)] + [None, "", " . ", ". a. "])
    for limit in (1, 3, 512):
        fast = chunking.chunk_sentences(docs, limit=limit)
        slow = chunking.chunk_sentences(docs, limit=limit, counter=lambda s: F.size(T.usplit_words(s)))  # by the column functions
        assert fast.schema.simpleString() == slow.schema.simpleString()
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    types = spark.createDataFrame([("dr",), ("e.g",), ("prof",), ("ä.b",)], "type string")
    fast, slow = (sentences.split_sentences_learned(docs, types, listed=n) for n in (10, 1))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    counted = {r["t"]: r["n"] for r in sentences.word_counts(docs).collect()}
    words = [w for r in docs.collect() for w in (r["text"] or "").split()]
    assert counted == {w: words.count(w) for w in set(words)}
    plan = sentences.word_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    assert [r[0] for r in docs.select(T.ustrip("text")).collect()] == [None if r["text"] is None else r["text"].strip() for r in docs.collect()]
