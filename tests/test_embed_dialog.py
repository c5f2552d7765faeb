"""Embedder plug-in point and dialog operators."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import dialog, embed


def test_plugin_embedder(spark):
    def _char_model(texts):
        """Toy model: counts of 'a', 'b', 'c' (called once per Arrow batch)."""
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts.to_pylist()):
            t = t or ""
            out[i] = [t.count("a"), t.count("b"), t.count("c")]
        return out

    df = spark.createDataFrame([(1, "aab"), (2, "ccc"), (3, "")], "id long, t string")
    rows = {r.id: r.embedding for r in embed.embed_text(df, "t", embedder=_char_model).collect()}
    assert np.allclose(rows[1], [2 / 5 ** 0.5, 1 / 5 ** 0.5, 0]) and np.allclose(rows[2], [0, 0, 1])
    assert rows[3] == [0.0, 0.0, 0.0]  # zero vector stays zero


def test_hashing_embedder_is_unit_norm(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat."), (2, "!!!")], "id long, t string")
    rows = {r.id: np.array(r.embedding) for r in embed.embed_text(df, "t").collect()}
    assert len(rows[1]) == 384 and abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and not rows[2].any()


def test_session_cut_and_transcript(spark):
    df = spark.createDataFrame([
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "Exit"), (1, 3, "user", "later"),
        (2, 0, "user", "exit now"), (2, 1, "user", "quit"), (3, 0, "assistant", "exit"), (3, 1, "user", "x"),
    ], "conv_id long, turn long, role string, text string")
    kept = sorted((r.conv_id, r.turn) for r in dialog.take_while_session(df).collect())
    assert kept == [(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    lines = [r.line for r in dialog.transcript(df).filter(F.col("conv_id") == 1).orderBy("turn").collect()]
    assert lines == ["You: hi", "Bot: hello", "You: Exit", "You: later"]


def test_validate_and_assemble(spark):
    df = spark.createDataFrame([(1, "  ask  "), (2, "   "), (3, None)], "id long, prompt string")
    got = {r.id: (r.status, r.error, r.prompt_clean) for r in dialog.validate_prompts(df).collect()}
    assert got == {1: ("ok", None, "ask"), 2: ("error", "Empty prompt", ""), 3: ("error", "Empty prompt", "")}
    t = spark.createDataFrame([(7, "  a stream\nof  pieces ")], "response_id long, text string")
    pieces = dialog.stream_pieces(t, ["response_id"], "text")
    assert pieces.count() > 1
    assert dialog.assemble_stream(pieces).first().text == "  a stream\nof  pieces "


def test_embedding_and_subwords_hold_few_rows(spark):
    """A batch of any size leaves the embedding in slices of ``CELLS`` cells; the rows and vectors are the same."""
    import pyarrow as pa

    from quarry.operators import embed

    texts = ["alpha beta alpha", None, "", "word " * 3000, *[f"t{i} beta" for i in range(5000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = list(embed._hashing_model(64, "text", "v", ["id"])([batch]))
    assert max(b.num_rows for b in out) <= embed.CELLS // 64 and len(out) > 1
    rows = [(i, v) for b in out for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert [i for i, _ in rows] == list(range(len(texts)))
    want = embed.embed_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:6])], "id long, text string"), "text", "v", 64, hashing_in_jvm=True)
    assert [r["v"] for r in want.orderBy("id").collect()] == [v for _, v in rows[:6]]
