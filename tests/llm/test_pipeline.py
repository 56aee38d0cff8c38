import random

import corpus_pipeline


def prose(rng, n):
    return " ".join("".join(rng.choice(["on", "er", "th", "st", "ing", "re", "an", "ou"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_stages_take_effect_and_keep_clean_rows(spark, tmp_path):
    rng = random.Random(12)
    texts = [prose(rng, 120) for _ in range(30)]
    shared, test = prose(rng, 90), prose(rng, 30)
    texts[3] = texts[2].replace(" ", "  ", 1) + " end"
    texts[5], texts[6] = texts[5] + " " + shared, shared + " " + texts[6]
    texts[8] = texts[8] + " " + test + " " + prose(rng, 40)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(90, None, "en", "s", 0), (91, "??", None, None, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(30)) - {3}
    assert test not in out[8]["text"] and shared in out[5]["text"] and shared not in out[6]["text"]
    for i in set(out) - {6, 8}:
        assert out[i]["text"] == texts[i] and out[i]["n_tokens"] == len(out[i]["token_ids"]) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


CLASHES = ["items", "n_words", "n_hit", "removal_spans", "removed_bytes", "n_repeated", "removed_spans", "id", "mark", "whole", "place", "key", "language", "rejected", "least"]


def odd_rows(spark):
    rng = random.Random(4)
    a, b = prose(rng, 150), prose(rng, 150)
    rows = [(1, a), (1, a), (None, a + " end"), (None, a), (2, b), (3, ""), (3, None), (4, " "), (5, prose(rng, 20000)), (6, "?!"), (7, b.replace(" ", "  "))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"own {c}" for c in CLASHES)) for i, t in rows], schema)


def test_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_rows(spark)
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns and [f.dataType for f in out.schema][: len(docs.columns)] == [f.dataType for f in docs.schema], name
            got = out.collect()
            assert all(r[c] == f"own {c}" for r in got for c in CLASHES), name
            ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
            if rows is not docs:
                assert got == []
            elif name == "language":
                assert [i for i, _ in ids] == [0, 0, 1, 1, 2, 5, 6, 7]
            elif name == "near_dedup":
                # Of the four likes one stays, of the pair one; blank rows are like nothing.
                assert [i for i, _ in ids] == [1, 2, 3, 3, 4, 5, 6]
            else:
                assert len(got) >= 8


def test_tokens_replace_their_own_columns(spark):
    docs = spark.createDataFrame([(1, "ab cd", 5, "x")], "doc_id long, text string, n_tokens long, token_ids string")
    row = corpus_pipeline.tokens(spark, docs, "").first()
    assert row["text"] == "ab cd" and row["n_tokens"] == len(row["token_ids"]) and set(row.asDict()) == {"doc_id", "text", "n_tokens", "token_ids"}


def test_operators_get_each_text_once(spark):
    docs = corpus_pipeline._narrow(odd_rows(spark))
    assert docs.columns == ["doc_id", "text", "whole"] and "text" not in docs.schema["whole"].dataType.names
