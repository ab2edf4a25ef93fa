"""The pipeline on a small corpus, stage by stage against what each stage says of its own input."""

import random
import re

import corpus_pipeline
from tidemark.llm.common import read_table


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    words = {"en": "the of and to in is that for with".split(), "de": "der die und von mit sich nicht auf".split()}
    for i in range(80):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + str(rng.randrange(30)) for _ in range(30)), lang, f"s{i % 4}", 1))
    rows += [(100, rows[3][1], "en", "s1", 1), (101, rows[4][1] + " end", "de", "s1", 1), (102, "123 456", "en", "s0", 1), (103, None, None, None, None), (104, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = read_table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append((name, docs.collect()))
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [{r.doc_id for r in found} for _, found in seen]
    assert kept[0] == {i for i, t, *_ in rows if t and re.search("[a-z]", t)}
    assert kept[1] == kept[0] - {3} and len(seen[1][1]) == len(kept[1])  # 100 repeats 3 and has the larger id
    assert kept[2] == kept[1] - {101}  # 101 is 4 with a word more
    text = {r.doc_id: r.text for r in seen[2][1]}
    assert kept[3] <= kept[2] and max(sum(r.doc_id == i for r in seen[3][1]) for i in kept[3]) <= 3
    assert len(seen[4][1]) == len(seen[3][1]) and all(r.decoded == text[r.doc_id] and r.round_trip for r in seen[4][1])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in again) == sorted((r.doc_id, tuple(r.ids)) for r in seen[4][1])


def test_documents_stay_where_no_language_can_be_learned(spark, tmp_path):
    rows = [(1, "some clean text", None, "s0", 1), (2, "漢字", None, "s0", 1), (3, "123 456", None, "s0", 1), (4, None, None, None, None), (5, "", None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2}
