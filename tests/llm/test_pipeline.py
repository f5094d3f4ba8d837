"""The pipeline over the smallest tables: each stage on what the one before kept."""

from pathlib import Path

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tarnholm.llm import decontam, packing, simhash, substring  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        seen[name] = before = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert before.columns == names
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "passages", "decontamination", "packing"]
    # every decision takes effect: nothing is left to find
    assert simhash.near_duplicates(seen["near_duplicates"]).filter("duplicate").count() <= 1
    assert decontam.contamination(seen["decontamination"], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert seen["passages"].count() >= 0.95 * seen["near_duplicates"].count()
    assert substring.passages(seen["passages"]).count() <= substring.passages(seen["near_duplicates"]).count() * 0.2 + 1
    # packing: a round trip of all that was kept
    tokens = {}
    for r in seen["packing"].orderBy("doc_id", "piece").collect():
        tokens.setdefault(r.doc_id, []).extend(r.tokens)
    t = packing.Tokenizer(Path(packing.VOCAB).read_bytes())
    for r in seen["decontamination"].collect():
        assert t.encoding.decode(tokens[r.doc_id][:-1]) == r.text
    assert len(tokens) == seen["decontamination"].count()
    assert pipeline.run(spark, sf).count() == seen["packing"].count()
