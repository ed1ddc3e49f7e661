"""The pipeline stage by stage, against the operators' own rules."""

import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from gradeloom.llm import decontam, mixing, quality, simjoin

ITEM = "how many apples does one child keep if twelve apples are shared by three children in the yard"


def _documents(spark, folder):
    r = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(120):
        text = [r.choice(words) for _ in range(r.choice([5, 60, 120]))]
        if i % 9 == 0:
            text[20:20] = ITEM.split()
        rows.append((i, " ".join(text), "en", f"s{i % 4}" if i % 7 else None, len(text)))
    rows += [(200 + i, rows[i][1] + " tail", "en", "s1", 1) for i in range(0, 120, 5)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (None, rows[1][1], "en", "s0", 1), rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = _documents(spark, str(tmp_path))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing_weights", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            kept = Counter(r["doc_id"] for r in quality.verdicts(docs).where("kept").collect())
            assert Counter(r["doc_id"] for r in out.collect()) == kept and 0 < sum(kept.values()) < docs.count()
        elif name == "near_duplicates":
            classes = {r["class"] for r in simjoin.classes(docs).collect()}
            assert out.count() == len(classes) < docs.count()
        elif name == "decontamination":
            assert not [r for r in out.collect() if ITEM in r["text"]]
            assert docs.count() - out.count() == docs.where(docs["text"].contains(ITEM)).count() > 0
        elif name == "mixing_weights":
            taken = sum(r["taken"] for r in mixing.mix(docs).collect())
            assert sum(len(r["text"].split()) for r in out.collect()) == taken
        if name != "sharding":
            assert out.columns == columns
        else:
            assert out.count() == docs.count()
            sizes = Counter(r["shard"] for r in out.collect())
            assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
        docs = out


def test_run_and_registration(spark, tmp_path):
    _documents(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    found = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert decontam.findings(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).count() == 0
