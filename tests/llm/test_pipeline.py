"""The pipeline against plain Python built from the stages' definitions."""

import re

import numpy as np
from llm_helpers import docs_of
from test_simhash import slow_fingerprint, slow_groups
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, pulearn, samples, stats
from plumbline.llm.text import WordHashes, map_texts
from pyspark.sql import functions as F


def repeats_removed(rows, window=20):
    first, out = {}, []
    split = [(i, t.split()) for i, t in rows]
    for i, words in sorted(split):
        for p in range(len(words) - window + 1):
            first.setdefault(tuple(words[p : p + window]), (i, p))
    for (i, words), (_, text) in zip(split, rows):
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] != (i, p):
                gone[p : p + window] = True
        if not gone.any():
            out.append((i, text))
        elif not gone.all():
            out.append((i, b" ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_run_against_brute_force(spark, read):
    docs = read("documents")
    model = pulearn.train(docs, read("labels"), samples.remainder(F.col("doc_id"), 4) != 2)
    rows = [(r["doc_id"], (r["text"] or "").encode(), r["source"]) for r in docs.collect()]
    hashes = WordHashes()
    rows = [r for r in rows if model.score(np.array([stats.counts(r[1], hashes)[1]]))[0] >= 0.7]
    group = slow_groups({i: slow_fingerprint(t.decode()) for i, t, _ in rows})
    rows = [r for r in rows if group[r[0]] == r[0]]
    source = {i: s for i, _, s in rows}
    rows = repeats_removed([(i, t) for i, t, _ in rows])
    planned = mixing.mix(docs_of(spark, [(i, t.decode(), "en", source[i]) for i, t in rows])).collect()
    planned = {p["doc_id"]: p for p in planned}
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    wanted = []
    for i, text in rows:
        p, words = planned[i], text.split()
        part = words[p["then_from"] : p["then_to"]] + words[p["first_from"] : p["first_to"]]
        parts = [text] * p["turns"] + ([text if len(part) == len(words) else b" ".join(part)] if part else [])
        for t in parts:
            ids = library.encode(t.decode(), add_special_tokens=False).ids
            wanted.append((i, source[i], len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in corpus_pipeline.run(spark, read.sf_dir).collect()]
    assert sorted(got) == sorted(wanted)


def test_stages_keep_the_columns_and_survive_odd_rows(spark, read, tmp_path):
    text = " ".join(f"word{i % 37} and{i % 11}," for i in range(80))
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text + " more"), (5, "w " * 30_000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS row", "2 AS score", "3 AS _text", "4 AS size")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, read.sf_dir)
            assert out.columns == docs.columns
            now = spark.createDataFrame(out.collect(), docs.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, read.sf_dir)
        assert last.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
        assert empty is False or last.collect() == []


def test_quality_stage_sends_texts_once_and_gets_scores(spark, read):
    """Whole rows, or a second copy of each text, in Python and back took an executor beyond its memory."""
    out = corpus_pipeline.good_quality(spark, read("documents"), read.sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and re.findall(r"ArrowEvalPython \[run\((.*?)\)#", plan) and plan.count("ArrowEvalPython") == 1
    assert re.search(r"ArrowEvalPython \[run\(cast\(text#\d+ as binary\)\)#\d+\], \[pythonUDF0#\d+\]", plan)


def test_workers_give_back_what_a_task_freed(spark):
    """Workers are used again by later stages, which then had the freed memory of earlier ones on top of their own."""

    def held(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            found = re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([int(found[1]) // 1024])], names=["pid", "mb"])

    def wasteful(batch):
        import builtins

        # Blocks below the size that is mapped alone, one of which outlives the task on top of the heap.
        blocks = [np.ones(10_000) for _ in range(4000)]
        builtins.kept_by_test = blocks[-1]
        return {"pid": np.full(batch.num_rows, len(blocks))}

    docs = docs_of(spark, [(i, "a b", "en", "s") for i in range(8)]).repartition(4).select(F.col("text").alias("_text"))
    assert map_texts(docs, "_text", wasteful, "pid bigint").count() == 8
    assert max(r["mb"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "pid bigint, mb bigint").collect()) < 200
