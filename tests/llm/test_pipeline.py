import os

import corpus_pipeline
from corpusforge.llm import decontaminate, simhash, toxicity
from messy import rows, text_of
from pyspark.sql import functions as F
from test_mixing import brute_mix
from test_sharding import brute
from test_simhash import brute_fingerprint, brute_groups, signed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, folder):
    """Hard rows, toxic ones, exact and near copies, and benchmark passages."""
    bad = [(1000 + i, text_of(500 + i, 40) + " vileword muckword " + text_of(600 + i, 20), "en", "s1", 1) for i in range(40)]
    good = [(2000 + i, text_of(700 + i, 60), "en", f"s{i % 3}", 1) for i in range(60)]
    copies = [(3000 + i, text_of(700, 60), "de", "s7", 1) for i in range(5)]
    long_ = text_of(9000, 4000)
    near = [(3100 + i, long_ + " " + text_of(9100 + i, 1), None, "s8", 1) for i in range(4)]
    leaks = [(3200 + i, text_of(800 + i, 30) + " " + text_of(4000 + i % 2, 30) + " " + text_of(820 + i, 30), "en", "s2", 1) for i in range(4)]
    docs = spark.createDataFrame([*rows(), *bad, *good, *copies, *near, *leaks], DOCS).withColumn("score", F.lit(7)).withColumn("a.b", F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 1) for r in bad[:30]] + [(r[0], 1, 0) for r in good[:50]] + [(None, 1, 1), (2000, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, text_of(4000 + i, 30)) for i in range(3)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0] for r in bad}, {r[0] for r in leaks}


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    bad, leaks = planted(spark, folder)
    docs, at = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = os.path.join(folder, f"stage{k}")
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        at[name] = docs.collect()
        known = {tuple(r)[:len(columns)] for r in before}
        assert all(tuple(r)[:len(columns)] in known for r in at[name])
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), F.col("doc_id").isNotNull())
            z = [model.intercept + sum(model.weights[model.place[f]] for f in toxicity.features(r["text"]) if model.place[f] >= 0) for r in before]
            assert sorted(map(str, at[name])) == sorted(str(r) for r, x in zip(before, z) if x < 0)
            assert not {r["doc_id"] for r in at[name]} & bad
        elif name == "near_duplicates":
            prints = {r: signed(brute_fingerprint(r["text"])) for r in before}
            group = brute_groups(sorted(set(prints.values())))
            kept = [group[prints[r]] for r in at[name]]
            assert sorted(kept) == sorted({group[v] for v in prints.values()})
            for r, g in zip(at[name], kept):
                ids = [x["doc_id"] for x in before if group[prints[x]] == g and x["doc_id"] is not None]
                assert r["doc_id"] == (min(ids) if ids else None)
        elif name == "decontamination":
            items = [decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            share = lambda t: max(sum(x[0] for x in decontaminate.tiling(i, decontaminate.tokens(t))) / len(i) for i in items)
            assert sorted(map(str, at[name])) == sorted(str(r) for r in before if share(r["text"]) < 0.8)
            assert not {r["doc_id"] for r in at[name]} & leaks
        elif name == "mixing":
            sizes = {}
            for r in at[name]:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
            want = {}
            for i, r in enumerate(brute_mix([tuple(x) for x in before])):
                want.setdefault(r[0], r)
            counts = {}
            for r in at[name]:
                counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
            assert max(counts.values()) <= 3 and set(counts) <= set(want)
        else:
            assert len(at[name]) == len(before)
            assert all(r["shard"] == brute(r["doc_id"], [1.0] * 16) for r in at[name])
            for s in range(16):
                assert sorted(r["slot"] for r in at[name] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in at[name])))
    assert simhash.fingerprint("") == 0


def test_run_chains_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} == set(got.columns) and got.count() > 50


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
