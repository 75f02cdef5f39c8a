"""The pipeline from end to end, each stage held against its operator or a plain loop on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from turnwise.llm.common import Scratch

from .test_lines import brute as plain_lines
from .test_minhash import brute as plain_groups
from .test_packing import check

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def odd_documents(spark):
    """sf0.001 with columns that clash with the operators', nulls, empty and repeated rows, one id with two texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in docs.where("length(text) between 900 and 2000 and lang = 'en'").orderBy("doc_id").limit(3).collect()]
    assert len(good) == 3
    rows = [(10**6, None, "en", "web", None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, good[0], "en", "web", 5), (10**6 + 2, good[0], "en", "web", 5), (10**6 + 3, good[1], None, "web", 5), (10**6 + 3, good[2][::-1], "en", "web", 5), (None, good[2], "en", "web", 5), (None, None, None, None, None)]
    more = spark.createDataFrame(rows, docs.schema)
    return docs.unionByName(more).selectExpr("*", "1 as kept", "'x' as weight", "2 as piece", "3 as label", "4 as component_id")


def stored(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_every_stage_does_its_part(spark, tmp_path):
    sf = stored(spark, tmp_path, odd_documents(spark))
    docs, tmp, at = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = docs
        docs = tmp.table(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == at[name].columns and docs.dtypes == at[name].dtypes
    at["end"] = docs
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    kept = at["toxicity"]
    assert kept.where("text is null or text = ''").isEmpty() and kept.count() > 0.5 * at["quality"].count()
    assert {r.n for r in kept.where("doc_id = 1000002").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} <= {2}

    before, after = rows(at["line_dedup"]), rows(at["near_dedup"])
    want = plain_lines(before)
    assert len(after) == len(before)
    several = {i for i, _ in before if sum(j == i for j, _ in before) > 1}
    assert all(t == want[i] for i, t in after if i is not None and i not in several)

    groups = plain_groups([(i, t) for i, t in after if i is not None and i not in several])
    left = [i for i, _ in rows(at["packing"])]
    assert all(i in left for i, (_, c) in groups.items() if i == c and not several)
    assert not [i for i, (_, c) in groups.items() if i != c and i in left]
    assert len([i for i in left if i == 1000002]) <= 1

    packed = [(i, t) for i, t in rows(at["packing"]) if left.count(i) == 1]
    found = [r for r in at["end"].collect() if left.count(r.doc_id) == 1]
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in found}) == sorted(-1 if i is None else i for i, _ in packed)
    assert check(rows(at["packing"]), at["end"].collect()) >= 1


def test_run_gives_the_rows_of_its_stages(spark, tmp_path):
    sf = stored(spark, tmp_path, odd_documents(spark))
    docs, tmp = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = tmp.table(stage(spark, docs, sf))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (corpus_pipeline.run(spark, sf), docs))
    assert got == want and got


def test_an_empty_table(spark, tmp_path):
    sf = stored(spark, tmp_path, odd_documents(spark).limit(0))
    assert corpus_pipeline.run(spark, sf).count() == 0
