"""The pipeline's stages on the given small tables, each against a plain computation on its own input."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolith.llm import langid, simhash
from aerolith.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_language_id_keeps_all_with_letters(spark, docs):
    more = docs.limit(1).selectExpr("-1L as doc_id", "'12 !! 34' as text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("-2L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    out = rows(STAGES["language_id"](spark, docs.unionByName(more), SF))
    assert {r[0] for r in out} == {r[0] for r in rows(docs)}


def test_toxicity_drops_what_it_predicts(spark, docs):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in rows(STAGES["toxicity"](spark, docs, SF))}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    some = rows(docs)
    extra = [(10_000 + k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(some[:30])]
    extra += [(None, *some[3][1:]), (None, *some[3][1:]), (None, "entirely other words stand in this one", "en", "src0", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(some + extra, docs.schema)
    f = {r: simhash.fingerprint(r[1]) for r in some + extra}
    u = np.unique(np.array(list(f.values()), dtype=np.uint64))
    near = np.bitwise_count(u[:, None] ^ u) <= 3
    label = np.arange(len(u))
    while True:
        new = np.array([label[m].min() for m in near])
        if (new == label).all():
            break
        label = new
    group = dict(zip(u.tolist(), label.tolist()))
    out = rows(STAGES["near_dedup"](spark, frame, SF))
    seen = Counter(group[f[r]] for r in out)
    assert set(seen) == set(group.values()) and set(seen.values()) == {1}
    best = {}
    for r in some + extra:
        if r[0] is not None:
            best[group[f[r]]] = min(best.get(group[f[r]], r[0]), r[0])
    assert all(r[0] == best.get(group[f[r]]) for r in out)


def test_suffix_dedup_cuts_texts(spark, docs):
    out = {r[0]: r for r in rows(STAGES["suffix_dedup"](spark, docs, SF))}
    texts = {r[0]: (r[1] or "").encode() for r in rows(docs)}
    count = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    assert set(out) == set(texts)
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        want = bytes(x for x, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        assert out[i][1] == want and out[i][4] == len(want)


def test_run_is_its_stages(spark, docs):
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, SF), name)
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, frame.collect())) and len(got) > 0
    assert langid.UNKNOWN == "und"


def test_stages_on_nothing_and_on_clashing_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
    odd = docs.limit(60).withColumns({c: F.lit(1) for c in ("said", "row", "id", "h", "k", "rows", "bucket", "carried_0", "count")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, SF).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, odd, SF).count() > 0
    assert corpus_pipeline.STAGES[4][1](spark, odd, SF).count() == 60
