"""The pipeline's stages are held against brute force on the smallest tables."""

from collections import Counter

import duckdb

import corpus_pipeline
from tests.llm.test_operators import shingles
from vicinage.llm import quality, queries

SF = "/root/testdata/sf0.001"


def near_kept(texts):
    """Smallest id of each component of similar documents, and all without words: every pair is compared."""
    sets = {}
    for k, t in texts.items():
        sh, n = shingles(t)
        sets[k] = set(sh) if n >= 5 else {tuple((t or "").lower().split())} if n else set()
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {k for k in ids if root(k) == k}


def holds_item(text, items):
    """Whether an item-sized window at any start has a bag of shingles of similarity 0.75 or more."""
    sh, _ = shingles(text)
    for words in items:
        own = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        m = sum(own.values())
        for at in range(-(m - 1), len(sh)) if own.keys() & set(sh) else ():
            win = Counter(sh[max(0, at) : max(0, at + m)])
            both = sum((win & own).values())
            if both / (sum(win.values()) + m - both) >= 0.75:
                return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len(corpus_pipeline.STAGES) == 5
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        kept = corpus_pipeline.materialize(stage(spark, before, SF), "test")
        assert kept.columns == columns and 0 < kept.count() <= before.count()
        left = {r.doc_id for r in kept.select("doc_id").collect()}
        if n == 0:
            model = quality.fit_on(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {k for k, t in texts.items() if model.scores([t.encode()])[0] >= quality.THRESHOLD}
        elif n == 1:
            want = set({t: k for k, t in sorted(texts.items())}.values())
        elif n == 2:
            want = near_kept(texts)
        else:
            want = {k for k, t in texts.items() if not holds_item(t, items)}
        assert left == want, n
        texts, before = {k: texts[k] for k in left}, kept
    packed = corpus_pipeline.STAGES[4][1](spark, before, SF).collect()
    assert {r.doc_id for r in packed} == set(texts) and all(len(r.ids) == 4 * r.length for r in packed)
    for sequence in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_exact_dedup_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(queries.ORACLE_SQL["op4_exact_dedup"]).fetchdf().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op4_exact_dedup"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))
