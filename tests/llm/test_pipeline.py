"""The pipeline against plain versions of its stages."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from timberline.llm import langid, packing, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        nxt = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert nxt.columns == columns
        kept.append((name, docs.collect(), nxt.collect()))
        docs = nxt
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = kept
    # language: as its own predictions say
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    pred = langid.identify(all_docs, langid.train(all_docs, langid.learnable(F.col("doc_id"))))
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in pred.where("lang_pred <> 'und' and score >= 0.5").collect()} and len(b) > 0.95 * len(a)
    # near-duplicates: the smallest of each component, by every pair
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in b}
    root = {i: i for i in fps}
    ids = sorted(fps)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 4:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    assert sorted(r["doc_id"] for r in c) == sorted({find(i) for i in ids})
    assert len(d) == len(c) and not any("@mail" in r["text"] for r in d)
    words = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    sources = len({r["source"] for r in d})
    assert words(d) - sources <= words(e) <= words(d)
    assert sum(p["length"] for p in f) == sum(len(x) + 1 for x in packing.WordIds(packing.default_tokenizer())([r["text"] for r in e]))
    assert all(len(p["ids"]) == p["length"] for p in f)
    assert np.array([p["offset"] + p["length"] for p in f]).max() <= 2048
    assert sorted(map(tuple, (r[:7] for r in cp.run(spark, SF).select(*f[0].__fields__[:7]).collect()))) == sorted(tuple(r[:7]) for r in f)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns through every stage, against plain versions."""
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "s") for r in base]
    words = base[0]["text"].split() + base[1]["text"].split()
    rows += [(None, None, None, None, None, 1, "s"), (-1, "", "en", "a", 0, 1, "s"), (-2, " \n", None, "a", 2, 1, "s"), (None, base[3]["text"] + " mail me at joe@site.org", "en", None, 7, 1, "s"), rows[5], rows[5], (-3, " ".join(words * 200), "en", None, 9, 1, "s"), (-4, rows[7][1], None, "\x00", 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, spans string")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        nxt = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs.collect(), nxt.collect())
        assert name == "packing" or nxt.schema == docs.schema
        docs = nxt
    texts = lambda rs: [r["text"] for r in rs]
    a, b = seen["language"]
    assert all(any(map(str.isalpha, t)) for t in texts(b)) and len([r for r in b if r["doc_id"] == rows[5][0]]) == 3
    assert sum(any(map(str.isalpha, t or "")) for t in texts(a)) - len(b) <= 0.05 * len(a)
    a, b = seen["near_duplicates"]
    fps = {t: simhash.fingerprint(t) for t in texts(a)}
    root = {t: t for t in fps}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for t in fps:
        for u in fps:
            if (fps[t] ^ fps[u]).bit_count() <= simhash.RADIUS:
                root[find(t)] = find(u)
    assert sorted(map(find, texts(b))) == sorted(set(map(find, fps)))
    a, b = seen["personal_data"]
    assert len(a) == len(b) and not any("joe@site.org" in t for t in texts(b)) and all(r["n_chars"] == len(r["text"]) for r in b if "[email]" in r["text"])
    plain = {r["text"] for r in a if not any(c.isdigit() or c == "@" for c in r["text"])}
    assert plain <= set(texts(b))
    a, b = seen["mixture"]
    count = lambda rs: sum(len(t.encode().split()) for t in texts(rs))
    assert count(a) - len({r["source"] for r in a}) <= count(b) <= count(a)
    assert all(any(u.startswith(t) for u in texts(a)) for t in texts(b))
    a, b = seen["packing"]
    ids = packing.WordIds(packing.default_tokenizer())(texts(a))
    assert sorted(p["doc_tokens"] for p in b if p["start"] == 0) == sorted(len(x) + 1 for x in ids)
    assert sum(p["length"] for p in b) == sum(len(x) + 1 for x in ids)
    empty = spark.read.parquet(f"{tmp_path}/language").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
