"""URL verdicts, neighbours, registered queries and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontamination, neighbours, packing, queries, toxicity, urls
from factloom.llm.common import fold

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(map(str, (r[names.index(c)] for c in columns))) for r in cursor.fetchall())
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect()) == want


def test_urls(spark):
    pages = [
        (1, "https://User.Example.NET/en/x?y#z", '<a href="/q">'),
        (2, "http://a.example.net/de", None),
        (3, "no scheme", '<a href="//c.d">'),
        (4, None, None),
        (5, "http://x.org/fr/1", '<a HREF=https://friend.test/1> <a href="/local">'),
        (6, "http://x.org", ""),
        (7, "http://friend.test?q", '<a href="http://x.org/">'),
        (8, "http://bad.test/a/b", '<a href="http://evil.net/">'),
        (9, "http://evil.net/", ""),
        (10, "ftp://example.com/de/a#b", ""),
        (11, "http://xexample.net", ""),
        (1, "https://User.Example.NET/en/x?y#z", None),
        (12, "a://b://c/d", ""),
    ]
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id bigint, url string, html string, rank string")
    rows = urls.judged(df).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("user.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/de", "net/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("x.org", "", None, "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "block") and got[9][2:] == ("net/", "block")
    assert got[10] == ("example.com", "/de/a", "example.com/de/", "block")
    assert got[11][:3] == ("xexample.net", "", None) and got[12][:2] == ("b:", "//c/d")
    assert urls.judged(df.limit(0)).count() == 0


def brute(ids, rows, query, k):
    scores = (rows * rows[query]).sum(axis=1)
    return [(int(ids[j]), float(scores[j])) for j in np.lexsort((ids, -scores)) if ids[j] != ids[query]][:k]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, 1500)[:, None]
    rows[100:110] = rows[7]  # ties
    table = [(i, v.tolist(), "x") for i, v in enumerate(rows)]
    odd = [(2000, None, "x"), (2020, [0.0] * 24, "x"), (2040, [float("nan")] * 24, "x"), (2060, [None] * 24, "x"), (None, [1.0] * 24, "x"), (2080, [1.0], "x")]
    df = spark.createDataFrame(table + odd, "vec_id bigint, embedding array<double>, rank string")
    found = neighbours.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for query, got in by.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(got, got[1:]))
        assert np.allclose([g[2] for g in got], [rows[query] @ rows[g[1]] for g in got])
        hits += len({g[1] for g in got} & {i for i, _ in brute(np.arange(1500), rows, query, 20)})
    assert hits / (20 * len(by)) >= 0.9
    few = neighbours.neighbours(df.filter("vec_id < 4"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [i for i, _ in brute(np.arange(4), rows[:4], 0, 20)]
    assert neighbours.neighbours(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0


def test_an_outlier_beside_a_tight_cluster_gets_k_rows(spark):
    rng = np.random.default_rng(10)
    center = rng.standard_normal(24)
    rows = center + 0.02 * rng.standard_normal((2000, 24))
    rows[0] = -center  # one query of 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    found = neighbours.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(by) == list(range(0, 2000, 20)) and {len(x) for x in by.values()} == {20}
    assert all([rank for rank, _ in sorted(x)] == list(range(1, 21)) for x in by.values())
    assert [i for _, i in sorted(by[0])] == [i for i, _ in brute(np.arange(2000), rows, 0, 20)]


def test_small_shards_find_the_same(spark, monkeypatch):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    whole = queries.QUERIES["op7_nearest_neighbours"](spark, FOLDER).collect()
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    parts = neighbours.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert sorted(whole) == sorted(parts)


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10**6, None, None, None, None), (None, "some words here", "en", "src1", 15), (10**6 + 1, "", "en", "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.filter("doc_id = 1"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.filter("doc_id IS NULL").count() == 1 and out.filter("doc_id = 1000000").count() == 1
        left = stage(spark, docs.limit(0), FOLDER)
        assert left.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_rows_of_one_doc_id_stay_unless_they_are_alike(spark):
    base = [(k, f"quite another text number {k} with words {k * 7} {k * 11} {k * 13} of its own {k * 17}") for k in range(6)]
    same = " ".join(f"w{k}" for k in range(40))
    rows = [*base, (3, "the second text of three stands alone here"), (3, base[3][1]), (8, same), (8, same + " tail"), (None, same), (-1, "minus one text is here alone"), (-1, "and this is its other one"),
            (7, same), (9, ""), (9, ""), (None, "no key and nothing like it"), (None, "no key but another text again")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), 7, "x", True) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, _score string, _drop boolean")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert out.dtypes == docs.dtypes
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect())
    want = [*base, (3, rows[6][1]), (-1, rows[11][1]), (-1, rows[12][1]), (7, same), (9, ""), (9, ""), rows[-2], rows[-1]]
    assert got == sorted((k is None, k or 0, t) for k, t in want)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.dtypes == docs.dtypes and {(r["n_lines"], r["_score"], r["_drop"]) for r in kept.collect()} == {(7, "x", True)}


def test_pipeline_over_repeated_and_missing_ids(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(5000))
    rows = [(5, long), (5, long + " and an end of its own"), (None, " ".join(f"other{k}" for k in range(4096))), (None, " ".join(f"more{k}" for k in range(4096))), (6, None), (6, "short text")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) - 2 * 4096 - 2 in (5000, 5006) and sum(r["doc_id"] == 6 for r in packed) == 2
    slots = [(r["sequence"], r["offset"]) for r in packed if r["sequence"]]
    assert len(slots) == len(set(slots)) and len({r["sequence"] for r in packed if r["length"] == 4096}) == 3


def test_full_pieces_of_repeated_rows_have_sequences_of_their_own(spark):
    text = " ".join("w" for _ in range(4096))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text), (None, "a b"), (None, "c d")], "doc_id long, text string")
    rows = packing.best_fit(df, "doc_id", packing.word_count(F.col("text"))).collect()
    assert len({(r["sequence"], r["offset"]) for r in rows}) == 6


def test_trust_and_distrust_reach_the_end_of_a_chain(spark):
    edges = [(f"h{k}", f"h{k + 1}") for k in range(40)]
    pages = [(k, f"http://{a}.com/", f'<a href="http://{b}.com/x">') for k, (a, b) in enumerate(edges)] + [(99, "http://h40.com/", '<a href="http://bad.net/">'), (100, "http://bad.net/", ""), (101, "http://far.com/", "")]
    got = {r["host"]: r["verdict"] for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[f"h{k}.com"] for k in range(41)} == {"block"} and got["far.com"] == "allow"


def test_neighbours_of_extreme_vectors(spark):
    rows = [(20 * k, [v, v / 2, -v]) for k, v in enumerate([1e200, 1e-170, 1.0, -1e200, 5e-324, 3.0])] + [(1, [1e200, 0.0, 0.0]), (2, [0.0, 1e-170, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert sorted(got) == [0, 20, 40, 60, 80, 100] and {len(x) for x in got.values()} == {7}
    with np.errstate(over="ignore", invalid="ignore"):
        for query, found in got.items():
            for key, score in found.items():
                want = float((np.array(dict(rows)[query]) * np.array(dict(rows)[key])).sum())
                assert score == want or (np.isnan(want) and score == -np.inf)


def test_pipeline_equals_its_operators(spark):
    """run() against the operators' own reports, applied to the documents in plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.train(docs, labels)
    toxic = {r[0] for r in docs.filter(toxicity.toxicity(F.col("text"), model)["score"] >= 0.7).select("doc_id").collect()}
    kept = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in toxic}
    by_source = {}
    for r in kept.values():
        by_source.setdefault(r["source"], []).append(r["text"])
    common = {}
    for source, texts in by_source.items():
        counts = {}
        for text in texts:
            for line in {x.strip(" ") for x in text.split("\n")} - {""}:
                counts[line] = counts.get(line, 0) + 1
        common[source] = {x for x, n in counts.items() if n >= 5 and n > 0.1 * len(texts)}
    texts = {i: "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in common[r["source"]]) for i, r in kept.items()}
    from tests.llm.test_text_operators import plain_components

    ids = sorted(texts)
    root, _ = plain_components([texts[i] for i in ids], ids, 5)
    alone = {i for i in ids if root[i] == i}
    words = lambda t: [w for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())]
    items = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    final = {r["doc_id"] for r in packed}
    leaked = {i for i in alone if any(f" {item} " in f" {' '.join(words(texts[i]))} " for item in items)}
    altered = {r[0] for r in decontamination.contaminated(spark.createDataFrame([(i, texts[i]) for i in sorted(alone)], 'doc_id long, text string'), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).select('doc_id').collect()}
    assert final <= alone and not final & leaked and not alone - leaked - final - altered
    assert sum(r["length"] for r in packed) == sum(len(texts[i].split()) for i in final)
