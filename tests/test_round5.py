"""What the findings of FINDINGS_r04.md mended: each test failed before."""

import random
import re

import pyarrow as pa

import __spark_entry__
from tessera.operators import retrieval, scan, search, text

from .test_search_series import brute_cosines, corpus

SF = "/root/testdata/sf0.001"


def no_index(*_, **__):
    raise AssertionError("an index of all postings was built")


def oracle(name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def odd():
    docs, queries = corpus(random.Random(4))
    docs += [("odd", "The Kelvin 5K İx xxİyy don't a_b snake_case_word ÄÖ straße __ zz9\tqq\x0brr ss a b c word"), ("blank", " \n "), ("long", "longerthantwelveletters w1 " + "x" * 9000)]
    return docs, [*queries, ("q7", "kelvin 5k i̇x yy snake_case a_b_ zz9 qq rr ss stra word"), ("q8", "thantwelvelet longerthantwelveletters w1 longerthantwelveletter"), ("q9", "w3 " * 300)]


def test_terms_are_those_of_spark(spark):
    docs = [(k, t) for k, t in odd()[0] if t]
    df = spark.createDataFrame(docs, "id string, text string")
    want = {tuple(r) for r in text.term_counts(df, "id", "text", lambda c: text.terms(c, text.STOP)).collect()}
    found = scan.words(pa.array([t for _, t in docs]), scan.LOWER, rows=7)
    letters = [found.letters[a : a + n].tobytes().decode() for a, n in zip(found.starts, found.lengths)]
    kept = [(r, letters[w]) for r, w in zip(found.row, found.number) if letters[w] not in text.STOP]
    terms = [(docs[r][0], w) for r, w in kept] + [(docs[r][0], f"{a} {b}") for (r, a), (s, b) in zip(kept, kept[1:]) if r == s]
    assert {(k, t, terms.count((k, t))) for k, t in set(terms)} == want
    made = scan.terms_of(found, pa.array(range(len(docs))).to_numpy(), len(docs), text.STOP)
    assert len(made.high) == len({t for _, t, _ in want}) and sorted(made.times) == sorted(n for *_, n in want) and len(made.doc) == len(want)


def test_scan_equals_scoring_everything(spark, monkeypatch):
    """Over groups of a few documents; rows of one key are one document, those without one too."""
    monkeypatch.setattr(scan, "GROUP_DOCS", 40)
    docs, queries = odd()
    want = brute_cosines([(k, t.replace("\u212a", "k").replace("\u0130", "i ") if t else t) for k, t in docs], queries)
    df, asked = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame([*queries, (None, "word")], "q string, text string")
    got = {}
    for r in scan.nearest(df, "id", "text", asked, "q", k=7).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    for q, _ in queries:
        best = sorted(want[q].items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(i, k) for i, (k, _) in enumerate(best, 1)] == [m[:2] for m in sorted(got.get(q, []))], q
        assert all(abs(a[2] - b[1]) < 1e-8 for a, b in zip(sorted(got.get(q, [])), best))
    more = df.unionByName(spark.createDataFrame([(docs[5][0], "w1 another row"), (None, "common zebra"), (None, "zebra word"), (None, None)], df.schema))
    indexed = search.TermIndex.build(more, "id").search(asked.where("q IS NOT NULL"), "q", 7)
    key = ["q", "rank", "id", "score"]
    assert sorted(map(tuple, scan.nearest(more, "id", "text", asked, "q", k=7).select(key).collect())) == sorted(map(tuple, indexed.select(key).collect()))
    assert scan.nearest(df.limit(0), "id", "text", asked, "q").count() == 0 == scan.nearest(df, "id", "text", asked.limit(0), "q").count()


def test_hybrid_scan_equals_hybrid_search(spark, monkeypatch):
    monkeypatch.setattr(scan, "GROUP_DOCS", 40)
    monkeypatch.setattr(scan, "MATRIX", 500)
    docs, queries = odd()
    df, asked = spark.createDataFrame(docs, "id string, text string"), [retrieval.Query(q, t) for q, t in queries if t]
    got, want = ({(r["query"], r["rank"]): (r["id"], r["score"]) for r in x.collect()} for x in (retrieval.hybrid_scan(df, "id", "text", asked), retrieval.hybrid_search(search.TermIndex.build(df, "id"), df, "text", asked)))
    assert got == want and len(got) > 80


def test_chunks_of_code_points(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "\n\n"), (5, "\U0001f600" * 1203), (6, "a" * 500), (7, "b" * 501), (8, " " * 500 + "x"), (9, "é\r\n" * 400)]
    made = text.chunks(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    want = {(i, f"{i}_{a}", c) for i, t in rows for a in range(0, len(t or ""), 500) if (c := t[a : a + 500].strip(" "))}
    assert {tuple(r) for r in made.collect()} == want
    # each piece was looked for from the start of its text
    assert "substring" not in made._jdf.queryExecution().toString()


def test_retrieve_chunks_without_an_index(spark, monkeypatch):
    monkeypatch.setattr(search.TermIndex, "build", no_index)
    monkeypatch.setattr(scan, "GROUP_DOCS", 300)
    made = __spark_entry__.queries()["retrieve_chunks"](spark, SF)
    assert sorted(map(tuple, made.collect())) == oracle("retrieve_chunks")


def test_retrieve_chunks_diverse_without_an_index(spark, monkeypatch):
    """The pools come with their texts: documents aren't cut and joined a second time."""
    monkeypatch.setattr(search.TermIndex, "build", no_index)
    made = __spark_entry__.queries()["retrieve_chunks_diverse"](spark, SF)
    # the only join names the queries
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    chunks = {r["chunk_id"]: r["chunk"].lower() for r in text.chunks(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()}
    pools = {}
    for q, c, score, rank in sorted(oracle("retrieve_chunks"), key=lambda r: (r[0], r[3])):
        pools.setdefault(q, []).append((c, score, {t for t in re.split("[^a-z0-9_]+", chunks[c]) if len(t) > 2}))
    want = set()
    for q, left in pools.items():
        taken = []
        while left and len(taken) < 4:
            best = max(left, key=lambda r: 0.7 * r[1] - 0.3 * max((len(r[2] & t[2]) / (len(r[2] | t[2]) or 1) for t in taken), default=0.0))  # noqa: B023
            left.remove(best)
            taken.append(best)
        want |= {(q, c, score, i) for i, (c, score, _) in enumerate(taken, 1)}
    assert {tuple(r) for r in made.collect()} == want and len(want) == 160


def test_search_chunks_without_an_index(spark, monkeypatch):
    monkeypatch.setattr(search.TermIndex, "build", no_index)
    made = __spark_entry__.queries()["search_chunks"](spark, SF)
    assert sorted(map(tuple, made.collect())) == oracle("search_chunks")
