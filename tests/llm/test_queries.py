"""The registered queries against their check SQL, or against brute force, on the given tables."""

import brute
import duckdb
import pytest

import corpus_pipeline
from stepfall.llm.jobs import ORACLES, QUERIES
from stepfall.llm.language import page_evidence
from stepfall.llm.text import word_count

TABLES = ("documents", "labels", "pages", "conversations")


def _rows(df):
    return df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_check_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got, want = _rows(QUERIES[name](spark, folder).toPandas()), _rows(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for column in got.columns:
        assert ((got[column] == want[column]) | (got[column].isna() & want[column].isna())).all(), column


def _texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_ngram_join(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_join"](spark, small).collect()}
    assert got == brute.near(list(_texts(spark, small).items()))


def test_byte_bpe(spark, small):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op5_byte_bpe"](spark, small).collect()}
    assert got == {i: brute.tokens(t) for i, t in _texts(spark, small).items()}


def test_personal_data(spark, small):
    for r in QUERIES["op6_personal_data"](spark, small).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in brute.personal(_TEXTS.setdefault(small, _texts(spark, small))[r.doc_id])]
        assert set(base) <= set(r.spans.split(",")) or not base
        assert len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone


_TEXTS: dict = {}


def test_language_and_toxicity_cover_every_row(spark, small):
    for name in ("op4_language_id", "op9_toxicity"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, small).collect()) == sorted(_texts(spark, small))


def test_pipeline(spark, small):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "source_mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        texts = {r.doc_id: r.text for r in docs.collect()}
        out = corpus_pipeline.settle(stage(spark, docs, small), name)
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in out.collect()) == sorted({keep for keep, _, _ in brute.exact(list(texts.items())).values()})
        if name == "ngram_join":
            assert sorted(r.doc_id for r in out.collect()) == sorted({top for _, top in brute.near(list(texts.items())).values()})
        if name == "source_mixing":
            sizes = {r.source: r.n for r in docs.groupBy("source").agg({"doc_id": "count"}).selectExpr("source", "`count(doc_id)` AS n").collect()}
            words = {s: 0 for s in sizes}
            for r in docs.select("source", word_count("text").alias("n")).collect():
                words[r.source] += r.n
            taken = {s: 0 for s in sizes}
            for r in out.select("source", "n_chars", "text", word_count("text").alias("n")).collect():
                taken[r.source] += r.n
                assert r.n_chars == len(r.text)
            assert taken == pytest.approx(brute.targets(words), abs=1)
        if name == "byte_bpe":
            rows = docs.select("doc_id", "text").collect()
            want = sorted((r.doc_id, *brute.tokens(r.text)) for r in rows)
            assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
        else:
            assert out.columns == columns
        docs = out
    assert corpus_pipeline.run(spark, small).count() == docs.count()


def test_language_of_pages_covers_every_page(spark, small):
    """Markup and address are evidence here; most pages get the language their markup declares."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    declared = {r.page_id: r.declared for r in page_evidence(pages).select("page_id", "declared").collect()}
    got = QUERIES["language_of_pages"](spark, small).collect()
    assert sorted(r.page_id for r in got) == sorted(declared)
    told = [r for r in got if r.kept and declared[r.page_id]]
    assert sum(r.detected == declared[r.page_id] for r in told) >= 0.95 * len(told)


def test_stages_without_labels_or_lengths(spark, docs):
    """Without any declared language nothing is rejected, and ``n_chars`` is no condition."""
    rows = [(1, "a b c", None, "s"), (2, "", None, "s"), (None, None, None, None)]
    bare = docs(rows).select("doc_id", "text", "lang", "source")
    assert corpus_pipeline.language_id(spark, bare, "").count() == 3
    assert [r.text for r in corpus_pipeline.source_mixing(spark, bare, "").collect()] == ["a b c"]


def test_pipeline_of_awkward_rows(spark, awkward, nothing):
    wanted = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (awkward, nothing):
        docs = rows.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars")
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, ""), name)
            assert name == "byte_bpe" or docs.columns == wanted
