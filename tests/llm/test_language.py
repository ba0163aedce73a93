import random

from conftest import AWKWARD
from pyspark.sql import functions as F

from stepfall.llm import language


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    test = docs.where("doc_id % 2 = 1").withColumn("none", F.lit(None).cast("string"))
    got = language.identify(test, declared_col="none", address_col="none", model=model)
    right = got.join(docs, "doc_id").agg(F.avg((F.col("detected") == F.col("lang")).cast("int")), F.avg(F.col("kept").cast("int"))).first()
    assert right[0] > 0.98 and right[1] > 0.98


def test_pages_with_markup_and_address(spark):
    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "pages"))
    model = language.fit(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    rows = language.page_evidence(pages)
    got = language.identify(rows, "page_id", "text", "declared", "address", model=model).join(rows, F.col("doc_id") == F.col("page_id"))
    assert got.agg(F.avg((F.col("detected") == F.col("declared")).cast("int"))).first()[0] > 0.98


def test_page_evidence(spark):
    html = "<!DOCTYPE html><html class=x lang='FR-ca'><script>var a = '<p>';</script><p>Bonjour</p><style>p{}</style></html>"
    rows = spark.createDataFrame([(1, "http://u@Shop.Example.FR:80/a?b", html), (2, None, None)], "page_id long, url string, html string")
    first, second = language.page_evidence(rows).orderBy("page_id").collect()
    assert first.text.split() == ["Bonjour"] and first.declared == "fr" and (second.text, second.declared) == ("", None)
    host = rows.select(language._host(F.col("url")).alias("h")).withColumn("s", language._suffix(F.col("h"))).collect()
    assert [tuple(r) for r in host] == [("shop.example.fr", "fr"), (None, None)]


def test_priors_decide_where_text_does_not(docs):
    """A text that says nothing follows its host; a host with few rows follows its suffix; declarations count too."""
    en, fr = "the house of the king and the queen " * 4, "la maison de la reine et du roi " * 4
    rows = [(i, en, "en", "a.example.uk") for i in range(40)] + [(100 + i, fr, "fr", "b.example.fr") for i in range(40)]
    rows += [(200, "zzz", None, "a.example.uk"), (201, "zzz", None, "b.example.fr"), (202, "zzz", None, "new.example.fr"), (203, "zzz", "fr", "c")]
    got = {r.doc_id: r for r in language.identify(docs(rows)).collect()}
    assert [got[i].detected for i in (200, 201, 202, 203)] == ["en", "fr", "fr", "fr"]
    assert got[201].probability > got[202].probability
    assert all(got[i].detected == "en" for i in range(40)) and all(got[100 + i].detected == "fr" for i in range(40))


EN, FR = "the house of the king and the queen " * 4, "la maison de la reine et du roi " * 4


def test_few_labels_among_many_rows(docs):
    """The sample is a share of the labelled rows, and a NULL id does not decide for all its rows."""
    for ids in (range(4000), [None] * 4000):
        rows = [(i, f"{(EN, FR)[n % 2]} {n}", (("en", "fr")[n % 2] if n < 8 else None), "a") for n, i in enumerate(ids)]
        got = language.identify(docs(rows), sample_rows=20).groupBy("detected", "kept").count().collect()
        assert sorted((r.detected, r.kept, r["count"]) for r in got) == [("en", True, 2000), ("fr", True, 2000)]


def test_the_sample_is_never_empty(docs):
    """All labelled rows are copies, which hash alike."""
    for i in range(4):
        got = language.identify(docs([(i, EN, "en", "a")] * 30 + [(99, EN, None, "a")]), sample_rows=1).collect()
        assert all(r.kept and r.detected == "en" for r in got)


def test_rare_languages_among_many_rows(docs):
    """Each language has its own share of the sample."""
    rows = [(i, f"{EN} {i}", "en", "a") for i in range(3000)] + [(5000 + i, f"{FR} {i}", "fr", "b") for i in range(3)]
    rows += [(6000, f"{FR} x", None, "c"), (6001, f"{EN} x", None, "c")]
    got = {r.doc_id: r.detected for r in language.identify(docs(rows), sample_rows=40).collect()}
    assert [got[i] for i in (0, 5000, 5001, 5002, 6000, 6001)] == ["en", "fr", "fr", "fr", "fr", "en"]


def test_languages_beyond_the_table(docs, monkeypatch):
    """Named by declaration or host, else und; languages of the table stay what they are."""
    monkeypatch.setattr(language, "MAX_LANGUAGES", 4)
    rng = random.Random(1)
    spoken = [["".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 8), k=5)) for _ in range(60)] for _ in range(16)]
    rows = []
    for k, vocabulary in enumerate(spoken):
        text = lambda words=vocabulary: " ".join(rng.choices(words, k=40))
        rows += [(100 * k + i, text(), f"l{k:02}", f"h{k}.example") for i in range(30 if k < 4 else 12)]
        rows += [(100 * k + 90, text(), None, f"h{k}.example"), (100 * k + 91, text(), None, None)]
    got = {r.doc_id: (r.detected, r.kept) for r in language.identify(docs(rows)).collect()}
    for i, _, declared, _ in rows:
        k, own = divmod(i, 100)
        assert got[i] == ((f"l{k:02}", True) if declared or k < 4 or own == 90 else ("und", False)), i


def test_awkward_rows(awkward, nothing, docs):
    rows = language.identify(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r.doc_id: r for r in rows}
    assert [got[i].detected for i in (1, 2, 3)] == ["und"] * 3 and not got[1].kept
    assert got[5].detected == "en" and got[7].detected == "la" and got[9].kept
    assert language.identify(nothing).collect() == []
    unlabelled = language.identify(docs([(1, "some text", None, None), (None, None, None, None)])).collect()
    assert [(r.detected, r.kept) for r in unlabelled] == [("und", False)] * 2
