"""The pipeline's stages, one after another, over a small part of the test tables."""

import zlib

import pytest

import corpus_pipeline
from titleforge.llm import fair_mix, pii


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 456", None, "src1", 7), (9003, "write to a@b.de now please my friend", None, None, 36)], docs.schema)
    docs = docs.union(extra)
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "pieces":
            assert after.columns == columns
        rows, ids = after.collect(), {r.doc_id for r in before.collect()}
        if name == "language":
            assert ids - {r.doc_id for r in rows} == {9001, 9002} and all(r.lang for r in rows)
        if name == "near_duplicates":
            assert len({r.doc_id for r in rows}) == len(rows) < len(ids)
        if name == "personal_data":
            assert len(rows) == len(ids) and all(not pii.find(r.text) and r.n_chars == len(r.text) for r in rows)
        if name == "mixture":
            want = {r.doc_id: r.taken for r in fair_mix.fair_mix(before).collect()}
            got = dict.fromkeys(want, 0)
            for r in rows:
                got[r.doc_id] += len(r.text.encode().split())
            assert got == want
        if name == "pieces":
            assert len(rows) == before.count() and all(r.round_trip for r in rows)
        before = after


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_empty(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null columns, blank texts, and further columns whose names the stages use inside."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, None, None), (None, text, None, None), (7, "some other words here", "en", "a"), (7, "quite another text of seven words now", "en", "a"), (8, "   ", None, "a"), (9, None, None, "b"), (10, "", None, "b"), (11, "x " * 30_000, None, "b")]
    rows += [(i, f"plain text number {i} about nothing", "en" if i % 2 else None, "a") for i in range(20, 40)]
    before = spark.createDataFrame([(*r, 0, 5, "r", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, root string, taken double")
    columns, counts = before.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, "").write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            found = before.collect()
            assert before.columns == columns and all((r["size"], r["root"], r["taken"]) == (5, "r", 1.5) for r in found)
            counts[name] = len(found)
            if name in ("language", "near_duplicates"):
                assert sum(r.doc_id is None for r in found) == (2 if name == "language" else 1) and sum(r.doc_id == 7 for r in found) == 2
    assert counts["language"] == 25 and counts["personal_data"] == counts["near_duplicates"] == 24


def test_language_reaches_the_token_ids(spark):
    """A text in another language than stated goes on under its own; a stated language that isn't known stays; unclear texts
    without one are und. All of that comes out with the token ids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = next(r.text for r in docs.filter("lang = 'en' and length(text) > 2000").orderBy("doc_id").collect())
    odd = "S\u0142owa w tym zdaniu s\u0105 d\u0142ugie oraz \u017c\u00f3\u0142te"
    ids = [i for i in range(9000, 9100) if zlib.crc32(str(i).encode()) % 4 == 2]  # never learned from
    extra = [(i, t, lang, "src0", 0) for i, (t, lang) in zip(ids, [(text, "de"), (text, "xx"), (text, None), (odd, None), (odd, "de"), ("12", "de")])]
    out = corpus_pipeline.language(spark, docs.union(spark.createDataFrame(extra, docs.schema)), "")
    want = dict(zip(ids, ["en", "xx", "en", "und", "de"]))
    assert {r.doc_id: r.lang for r in out.filter("doc_id >= 9000").collect()} == want
    assert {r.doc_id: r.lang for r in corpus_pipeline.pieces(spark, out, "").filter("doc_id >= 9000").collect()} == want
