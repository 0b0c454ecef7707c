"""The pipeline's stages one after another, and the registered queries."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(c.STAGES):
        docs, _ = c.materialize(stage(spark, docs, SF), "t")
        sizes.append(docs.count())
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    out = c.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == sizes[-1]


def test_pipeline_against_brute_force(spark, tmp_path):
    """The rows of run() from plain loops: all pairs of fingerprints, all alignments, the mix in SQL, whole-text encoding."""
    import zlib

    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from ohlcraft.llm import mixing, toxicity
    from ohlcraft.llm.encoding import default_tokenizer

    from test_operators import components_of, slow_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("size(split(text, ' ')) < 120")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6)
    items = [r.text for r in bench.collect()]
    leaks = [(9000 + i, "these words come before " + x + " and these after it", "en", "src1", 9) for i, x in enumerate(items)]
    copies = docs.where("doc_id % 9 = 0").selectExpr("doc_id + 20000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(leaks, docs.schema)).unionByName(copies)
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.toxic}
    rows = [r for r in docs.collect() if r.doc_id not in toxic]

    fps = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    comp = components_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    rows = [r for r in rows if comp[r.doc_id] == r.doc_id]
    assert len(rows) < len(fps)

    def words(x):
        return "".join(ch if ord(ch) > 127 or ch.isalnum() else " " for ch in x.lower()).split()

    def score(a, b):
        h, top = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, h[j] + (1 if x == y else -1), h[j + 1] - 1, row[j] - 1))
            h, top = row, max(top, *row)
        return top

    before = len(rows)
    rows = [r for r in rows if all(score(words(i), words(r.text)) < 0.5 * len(words(i)) for i in items)]
    assert len(rows) <= before - len(items)

    documents = spark.createDataFrame(rows, docs.schema).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM documents")
    chosen = sorted(r[0] for r in con.execute(mixing.ORACLE).fetchall())
    texts, tok, start, want = {r.doc_id: r.text for r in rows}, Tokenizer.from_file(default_tokenizer()), 0, []
    for i in chosen:
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = c.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, stage):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, tokens long"
    rows = [(1, None, None, None, None, "a", 1), (1, "", "en", "src1", 0, "a", 1), (None, "some words here", "en", "src1", 0, "a", 1), (2, "w " * 5000, "en", "src1", 0, "a", 1), (2, "w " * 5000, "en", "src1", 0, "a", 1), (3, "a b c d e f", "xx", "other", 0, "a", 1)]
    name, f = c.STAGES[stage]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        out = f(spark, table, SF)
        assert out.count() <= 2 * len(rows)
        if stage < 4:
            assert out.columns == table.columns
