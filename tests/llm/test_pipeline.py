"""The stages one after another, each against what it must do to its own input."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import decontaminate, mixing, quality, queries, simhash, tokenstore
from tessella.llm.common import stored, worker_memory


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, d), f"test-{name}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            good = quality.quality(before, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1")
            assert ids == {r["doc_id"] for r in good.collect()}
        if name == "simhash":
            assert ids == {r["component_id"] for r in simhash.components(before).collect()}
        if name == "decontamination":
            clean = decontaminate.contamination(before, spark.read.parquet(f"{d}/benchmark.parquet")).where("NOT contaminated")
            assert ids == {r["doc_id"] for r in clean.collect()}
    assert docs.where("NOT verified").isEmpty() and docs.count() > 0
    assert corpus_pipeline.run(spark, d).count() == docs.count()


CLASHING = "text_hash root row kept_id kept_hash bad_id bad_digest kept score predicted key key_of times rows i again doc digest fp __id own.name".split()


def test_stages_on_odd_rows(spark):
    """Nulls, repeated ids, empty texts and columns named like the stages' own: a row is what it was, and the right ones stay."""
    base = [(1, "a fine text of some words that stand here for all to read", "en", "s"), (1, "quite another text with other words in it and more of them too", "en", "s"), (None, "no id but words enough to tell it from the others around it", None, None), (None, None, None, None), (2, "", "en", "s"), (3, "a fine text of some words that stand here for all to read", "en", "t"), (3, "a fine text of some words that stand here for all to read", "en", "t")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHING]) for r in base], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([(7, "another text with other words in it and more of them too")], "item_id long, text string")
    text_of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    good = quality.good_documents(docs, labels, threshold=0.1)
    assert good.columns == docs.columns and sorted(map(tuple, good.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    once = simhash.deduplicated(docs)
    assert once.columns == docs.columns and [r for r in text_of(once) if r[1]] == sorted([base[0][:2], base[1][:2], base[2][:2]], key=repr) and once.count() == 4
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and text_of(clean) == sorted((r[:2] for r in base if r != base[1]), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r[:2] for r in text_of(mixed)} == {r[:2] for r in base if r[1]}
    for stage in (lambda d: quality.good_documents(d, labels), simhash.deduplicated, lambda d: decontaminate.decontaminated(d, bench), mixing.mixed_documents):
        nothing = stage(docs.limit(0))
        assert nothing.columns == docs.columns and nothing.isEmpty()


def test_a_stage_gives_up_what_another_left_in_its_worker():
    """Else the token store's words, some hundred MB, stand beside the next run's texts."""
    texts = pa.record_batch({"doc_id": [1], "held_out": [False], "text": [b"a few words"], "order": [1], "y": [1.0], "text_hash": [1]})
    prints = pa.record_batch({"fp": [5]})
    tasks = [(quality._bags, texts), (quality._scorer(quality.Constant(0.5), 0.7, None), texts), (simhash._fingerprints, texts), (simhash._keys, prints)]
    path = queries.tokenizer_path("word_bpe_49k.json")
    for task, batch in tasks:
        words = tokenstore.WordEncoder(path)
        words([b"a few words"])
        assert worker_memory("tokenstore")[path]["known"] and tokenstore.WordEncoder(path).kept is words.kept
        assert sum(map(len, task(iter([batch])))) >= 1
        assert not worker_memory("tokenstore")


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_kept_texts_go_to_the_workers_once(spark, monkeypatch, kind):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} of some words, " * (i % 5)) for i in range(1300)], "doc_id long, body string").selectExpr("doc_id", f"CAST(body AS {kind}) AS body", "doc_id AS text").coalesce(1)
    model, sent, scorer = quality.Network.new(3), [], quality._scorer

    def seen(*args):
        def score(batches):
            yield from scorer(*args)(map(told, batches))

        def told(batch):
            assert sum(f.name in ("text", "body") for f in batch.schema) == 0 and [f.name for f in batch.schema.field("kept").type] == ["doc_id", "body", "text"]
            return batch

        sent.append(args)
        return score

    plain = {r["doc_id"]: r["score"] for r in quality.scored(docs, model, text_col="body").collect()}
    monkeypatch.setattr(quality, "_scorer", seen)
    found = quality.scored(docs, model, text_col="body", keep=tuple(docs.columns)).collect()
    assert sent and {r["doc_id"]: r["score"] for r in found} == pytest.approx(plain) and len(found) == 1300
    assert all(tuple(r["kept"])[::2] == (r["doc_id"], r["doc_id"]) for r in found)


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names
    assert set(queries.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
