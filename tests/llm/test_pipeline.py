import re

import sentencepiece
from conftest import SF
from helpers import jaccard_components, sha

import corpus_pipeline
from ragweave.llm import sentencepiece_codec
from ragweave.llm.decontam import WINDOW


def test_pipeline_against_brute_force(spark):
    """The last stage's digests follow from the documents that plain versions of the stages keep."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    groups = jaccard_components([texts[i] for i in ids], 5, 80)
    kept = [i for k, i in enumerate(ids) if groups[k][1] == k]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        assert len(w) >= WINDOW
        runs |= {tuple(w[p : p + WINDOW]) for p in range(len(w) - WINDOW + 1)}
    kept = [i for i in kept if not any(tuple(w[p : p + WINDOW]) in runs for w in [cut(texts[i])] for p in range(len(w) - WINDOW + 1))]
    mask = lambda t: re.sub(r"\bAKIA[0-9A-Z]{16}\b", "[SECRET]", re.sub(r'(password=|token = ")\w+', r"\1[SECRET]", t))
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = {}
    for i in kept:
        codes = model.encode(mask(texts[i])) + [2]
        want[i] = (len(codes), sha(" ".join(map(str, codes))), sha(model.decode(codes)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = "The heon of the and to thonin in ereati the and of heti thereon was. " * 3
    rows = [(1, clean, "en", "s", 1), (2, clean, None, "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "12 34", "en", "s", 5), (None, "Le la de en et les pas que " * 5, "fr", "s", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.dtypes == table.dtypes, name
        assert {r.doc_id for r in docs.collect()} == ({1, None} if table.count() else set())


def test_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(i, t, "en", "s", len(t)) for i, t in [(7, a), (7, a), (None, a), (3, a + " more"), (None, b), (None, b), (5, leak), (None, leak + " tail"), (9, b[:60]), (9, leak)]]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept if r.text[0] in "ab" and r.text != leak), key=repr) == sorted([(3, a + " more"), (None, b), (9, b[:60])], key=repr)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted([(r[0], r[1]) for r in rows if leak not in r[1]], key=repr)
