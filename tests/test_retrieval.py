import pytest
from pyspark.sql import functions as F

from ragweave.operators import embed, evaluate, generate, merge, report, route, search
from ragweave.plans import experiment, schemas
from ragweave.plans.config import Settings
from ragweave.providers import HashEmbedder, OverlapScorer, RuleChat
from ragweave.sources import corpus, sinks

FAST = Settings(embedding_pause=0.0, threshold=0.0, min_words=1)


def test_top_n(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "chunk_id bigint, embedding array<float>")
    index = index.withColumn("norm_embedding", embed.l2_normalize(F.col("embedding")))
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "query_id bigint, query_embedding array<float>")
    for method in ("base", "faiss"):
        got = [(r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in search.top_n(asked, index, 3, method).orderBy("rank").collect()]
        assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    with pytest.raises(ValueError):
        search.top_n(asked, index, 3, "other")
    assert search.top_n(asked.where("query_id = 1"), index, 3).count() == 0


def test_filter_is_strict(spark):
    hits = spark.createDataFrame([(0.5, "w " * 20), (0.6, "w " * 10), (0.6, "w " * 11)], "score double, text string")
    assert search.filter_hits(hits).count() == 1


def test_round_robin(spark):
    lists = {0: "abc", 1: "ad", 2: "b"}
    rows = [(7, s, c, 1.0 - i / 10, i) for s, cs in lists.items() for i, c in enumerate(cs)]
    hits = spark.createDataFrame(rows, "query_id bigint, sub_idx int, chunk_id string, relevance_score double, rank int")
    assert [r.chunk_id for r in merge.round_robin(hits, 3).orderBy("final_rank").collect()] == ["a", "b", "d"]


def test_routing(spark):
    q = spark.createDataFrame([("Compare Mill and Bain on 'induction'",), ("a million",)], "query string")
    got = [tuple(r.c) for r in q.select(route.complexity(F.col("query")).alias("c")).collect()]
    assert got == [(2, 1, 2, 1, 6), (1, 0, 0, 0, 1)]


def test_decomposition(spark):
    replies = [('{"queries": ["a", "b", "c", "d"]}',), ("{bad",), ('{"x": 1}',), ('{"queries": []}',)]
    got = [r.v for r in spark.createDataFrame(replies, "r string").select(route.parse_decomposition(F.col("r"), F.lit("q")).alias("v")).collect()]
    assert got == [["a", "b", "c"], ["q"], ["q"], []]


def test_embedding_recovery():
    short = HashEmbedder(8, max_chars=100)
    text = " ".join(f"Sentence number {i} is here." for i in range(10))
    small = Settings(embedding_pause=0.0, part_chars=60)
    assert embed.embed_with_recovery(short, text, small) is not None
    assert embed.embed_with_recovery(HashEmbedder(8, max_chars=5), text, small) is None
    assert embed.weighted_mean([[1.0, 0.0], [0.0, 1.0]], [3, 1]) == [0.75, 0.25]


def test_verdicts(spark):
    def one(f, text):
        return spark.range(1).select(f(F.lit(text)).alias("v")).first().v

    assert [one(evaluate.relevance_verdict, t) for t in (" relevant", "NOT RELEVANT", "")] == ["RELEVANT", "NOT RELEVANT", "NOT RELEVANT"]
    assert one(lambda c: evaluate.relevance_verdict(c, True), "NOT RELEVANT") == "RELEVANT"
    assert [one(evaluate.recall_verdict, t) for t in ("yes UNANSWERABLE", "Yes", "?")] == ["UNANSWERABLE", "YES", "NO"]
    texts = ("Final Verdict: Faithful", "final verdict: unfaithful", "It is faithful", "It is unfaithful", "?")
    assert [one(evaluate.faithfulness_verdict, t) for t in texts] == [1, 0, 1, 0, -1]


EVAL = "query_id bigint, query_type string, query string, answer string, model_answer string, ret_precision double, ret_recall string, rouge_score double, faithfulness_verdict int, faithfulness_report string, traceable_context string"


def test_summary_edges(spark):
    def table(rows):
        return [r.Value for r in report.summary(spark.createDataFrame(rows, EVAL)).collect()]

    assert table([]) == ["4", "overlap", "0.0", "0.0", "0.0", "0.0", "0"]
    row = (1, "Unanswerable", "q", "a", "m", None, "UNANSWERABLE", 0.0, -1, "", "")
    assert table([row]) == ["4", "overlap", "0.0", "0.0", "0.0", "0.0", "1"]


def test_corpus_to_report(spark, tmp_path):
    raw = tmp_path / "raw" / "deep"
    raw.mkdir(parents=True)
    body = "CHAPTER I of logic\r\n\r\n" + "\r\n\r\n".join(f"Induction number {i} goes from cases to laws, as Mill taught in topic{i}. " * 4 for i in range(12))
    (raw / "a_book.txt").write_bytes(b"*** START OF IT ***" + body.encode() + b"\xff *** END OF IT ***")
    (raw / "b.TXT").write_text("ignored")
    docs = corpus.text_documents(spark, str(tmp_path / "raw"))
    assert [r.filename for r in docs.collect()] == ["a_book.txt"]
    assert "\r" not in docs.first().content
    assert corpus.text_documents(spark, str(tmp_path / "none")).count() == 0
    index = experiment.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "out"), settings=FAST)
    assert index.count() > 1
    asked = corpus.queries(spark, [{"query": "What is induction of topic3", "answer": "From cases to laws", "query_type": "Factual"}, {"query": "Quantum computers", "query_type": "Unanswerable"}, {"query": "x"}])
    done = experiment.run_experiment(asked, index, settings=FAST)
    rows = {r.query_id: r for r in done.collect()}
    assert len(rows) == 3 and rows[0].ret_precision > 0 and rows[1].rouge_score == 0.0
    run = sinks.write_report(done, str(tmp_path / "logs"), FAST)
    assert spark.read.parquet(f"{run}/Detailed_Trace").count() == 3
    assert [r.ID for r in spark.read.parquet(f"{run}/Detailed_Trace").orderBy("ID").collect()] == [1, 2, 3]


def test_gold_and_single(spark, tmp_path):
    (tmp_path / "g.csv").write_text("question_type,question\nFactual,What?\n,Why?\n")
    assert [tuple(r) for r in corpus.gold_questions(spark, str(tmp_path / "g.csv")).collect()] == [("Factual", "What?", ""), ("", "Why?", "")]
    with pytest.raises(ValueError):
        corpus.single_query(spark, " ")


def test_answers_skip(spark):
    asked = spark.createDataFrame([(1, "q")], "query_id bigint, query string")
    hits = spark.createDataFrame([], "query_id bigint, final_rank int, text string, source string")
    assert generate.answer(asked, hits, RuleChat, skip_without_hits=True).first().model_answer is None
    assert "could not find" in generate.answer(asked, hits, RuleChat).first().model_answer
    assert OverlapScorer().score([("a b", "b c"), ("", "x")]) == [0.5, 0.0]


@pytest.mark.parametrize("name", ["c.json", "c"])
def test_chunks_come_back(spark, tmp_path, name):
    rows = [(i, f"text {i}\nmore", 9, [i, i + 1], ("s", "p")) for i in range(10)]
    table = spark.createDataFrame(rows, schemas.CHUNK).repartition(3)
    sinks.write_chunks(table, str(tmp_path / name))
    assert sorted(corpus.chunks(spark, str(tmp_path / name)).collect()) == sorted(table.collect())
    masters = spark.createDataFrame([(0, "a", ("s", "p")), (1, "b", ("s", "p"))], schemas.MASTER_CHUNK)
    sinks.write_chunks(masters, str(tmp_path / ("m" + name)))
    assert sorted(corpus.masters(spark, str(tmp_path / ("m" + name))).collect()) == sorted(masters.collect())
    (tmp_path / "array.json").write_text('[{"chunk_id": 1, "text": "a"},\n {"chunk_id": 2, "text": "b"}]')
    assert [r.chunk_id for r in corpus.chunks(spark, str(tmp_path / "array.json")).orderBy("chunk_id").collect()] == [1, 2]


def test_failed_judges_are_counted_not_scored(spark):
    class Broken:
        def chat(self, system, user, schema=None):
            raise OSError("no model")

    hits = spark.createDataFrame([(1, "q", 1, "text", "s")], "query_id bigint, query string, final_rank int, text string, source string")
    judged = evaluate.judge_relevance(hits, Broken)
    assert judged.first().relevance is None
    asked = spark.createDataFrame([(1, "Factual", "q", "a", "m"), (2, "Factual", "q", "a", "m")], "query_id bigint, query_type string, query string, answer string, model_answer string")
    rows = {r.query_id: r for r in evaluate.audit(asked, judged, Broken).collect()}
    assert (rows[1].ret_precision, rows[1].ret_recall, rows[1].faithfulness_verdict, rows[1].judge_failures) == (None, None, None, 3)
    assert (rows[2].ret_precision, rows[2].judge_failures) == (0.0, 2)
    with pytest.raises(Exception, match="no model"):
        evaluate.judge_relevance(hits, Broken, strict=True).collect()


def test_every_role_has_its_model(spark, tmp_path):
    import json
    from functools import partial

    class Named:
        def __init__(self, name):
            self.name = name

        def chat(self, system, user, schema=None):
            with open(tmp_path / self.name, "a") as f:
                f.write(system[:9])
            return json.dumps({"queries": ["a"]}) if schema else "YES RELEVANT Final Verdict: Faithful"

    text = "Compare Mill and Bain on 'induction' and more words than ten of them in all here"
    chunks = spark.createDataFrame([(1, text, ("s", "p"))], "chunk_id bigint, text string, metadata struct<source:string,path:string>")
    index = experiment.keep(embed.build_index(chunks, HashEmbedder), "index")
    roles = experiment.Providers(decomposer=partial(Named, "d"), generator=partial(Named, "g"), retrieval_judge=partial(Named, "r"), answer_judge=partial(Named, "a"))
    asked = corpus.queries(spark, [{"query": text, "answer": "x", "query_type": "Factual"}])
    done = experiment.run_experiment(asked, index, roles, Settings(embedding_pause=0.0, threshold=-1.0, min_words=1))
    assert done.first().faithfulness_verdict == 1
    assert {p.name for p in tmp_path.iterdir()} == {"d", "g", "r", "a"}
    made = experiment.served("http://localhost:1", Settings(judge_model="j", embedding_timeout=7))
    assert (made.answer_judge().model, made.embedder().timeout) == ("j", 7)
    quiet = experiment.run_experiment(asked, index, roles, Settings(embedding_pause=0.0, threshold=-1.0, run_generation=False, run_audit=False))
    assert quiet.first().model_answer is None


def test_modes(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("CHAPTER I\n\n" + "\n\n".join(f"Induction {i} goes from cases to laws of thought. " * 5 for i in range(8)))
    out = str(tmp_path / "out")
    assert experiment.main(spark, "ingest", out, raw=str(tmp_path / "raw"), settings=FAST).count() > 0
    assert experiment.main(spark, "gen", out, query="What is induction", settings=FAST).first().model_answer
    assert experiment.main(spark, "eval", out, queries=[{"query": "What is induction"}], settings=FAST).count() == 1
    with pytest.raises(ValueError):
        experiment.main(spark, "other", out)
    done = experiment.run(spark, str(tmp_path / "raw"), out, [{"query": "What is induction"}], settings=Settings(embedding_pause=0.0, run_ingestion=True))
    assert done.count() == 1 and (tmp_path / "out" / "reports").exists()


def test_many_queries_meet_groups_of_rows(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(*(F.sin(F.col("id") % 250 * k).cast("float") for k in range(1, 5))).alias("embedding"))
    index = rows.withColumn("norm_embedding", embed.l2_normalize(F.col("embedding"))).repartition(5)
    asked = rows.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    few = [sorted(search.top_n(asked, index, 6, m).collect()) for m in ("base", "faiss")]
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "GROUP_ROWS", 70)
    assert [sorted(search.top_n(asked, index, 6, m).collect()) for m in ("base", "faiss")] == few


def test_batches(spark):
    class Batched(HashEmbedder):
        def embed_batch(self, texts):
            if len(texts) > 2 or "bad" in texts:
                raise ValueError
            return [self.embed(t) for t in texts]

    small = Settings(embedding_pause=0.0, embedding_batch=2)
    assert embed.embed_many(Batched(4), ["a", "b", "bad"], small) == [HashEmbedder(4).embed(t) for t in ("a", "b", "bad")]
    assert embed.parts_of("aa. " + "b" * 30 + ". c. d.", 10) == ["aa.", "b" * 30 + ".", "c. d."]


def test_search_holds_tiles_of_scores():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    def table(ids, vectors):
        return pa.table({"k": pa.array(ids), "v": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), vectors.shape[1]).cast(pa.list_(pa.float64()))})

    rng = np.random.default_rng(3)
    asked, rows = rng.normal(size=(4096, 4)), rng.normal(size=(10_000, 4))
    rows[5000:] = rows[:5000]
    scan = search._scan(SimpleNamespace(value=table(np.arange(4096), asked)), 3, True)
    batches = table(np.arange(10_000), rows).to_batches()
    tracemalloc.start()
    got = pa.Table.from_batches(list(scan(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128e6
    scores = np.round((asked[7] / np.linalg.norm(asked[7])) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T, search.DECIMALS)
    want = np.lexsort((np.arange(10_000), -scores))[:3].tolist()
    assert [k for q, k in zip(got["query_id"].to_pylist(), got["chunk_id"].to_pylist()) if q == 7] == want


def test_scores_that_are_no_numbers_displace_none(spark):
    rows = [(i, [float("nan"), 1.0] if i < 4 else [float(i), 1.0]) for i in range(12)]
    index = spark.createDataFrame(rows, "chunk_id bigint, norm_embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, query_embedding array<double>")
    assert [r.chunk_id for r in search.top_n(asked, index, 3).orderBy("rank").collect()] == [11, 10, 9]


def test_models_get_texts_in_lots(spark):
    import pandas as pd

    class Counting(HashEmbedder):
        def embed_batch(self, texts):
            if sum(map(len, texts)) > 1_200_000:
                raise MemoryError
            return [[float(len(t)), float(sum(map(len, texts)))] for t in texts]

    whole = Settings(embedding_pause=0.0, embedding_batch=1000)
    rows = spark.createDataFrame([(i, None if i == 3 else "a b " * 25_000) for i in range(30)], "i int, t string").coalesce(1)
    got = rows.select("i", embed.embed_column(F.col("t"), lambda: Counting(4), whole).alias("v")).orderBy("i").collect()
    assert [r.v and r.v[0] for r in got] == [None if i == 3 else 100_000.0 for i in range(30)]
    assert max(r.v[1] for r in got if r.v) <= 1_200_000
    assert [len(x) for x, _ in embed.lots(pd.Series(["a" * 700_000, "b" * 700_000, None]), pd.Series(["", None, ""]))] == [1, 2]
    scored = rows.select(F.col("t").alias("query"), F.lit("s").alias("source"), F.lit("a").alias("text"))
    assert merge.rerank(scored, OverlapScorer).where("relevance_score > 0").count() == 29
