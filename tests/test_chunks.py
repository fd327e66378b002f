from pyspark.sql import functions as F

from ragweave.operators import chunk, clean


def paras(spark, texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "path string, idx int, para string")


def left(df):
    return sorted(r.idx for r in df.collect())


def test_first_content(spark):
    lengths = [150, 150, 10, 20, 120, 130, 5]
    assert left(clean.seek_first_content(paras(spark, ["x" * n for n in lengths]))) == [2, 3, 4, 5, 6]
    assert left(clean.seek_first_content(paras(spark, ["a", "b"]))) == [0, 1]


def test_sections(spark):
    texts = ["x", "Chapter I", "keep", "Index", "drop", "Preface", "drop", "Book II", "keep"]
    assert left(clean.drop_sections(paras(spark, texts))) == [1, 2, 7, 8]
    assert left(clean.drop_sections(paras(spark, ["short", "short"]))) == []


def test_core_text_of_nothing(spark):
    docs = spark.createDataFrame([("d", "short")], "path string, content string")
    assert clean.core_text(docs).collect()[0].core == ""


def masters(spark, rows):
    return spark.createDataFrame([(i, t, (s, p)) for i, (t, s, p) in enumerate(rows)], "master_id bigint, text string, metadata struct<source:string,path:string>")


def packed(spark, rows, mode="clean"):
    return [(r.chunk_id, r.text, list(r.original_master_ids), r.metadata.path) for r in chunk.pack(masters(spark, rows), 800, mode).orderBy("chunk_id").collect()]


def test_packing(spark):
    giant = "g" * 5000
    got = packed(spark, [("a" * 600, "s", "1"), ("b" * 600, "s", "1"), (giant, "s", "1"), ("c" * 10, "s", "2"), ("d" * 10, "t", "3")])
    assert got == [(0, "a" * 600 + " " + "b" * 600, [0, 1], "1"), (1, giant, [2], "1"), (2, "c" * 10, [3], "2"), (3, "d" * 10, [4], "3")]


def test_split_point():
    assert chunk.split_at_sentence("aa. bb. cc.", 7) == ("aa. bb. cc.", "")
    assert chunk.split_at_sentence("x" * 30 + ". b.", 10) == ("x" * 30 + ".", "b.")
    assert chunk.split_at_sentence("a. " + "x" * 30 + ".", 10) == ("a.", "x" * 30 + ".")


def test_overlap_prefix(spark):
    def prefix(prev):
        return spark.range(1).select(chunk.overlap_prefix(F.lit(prev), 1200).alias("p")).first().p

    assert prefix("x" * 73 + ". " + "y" * 24 + ".") == "y" * 24 + "."
    assert prefix("x" * 58 + ". " + "y" * 39 + ".") == "y" * 39 + "."
    assert prefix("x" * 297 + ". " + "y" * 700 + ".") is None


def test_overlap_stays_within_a_source(spark):
    rows = [("First one here. " + "x" * 900 + ". Tail.", "s", "1"), ("y" * 900 + ".", "s", "1"), ("z" * 900 + ".", "t", "2")]
    got = packed(spark, rows, "overlap")
    assert got[1][1] == "Tail. " + "y" * 900 + "."
    assert got[2][1] == "z" * 900 + "."


def test_dense_ids(spark):
    rows = spark.range(1000).select(F.col("id").alias("x"), F.format_string("%03d", (F.col("id") / 7).cast("int")).alias("g"), (F.col("id") % 7).alias("place")).repartition(5)
    got = chunk.dense_ids(rows, "g", "place", "n").collect()
    assert all(r.x == r.n for r in got) and len(got) == 1000
    assert chunk.dense_ids(rows.where("x < 0"), "g", "place", "n").count() == 0


def test_stats_of_nothing(spark):
    r = chunk.chunk_stats(spark.createDataFrame([], "text string")).first()
    assert (r.n_chunks, r.mean_size) == (0, None)


def test_sources_are_packed_as_they_stream():
    import pyarrow as pa

    from ragweave.operators import chunk

    texts = [(f"p{i:03d}", "s", n, f"Sentence {i} of {n}. " * (1 + (i + n) % 5)) for i in range(40) for n in range(i % 7)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("path", "source", "master_id", "text"), r)) for r in texts[a : a + 9]]) for a in range(0, len(texts), 9)]
    got = [r for b in chunk._packer(80, 120, chunk.rule_sentences)(iter(batches)) for r in b.to_pylist()]
    want = [(p, n, c, m) for p in dict.fromkeys(t[0] for t in texts) for n, (c, m) in enumerate(chunk.pack_rows([(t[2], t[3]) for t in texts if t[0] == p], 80, 120))]
    assert [(r["path"], r["n"], r["core"], r["ids"]) for r in got] == want


def test_packing_calls_no_function_for_each_source(spark):
    from ragweave.operators import chunk

    plans = []
    keep, chunk.tables.keep = chunk.tables.keep, lambda df, name: plans.append(df._jdf.queryExecution().toString()) or df
    try:
        masters = spark.createDataFrame([(0, "A b. C d.", ("s", "p"))], "master_id bigint, text string, metadata struct<source:string,path:string>")
        chunk.pack(masters, 10)
    finally:
        chunk.tables.keep = keep
    assert "FlatMapGroupsInPandas" not in plans[0]
