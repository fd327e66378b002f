from ragweave.plans.config import Settings
from ragweave.streaming import ingest


def body(word):
    return "CHAPTER I of logic\n\n" + "\n\n".join(f"{word} number {i} goes from cases to laws, as is taught in topic{i}. " * 4 for i in range(12))


def test_new_files_are_added_once(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    settings = Settings(embedding_pause=0.0)
    assert ingest.index(spark, out).count() == 0
    counts = []
    for name in ("a", "b"):
        (raw / f"{name}.txt").write_text(body(name))
        ingest.stream_corpus(spark, str(raw), out, settings=settings).awaitTermination()
        counts.append(ingest.index(spark, out).count())
    ids = sorted(r.chunk_id for r in ingest.index(spark, out).collect())
    assert 0 < counts[0] < counts[1] and ids == list(range(counts[1]))
    ingest.stream_corpus(spark, str(raw), out, settings=settings).awaitTermination()
    assert ingest.index(spark, out).count() == counts[1]
