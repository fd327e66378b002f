"""Registered queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragweave.functions import text as T
from ragweave.operators import chunk, clean, embed, evaluate, generate, merge, report, route, search
from ragweave.plans import experiment
from ragweave.plans.config import BRIDGES, CONCEPTS, THINKERS, Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Search. Vectors with ids divisible by 50 ask; scores are rounded for comparison.

_INDEX = "index_rows AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_SCORED = f"""{_INDEX},
    scored AS (
        SELECT q.chunk_id AS query_id, i.chunk_id, list_inner_product(q.v, i.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(i.v, i.v)) AS score
        FROM index_rows q JOIN index_rows i ON q.chunk_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", embed.l2_normalize(F.col("embedding")).alias("norm_embedding"))


def _asked(index: DataFrame) -> DataFrame:
    return index.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _hits(spark: SparkSession, sf_dir: str, method: str, n: int = 100) -> DataFrame:
    index = _index(spark, sf_dir)
    return search.top_n(_asked(index), index, n, method)


_TOP = f"WITH {_SCORED} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 100"


@query(_TOP)
def knn_topn_cosine(spark, sf_dir):
    return _hits(spark, sf_dir, "base").withColumn("score", F.round("score", 6))


@query(_TOP)
def knn_topn_ip(spark, sf_dir):
    return _hits(spark, sf_dir, "faiss").withColumn("score", F.round("score", 6))




class _Template(str):
    """SQL in which {0} stands for a text expression."""

    def format(self, value: str) -> str:
        return self.replace("{0}", value)


_WORDS = _Template(r"len(list_filter(regexp_split_to_array({0}, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'), lambda w: w <> ''))")


@query(f"""WITH {_SCORED},
    kept AS (
        SELECT r.*, d.text, d.source FROM ranked r JOIN documents d ON d.doc_id = r.chunk_id
        WHERE rank <= 100 AND score > 0.2 AND {_WORDS.format('d.text')} > 10),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS final_rank FROM kept)
    SELECT query_id, final_rank, chunk_id, round(score, 6) AS score, source FROM final WHERE final_rank <= 3""")
def hits_filtered(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    kept = search.filter_hits(search.with_text(_hits(spark, sf_dir, "faiss"), texts), 0.2, 10)
    final = merge.first_k(kept.withColumn("relevance_score", F.col("score")), 3)
    return final.select("query_id", "final_rank", "chunk_id", F.round("score", 6).alias("score"), "source")


@query(f"""WITH {_SCORED},
    lists AS (
        SELECT query_id - query_id % 150 AS query_id, CAST(query_id % 150 // 50 AS INTEGER) AS sub_idx, chunk_id, score, rank FROM ranked WHERE rank <= 10),
    deep AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_idx ORDER BY score DESC, rank) AS depth FROM lists),
    once AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY depth, sub_idx) AS n FROM deep),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth, sub_idx) AS INTEGER) AS final_rank FROM once WHERE n = 1)
    SELECT query_id, final_rank, sub_idx, chunk_id FROM final WHERE final_rank <= 8""")
def round_robin_merge(spark, sf_dir):
    hits = _hits(spark, sf_dir, "faiss", 10)
    lists = hits.select((F.col("query_id") - F.col("query_id") % 150).alias("query_id"), (F.col("query_id") % 150 / 50).cast("int").alias("sub_idx"), "chunk_id", F.col("score").alias("relevance_score"), "rank")
    return merge.round_robin(lists, 8).select("query_id", "final_rank", "sub_idx", "chunk_id")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM v, unnest(range(1, len(v) + 1)) t(i)""")
def l2_normalize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(embed.l2_normalize(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""WITH v AS (SELECT vec_id // 4 AS grp, vec_id % 4 + 1 AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT grp, CAST(i - 1 AS INTEGER) AS pos, round(sum(w * v[i]) / sum(w), 6) AS x FROM v, unnest(range(1, len(v) + 1)) t(i) GROUP BY grp, i""")
def weighted_mean_pool(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / 4).cast("long").alias("grp"), (F.col("vec_id") % 4 + 1).alias("weight"), "embedding")
    return embed.mean_pool(e, "grp").select("grp", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Text functions.

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_NORM = _Template(rf"trim(regexp_replace({{0}}, '{_SPACE}', ' ', 'g'))")
_STRIP = _Template(rf"regexp_replace(regexp_replace({{0}}, '^{_SPACE}', ''), '{_SPACE}$', '')")
_JOIN = _Template(r"regexp_replace(regexp_replace({0}, '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g'), '(^|[^\n])\n([^\n]|$)', '\1 \2', 'g')")


@query(f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_JOIN.format('text')} AS text FROM documents")
def join_wrapped_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.join_wrapped_lines(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_WORDS.format('text')} AS n_words FROM documents")
def word_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("SELECT doc_id, replace(replace(source || '_part_one.txt', '_', ' '), '.txt', '') AS title FROM documents")
def source_prettify(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.source_title(F.concat("source", F.lit("_part_one.txt"))).alias("title"))


_MARKED = """CASE doc_id % 4 WHEN 0 THEN 'Licence' || chr(10) || '*** START OF THIS BOOK ***' || text || '*** END OF THIS BOOK ***' || ' tail'
    WHEN 1 THEN '*** start of it ***' || text WHEN 2 THEN text || '*** END OF X ***' || text ELSE '*** END OF Y ***' || text || '*** START OF Z ***' END"""


@query(rf"""WITH m AS (SELECT doc_id, {_JOIN.format(_MARKED)} AS t FROM documents),
    p AS (SELECT doc_id, t, regexp_extract(t, '(?i)\*\*\* START OF[^\n]*?\*\*\*') AS s, regexp_extract(t, '(?i)\*\*\* END OF[^\n]*?\*\*\*') AS e FROM m),
    q AS (SELECT doc_id, t, CASE WHEN s = '' THEN 1 ELSE instr(t, s) + length(s) END AS a, CASE WHEN e = '' THEN length(t) + 1 ELSE instr(t, e) END AS b FROM p)
    SELECT doc_id, {_STRIP.format('substr(t, a, greatest(b - a, 0))')} AS text FROM q""")
def boilerplate_trim(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("content", F.expr(_MARKED))
    return d.select("doc_id", T.trim_boilerplate(F.col("content")).alias("text"))


_TOC = "CASE doc_id % 4 WHEN 0 THEN text || 'TABLE OF CONTENTS' || text || 'CONTENTS' || text WHEN 1 THEN 'CONTENTS' || text || 'CONTENTS' || text WHEN 2 THEN 'contents' || text ELSE 'TABLE OF CONTENTS a TABLE OF CONTENTS' || text END"


@query(f"""WITH m AS (SELECT doc_id, {_TOC} AS t FROM documents),
    k AS (SELECT *, CASE WHEN contains(t, 'TABLE OF CONTENTS') THEN 'TABLE OF CONTENTS' WHEN contains(t, 'CONTENTS') THEN 'CONTENTS' END AS m FROM m)
    SELECT doc_id, CASE WHEN m IS NULL THEN t ELSE substr(t, length(t) - instr(reverse(t), reverse(m)) - length(m) + 2) END AS text FROM k""")
def toc_slice(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("t", F.expr(_TOC)).select("doc_id", T.contents_slice(F.col("t")).alias("text"))


_HEADED = "CASE doc_id % 7 WHEN 0 THEN 'Chapter in which ' WHEN 1 THEN 'PROP. 3 ' WHEN 2 THEN 'Chapter on ' WHEN 3 THEN 'Problems of ' WHEN 4 THEN 'book xv ' WHEN 5 THEN 'Index ' ELSE '' END || text"


@query(rf"""SELECT doc_id, regexp_matches({_HEADED}, '(?i)^(BOOK|CHAPTER|SECTION|PROP\.){_SPACE}[IVXLCDM\d]+') AS heading,
    regexp_matches(upper({_HEADED}), '^(CONTENTS|TABLE OF CONTENTS|PREFACE|INDEX|QUESTIONS|EXERCISES|PROBLEMS|APPENDIX|BIBLIOGRAPHY|REFERENCES)') AS removed FROM documents""")
def heading_flags(spark, sf_dir):
    p = read(spark, sf_dir, "documents").withColumn("p", F.expr(_HEADED))
    return p.select("doc_id", T.is_heading(F.col("p")).alias("heading"), T.is_removed_heading(F.col("p")).alias("removed"))


@query(rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, b[i] AS block FROM (
    SELECT doc_id, string_split(regexp_replace(text || chr(10) || 'Chapter one' || chr(10) || text || chr(10) || 'book ' || text, '(?i)\n((BOOK|CHAPTER|SECTION|PROP\.){_SPACE})', chr(1) || '\1', 'g'), chr(1)) AS b FROM documents), unnest(range(1, len(b) + 1)) t(i)""")
def structural_split(spark, sf_dir):
    t = F.concat("text", F.lit("\nChapter one\n"), "text", F.lit("\nbook "), "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.structural_split(t)).alias("idx", "block"))


_SENTENCES = _Template(r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, s[i] AS sentence FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents), unnest(range(1, len(s) + 1)) t(i)")
def sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents),
    walk AS (
        SELECT doc_id, 1 AS i, s, CAST('' AS VARCHAR) AS buf, CAST([] AS VARCHAR[]) AS done FROM s
        UNION ALL
        SELECT doc_id, i + 1, s, CASE WHEN length(buf) + length(s[i]) <= 1200 THEN trim(CASE WHEN buf = '' THEN s[i] ELSE buf || ' ' || s[i] END) ELSE s[i] END,
            CASE WHEN length(buf) + length(s[i]) <= 1200 OR buf = '' THEN done ELSE list_append(done, buf) END FROM walk WHERE i <= len(s)),
    parts AS (SELECT doc_id, CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END AS p FROM walk WHERE i = len(s) + 1)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS part, p[i] AS text FROM parts, unnest(range(1, len(p) + 1)) t(i)""")
def split_large_paragraph(spark, sf_dir):
    parts = T.fold_sentences(T.sentences(F.col("text")), 1200)
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("part", "text"))


@query()
def sub_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sub_chunks(F.col("text"))).alias("part", "text"))


# Cleaning: line ends become blank lines and headings are put in, as the test documents have no structure.

_STRUCTURED = "replace(replace(text, chr(10), chr(10) || chr(10)), '. The ', '.' || chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'CHAPTER IV ' WHEN 1 THEN 'Appendix ' ELSE 'Section on ' END)"
_FIRST = f"""p AS (SELECT doc_id, unnest(range(0, len(a))) AS idx, unnest(a) AS para FROM (SELECT doc_id, string_split({_STRUCTURED}, chr(10) || chr(10)) AS a FROM documents)),
    f AS (SELECT *, CASE WHEN idx >= 2 AND length(para) > 100 AND lead(length(para)) OVER (PARTITION BY doc_id ORDER BY idx) > 100 THEN idx END AS hit FROM p),
    g AS (SELECT doc_id, idx, para, coalesce(min(hit) OVER (PARTITION BY doc_id) - 2, 0) AS start FROM f)"""
_SECTIONS = _Template(rf"""n AS (SELECT doc_id, idx, {_NORM.format('para')} AS para FROM {{0}}),
    e AS (SELECT *, regexp_matches(para, '(?i)^(BOOK|CHAPTER|SECTION|PROP\.){_SPACE}[IVXLCDM\d]+') AS h,
        regexp_matches(upper(para), '^(CONTENTS|TABLE OF CONTENTS|PREFACE|INDEX|QUESTIONS|EXERCISES|PROBLEMS|APPENDIX|BIBLIOGRAPHY|REFERENCES)') AS b FROM n WHERE para <> ''),
    fr AS (SELECT *, min(CASE WHEN h OR length(para) > 200 THEN idx END) OVER (PARTITION BY doc_id) AS front FROM e),
    st AS (SELECT *, last_value(CASE WHEN b THEN 'B' WHEN h THEN 'S' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS state FROM fr WHERE idx >= front),
    kept AS (SELECT doc_id, idx, para FROM st WHERE coalesce(state, '-') <> 'B')""")


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(_STRUCTURED).alias("content"))


@query(f"WITH {_FIRST} SELECT doc_id, CAST(idx AS INTEGER) AS idx, para FROM g WHERE idx >= start")
def first_content(spark, sf_dir):
    return clean.seek_first_content(clean.explode_paragraphs(_structured(spark, sf_dir), "doc_id"), "doc_id")


@query(f"WITH {_FIRST}, {_SECTIONS.format('p')} SELECT doc_id, CAST(idx AS INTEGER) AS idx, para FROM kept")
def section_removal(spark, sf_dir):
    return clean.drop_sections(clean.normalize_paragraphs(clean.explode_paragraphs(_structured(spark, sf_dir), "doc_id")), "doc_id")


_CORE = f"{_FIRST}, s0 AS (SELECT doc_id, idx, para FROM g WHERE idx >= start), {_SECTIONS.format('s0')}"


@query(f"""WITH {_CORE} SELECT d.doc_id, coalesce(c.core, '') AS core FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY idx) AS core FROM kept GROUP BY doc_id) c ON c.doc_id = d.doc_id""")
def preprocess_core(spark, sf_dir):
    return clean.core_text(_structured(spark, sf_dir), "doc_id")


# Chunks. Documents are one file each, in path order.


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.format_string("%010d", "doc_id").alias("path"), F.concat("source", F.lit(".txt")).alias("filename"), F.expr("replace(text, chr(10), chr(10) || chr(10))").alias("content"))


_FOLDED = """walk AS (
        SELECT path, idx, 1 AS i, s, CAST('' AS VARCHAR) AS buf, CAST([] AS VARCHAR[]) AS done FROM long_ones
        UNION ALL
        SELECT path, idx, i + 1, s, CASE WHEN length(buf) + length(s[i]) <= 1200 THEN trim(CASE WHEN buf = '' THEN s[i] ELSE buf || ' ' || s[i] END) ELSE s[i] END,
            CASE WHEN length(buf) + length(s[i]) <= 1200 OR buf = '' THEN done ELSE list_append(done, buf) END FROM walk WHERE i <= len(s)),
    folded AS (SELECT path, idx, CASE WHEN buf = '' THEN done ELSE list_append(done, buf) END AS p FROM walk WHERE i = len(s) + 1)"""
_MASTERS = rf"""docs AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS path, source || '.txt' AS source, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
    trimmed AS (SELECT path, source, {_STRIP.format('t')} AS t FROM (SELECT path, source, {_JOIN.format('t')} AS t FROM docs)),
    marked AS (SELECT *, CASE WHEN contains(t, 'TABLE OF CONTENTS') THEN 'TABLE OF CONTENTS' WHEN contains(t, 'CONTENTS') THEN 'CONTENTS' END AS m FROM trimmed),
    sliced AS (SELECT path, source, CASE WHEN m IS NULL THEN t ELSE substr(t, length(t) - instr(reverse(t), reverse(m)) - length(m) + 2) END AS t FROM marked),
    p AS (SELECT path AS doc_id, unnest(range(0, len(a))) AS idx, unnest(a) AS para FROM (SELECT path, string_split(t, chr(10) || chr(10)) AS a FROM sliced)),
    f AS (SELECT *, CASE WHEN idx >= 2 AND length(para) > 100 AND lead(length(para)) OVER (PARTITION BY doc_id ORDER BY idx) > 100 THEN idx END AS hit FROM p),
    g AS (SELECT doc_id, idx, para, coalesce(min(hit) OVER (PARTITION BY doc_id) - 2, 0) AS start FROM f),
    s0 AS (SELECT doc_id, idx, para FROM g WHERE idx >= start), {_SECTIONS.format('s0')},
    long_ones AS (SELECT doc_id AS path, idx, {_SENTENCES.format('para')} AS s FROM kept WHERE length(para) > 1200),
    {_FOLDED},
    parts AS (SELECT path, idx, i AS part, p[i] AS text FROM folded, unnest(range(1, len(p) + 1)) t(i) UNION ALL SELECT doc_id, idx, 1, para FROM kept WHERE length(para) <= 1200),
    masters AS (SELECT row_number() OVER (ORDER BY path, idx, part) - 1 AS master_id, text, source, path, row_number() OVER (PARTITION BY path ORDER BY idx, part) AS pos FROM parts JOIN docs USING (path))"""
_REACH = "list_transform(range(1, len(s) + 1), lambda j: length(s[j]) + greatest(0, coalesce(list_sum(list_transform(s[1:j - 1], lambda x: length(x) + 1)), 0) - 1))"
#: Packing: one row for each source walks over its master chunks; a chunk that is too short is split between sentences.
_PACKED = f"""steps AS (
        SELECT path, 1 AS i, CAST('' AS VARCHAR) AS buf, CAST([] AS BIGINT[]) AS ids, CAST([] AS STRUCT(core VARCHAR, ids BIGINT[])[]) AS done FROM masters WHERE pos = 1
        UNION ALL
        SELECT path, i + 1, CASE WHEN fits THEN joined WHEN filled THEN text ELSE array_to_string(s[cut + 1:], ' ') END,
            CASE WHEN fits THEN list_append(ids, master_id) WHEN filled THEN [master_id] WHEN cut < len(s) THEN [master_id] ELSE [] END,
            CASE WHEN fits THEN done WHEN filled THEN list_append(done, {{'core': buf, 'ids': ids}}) ELSE list_append(done, {{'core': array_to_string(s[1:cut], ' '), 'ids': list_append(ids, master_id)}}) END
        FROM (SELECT *, CASE WHEN inside < len(s) AND (r[inside + 1] <= 2400 OR inside = 0) THEN inside + 1 ELSE inside END AS cut
            FROM (SELECT *, len(list_filter(r, lambda x: x <= 1200)) AS inside
            FROM (SELECT *, {_REACH} AS r
            FROM (SELECT *, CASE WHEN fits OR filled THEN [] ELSE list_transform({_SENTENCES.format('joined')}, lambda x: trim(x)) END AS s
            FROM (SELECT w.path, w.i, w.buf, w.ids, w.done, m.text, m.master_id, length(w.buf) + length(m.text) <= 1200 AS fits, length(w.buf) >= 800 AS filled, CASE WHEN w.buf = '' THEN m.text ELSE w.buf || ' ' || m.text END AS joined
                FROM steps w JOIN masters m ON m.path = w.path AND m.pos = w.i)))))),
    ends AS (SELECT path, CASE WHEN buf = '' THEN done ELSE list_append(done, {{'core': buf, 'ids': ids}}) END AS c, i, max(i) OVER (PARTITION BY path) AS top FROM steps),
    cores AS (SELECT path, n, c[n].core AS core, c[n].ids AS ids FROM ends, unnest(range(1, len(c) + 1)) t(n) WHERE i = top)"""
_CHUNKS = _Template("""SELECT row_number() OVER (ORDER BY path, n) - 1 AS chunk_id, text, CAST(length(text) AS INTEGER) AS size, array_to_string(ids, ',') AS master_ids, source, path
    FROM ({0}) JOIN docs USING (path)""")
_SUFFIX = "len(list_filter(range(1, len(s) + 1), lambda k: list_sum(list_transform(s[len(s) - k + 1:], lambda x: length(x) + 1)) <= floor(length(prev) * 0.3D)))".replace("0.3D", "CAST(0.3 AS DOUBLE)")
_OVERLAPPED = f"""SELECT path, n, ids, CASE WHEN prev IS NULL THEN core WHEN k > 0 THEN trim(array_to_string(s[len(s) - k + 1:], ' ') || ' ' || core) WHEN length(s[len(s)]) < 600 THEN trim(s[len(s)] || ' ' || core) ELSE core END AS text
    FROM (SELECT *, {_SUFFIX} AS k FROM (SELECT *, {_SENTENCES.format('prev')} AS s FROM (SELECT *, lag(core) OVER (PARTITION BY path ORDER BY n) AS prev FROM cores)))"""


def _masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.master_chunks(_files(spark, sf_dir))


@query(f"WITH RECURSIVE {_MASTERS} SELECT master_id, text, source, path FROM masters")
def master_chunks(spark, sf_dir):
    return _masters(spark, sf_dir).select("master_id", "text", "metadata.source", "metadata.path")


def _packed(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    packed = chunk.pack(_masters(spark, sf_dir), 800, mode)
    return packed.select("chunk_id", "text", "size", F.array_join("original_master_ids", ",").alias("master_ids"), "metadata.source", "metadata.path")


@query(f"WITH RECURSIVE {_MASTERS}, {_PACKED} {_CHUNKS.format('SELECT path, n, ids, core AS text FROM cores')}")
def pack_clean(spark, sf_dir):
    return _packed(spark, sf_dir, "clean")


@query(f"WITH RECURSIVE {_MASTERS}, {_PACKED} {_CHUNKS.format(_OVERLAPPED)}")
def pack_overlap(spark, sf_dir):
    return _packed(spark, sf_dir, "overlap")


@query(f"WITH RECURSIVE {_MASTERS} SELECT count(*) AS n_chunks, round(avg(length(text)), 2) AS mean_size, CAST(max(length(text)) AS INTEGER) AS max_size, CAST(min(length(text)) AS INTEGER) AS min_size FROM masters")
def chunk_stats(spark, sf_dir):
    return chunk.chunk_stats(_masters(spark, sf_dir))


# Routing.

_ASKED = "CASE turn % 5 WHEN 0 THEN 'Compare Mill and Bain on \"induction\". ' WHEN 1 THEN 'How do Jevons, De Morgan and Venn differ on the syllogism vs ''axioms''? ' WHEN 2 THEN 'What is a premise? ' ELSE '' END || text"


def _stems(words, column):
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w}') AS INTEGER)" for w in words) + ")"


_COMPLEX = _Template(f"""{_stems(THINKERS, '{0}')} AS thinker_count, {_stems(CONCEPTS, '{0}')} AS concept_count, CASE WHEN {_stems(BRIDGES, '{0}')} > 0 THEN 2 ELSE 0 END AS bridge_score,
        CASE WHEN regexp_matches({{0}}, '["''][^\\n]*?["'']') THEN 1 ELSE 0 END AS artifact_score""")


@query(f"""WITH q AS (SELECT conv_id, turn, {_ASKED} AS q FROM conversations), c AS (SELECT conv_id, turn, {_COMPLEX.format('q')} FROM q)
    SELECT *, thinker_count + concept_count + bridge_score + artifact_score AS total_score FROM c""")
def complexity_score(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ASKED).alias("q"))
    return asked.select("conv_id", "turn", route.complexity(F.col("q")).alias("c")).select("conv_id", "turn", "c.*")


_REPLY = "CASE turn % 4 WHEN 0 THEN '{\"queries\": [\"a\", \"b\", \"c\", \"d\"]}' WHEN 1 THEN 'no json' WHEN 2 THEN '{\"other\": 1}' ELSE '{\"queries\": []}' END"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a|b|c' WHEN 3 THEN '' ELSE text END AS sub_queries FROM conversations")
def decompose_parse(spark, sf_dir):
    parsed = route.parse_decomposition(F.expr(_REPLY), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(parsed, "|").alias("sub_queries"))


# Evaluation: user turns are references, the turns after them answers.

_PAIRS = "pairs AS (SELECT a.conv_id, a.turn, a.text AS ref, b.text AS ans FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ans"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref")).join(b, ["conv_id", "turn"])


@query(rf"""WITH {_PAIRS},
    t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(ref), '[^a-z0-9]+'), lambda w: w <> '') AS r, list_filter(regexp_split_to_array(lower(ans), '[^a-z0-9]+'), lambda w: w <> '') AS a FROM pairs),
    l AS (SELECT *, CASE WHEN len(r) = 0 OR len(a) = 0 THEN 0 ELSE list_last(list_reduce(a,
        lambda row, w: list_reduce(list_transform(range(1, len(r) + 1), lambda i: [i]), lambda acc, i: list_append(acc, CASE WHEN r[i[1]] = w THEN row[i[1]] + 1 ELSE greatest(row[i[1] + 1], list_last(acc)) END), [CAST(0 AS BIGINT)]),
        list_transform(range(0, len(r) + 1), lambda i: CAST(0 AS BIGINT)))) END AS lcs FROM t)
    SELECT conv_id, turn, round(CASE WHEN lcs = 0 THEN 0.0 ELSE 2.0 * lcs / (len(r) + len(a)) END, 6) AS rouge FROM l""")
def rouge_l(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(evaluate.rouge_l(F.col("ref"), F.col("ans"), False), 6).alias("rouge"))


@query()
def rouge_l_stemmed(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(evaluate.rouge_l(F.col("ref"), F.col("ans")), 6).alias("rouge"))


_JUDGED = "CASE turn % 6 WHEN 0 THEN ' relevant' WHEN 1 THEN 'NOT RELEVANT' WHEN 2 THEN 'Final Verdict: Faithful but unfaithful' WHEN 3 THEN 'yes, UNANSWERABLE' WHEN 4 THEN 'Yes. unfaithful' ELSE text END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_JUDGED} AS reply FROM conversations)
    SELECT conv_id, turn, CASE WHEN NOT contains(upper(reply), 'NOT RELEVANT') AND contains(upper(reply), 'RELEVANT') THEN 'RELEVANT' ELSE 'NOT RELEVANT' END AS verdict,
        CASE WHEN contains(upper(reply), 'RELEVANT') THEN 'RELEVANT' ELSE 'NOT RELEVANT' END AS compat FROM r""")
def verdict_relevance(spark, sf_dir):
    reply = F.expr(_JUDGED)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.relevance_verdict(reply).alias("verdict"), evaluate.relevance_verdict(reply, True).alias("compat"))


@query(f"""WITH r AS (SELECT conv_id, turn, upper({_JUDGED}) AS reply FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(reply, 'UNANSWERABLE') THEN 'UNANSWERABLE' WHEN contains(reply, 'YES') THEN 'YES' ELSE 'NO' END AS verdict FROM r""")
def verdict_recall(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.recall_verdict(F.expr(_JUDGED)).alias("verdict"))


@query(f"""WITH r AS (SELECT conv_id, turn, lower({_JUDGED}) AS reply FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(reply, 'final verdict: faithful') THEN 1 WHEN contains(reply, 'final verdict: unfaithful') THEN 0
        WHEN contains(reply, 'unfaithful') THEN 0 WHEN contains(reply, 'faithful') THEN 1 ELSE -1 END AS verdict FROM r""")
def verdict_faithful(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.faithfulness_verdict(F.expr(_JUDGED)).alias("verdict"))


@query("SELECT conv_id, turn, contains(lower(CASE turn % 3 WHEN 0 THEN 'Sorry, I Could Not Find it. ' ELSE '' END || text), 'could not find') AS refused FROM conversations")
def refusal_check(spark, sf_dir):
    said = F.expr("CASE turn % 3 WHEN 0 THEN 'Sorry, I Could Not Find it. ' ELSE '' END || text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", evaluate.refused(said).alias("refused"))


@query(f"""WITH {_SCORED},
    judged AS (SELECT query_id, coalesce(l.quality, 0) AS q FROM ranked LEFT JOIN labels l ON l.doc_id = chunk_id WHERE rank <= 10 AND score > 0.2)
    SELECT i.chunk_id AS query_id, round(coalesce(avg(judged.q), 0.0), 6) AS ret_precision FROM index_rows i LEFT JOIN judged ON judged.query_id = i.chunk_id WHERE i.chunk_id % 50 = 0 GROUP BY i.chunk_id""")
def precision_at_k(spark, sf_dir):
    hits = _hits(spark, sf_dir, "faiss", 10).where("score > 0.2")
    good = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    judged = hits.join(good, "chunk_id", "left").withColumn("relevance", F.when(F.col("quality") == 1, "RELEVANT").otherwise("NOT RELEVANT"))
    found = evaluate.precision_at_k(_asked(_index(spark, sf_dir)), judged)
    return found.withColumn("ret_precision", F.round("ret_precision", 6))


_EVALUATED = """SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 0 THEN 'Factual' WHEN 1 THEN 'Cross-concept' ELSE 'Unanswerable' END AS query_type, source AS query, lang AS answer, text AS model_answer,
    CASE WHEN doc_id % 10 = 9 THEN NULL ELSE (doc_id % 4) / 3.0D END AS ret_precision, CASE doc_id % 5 WHEN 0 THEN 'UNANSWERABLE' WHEN 1 THEN 'NO' WHEN 2 THEN NULL ELSE 'YES' END AS ret_recall,
    CASE WHEN doc_id % 11 = 3 THEN NULL ELSE n_chars % 100 / 100.0D END AS rouge_score, CAST(CASE doc_id % 4 WHEN 0 THEN -1 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS faithfulness_verdict,
    source AS faithfulness_report, lang AS traceable_context FROM documents"""
_EVAL_SQL = _EVALUATED.replace("3.0D", "CAST(3 AS DOUBLE)").replace("100.0D", "CAST(100 AS DOUBLE)")
_AVERAGES = f"""SELECT coalesce(avg(coalesce(ret_precision, 0)), 0.0) AS p, coalesce(avg(CASE WHEN ret_recall = 'YES' THEN 1.0 ELSE 0.0 END) FILTER (WHERE ret_recall IS DISTINCT FROM 'UNANSWERABLE'), 0.0) AS r,
    coalesce(avg(coalesce(faithfulness_verdict, 0)) FILTER (WHERE coalesce(faithfulness_verdict, 0) <> -1), 0.0) AS f, coalesce(avg(coalesce(rouge_score, 0)), 0.0) AS l,
    coalesce(avg(coalesce(rouge_score, 0)) FILTER (WHERE NOT contains(lower(query_type), 'unanswerable')), 0.0) AS a, count(*) AS n FROM ({_EVAL_SQL})"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EVALUATED.replace("FROM documents", "FROM {documents}"), documents=read(spark, sf_dir, "documents"))


@query(f"SELECT round(p, 6) AS avg_precision, round(r, 6) AS avg_recall, round(f, 6) AS avg_faithfulness, round(l, 6) AS avg_rouge, round(a, 6) AS avg_rouge_answerable, n AS n_queries FROM ({_AVERAGES})")
def experiment_averages(spark, sf_dir):
    a = evaluate.averages(_evaluated(spark, sf_dir))
    return a.select(*(F.round(c, 6).alias(c) for c in a.columns[:-1]), "n_queries")


@query(f"""WITH a AS ({_AVERAGES}), s AS (
        SELECT 'Iteration' AS Metric, 4.0 AS Value FROM a UNION ALL SELECT 'Avg Precision@K', p FROM a UNION ALL SELECT 'Avg Recall', r FROM a
        UNION ALL SELECT 'Avg Faithfulness (1=Strict)', f FROM a UNION ALL SELECT 'Avg ROUGE-L', l FROM a UNION ALL SELECT 'Total Queries', n FROM a)
    SELECT Metric, round(CAST(Value AS DOUBLE), 6) AS Value, CASE WHEN Metric = 'Iteration' THEN '4' END AS setting FROM s UNION ALL SELECT 'Chunking Mode', NULL, 'overlap' FROM a""")
def experiment_summary(spark, sf_dir):
    s = report.summary(_evaluated(spark, sf_dir), Settings())
    return s.select("Metric", F.round(F.expr("try_cast(Value AS DOUBLE)"), 6).alias("Value"), F.expr("CASE WHEN Metric IN ('Iteration', 'Chunking Mode') THEN Value END").alias("setting"))


@query(f"""SELECT row_number() OVER (ORDER BY query_id) AS "ID", query AS "Question", answer AS "Reference", model_answer AS "Model Answer", ret_recall AS "Recall Verdict", rouge_score AS "ROUGE-L",
    faithfulness_verdict AS "Faithfulness Verdict", faithfulness_report AS "Audit Report (Raw)", traceable_context AS "Sources Used" FROM ({_EVAL_SQL})""")
def experiment_detail(spark, sf_dir):
    return report.detail(_evaluated(spark, sf_dir))


@query(f"SELECT query_type, count(*) AS n_queries, round(avg(coalesce(rouge_score, 0)), 6) AS avg_rouge FROM ({_EVAL_SQL}) GROUP BY query_type")
def rouge_by_type(spark, sf_dir):
    return evaluate.rouge_by_type(_evaluated(spark, sf_dir)).withColumn("avg_rouge", F.round("avg_rouge", 6))


@query(f"SELECT query_id, rouge_score FROM ({_EVAL_SQL}) WHERE coalesce(rouge_score, 0) < 0.3")
def low_scores(spark, sf_dir):
    return evaluate.low_scores(_evaluated(spark, sf_dir)).select("query_id", "rouge_score")


# Contexts: the hits of a query are the documents among the vectors its search ranks first, numbered anew.

_HITS = f"""{_SCORED}, h AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS final_rank, d.text, d.source || '_a.txt' AS source, d.lang AS relevance, d.n_chars % 8 / CAST(8 AS DOUBLE) AS score, d.n_chars % 16 / CAST(8 AS DOUBLE) AS relevance_score
    FROM ranked JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 10)"""


def _found_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.expr("source || '_a.txt'").alias("source"), F.col("lang").alias("relevance"), F.expr("n_chars % 8 / 8.0D").alias("score"), F.expr("n_chars % 16 / 8.0D").alias("relevance_score"))
    found = _hits(spark, sf_dir, "faiss", 10).select("query_id", "rank", "chunk_id").join(docs, "chunk_id")
    return found.withColumn("final_rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rank)")).drop("chunk_id", "rank")


@query(f"""WITH {_HITS} SELECT query_id,
    string_agg('Source: ' || replace(replace(source, '_', ' '), '.txt', '') || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY final_rank) AS answer_context,
    string_agg('Chunk ID: ' || final_rank || chr(10) || 'Source: ' || source || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY final_rank) AS judge_context,
    string_agg('Passage ' || final_rank || ': ' || text, chr(10) || chr(10) ORDER BY final_rank) AS recall_context FROM h GROUP BY query_id""")
def context_blocks(spark, sf_dir):
    hits = generate.ordered_hits(_found_hits(spark, sf_dir))
    h = F.col("hits")
    return hits.select("query_id", generate.answer_context(h).alias("answer_context"), generate.judge_context(h).alias("judge_context"), generate.recall_context(h).alias("recall_context"))


@query(f"""WITH {_HITS} SELECT query_id, chr(10) || chr(10) || repeat('=', 50) || string_agg('ID: ' || final_rank || ' | Similarity Score: ' || score || ' | Re-Ranker Score: ' || relevance_score ||
    ' | Source: ' || source || ' | Verdict: ' || relevance || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY final_rank) AS traceable_context FROM h GROUP BY query_id""")
def trace_context(spark, sf_dir):
    return report.traces(_found_hits(spark, sf_dir))


@query(f"""WITH {_HITS} SELECT query_id, final_rank AS "Rank", source AS "Source", CASE WHEN score = 0 THEN 'N/A' ELSE CAST(score AS VARCHAR) END AS "Similarity Score",
    CASE WHEN relevance_score = 0 THEN 'N/A' ELSE CAST(relevance_score AS VARCHAR) END AS "Re-Ranker Score", relevance AS "Precision Verdict", text AS "Text Snippet" FROM h""")
def display_table(spark, sf_dir):
    hits = _found_hits(spark, sf_dir)
    shown = report.display(hits.withColumn("final_rank", F.struct("query_id", "final_rank")), wrapped=False)
    return shown.select("Rank.query_id", F.col("Rank.final_rank").alias("Rank"), *shown.columns[1:])


# Model calls, with the deterministic offline providers.


def _offline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.struct("source", F.col("source").alias("path")).alias("metadata"))
    return experiment.keep(embed.build_index(chunks, experiment.HashEmbedder), "index")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 == 0, "Unanswerable").otherwise("Factual").alias("query_type"), F.col("text").alias("query"), F.col("text").alias("answer"))


_BAG = _Template("list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')")
#: The hashing embedder: words fall on 64 dimensions by the first byte of their digest, signed by the second.
_EMBEDDED = _Template(f"""(SELECT key, d AS pos, sum(sign) AS x FROM (
        SELECT key, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) % 64 AS d, CASE WHEN CAST('0x' || substr(md5(w), 3, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign
        FROM (SELECT key, unnest({_BAG.format('t')}) AS w FROM ({{0}}))) GROUP BY key, d)""")
_DOC_VECTORS = f"""e AS (SELECT * FROM {_EMBEDDED.format('SELECT doc_id AS key, text AS t FROM documents')}),
    size AS (SELECT key, sqrt(sum(x * x)) AS size FROM e GROUP BY key),
    unit AS (SELECT key, pos, CAST(x / size AS FLOAT) AS x FROM e JOIN size USING (key) WHERE size > 0)"""


@query(f"WITH {_DOC_VECTORS} SELECT key AS chunk_id, CAST(pos AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 5) AS x FROM unit WHERE x <> 0")
def embed_fake(spark, sf_dir):
    found = _offline_index(spark, sf_dir).select("chunk_id", F.posexplode("norm_embedding").alias("pos", "x")).where("x <> 0")
    return found.select("chunk_id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, list_distinct({_BAG.format('ref')}) AS a, list_distinct(list_append({_BAG.format('ans')}, 'source')) AS b FROM pairs)
    SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) END, 6) AS relevance_score FROM w""")
def rerank_fake(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("query"), F.col("ans").alias("text"), F.lit("").alias("source"))
    return merge.rerank(pairs, experiment.OverlapScorer).select("conv_id", "turn", F.round("relevance_score", 6).alias("relevance_score"))


@query(f"""WITH {_PAIRS}, w AS (SELECT conv_id * 1000 + turn AS query_id, {_BAG.format('split_part(ref, chr(10), 1)')} AS a, list_concat({_BAG.format('ans')}, ['source', 'a', 'content']) AS b, split_part({_STRIP.format('ans')}, chr(10), 1) AS said FROM pairs)
    SELECT query_id, CASE WHEN said <> '' AND len(list_intersect(list_distinct(a), list_distinct(b))) > 0 THEN said ELSE 'I could not find an answer in the passages.' END AS model_answer FROM w""")
def answer_fake(spark, sf_dir):
    asked = _pairs(spark, sf_dir).select(F.expr("conv_id * 1000 + turn").alias("query_id"), F.col("ref").alias("query"), F.col("ans").alias("text"))
    hits = asked.select("query_id", F.lit(1).alias("final_rank"), "text", F.lit("a.txt").alias("source"))
    return generate.answer(asked.drop("text"), hits, experiment.RuleChat).select("query_id", "model_answer")


#: Searches of the benchmark's items among the documents, each item one question: its words' vector against all, those over the threshold with enough words by shared words.
_FETCHED = f"""{_DOC_VECTORS},
    parts AS (SELECT item_id AS query_id, CAST(i - 1 AS INTEGER) AS sub_idx, p[i] AS t, item_id * 64 + i - 1 AS key FROM (
        SELECT item_id, CASE WHEN thinker_count + concept_count + bridge_score + artifact_score < 4 THEN [text] ELSE list_slice(list_filter(list_transform(regexp_split_to_array(text, '\\band\\b|;'), lambda x: {_STRIP.format('x')}), lambda x: x <> ''), 1, 3) END AS p
        FROM (SELECT item_id, text, {_COMPLEX.format('text')} FROM benchmark)), unnest(range(1, len(p) + 1)) u(i)),
    asked AS (SELECT key, t FROM parts),
    items AS (SELECT * FROM {_EMBEDDED.format('SELECT key, t FROM asked')}),
    asked_size AS (SELECT key, sqrt(sum(x * x)) AS size FROM items GROUP BY key),
    scored AS (SELECT i.key AS q, u.key AS chunk_id, round(sum(i.x / a.size * CAST(u.x AS DOUBLE)), 12) AS score FROM items i JOIN asked_size a USING (key) JOIN unit u USING (pos) WHERE a.size > 0 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM scored),
    kept AS (SELECT r.*, p.query_id, p.sub_idx, p.t, d.text, d.source FROM ranked r JOIN parts p ON p.key = r.q JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 100 AND score > 0.5 AND {_WORDS.format('d.text')} > 10),
    reranked AS (SELECT *, len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) AS relevance_score FROM (SELECT *, list_distinct({_BAG.format('t')}) AS a, list_distinct(list_concat({_BAG.format('text')}, list_append({_BAG.format('source')}, 'source'))) AS b FROM kept)),
    deep AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_idx ORDER BY relevance_score DESC, rank) AS depth FROM reranked),
    once AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY depth, sub_idx) AS n FROM deep),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY depth, sub_idx) AS INTEGER) AS final_rank FROM once WHERE n = 1)"""


@query(f"WITH {_FETCHED} SELECT query_id, final_rank, chunk_id, round(score, 6) AS score, round(relevance_score, 6) AS relevance_score FROM final WHERE final_rank <= 3")
def retrieve_fake(spark, sf_dir):
    p = experiment.Providers()
    found = merge.retrieve(_questions(spark, sf_dir), _offline_index(spark, sf_dir), p.embedder, p.scorer, p.decomposer, Settings(), experiment.keep)
    return found.select("query_id", "final_rank", "chunk_id", F.round("score", 6).alias("score"), F.round("relevance_score", 6).alias("relevance_score"))


@query()
def rag_end_to_end(spark, sf_dir):
    done = experiment.run_experiment(_questions(spark, sf_dir), _offline_index(spark, sf_dir))
    return done.select("query_id", "model_answer", F.round("ret_precision", 6).alias("ret_precision"), "ret_recall", F.round("rouge_score", 6).alias("rouge_score"), "faithfulness_verdict")
