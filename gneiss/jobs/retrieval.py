"""Queries of the retrieval and graph families, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph as G
from gneiss.operators import promotion as P
from gneiss.operators import retrieval as R
from gneiss.operators.ranked_index import RankedIndex, shared_index
from gneiss.session import checkpointed, shared_folder, table
from gneiss.sources.vectors import VectorTable

DEPTH = 50


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, sf: str) -> RankedIndex:
    """The index of all documents, which the queries of a session share."""
    return shared_index(documents(spark, sf))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).search(items(spark, sf), 10)


def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.size(R.content_terms(F.col("text"))).cast("long").alias("n_terms"))


def ood_cap(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'user'").select(F.expr("conv_id * 1000 + turn").alias("query_id"), "text")
    out = index(spark, sf).overlap(turns)
    return out.select("query_id", "n_terms", "n_known", F.round("overlap", 6).alias("overlap"))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return R.cosine_top(table(spark, sf, "embeddings"), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return R.cosine_top(table(spark, sf, "embeddings"), 10, same="label").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def _two_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items against documents: by embedding and by BM25, each to the depth that is fused."""
    docs, asked = documents(spark, sf), items(spark, sf)
    vectors = lambda d: R.hash_embed(d, digest="md5").withColumnRenamed("embedding", "v")
    base, queries = checkpointed(vectors(docs)), vectors(asked.withColumnRenamed("query_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
    # An item's id says nothing about the document of that number.
    near = R.nearest(base, queries.withColumn("query_id", -1 - F.col("query_id")), DEPTH).withColumn("query_id", -1 - F.col("query_id"))
    return checkpointed(near), checkpointed(index(spark, sf).search(asked, DEPTH))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = R.fuse(list(_two_lists(spark, sf)))
    return R.top(fused, 10, "fused").select("query_id", "doc_id", "rank", F.round("fused", 9).alias("fused"))


def retrieval_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The four modes from one computation of the lists.

    Scores are capped by how many of a query's terms the documents have, times its best similarity where there is a vector list.  In
    the full mode neighbours in a graph of documents (each with the one of an eighth of its number) join before the cut.
    """
    near, lexical = _two_lists(spark, sf)
    shares = checkpointed(index(spark, sf).overlap(items(spark, sf)).select("query_id", "overlap"))
    alike = near.groupBy("query_id").agg(F.max("score").alias("alike"))
    by_both = shares.join(alike, "query_id", "left").select("query_id", (F.col("overlap") * F.coalesce("alike", F.lit(0.0))).alias("cap"))
    by_words = shares.select("query_id", F.col("overlap").alias("cap"))
    modes = {
        "hybrid_no_graph": R.normalised(R.fuse([near, lexical]), by_both, 10), "vector_only": R.normalised(R.fuse([near]), by_both, 10),
        "bm25_only": R.normalised(R.fuse([lexical]), by_words, 10),
    }
    edges = documents(spark, sf).selectExpr("doc_id as src", "doc_id div 8 as dst").filter("src <> dst")
    wide = G.expand(modes["hybrid_no_graph"].select("query_id", F.col("doc_id").alias("id"), "score"), edges, 1)
    modes["hybrid"] = R.top(wide.select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score")), 10)
    out = None
    for mode, one in modes.items():
        one = one.select(F.lit(mode).alias("mode"), "query_id", "doc_id", "rank", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def exact_ref_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark item word for word come first, all of them, ranked or not; the ten best by BM25 follow."""
    ranked = bm25_topk(spark, sf)
    named = P.holders(documents(spark, sf), items(spark, sf)).withColumns({"priority": F.lit(0), "place": F.lit(0).cast("long")})
    out = P.promote(ranked, named)
    return out.select("query_id", "doc_id", "origin", "rank", F.round("score", 6).alias("score"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings that are stored without every fourth, of which every third then changes: what is stored in the end, after the change came twice."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0]
    stored = VectorTable.create(spark, shared_folder(spark), rows.schema, dim, buckets=32)
    stored.upsert(rows.filter("id % 4 <> 1"))
    for _ in range(2):
        stored.upsert(rows.filter("id % 3 = 0").select("id", F.reverse("embedding").alias("embedding"), (F.col("label") + 100).alias("label")))
    return stored.read().select(F.col("id").alias("vec_id"), "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return R.hash_embed(documents(spark, sf))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The key hierarchy as a graph: region - nation - customer - order - part."""
    t = lambda n: table(spark, sf, n)
    e = [
        t("nation").selectExpr("concat('r', n_regionkey) as src", "concat('n', n_nationkey) as dst", "'contains' as kind", "0.5D as weight", "1L as ord"),
        t("customer").selectExpr("concat('n', c_nationkey) as src", "concat('c', c_custkey) as dst", "'contains' as kind", "0.5D as weight", "2L as ord"),
        t("orders").selectExpr("concat('c', o_custkey) as src", "concat('o', o_orderkey) as dst", "'references' as kind", "0.8D as weight", "3L as ord"),
        t("lineitem").selectExpr("concat('o', l_orderkey) as src", "concat('p', l_partkey) as dst",
                                 "case l_returnflag when 'A' then 'requires' when 'N' then 'defines' else 'constrains' end as kind",
                                 "case l_returnflag when 'A' then 1.0D when 'N' then 0.9D else 0.85D end as weight", "l_linenumber + 10L as ord"),
    ]
    return e[0].unionByName(e[1]).unionByName(e[2]).unionByName(e[3])


def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return G.dedup_edges(_edges(spark, sf)).select("src", "dst", "kind", "weight").distinct()


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").selectExpr("r_regionkey as query_id", "concat('r', r_regionkey) as id", "1.0D / (1 + r_regionkey) as score")


def _expanded(hops: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return G.expand(_seeds(spark, sf), _edges(spark, sf), hops).select("query_id", "id", "hop", F.round("score", 9).alias("score"))

    return query


def graph_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    wide = G.expand(_seeds(spark, sf), _edges(spark, sf), 2).withColumnRenamed("id", "doc_id")
    return R.top(wide, 10).select("query_id", "doc_id", "hop", "rank", F.round("score", 9).alias("score"))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a large order."""
    return G.orphans(table(spark, sf, "customer").selectExpr("concat('c', c_custkey) as id"), _edges(spark, sf).join(table(spark, sf, "orders").filter("o_totalprice > 250000").selectExpr("concat('o', o_orderkey) as dst"), "dst", "left_semi"))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(table(spark, sf, "part").selectExpr("concat('p', p_partkey) as id"), _edges(spark, sf))


QUERIES = {f.__name__: f for f in (
    bm25_topk, content_tokens, ood_cap, knn_topk, knn_filtered, rrf_fusion, retrieval_modes, exact_ref_promotion, hash_embed, vector_upsert,
    graph_build, edge_dedup, graph_retrieve, orphans, node_degrees,
)} | {f"graph_expand_h{h}": _expanded(h) for h in (1, 2, 3)}

_STOP = "[" + ", ".join(f"'{w}'" for w in R.STOPWORDS) + "]"
CONTENT = f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9-]+'), lambda x: lower(x))), lambda x: NOT list_contains({_STOP}, x))"


def bm25_sql(depth: int, asked: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""
    dt AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9-]+') AS t FROM documents),
    tot AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
    tf AS MATERIALIZED (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM dt), pc AS (SELECT doc_id, length, term, count(*) AS tf FROM tf GROUP BY ALL),
    dff AS (SELECT term, count(*) AS df FROM pc GROUP BY term),
    qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9-]+')) AS term FROM ({asked})),
    qc AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
    bs AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score
           FROM pc JOIN qc USING (term) JOIN dff USING (term), tot GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0) WHERE rank <= {depth})"""


def _vector_sql(source: str, key: str) -> str:
    """Hashed embeddings, sparse: key, column, weight."""
    words = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\\\p{{L}}\\\\p{{N}}-]+'), lambda w: len(w) >= 2 AND NOT list_contains({_STOP}, w))".replace("\\\\", "\\")
    return f"""(WITH w AS (SELECT {key} AS id, unnest({words}) AS w FROM {source}), c AS (SELECT id, ('0x' || md5(w)[:8])::BIGINT % 384 AS col, 1 + ln(count(*)) AS x FROM w GROUP BY ALL),
        n AS (SELECT id, col, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM c) SELECT id, col, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM n)"""


_LISTS = f"""{bm25_sql(DEPTH)}, vd AS MATERIALIZED {_vector_sql("documents", "doc_id")}, vq AS MATERIALIZED {_vector_sql("benchmark", "item_id")},
    vs0 AS (SELECT vq.id AS query_id, vd.id AS doc_id, round(sum(vq.x * vd.x), 9) AS score FROM vq JOIN vd USING (col) GROUP BY ALL),
    vs AS (SELECT q.query_id, d.doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT id AS query_id FROM vq) q CROSS JOIN (SELECT DISTINCT id AS doc_id FROM vd) d LEFT JOIN vs0 USING (query_id, doc_id)),
    ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= {DEPTH}),
    dc AS (SELECT doc_id, unnest({CONTENT}) AS term FROM documents), qq AS (SELECT item_id AS query_id, unnest({CONTENT}) AS term FROM benchmark)"""


def _knn_sql(extra: str) -> str:
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 9) AS score
              FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id {extra})
        SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""


_EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'contains' AS kind, 0.5::DOUBLE AS weight, 1 AS ord FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 0.5, 2 FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'references', 0.8, 3 FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'requires' WHEN 'N' THEN 'defines' ELSE 'constrains' END,
        CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.9 ELSE 0.85 END, l_linenumber + 10 FROM lineitem)"""


def _expand_sql(hops: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    x AS (SELECT r_regionkey AS query_id, 'r' || r_regionkey AS id, 0 AS hop FROM region UNION SELECT query_id, dst, hop + 1 FROM x JOIN b ON x.id = b.src WHERE hop < {hops}),
    m AS (SELECT query_id, id, min(hop)::INT AS hop FROM x GROUP BY ALL)"""


def _mode_sql(name: str, lists: list[str], cap: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {x}" for x in lists)
    return f"""{name} AS (SELECT query_id, doc_id, rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id, round(fused / max(fused) OVER (PARTITION BY query_id) * least(1, greatest(0, {cap})), 9) AS score FROM (
                SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM ({union}) GROUP BY ALL) JOIN cap USING (query_id))) WHERE rank <= 10)"""


ORACLES = {
    "bm25_topk": f"WITH {bm25_sql(10)} SELECT query_id, doc_id, rank::INT AS rank, score FROM bm",
    "content_tokens": f"SELECT doc_id, len({CONTENT}) AS n_terms FROM documents",
    "ood_cap": f"""WITH voc AS (SELECT DISTINCT unnest({CONTENT}) AS term FROM documents), q AS (SELECT conv_id * 1000 + turn AS query_id, {CONTENT} AS t FROM conversations WHERE role = 'user'),
        k AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, unnest(t) AS term FROM q) JOIN voc USING (term) GROUP BY ALL)
        SELECT query_id, len(t) AS n_terms, coalesce(n, 0) AS n_known, round(CASE WHEN len(t) > 0 THEN coalesce(n, 0) / len(t)::DOUBLE ELSE 0 END, 6) AS overlap FROM q LEFT JOIN k USING (query_id)""",
    "knn_topk": _knn_sql(""),
    "knn_filtered": _knn_sql("AND q.label = c.label"),
    "rrf_fusion": f"""WITH {_LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS fused FROM
        (SELECT query_id, doc_id, rank FROM ov UNION ALL SELECT query_id, doc_id, rank FROM bm) GROUP BY ALL)
        SELECT query_id, doc_id, rank::INT AS rank, round(fused, 9) AS fused FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "retrieval_modes": f"""WITH {_LISTS}, voc AS (SELECT DISTINCT term FROM dc), kn AS (SELECT query_id, count(voc.term) AS n, count(*) AS m FROM qq LEFT JOIN voc USING (term) GROUP BY ALL),
        al AS (SELECT query_id, max(score) AS alike FROM ov GROUP BY query_id),
        cap AS (SELECT item_id AS query_id, coalesce(n / m::DOUBLE, 0) AS overlap, coalesce(n / m::DOUBLE, 0) * coalesce(alike, 0) AS joint FROM benchmark LEFT JOIN kn ON item_id = kn.query_id LEFT JOIN al ON item_id = al.query_id),
        {_mode_sql("m1", ["ov", "bm"], "joint")}, {_mode_sql("m2", ["ov"], "joint")}, {_mode_sql("m3", ["bm"], "overlap")},
        ed AS (SELECT doc_id AS a, doc_id // 8 AS b FROM documents WHERE doc_id <> doc_id // 8), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
        nb AS (SELECT DISTINCT query_id, b AS doc_id FROM m1 JOIN bo ON doc_id = a), best AS (SELECT query_id, max(score) AS best FROM m1 GROUP BY query_id),
        x AS (SELECT query_id, doc_id, score FROM m1 UNION ALL SELECT query_id, doc_id, round(best * 0.5, 9) FROM nb JOIN best USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.query_id = nb.query_id AND m1.doc_id = nb.doc_id)),
        m0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 10)
        {" UNION ALL ".join(f"SELECT '{mode}' AS mode, query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM {m}" for mode, m in (("hybrid", "m0"), ("hybrid_no_graph", "m1"), ("vector_only", "m2"), ("bm25_only", "m3")))}""",
    "exact_ref_promotion": f"""WITH {bm25_sql(10)}, nm AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text)),
        hi AS (SELECT query_id, greatest(max(score), 1) AS high FROM bm GROUP BY query_id),
        sc AS (SELECT query_id, doc_id, 'exact_ref' AS origin, coalesce(high, 1) AS score FROM nm LEFT JOIN hi USING (query_id)
            UNION ALL SELECT query_id, doc_id, 'hybrid', score FROM bm WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.query_id = bm.query_id AND nm.doc_id = bm.doc_id))
        SELECT query_id, doc_id, origin, row_number() OVER (PARTITION BY query_id ORDER BY origin, score DESC, doc_id)::INT AS rank, round(score, 6) AS score FROM sc""",
    "vector_upsert": """SELECT vec_id, (label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END)::INT AS label, round((CASE WHEN vec_id % 3 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END)::DOUBLE, 6) AS first,
        round((CASE WHEN vec_id % 3 = 0 THEN embedding[1] ELSE embedding[len(embedding)] END)::DOUBLE, 6) AS last FROM embeddings WHERE vec_id % 4 <> 1 OR vec_id % 3 = 0""",
    "graph_build": f"WITH {_EDGES} SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY kind",
    "edge_dedup": f"WITH {_EDGES} SELECT DISTINCT src, dst, kind, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, ord) AS n FROM e) WHERE n = 1",
    "graph_retrieve": _expand_sql(2) + """, s AS (SELECT query_id, id AS doc_id, hop, round(1.0::DOUBLE / (1 + query_id) * pow(0.5, hop), 12) AS score FROM m)
        SELECT query_id, doc_id, hop, rank::INT AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "orphans": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "node_degrees": f"""WITH {_EDGES} SELECT 'p' || p_partkey AS id, 0::BIGINT AS out_degree, coalesce(n, 0) AS in_degree
        FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = 'p' || p_partkey""",
} | {f"graph_expand_h{h}": _expand_sql(h) + " SELECT query_id, id, hop, round(1.0::DOUBLE / (1 + query_id) * pow(0.5, hop), 9) AS score FROM m" for h in (1, 2, 3)}
