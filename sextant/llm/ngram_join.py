"""N-gram Jaccard join by several global token orders (operator 1).

A document is the set of its distinct shingles of RULE.k words, lower-cased A-Z; with fewer words the
whole sequence is one shingle; without words the set is empty and links with nothing. Two link when
the Jaccard similarity is at least RULE.a / RULE.b. Candidates share a prefix token under the rarity
order, at sizes and places that allow a link, and must share one under each of ORDERS further hash
orders before their sets are compared exactly.

Equal sets are one class. Classes that share most of their prefix tokens with one other class form a
cluster, whose sets meet in one task (large clusters: each two blocks in one); pairs are filtered, compared
and counted there, and a task gives a row a class, not a row a pair. Pairs across clusters are found in
the index and joined with their sets. No link between different texts is lost; copies are not paired.

Null ids take part in nothing and get a null component; rows that repeat an id are rows of the
result. Texts are hashed whole, so a task's memory follows the longest text (about 50 bytes a byte).
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _sets
from ._runtime import materialise, release, unused

RULE = _sets.Rule(k=3, a=9, b=10, lines=False, slots=1 << 24)
ORDERS = 2


def linked(docs: DataFrame, rule: _sets.Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows it links with) of every row of docs."""
    out = grouped(docs, rule)
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("d").isNotNull(), F.coalesce("component", "d")).alias("component_id"), F.when(F.col("d").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))


def without_copies(docs: DataFrame, rule: _sets.Rule = RULE) -> DataFrame:
    """docs with one row of each group that links connect: that of the smallest id, then of the smallest hash of its text.

    Rows of one id are rows of their own, so an id stays with a text that is no copy even where another of
    its texts goes; of equal rows (id and text) one stays. Rows without an id or without words stay.
    """
    rows = grouped(docs, rule).where("d IS NOT NULL").select("d", "th", "c")
    stays = rows.groupBy("c").agg(F.min(F.struct("d", "th")).alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND c IS NOT NULL")
    gone = materialise(rows.join(stays, "c").where(F.struct("d", "th") != F.col("stays")).select("d", "th").distinct(), "gone")
    twice = materialise(rows.groupBy("d", "th").count().where("count > 1").select("d", "th").join(gone, ["d", "th"], "left_anti"), "twice")

    def only(found: DataFrame, kind: str) -> DataFrame:
        return docs.join(found.withColumnsRenamed({"d": d, "th": th}), (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(th)), kind)

    d, th = unused(docs, "d", "th")
    if not twice.take(1):
        return only(gone, "left_anti")
    return only(gone.union(twice), "left_anti").unionByName(only(twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def grouped(docs: DataFrame, rule: _sets.Rule = RULE) -> DataFrame:
    """d, th (hash of the text), n, and of rows with words c (names the group that links connect), component (its
    smallest id) and n_links, of every row of docs; the last two null where a row has no link and no copy."""
    docs = docs.select("doc_id", "text")
    rarity, found, first = _sets.begin(docs, rule)
    index = materialise(_sets.shared(found, rule), "index")
    clusters = materialise(_sets.clusters(index), "clusters")
    near = materialise(_near(docs, rule, rarity, first, clusters), "near")
    across = materialise(_across(docs, rule, rarity, found, first, index, clusters), "across")
    release(index, clusters)
    edges = near.where("p IS NOT NULL").select("v", F.col("p").alias("w")).union(across)
    reach = _sets.components(edges)
    # a link of two classes is one of each two of their members
    sizes = first.select(_sets.key().alias("v"), "d", "members")
    both = across.union(across.select("w", "v"))
    others = near.select("v", "others").union(both.join(sizes.select(F.col("v").alias("w"), "members"), "w").select("v", "members")).groupBy("v").agg(F.sum("others").alias("others"))
    # a component's name is its smallest document, which may be in any of its classes
    members = reach.join(sizes, "v").join(others, "v")
    names = members.groupBy("c").agg(F.min("d").alias("component"))
    named = members.join(names, "c").select("v.k1", "v.k2", "c", "component", F.expr("members - 1 + others AS n_links"))
    alone = first.join(named.select("k1", "k2"), ["k1", "k2"], "left_anti").where("members > 1").select("k1", "k2", _sets.key().alias("c"), F.col("d").alias("component"), F.expr("members - 1 AS n_links"))
    out = found.select("k1", "k2", "d", "th", "n").join(named.union(alone), ["k1", "k2"], "left")
    return out.select("d", "th", "n", F.when(F.col("n") > 0, F.coalesce("c", _sets.key())).alias("c"), "component", "n_links")


def _near(docs: DataFrame, rule: _sets.Rule, rarity, first: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links inside the clusters, as _sets.within gives them."""
    classes = first.join(clusters.withColumnRenamed("r", "k1"), "k1")
    sizes = classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("tokens")).where("classes > 1")
    blocks = F.greatest(F.ceil(F.col("classes") / (_sets.BLOCK // 2)), F.ceil(F.col("tokens") / _sets.BLOCK_TOKENS)).cast("int")
    wanted = materialise(classes.join(sizes.select("g", blocks.alias("blocks")), "g"), "wanted")
    return _sets.within(_sets.candidate_sets(docs, rule, rarity, wanted), rule, ORDERS)


def _across(docs: DataFrame, rule: _sets.Rule, rarity, found: DataFrame, first: DataFrame, index: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (v, w) between classes of different clusters."""
    rows = index.join(clusters, "r", "left").withColumn("g", F.coalesce("g", "r")).drop("lead")
    rows = rows.selectExpr("*", "count(*) OVER (PARTITION BY tok) AS df", "min(g) OVER (PARTITION BY tok) AS g1", "max(g) OVER (PARTITION BY tok) AS g2").where("g1 <> g2").drop("g1", "g2")
    bitmaps = found.where(F.size("bitmap") > 0).select(F.col("k1").alias("r"), "bitmap").dropDuplicates(["r"])
    candidates = materialise(_sets.pairs(rows.join(bitmaps, "r"), rule, ordered=False), "pairs")
    named = candidates.select(F.col("r1").alias("k1")).union(candidates.select("r2")).distinct()
    wanted = materialise(first.join(named, "k1", "left_semi").select("d", "l", "k1", "k2"), "wanted")
    sets = materialise(_sets.candidate_sets(docs, rule, rarity, wanted, ORDERS).dropDuplicates(["k1", "k2"]), "sets")
    return _sets.verified(candidates, sets, rule, ORDERS)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


_SETS_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
"""
OP1_SQL = (
    _SETS_SQL
    + """
common AS (SELECT t AS t FROM t GROUP BY t HAVING count(*) > 1),
u AS MATERIALIZED (SELECT doc_id, t FROM t WHERE t IN (SELECT t FROM common)),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM inter JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
sym AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, sym.y FROM reach JOIN sym ON sym.x = reach.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM s JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
)
