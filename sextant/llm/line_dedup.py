"""Line dedup by an exact set-similarity join (operator 10).

A line's tokens are its distinct words, lower-cased A-Z; a line without words is never removed. Tokens are
ordered by rarity; candidates share a prefix token (a frequent one of a line of up to RULE.double words: two
of them) and pass the length, place and parity-bitmap filters; Jaccard similarity of at least 4/5 is verified on
whole sets. A line goes when any earlier line (smaller doc_id, or the same id and a smaller line number)
matches it; lines are judged on the input, not on what is left.

Equal sets are one class, of which the first line stays. Each class is first compared with the earlier ones of
its index keys that are nearest by bitmap; only classes that this leaves are compared with all their candidates.

Null texts stay null; null ids take part in nothing and keep their text. Rows that repeat an id and
text count once; lines of different texts with one id are earlier or later by their line number. A task's
memory follows the longest text (about 50 bytes a byte). Extra columns pass through; n_lines, n_removed
and kept of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _sets
from ._runtime import forget, materialise, prepare, release, replaced, unused, with_columns

RULE = _sets.Rule(k=1, a=4, b=5, lines=True, slots=1 << 24, words=2, double=64)
#: Candidates of each class that are compared first.
TRIES = 3

def repeated_lines(docs: DataFrame, rule: _sets.Rule = RULE) -> DataFrame:
    """d, th and the sorted numbers of the lines that go, for each text that has any."""
    docs = docs.select("doc_id", "text")
    rarity, found, first = _sets.begin(docs, rule)
    near = materialise(_sets.nearest_earlier(found, rule), "near")
    forget(docs.sparkSession)
    tries = near.where("r2 IS NOT NULL").groupBy("r1", "r2").agg(F.min("apart").alias("apart"), F.count(F.lit(1)).alias("hits"))
    tries = materialise(tries.selectExpr("r1", "r2", "row_number() OVER (PARTITION BY r1 ORDER BY apart, hits DESC, r2) AS place"), "tries")
    first = materialise(first, "first")
    # the nearest ones of all, then all candidates of what that leaves: those found, and of keys that have more all pairs
    gone = materialise(_later(docs, rule, rarity, first, tries.where(F.col("place") <= TRIES).select("r1", "r2")), "gone")
    closed = gone.select(F.col("v.k1").alias("r1"))
    rest = tries.where(F.col("place") > TRIES).select("r1", "r2").join(closed, "r1", "left_anti")
    entries = near.where("r2 IS NULL").drop("r2", "apart").withColumnRenamed("r1", "r")
    more = materialise(entries.where("more").select("tok", "r").join(closed.withColumnRenamed("r1", "r"), "r", "left_anti"), "more")
    if more.take(1):
        rest = rest.union(_all_pairs(entries, more, rule))
    rest = materialise(rest.distinct(), "rest")
    if rest.take(1):
        gone = materialise(gone.union(_later(docs, rule, rarity, first, rest)), "gone")
    release(near, tries, more, rest)
    near = gone.select("v.k1", "v.k2", F.lit(True).alias("near")).distinct()
    known = first.selectExpr("k1", "k2", "d AS d0", "l AS l0", "members").join(near, ["k1", "k2"], "left").where("members > 1 OR near")
    hit = found.where("d IS NOT NULL").select("d", "th", "l", "k1", "k2").join(known, ["k1", "k2"]).where("near OR d <> d0 OR l <> l0")
    return hit.groupBy("d", "th").agg(F.array_sort(F.collect_set("l")).alias("lines"))


def _later(docs: DataFrame, rule: _sets.Rule, rarity, first: DataFrame, candidates: DataFrame) -> DataFrame:
    """v: the later class of each candidate pair whose sets match."""
    named = candidates.select(F.col("r1").alias("k1")).union(candidates.select("r2")).distinct()
    wanted = materialise(first.join(named, "k1", "left_semi").select("d", "l", "k1", "k2"), "wanted")
    sets = materialise(_sets.candidate_sets(docs, rule, rarity, wanted).dropDuplicates(["k1", "k2"]), "sets")
    links = _sets.verified(candidates, sets, rule)
    at = sets.select(_sets.key().alias("v"), F.struct("d", "l").alias("at"))
    links = links.join(at, "v").join(at.select(F.col("v").alias("w"), F.col("at").alias("at2")), "w")
    return links.where("at <> at2").select(F.when(F.col("at") > F.col("at2"), F.col("v")).otherwise(F.col("w")).alias("v")).distinct()


def _all_pairs(entries: DataFrame, more: DataFrame, rule: _sets.Rule) -> DataFrame:
    """The candidate pairs under the keys in more (tok, r) with at least one class of more."""
    rows = entries.drop("more").join(more.select("tok").distinct(), "tok", "left_semi")
    rows = rows.join(more.select("r").distinct().withColumn("open", F.lit(True)), "r", "left").withColumns({"open": F.coalesce("open", F.lit(False)), "g": F.col("r")})
    return _sets.pairs(rows.selectExpr("*", "count(*) OVER (PARTITION BY tok) AS df"), rule, ordered=True)


def without_lines(docs: DataFrame, rule: _sets.Rule = RULE) -> DataFrame:
    """docs with n_lines, n_removed and kept: the text without its repeated lines."""
    new = [("n_lines", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    docs = docs.drop(*(n for n, _ in new))
    prepare(docs.sparkSession)
    gone = materialise(repeated_lines(docs, rule), "gone")
    rows, elements = gone.select(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    own_id, d, th, lines = unused(docs, "id", "d", "th", "lines")
    lists = gone.select(F.col("d").alias(d), F.col("th").alias(th), F.col("lines").alias(lines))
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long"))
    if rows <= _sets.SMALL and elements <= _sets.SMALL_LISTS:
        lists, sure, may = F.broadcast(lists), None, keyed
    else:  # texts that surely lose nothing are not shuffled
        touched = docs.sparkSession.sparkContext.broadcast(_sets.bloom(gone.select("d"), rows))  # at most BLOOM_BITS

        def some(wanted: bool) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(_sets.in_bloom(touched.value, batch.column(own_id)) == wanted))

            return keyed.mapInArrow(run, keyed.schema)

        sure, may = some(False).drop(own_id), some(True)
    joined = may.join(lists, (F.col(own_id) == F.col(d)) & (F.xxhash64("text") == F.col(th)), "left").drop(d, th, own_id)
    whole = joined.where(F.col(lines).isNull()).drop(lines)
    whole = whole if sure is None else sure.unionByName(whole)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    whole = whole.withColumns({"n_lines": n_lines, "n_removed": F.lit(0).cast("long"), "kept": F.col("text")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column(lines).to_pylist(), strict=True):
                split, out = text.split("\n"), set(numbers)
                rows.append((len(split), len(out), "\n".join(x for i, x in enumerate(split) if i not in out)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield replaced(batch.drop_columns([lines]), {n: pa.array(x, k) for (n, _), x, k in zip(new, columns, (pa.int64(), pa.int64(), pa.string()), strict=True)})

    return whole.unionByName(joined.where(F.col(lines).isNotNull()).mapInArrow(cut, with_columns(docs.schema, new)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("kept"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The rows of (doc_id, i, keep) of each line, shared with the pipeline's SQL; {docs} has doc_id and text.
LINES_SQL = r"""
lines AS MATERIALIZED (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})),
lw AS MATERIALIZED (SELECT doc_id, i, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM lines),
ls AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(w)) AS s FROM lw WHERE len(w) > 0),
lc AS MATERIALIZED (SELECT s, min((doc_id, i)) AS f, row_number() OVER () AS c FROM ls GROUP BY s),
lt AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS t FROM lc),
lf AS MATERIALIZED (SELECT t, count(*) AS df FROM lt GROUP BY t),
lp AS MATERIALIZED (SELECT c, n, t FROM (SELECT c, n, t, df, row_number() OVER (PARTITION BY c ORDER BY df, t) AS pos FROM lt JOIN lf USING (t)) WHERE df > 1 AND pos <= n - ceil(4 * n / 5) + 1),
li AS MATERIALIZED (SELECT DISTINCT a.c AS x, b.c AS y FROM lp a JOIN lp b ON a.t = b.t AND a.c < b.c AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
lnear AS (SELECT DISTINCT CASE WHEN a.f > b.f THEN x ELSE y END AS x FROM li JOIN lc a ON a.c = x JOIN lc b ON b.c = y
  WHERE a.f <> b.f AND 9 * len(list_intersect(a.s, b.s)) >= 4 * (len(a.s) + len(b.s))),
lgone AS MATERIALIZED (SELECT doc_id, i FROM ls JOIN lc USING (s) WHERE (doc_id, i) <> f OR c IN (SELECT x FROM lnear))
"""
OP10_SQL = (
    "WITH "
    + LINES_SQL.format(docs="documents")
    + """
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lgone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN lgone USING (doc_id, i) GROUP BY doc_id) k USING (doc_id)
"""
)
