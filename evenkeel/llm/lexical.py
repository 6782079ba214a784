"""Ranked lexical search by NRA: sorted reads only, with a lower and an upper score interval for each document.

Every document's terms are counted once and stored, document by document; totals and document frequencies come from that table. The
documents are then dealt to shards of about ``SHARD`` postings, and every shard meets every block of about ``BLOCK`` item terms. In a shard
the postings of each wanted term are one list, sorted by impact. For an item, all its lists are read from the top, in rounds of
doubling depth. What was read of a document is its lower bound; a list in which it was not met yet can add at most the
impact at which the reading stands, which gives the upper bound. Documents whose upper bound is below the k-th lower bound are out.
Reading ends when no other document can come in and the scores of all that are left are exact, so ties are decided by id.

The best k of each shard hold the best k of all, and k rows for each item and shard travel on.

Null and empty texts have no terms: such documents are never found, such items find nothing. Repeated rows of either table count each
for themselves. Of equal scores the smaller id comes first, a null id last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import forget, map_batches, register, stored, table

K = 10
#: Postings of a shard and terms of a block of items, on average; both bound the memory of one task.
SHARD, BLOCK = 1 << 20, 1 << 18
#: Postings of each list read in the first round.
DEPTH = 64
#: ASCII letters and digits and everything beyond ASCII belong to terms; capitals of ASCII become small.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


def _counted(name: str):
    """Arrow batches to rows of (name, n, terms, counts): the terms of a row's text, sorted, and how often each occurs."""
    def build(batch: pa.RecordBatch) -> Iterator[dict]:
        n, words, counts, ends = [], [], [], [0]
        for text in batch.column("text"):
            own = terms(text.as_py())
            seen = Counter(own)
            n.append(len(own))
            words.extend(seen)
            counts.extend(seen.values())
            ends.append(len(words))
        ends = pa.array(ends, pa.int32())
        yield {
            name: batch.column(name), "n": n, "terms": pa.ListArray.from_arrays(ends, pa.array(words, pa.binary()).cast(pa.string())),
            "counts": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
        }

    return build


def index(docs: DataFrame, key: str, label: str) -> tuple[DataFrame, str]:
    """(key, n, terms, counts) of every row of ``docs`` (key, text), stored once; and the path."""
    return stored(map_batches(docs.select(key, "text"), _counted(key), f"{key} long, n long, terms array<string>, counts array<long>"), label)


def weights(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, weight) of the terms of ``wanted`` that some document holds, the number of documents with terms and that of all their terms."""
    total = docs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = docs.select(F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000.0 * F.ln(F.lit(2 * total[0] + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return df.select("term", weight.alias("weight")), total[0], total[1]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents that may be among the best k, with their exact scores, and how many postings were read.

    Each list holds the numbers (below ``size``) of different documents and their impacts, greatest first. The best k of the result by any
    order of ties are the best k of all; documents of score 0 are left out.
    """
    lists = [(docs, impacts) for docs, impacts in lists if len(docs)]
    lower, read, at = np.zeros(size, np.int64), 0, 0
    while True:
        for docs, impacts in lists:
            part = slice(at, depth)
            lower[docs[part]] += impacts[part]
            read += len(docs[part])
        # What each list can still add: to documents not yet met in it, at most the impact where the reading stands.
        ahead = [int(impacts[depth]) if depth < len(docs) else 0 for docs, impacts in lists]
        slack = np.full(size, sum(ahead), np.int64)
        for (docs, _), more in zip(lists, ahead):
            if more:
                slack[docs[:depth]] -= more
        kth = int(np.partition(lower, size - k)[size - k]) if size > k else 0
        left = np.flatnonzero((lower + slack >= max(kth, 1)))
        if not slack[left].any():
            return left, lower[left], read
        at, depth = depth, depth * 2


def _search(k: int, n_docs: int, n_terms: int):
    """One shard of documents and one block of items, as Arrow tables, to the best k documents of each item."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [], [])
        # The wanted terms are numbered; a document's other terms are not looked at again.
        wanted = pa.compute.unique(pa.compute.list_flatten(right.column("terms")).combine_chunks())
        at = pa.compute.index_in(pa.compute.list_flatten(left.column("terms")).combine_chunks(), wanted)
        known = pa.compute.is_valid(at).to_numpy(zero_copy_only=False)
        owner = pa.compute.list_parent_indices(left.column("terms").combine_chunks()).to_numpy()[known]
        term = at.drop_null().to_numpy().astype(np.int64)
        tf = pa.compute.list_flatten(left.column("counts")).to_numpy()[known]
        n = left.column("n").to_numpy()
        m = 10 + (90 * n * n_docs) // max(n_terms, 1)
        weight = np.zeros(len(wanted), np.int64)
        of_items = pa.compute.index_in(pa.compute.list_flatten(right.column("terms")).combine_chunks(), wanted).to_numpy()
        weight[of_items] = pa.compute.list_flatten(right.column("weights")).to_numpy()
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        order = np.lexsort((-impact, term))
        owner, impact = owner[order], impact[order]
        begin = np.searchsorted(term[order], np.arange(len(wanted) + 1))
        ids = left.column("doc_id").combine_chunks()
        id_rank = np.empty(len(ids), np.int64)
        id_rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        spans = np.cumsum([0, *pa.compute.list_value_length(right.column("terms")).to_pylist()])
        item, doc, score = [], [], []
        for i in range(right.num_rows):
            own = of_items[spans[i] : spans[i + 1]]
            found, exact, _ = nra([(owner[begin[t] : begin[t + 1]], impact[begin[t] : begin[t + 1]]) for t in own], len(ids), k)
            best = np.lexsort((id_rank[found], -exact))[:k]
            item += [i] * len(best)
            doc += found[best].tolist()
            score += exact[best].tolist()
        return _found(right.column("item").take(item), right.column("item_id").take(item), ids.take(pa.array(doc, pa.int64())), score)

    return run


_RESULT = "item long, item_id long, doc_id long, score long"


def _found(*columns) -> pa.Table:
    names = [f.split()[0] for f in _RESULT.split(", ")]
    return pa.table({name: pa.chunked_array([c], pa.int64()) if isinstance(c, list) else c for name, c in zip(names, columns)})


def search(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    found, at0 = index(docs.select("doc_id", "text"), "doc_id", "lexical-docs")
    numbered = items.select("item_id", "text", F.monotonically_increasing_id().alias("item"))
    ids, at1 = stored(numbered, "lexical-items")
    listed, at2 = index(ids.select("item", "text"), "item", "lexical-terms")
    each = listed.select("item", F.explode("terms").alias("term"))
    known, n_docs, n_terms = weights(found, each.select("term").distinct())
    weighted = each.join(known, "term").groupBy("item").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    queries, at3 = stored(weighted.select("item", F.col("t")["term"].alias("terms"), F.col("t")["weight"].alias("weights")).join(
        ids.select("item", "item_id"), "item"), "lexical-queries")

    # Sizes decide how many shards and blocks there are, never what they hold.
    postings = found.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    wanted = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    shards, blocks = postings // shard + 1, wanted // block + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.where("n > 0").select("*", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    left = left.select("*", every(blocks).alias("block"))
    right = queries.select("*", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).select("*", every(shards).alias("shard"))
    part = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k, n_docs, n_terms), _RESULT)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out, _ = stored(part.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "lexical-best")
    forget(spark, at0, at1, at2, at3)
    return out


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOW}, '{_PATTERN}') AS w FROM documents),
s AS MATERIALIZED (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOW}, '{_PATTERN}') AS w FROM benchmark)),
p AS MATERIALIZED (SELECT d, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY d, doc_id, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term),
h AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) AS x FROM p JOIN t USING (term), s),
r AS (SELECT i, item_id, d, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN h USING (term) GROUP BY i, item_id, d, doc_id HAVING sum(x) > 0)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM r
WINDOW w AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER w <= {K}"""


@register("op12_lexical_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item its ten best documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
