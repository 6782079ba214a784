"""Merkle manifest of a data set, its nodes labelled by nested intervals.

Every row is a leaf; a leaf's rank is its place in its group. A node at level k covers the leaf ranks [lo, hi): 2^k of them from a
multiple of 2^k on, fewer at the end of the group. Intervals are nested or apart, so a node's ancestors are the nodes whose interval holds
its own, and its sibling is what is left of the parent's interval without its own.

Levels are worked on in buckets of ``LEVELS``. The nodes at the lowest level of a bucket that lie in one node of the bucket above form a
fragment of at most 2^LEVELS nodes, which is one row and one hash tree built in it; its top node goes to the bucket above. So a tree of n
leaves takes log(n) / ``LEVELS`` shuffles, each a thousandth of the one before. Then the siblings along the way up are handed down, bucket
by bucket, by a containment join: a fragment joins the node of the bucket above that covers the same interval. The groups' roots are
leaves of one more tree, over all groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import forget, register, stored, table
from .fingerprint import let
from .ranges import ranked

LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: for each value ``-`` if it is null, else its UTF-8 byte count, a colon and the value."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return digest(F.concat(*[part(c.cast("string")) for c in columns]))


def _up(nodes: Column, total: Column, level: int) -> Column:
    """The level above ``level`` of a fragment; none once the group has one node."""
    at = lambda i: F.get(nodes, i)
    pairs = F.transform(F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(2)), lambda i: digest(F.concat(at(i), F.coalesce(at(i + 1), F.lit("")))))
    return F.when(total > (1 << level), pairs)


def _fragments(leaves: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Leaves or nodes (__group, __rank, __total, __digest) as fragments: ``__levels`` holds the digests level by level."""
    rows = leaves.groupBy("__group", F.shiftright("__rank", LEVELS).alias("__fragment")).agg(
        F.first("__total").alias("__total"), F.sort_array(F.collect_list(F.struct("__rank", "__digest"))).alias("__nodes"))
    rows = rows.withColumn("__l0", F.col("__nodes")["__digest"]).drop("__nodes")
    for k in range(LEVELS):
        rows = rows.withColumn(f"__l{k + 1}", _up(F.col(f"__l{k}"), F.col("__total"), k))
    names = [f"__l{k}" for k in range(LEVELS + 1)]
    return stored(rows.select("__group", "__fragment", "__total", F.array_compact(F.array(*names)).alias("__levels")), label)


def _paths(levels: Column, total: Column, place: Column) -> Column:
    """The siblings of the fragment's node ``place`` on the way to its top, lowest first: digest (null if it has none) and whether it is left."""
    def step(nodes: Column, k: Column) -> Column:
        own = F.call_function("shiftright", place, k)
        left = own.bitwiseAND(1) == 1
        return F.struct(F.get(nodes, F.when(left, own - 1).otherwise(own + 1)).alias("digest"), left.alias("left"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def trees(leaves: DataFrame, label: str = "manifest") -> tuple[list[DataFrame], list[str]]:
    """The fragments of each bucket of levels, lowest first, of the trees over ``leaves`` (__group, __rank, __total, __digest); and paths.

    The last bucket has one fragment a group, whose top node is the group's root.
    """
    most = leaves.agg(F.max("__total")).first()[0] or 0
    buckets, paths = [], []
    while True:
        rows, path = _fragments(leaves, f"{label}-{len(buckets)}")
        buckets.append(rows)
        paths.append(path)
        if most <= 1 << LEVELS:
            return buckets, paths
        most = (most + (1 << LEVELS) - 1) >> LEVELS
        top = F.element_at(F.element_at("__levels", -1), 1)
        size = F.floor((F.col("__total") + ((1 << LEVELS) - 1)) / (1 << LEVELS)).cast("long")
        leaves = rows.select("__group", F.col("__fragment").alias("__rank"), size.alias("__total"), top.alias("__digest"))


def roots(buckets: list[DataFrame]) -> DataFrame:
    """(__group, __digest) of each group's root."""
    return buckets[-1].select("__group", F.element_at(F.element_at("__levels", -1), 1).alias("__digest"))


def nodes(buckets: list[DataFrame]) -> DataFrame:
    """All nodes as (group, level, lo, hi, digest): the interval of leaf ranks that a node covers, level 0 being the leaves."""
    out = []
    for b, rows in enumerate(buckets):
        each = rows.select("__group", "__fragment", "__total", F.posexplode("__levels").alias("__k", "__nodes"))
        if b:
            each = each.where("__k > 0")  # its lowest level is the top level of the bucket below
        each = each.select("__group", "__fragment", "__total", "__k", F.posexplode("__nodes").alias("__i", "digest"))
        width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k") + b * LEVELS)
        lo = F.shiftleft(F.col("__fragment"), LEVELS * (b + 1)) + F.col("__i") * width
        each = each.select(F.col("__group").alias("group"), (F.col("__k") + b * LEVELS).alias("level"), lo.alias("lo"), (lo + width).alias("hi"), "digest", F.col("__total").alias("__total"))
        out.append(each.drop("__total") if b else each.withColumn("hi", F.least("hi", "__total")).drop("__total"))
    everything = reduce(DataFrame.unionByName, out)
    if len(buckets) == 1:
        return everything
    sizes = buckets[0].groupBy(F.col("__group").alias("__of")).agg(F.max("__total").alias("__leaves"))
    clipped = everything.join(sizes, F.col("group") == F.col("__of"))
    return clipped.withColumn("hi", F.least("hi", "__leaves")).drop("__of", "__leaves")


def siblings(buckets: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Per leaf (__group, __rank): ``__path`` to the root, lowest sibling first, and what ``above`` (__group, …) says of its group.

    ``above`` may hold a ``__path`` of the group's root in a tree over the groups, which is appended.
    """
    extra = [c for c in above.columns if c not in ("__group", "__path")] if above is not None else []
    handed = above.select("__group", F.lit(0).cast("long").alias("__node"), *[c for c in above.columns if c != "__group"]) if above is not None else None
    for rows in reversed(buckets):
        if handed is not None:
            handed = handed.select(F.col("__group").alias("__of"), "__node", *[c for c in handed.columns if c not in ("__group", "__node")])
            rows = rows.join(handed, (F.col("__group") == F.col("__of")) & (F.col("__fragment") == F.col("__node")))
        upper = F.col("__path") if "__path" in rows.columns else F.array().cast("array<struct<digest:string,left:boolean>>")
        each = rows.select("__group", "__fragment", "__total", "__levels", upper.alias("__upper"), *extra, F.posexplode(F.get("__levels", F.lit(0))).alias("__i", "__digest"))
        handed = each.select(
            "__group", (F.shiftleft("__fragment", LEVELS) + F.col("__i")).alias("__node"),
            F.concat(_paths(F.col("__levels"), F.col("__total"), F.col("__i")), F.col("__upper")).alias("__path"), *extra,
        )
    return handed.withColumnRenamed("__node", "__rank")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to; a node without a sibling is hashed alone."""
    step = lambda acc, s: digest(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])))
    return F.aggregate(path, leaf, step)


def group_key(value: Column) -> Column:
    """A text that orders groups by their bytes, null first, and is never null."""
    return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), value))


def manifest(docs: DataFrame, leaf: Column, group: Column, order: list[Column], extra: dict[str, Column] | None = None):
    """Trees over ``docs``: per group over its leaves by ``order``, and one over the groups' roots by group.

    Returns (leaves, buckets of the groups' trees, buckets of the top tree, paths of the tables). ``leaves`` has __group, __rank, __total,
    __digest, the order columns as __o0, … and the ``extra`` ones. Nulls come first in the order; rows alike in it are ordered by their
    digests; a null group is a group of its own. No rows give no tree.
    """
    named = {f"__o{i}": c for i, c in enumerate(order)}
    rows, at0 = stored(docs.select(
        group_key(group).alias("__group"), leaf.alias("__digest"), F.monotonically_increasing_id().alias("__tie"),
        *[c.alias(n) for n, c in {**named, **(extra or {})}.items()]), "manifest-leaves")
    rows, at1 = ranked(rows, "__group", [*named, "__digest", "__tie"], "manifest-ranks")
    leaves, at2 = stored(rows.drop("__tie"), "manifest-ranked")
    forget(docs.sparkSession, at0, at1)
    buckets, paths = trees(leaves)
    whole, at3 = ranked(roots(buckets).select(F.lit("").alias("__all"), "__group", "__digest"), "__all", ["__group"], "manifest-roots")
    top, more = trees(whole.select(F.col("__all").alias("__group"), "__rank", "__total", "__digest"), "manifest-top")
    return leaves, buckets, whole, top, [at2, *paths, at3, *more]


def proofs(leaves: DataFrame, buckets: list[DataFrame], whole: DataFrame, top: list[DataFrame]) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``__path``: the siblings from the leaf to the root."""
    one = roots(top).select(F.col("__digest").alias("root"))
    up = siblings(top).select(F.col("__rank").alias("__at"), F.col("__path"))
    groups = whole.select("__group", F.col("__rank"), F.col("__digest").alias("subroot")).join(up, F.col("__rank") == F.col("__at"))
    groups = groups.select("__group", "subroot", "__path", one.scalar().alias("root"))
    paths = siblings(buckets, groups).withColumnsRenamed({"__group": "__of", "__rank": "__place"})
    return leaves.join(paths, (F.col("__group") == F.col("__of")) & (F.col("__rank") == F.col("__place"))).drop("__of", "__place")


def tampered(doc_id: Column) -> Column:
    """Whether 7 divides the unsigned crc32 of the decimal id; never for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def _sql() -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda n: "sha256(" + " || ".join(value(n if c == "n_chars" else c) for c in COLUMNS) + ")"
    tree = lambda name, start: f"""{name}(g, level, i, h, n) AS (
    {start}
    UNION ALL
    SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, i // 2, n)"""
    return f"""
WITH RECURSIVE bits AS (SELECT [list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR x IN range(256)] AS t),
d AS MATERIALIZED (SELECT *, {row('n_chars')} AS leaf, {row('(n_chars + 1)')} AS other,
  coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: xor(c // 256, bits.t[(xor(c, b) % 256) + 1])), 4294967295) % 7 = 0, false) AS hit FROM documents, bits),
r AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g
  FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
{tree('t', 'SELECT g, 0, rank, leaf, n FROM r')},
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
{tree('u', 'SELECT 0, 0, rank, h, n FROM s')},
steps AS MATERIALIZED (
  SELECT r.g, r.rank, a.level AS k, b.h AS sib, b.i < a.i AS l FROM r JOIN t a ON a.g = r.g AND a.i = r.rank >> a.level AND a.n > 1
    LEFT JOIN t b ON b.g = a.g AND b.level = a.level AND b.i = xor(a.i, 1)
  UNION ALL
  SELECT r.g, r.rank, 1000 + a.level, b.h, b.i < a.i FROM r JOIN s USING (g) JOIN u a ON a.i = s.rank >> a.level AND a.n > 1
    LEFT JOIN u b ON b.level = a.level AND b.i = xor(a.i, 1)),
path AS (SELECT g, rank, row_number() OVER (PARTITION BY g, rank ORDER BY k) AS k, sib, l FROM steps),
proof AS (SELECT g, rank, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS p FROM path GROUP BY g, rank),
f(g, rank, k, acc) AS (
  SELECT g, rank, 0::BIGINT, CASE WHEN hit THEN other ELSE leaf END FROM r
  UNION ALL
  SELECT f.g, f.rank, f.k + 1, sha256(CASE WHEN sib IS NULL THEN acc WHEN l THEN sib || acc ELSE acc || sib END)
  FROM f JOIN path ON path.g = f.g AND path.rank = f.rank AND path.k = f.k + 1),
folded AS (SELECT g, rank, max_by(acc, k) AS acc FROM f GROUP BY g, rank)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, acc AS folded_root,
       acc = (SELECT h FROM u WHERE n = 1) AS verified
FROM r JOIN s USING (g) LEFT JOIN proof ON proof.g = r.g AND proof.rank = r.rank JOIN folded ON folded.g = r.g AND folded.rank = r.rank"""


@register("op13_merkle_manifest", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its leaf, the roots, the digest of its proof, and whether the tampered leaf leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    plain = [F.col(c) for c in COLUMNS]
    other = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    extra = {"__other": F.when(tampered(F.col("doc_id")), other)}
    leaves, buckets, whole, top, paths = manifest(docs, leaf_digest(plain), F.col("lang"), [F.col("doc_id")], extra)
    rows = proofs(leaves, buckets, whole, top)
    rows = rows.withColumn("folded_root", fold(F.coalesce("__other", "__digest"), F.col("__path")))
    out, _ = stored(rows.select(
        F.col("__o0").alias("doc_id"), F.col("__digest").alias("leaf"), "subroot", "root",
        digest(F.array_join(F.col("__path")["digest"], "")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    ), "manifest-proofs")
    forget(spark, *paths)
    return out
