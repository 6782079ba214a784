"""URL rules by a sort-merge range join, in built-in expressions only.

A rule (host, path) fits its host and all subdomains where the path of the URL starts with the rule's. Hosts become keys of their
labels in reverse, each followed by a dot (``com.example.www.``), so a rule's host and its subdomains are one interval of the sorted
keys, that of the keys which start with the rule's. Intervals of prefixes are nested or apart. Points and rules are sorted together and
cut into chunks; the sweep carries a stack along: the last rule before a point brings the stack of the rules it lies in, itself on top,
and what the point's key does not start with is popped. A chunk takes over the stack at the end of the chunk before it.

A first sweep over hosts gives each URL the rule hosts that hold it. A second one over ``<rule host>/<path>`` gives the longest
path rule of each of these hosts. Of all rules found the longest one (host and path in code points, then the longer host) decides.

Copies of one URL, and URLs of one host, are spread over chunks by their row number, and no join has a URL, host or rule for its key.
Points are compared over as many characters as the longest rule has, which changes no answer; the texts returned are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import forget, register, stored, table
from .ranges import CHUNK, chunked

#: Fixed values of the contract: host, path and verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both are empty for a null and for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(rest, _PARTS, 2)


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot behind it; the empty host has the empty key, which every key starts with."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def nested(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (__key, __value), keys distinct, as (__key, __stack): those that the key starts with, shortest first, itself last."""
    lengths = prefixes.agg(F.array_sort(F.collect_set(F.length("__key"))).alias("l"))
    each = prefixes.select("__key", lengths.scalar().alias("__lengths"))
    each = each.select("__key", F.explode(F.filter("__lengths", lambda n: n <= F.length("__key"))).alias("__n"))
    each = each.select("__key", F.substr("__key", F.lit(1), F.col("__n")).alias("__part"))
    outer = prefixes.select(F.col("__key").alias("__part"), F.struct(F.col("__key").alias("key"), F.col("__value").alias("value")).alias("__entry"))
    found = each.join(outer, "__part").groupBy("__key").agg(F.collect_list("__entry").alias("__stack"))
    return found.withColumn("__stack", F.array_sort("__stack", lambda a, b: F.length(a["key"]) - F.length(b["key"])))


def enclosing(points: DataFrame, prefixes: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``points`` (__row, __key and more) with ``__open``: the prefixes (__key, __value) that hold its key, outermost first; and a path."""
    marks = nested(prefixes)
    rows, path = chunked(points.unionByName(marks, allowMissingColumns=True), ["__key", "__row"], label)
    # The last stack of each chunk that has one, and what each chunk takes over: one row for a chunk at most.
    ends = rows.where(F.col("__row").isNull()).groupBy(CHUNK).agg(F.max_by("__stack", "__key").alias("__last"))
    ends = rows.select(CHUNK).distinct().join(ends, CHUNK, "left")
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select(CHUNK, F.last("__last", True).over(before).alias("__stack"), F.lit("").alias("__key")).where("__stack IS NOT NULL")
    sweep = Window.partitionBy(CHUNK).orderBy("__key", F.col("__row").isNotNull(), "__row", F.size("__stack")).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(taken, allowMissingColumns=True).withColumn("__stack", F.last("__stack", True).over(sweep))
    still = F.filter("__stack", lambda entry: F.startswith(F.col("__key"), entry["key"]))
    return swept.where(F.col("__row").isNotNull()).withColumn("__open", still).drop("__stack", CHUNK), path


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules`` has host, path and verdict, any number of them; a null host or path counts as empty, the empty host fits all hosts, and of rules
    with the same host and path the greatest verdict counts (block before allow). A null URL, or one without ``://``, has an empty host
    and path. Repeated rows are judged each for itself; columns of ``urls`` with the four names are replaced. All other columns travel
    through one shuffle: pass only those you need.
    """
    spark = urls.sparkSession
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(f"`{url}`"))
    kept = F.struct(*[F.col(f"`{c}`") for c in names])
    base, at0 = stored(urls.select(
        F.monotonically_increasing_id().alias("__row"), kept.alias("__kept"), host.alias("host"), path.alias("path")), "urls")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = rules.select(F.translate(text("host"), _UPPER, _LOWER).alias("host"), text("path").alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("__key", host_key(F.col("host")))
    longest = rules.agg(F.coalesce(F.max(F.length("__key")), F.lit(0)).alias("h"), F.coalesce(F.max(F.length("path")), F.lit(0)).alias("p")).first()

    hosts = rules.select("__key", F.lit(None).cast("string").alias("__value")).distinct()
    points = base.select(
        "__row", F.substr(host_key(F.col("host")), F.lit(1), F.lit(longest.h)).alias("__key"),
        F.substr("path", F.lit(1), F.lit(longest.p)).alias("__path"),
    )
    held, at1 = enclosing(points, hosts, "url-hosts")
    probes = held.select("__row", "__path", F.explode("__open").alias("__host")).select(
        "__row", F.concat("__host.key", F.lit("/"), "__path").alias("__key"))
    value = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("n_host"), F.concat("host", "path").alias("rule"), "verdict")
    keys = rules.select(F.concat("__key", F.lit("/"), "path").alias("__key"), value.alias("__value"))
    fitting, at2 = enclosing(probes, keys, "url-paths")
    found = fitting.select(F.col("__row").alias("__of"), F.try_element_at("__open", F.lit(-1))["value"].alias("__best")).where("__best IS NOT NULL")
    found = found.groupBy("__of").agg(F.max("__best").alias("__best"))
    out = base.join(found, F.col("__row") == F.col("__of"), "left")
    out, _ = stored(out.select(
        *[F.col("__kept").getField(c).alias(c) for c in names], "host", "path", F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    ), "url-verdicts")
    forget(spark, at0, at1, at2)
    return out


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT r, page_id, translate(regexp_extract(rest, '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '{_PARTS}', 2) AS path FROM u),
fit AS (SELECT r, max_by(h || p, [length(h || p), length(h)]) AS rule, max_by(v, [length(h || p), length(h)]) AS v
        FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM k LEFT JOIN fit USING (r)"""


@register("op11_url_filter", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page the host and path of its URL, the rule that decides and the verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
