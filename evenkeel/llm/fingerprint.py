"""Document fingerprints by Order MinHash, in built-in expressions only.

Each word 3-gram of a text, together with its occurrence number, is hashed to a point on a circle of 64-bit numbers. From each of
``SLOTS`` evenly spread marks the next ``2`` points are the minimal ones under that rotation; put in the order of the text, their pair
is hashed to one slot of 4 hex digits. Copies agree in all slots; an edit changes the slots of the 3-grams it touches, and moving a
passage changes the order in pairs that span it. The likeness of two fingerprints is the square root of the share of equal slots: two
3-grams must agree in a slot, so it is near the share of 3-grams that the texts have in common.

A text of fewer than 3 words has one gram of all its words; without words the fingerprint is empty, and alike only to an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import register, table

GRAM, SLOTS = 3, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, gram: int = GRAM, slots: int = SLOTS) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, "").otherwise(_slots(h, gram, slots)))


def _slots(h: Column, gram: int, slots: int) -> Column:
    n = F.greatest(F.size(h) - (gram - 1), F.lit(1))
    grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.xxhash64(*[F.get(h, i + k) for k in range(gram)]).alias("v"), i.alias("p")))
    return let(F.sort_array(grams), lambda s: let(_runs(s), lambda runs: let(
        F.when(F.size(runs) == F.size(s), s).otherwise(F.sort_array(_numbered(s, runs))), lambda a: _text(a, slots))))


def _runs(s: Column) -> Column:
    """Where equal grams begin in the sorted grams."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["v"] != F.get(s, j - 1)["v"]))


def _numbered(s: Column, runs: Column) -> Column:
    """Later occurrences of a gram become points of their own."""
    def run(first: Column, r: Column) -> Column:
        last = F.coalesce(F.get(runs, r + 1), F.size(s)) - 1
        return F.transform(F.sequence(first, last), lambda j: let(F.get(s, j), lambda x: F.struct(
            F.when(j == first, x["v"]).otherwise(F.xxhash64(x["v"], j - first)).alias("v"), x["p"].alias("p"))))

    return F.flatten(F.transform(runs, run))


def _text(a: Column, slots: int) -> Column:
    """Slots from the sorted points. The marks are sorted in with them; mark j at place t has t - j points before it."""
    step = (1 << 64) // slots
    marks = F.array(*[F.struct(F.lit(-(1 << 63) + j * step).cast("long").alias("v"), F.lit(-1).alias("p")) for j in range(slots)])
    n = F.size(a)

    def slot(t: Column, j: Column) -> Column:
        pair = let(F.get(a, (t - j) % n), lambda x: let(F.get(a, (t - j + 1) % n), lambda y: F.when(
            x["p"] <= y["p"], F.xxhash64(x["v"], y["v"])).otherwise(F.xxhash64(y["v"], x["v"]))))
        return F.substring(F.hex(pair.bitwiseAND(0xFFFF) + 0x10000), 2, 4)

    return let(F.sort_array(F.concat(a, marks)), lambda b: F.array_join(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda t: F.get(b, t)["p"] == -1), slot), ""))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    same = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: F.substr(a, j * 4 + 1, F.lit(4)) == F.substr(b, j * 4 + 1, F.lit(4)))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.sqrt(F.size(same) / F.lit(float(slots))))


def with_next(docs: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` of the next row by ``order``, after the last row those of the first one; nulls come first.

    The first order column must be a number. Its range is cut into as many chunks as there are shuffle partitions; the first rows
    of each chunk also go to the chunk before, so one shuffle of the rows is enough and no task sees more than its chunk.
    """
    spark, key = docs.sparkSession, order[0]
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(key).where(F.col(key).isNotNull()).repartitionByRange(chunks, key)
    low = sorted({r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min(key).alias("low")).select("low").collect()})
    if not low:
        low = [0]
    starts = F.lit(low)
    nulls = not docs.where(F.col(key).isNull()).isEmpty()
    own = F.greatest(F.size(F.filter(starts, lambda x: x <= F.col(key))) - 1, F.lit(0))
    at = F.when(F.col(key).isNull(), 0).otherwise(own)
    is_first = F.col(key).isNull() if nulls else F.col(key) == low[0]
    places = F.array_compact(F.array(
        F.struct(at.alias("chunk"), F.lit(0).alias("kind")),
        F.when((at > 0) & (F.col(key) == F.get(starts, at)), F.struct((at - 1).alias("chunk"), F.lit(1).alias("kind"))),
        F.when(is_first, F.struct(F.lit(len(low) - 1).alias("chunk"), F.lit(2).alias("kind"))),
    ))
    rows = docs.withColumn("__at", F.explode(places))
    w = Window.partitionBy("__at.chunk").orderBy("__at.kind", *[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return rows.where("__at.kind = 0").drop("__at")


@register("op10_fingerprint")
def op10(spark, sf_dir) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness, as the contract names them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(docs, ["doc_id", "text"], ["text", "fingerprint"])
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n.cast("int") - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
