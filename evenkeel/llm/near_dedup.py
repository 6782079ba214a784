"""Near duplicates by Order MinHash: a few minimal occurrence-labelled word 5-grams in text order, then banded alignment.

Of every distinct text, each of ``SKETCHES`` hash functions picks the ``TUPLE`` smallest 5-grams, where the n-th occurrence of a
5-gram counts as an item of its own; their hashes in the order of the text are one bucket key. Texts that share a bucket are
aligned word by word within a band, and are linked when at most a fifth of the longer one's words must be edited
(similarity 0.8 or more). Classes are the connected components of the links.

Two copies with a share J of common 5-grams meet in a bucket with probability 1-(1-J*J)**64. Edits spread over the whole text leave J of
about 0.2 at a similarity of 0.80, 0.29 at 0.85 and 0.42 at 0.90, so 0.92, 0.99 and 1.00 of such pairs meet.

Every member of a bucket is aligned with its hub, so a bucket of copies costs one alignment a member, not all pairs. Members that stay in
other classes meet over their rarest pairs of neighbouring words: an edit touches two of them, so two texts within the allowed edits
have at least three fifths of the longer one's pairs in common, counted with repeats, and each has one of the common ones among the first
two fifths (and one more) of its pairs in any one order of all pairs. Only texts of different classes that agree in such a pair are compared:
a text meets a class in blocks of its members, by counters of their words, and what these leave is aligned. No link of two texts that share a bucket is lost, and
unrelated texts around a common passage, which share a bucket too, do not meet. ``tests/llm`` compares the classes with all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import drop_kept, forget, give_back, map_batches, register, stored, table
from .components import classes
from .words import blocks, mix, scan, span_hash

GRAM, TUPLE, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
#: Members aligned with one copy of a hub's text in a task.
PER_HUB = 512
#: Rounds of hubs, one a bucket and round.
ROUNDS = 2
#: Counters of word pairs by hash; they order the pairs of a text, rare ones first. The driver holds one array of them.
COUNTERS = 1 << 20
#: Counters of a text's words by hash, one byte each, which rule pairs out before any words travel.
TALLY = 1024
#: Texts of a class that are compared with others as one block.
BLOCK = 512
MARKS = ("bits0", "bits1", "bits2", "bits3")
_PLACE = np.uint64((1 << 24) - 1)


def labelled_grams(words, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-gram together with its occurrence number in its text, and the first k-gram of each text.

    A text of fewer than k words has one k-gram of all its words; one without words has none.
    """
    n = np.diff(words.first)
    count = np.where(n >= gram, n - gram + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = words.first[doc] + np.arange(first[-1]) - first[doc]
    h = span_hash(words.hash, start, np.minimum(start + gram, words.first[doc + 1]))
    keyed = h ^ mix(doc.astype(np.uint64))
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    run = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    nth = np.empty(len(h), np.uint64)
    nth[order] = (np.arange(len(h)) - run).astype(np.uint64)
    return np.where(nth > 0, mix(h + nth * np.uint64(0xD1B54A32D192ED03)), h), first


def sketch(texts: list[str], sketches: int = SKETCHES, gram: int = GRAM) -> np.ndarray:
    """Bucket keys (texts x sketches); a text without words has the key 0 everywhere."""
    words = scan(texts)
    h, first = labelled_grams(words, gram)
    out = np.zeros((len(texts), sketches), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    starts = first[:-1][full]
    size = np.diff(first)[full]
    place = (np.arange(len(h)) - np.repeat(starts, size)).astype(np.uint64) & _PLACE
    for s in range(sketches):
        seed = mix(np.full(1, s + 1, np.uint64))[0]
        x = (h ^ seed) * np.uint64(0x9FB21C651E98DF25)
        x = ((x ^ (x >> np.uint64(28))) & ~_PLACE) | place
        best = np.minimum.reduceat(x, starts)
        x[(best & _PLACE).astype(np.int64) + starts] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = np.where(size > 1, np.minimum.reduceat(x, starts), best)
        a, b = (best & _PLACE).astype(np.int64), (second & _PLACE).astype(np.int64)
        out[full, s] = mix(mix(h[starts + np.minimum(a, b)] + seed) * np.uint64(31) + h[starts + np.maximum(a, b)] + np.uint64(s))
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences if it is at most ``most``, else ``most + 1``: banded rows, widening bands."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(same[0]) if len(same) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    masks: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    band = max(8, len(a) - len(b))
    while True:
        band = min(band, most, len(a))
        d = _banded(masks, len(a), b.tolist(), band)
        if d <= band or band >= min(most, len(a)):
            return min(d, most + 1)
        band *= 4


def _banded(masks: dict[int, int], n: int, b: list[int], k: int) -> int:
    """Edit distance inside the band of k diagonals on either side, one column of differences as the bits of a number.

    ``masks`` holds the places of each word in the longer sequence of n words. Bit t of column j is row j - k + t, so the
    band slides down by one row a column. A result over k only says that the distance is over k.
    """
    width = (1 << 2 * k + 1) - 1
    up, down = width ^ ((1 << k) - 1), 0  # where the next row is one more or one less than this one
    bottom, score, turn = 1 << 2 * k, k, n - k
    for j, word in enumerate(b, 1):
        at = j - k - 1
        mask = masks.get(word, 0)
        same = (mask >> at if at >= 0 else mask << -at) & width
        free = ((((same & up) + up) ^ up) | same | down) & width  # cells equal to the one up left
        more, less = down | (width & ~(free | up)), free & up
        if j <= turn:  # along the lowest diagonal, then along the last row
            score += not free & bottom
        else:
            row = 1 << n - j + k
            score += bool(more & row) - bool(less & row)
        free >>= 1
        up, down = less | (width & ~(free | more)), free & more
    return score


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length reaches the similarity."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    for q in (1, 2):  # an edit touches at most q of the q-grams, so fewer common ones rule the pair out
        x, y = (a, b) if q == 1 else (mix(a[:-1]) + a[1:], mix(b[:-1]) + b[1:])
        if max(len(a), len(b)) - q + 1 - q * most > _common(x, y):
            return False
    return edits(a, b, most) <= most


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection, counting repeats."""
    a, b = np.sort(a), np.sort(b)
    n = np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")
    nth = np.arange(len(a)) - np.searchsorted(a, a, "left")
    return int((nth < n).sum())


def signatures(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """(digest, keys) of every distinct text of ``docs`` (digest, text) that has words; copies shrink to one row in the map tasks."""
    def run(batch: pa.RecordBatch):
        digests = batch.column("digest")
        for at, part in blocks(batch.column("text").to_pylist()):
            keys = sketch(part, sketches)
            full = np.flatnonzero(keys.any(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * sketches), pa.array(keys[full].view(np.int64).ravel()))
            yield {"digest": digests.take(pa.array(full + at)), "keys": lists}

    return map_batches(docs, run, "digest binary, keys array<long>").dropDuplicates(["digest"])


def word_rows(texts: DataFrame) -> DataFrame:
    """(item, words, size, bits): 32 bits of every word's hash, a third of the text to move and nothing to parse again; their number and ``marks``."""
    def run(batch: pa.RecordBatch):
        items = batch.column("item")
        for at, part in blocks(batch.column("text").to_pylist()):
            found = scan(part)
            low = (found.hash >> np.uint64(32)).astype("<u4")
            data = [low[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:])]
            yield {"item": items.slice(at, len(part)), "words": data, "size": np.diff(found.first), **marks(found)}

    return map_batches(texts, run, f"item long, words binary, size int, {', '.join(f'{m} long' for m in MARKS)}")


def marks(words) -> dict[str, np.ndarray]:
    """A set of bits for the words of each text. An edit adds one word at most and takes one away, so it does so with the bits."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    bit = words.hash >> np.uint64(40)
    out = {}
    for k, name in enumerate(MARKS):
        own = bit % np.uint64(len(MARKS)) == k
        value = np.zeros(len(words.first) - 1, np.uint64)
        np.bitwise_or.at(value, doc[own], np.uint64(1) << (bit[own] >> np.uint64(8)) % np.uint64(64))
        out[name] = value.view(np.int64)
    return out


def _aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words are alike. Words of an item are copied once for every ``PER_HUB`` of its partners, so no task holds all."""
    share = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    copies = F.greatest(F.lit(1), F.ceil(F.col("n") / PER_HUB)).cast("int")
    salted = pairs.join(share, "a").withColumn("salt", F.pmod(F.xxhash64("b"), copies).cast("int")).select("a", "b", "salt")
    hubs = words.join(share, words["item"] == share["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), F.col("words").alias("words_a")
    )
    # Both joins read the words as they are, so they travel once.
    members = salted.join(words, salted["b"] == words["item"]).select("a", "b", "salt", F.col("words").alias("words_b"))

    def run(batch: pa.RecordBatch):
        a, b = batch.column("a"), batch.column("b")
        read = lambda x: np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64)
        both = zip(batch.column("words_a"), batch.column("words_b"))
        keep = pa.array([i for i, (x, y) in enumerate(both) if alike(read(x), read(y), similarity)], pa.int64())
        yield {"a": a.take(keep), "b": b.take(keep)}

    return map_batches(members.join(hubs, ["a", "salt"]).select("a", "b", "words_a", "words_b"), run, "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key")


def _open(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows (key, item, size) of buckets with texts of two or more classes, with the class and its number of rows in the bucket."""
    own = rows.join(known, "item", "left").select("key", "item", "size", *MARKS, F.coalesce("class", "item").alias("class"))
    parts = own.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key")
    return own.join(parts.join(several, "key"), ["key", "class"])


def _lacking(a: str, b: str) -> Column:
    """How many marks of one text the other lacks: so many edits at least."""
    return sum((F.bit_count(F.col(f"{a}{m}").bitwiseAND(F.bitwise_not(f"{b}{m}"))) for m in MARKS), F.lit(0))


def _most(size: Column, similarity: float) -> Column:
    return F.floor(F.lit(1 - similarity) * size + 1e-9)


def labelled_pairs(data) -> np.ndarray:
    """A number for every word (32-bit hashes as bytes) and the one before it, together with the pair's occurrence number in the text."""
    w = np.frombuffer(data.as_buffer(), "<u4").astype(np.uint64)
    both = mix(w) + np.concatenate([np.zeros(1, np.uint64), w[:-1]]) if len(w) else w
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    nth = np.empty(len(w), np.uint64)
    nth[order] = np.arange(len(w)) - np.searchsorted(ranked, ranked, "left")
    return mix(mix(both) + nth)


def _counters(words: DataFrame) -> np.ndarray:
    """How many labelled pairs fall on each of ``COUNTERS`` counters, over all texts; the array has this size whatever the data."""
    def run(batch: pa.RecordBatch):
        slots = [labelled_pairs(data) % np.uint64(COUNTERS) for data in batch.column("words")]
        total = np.bincount(np.concatenate(slots).astype(np.int64), minlength=COUNTERS)
        yield {"slot": np.flatnonzero(total), "n": total[total > 0]}

    found = map_batches(words, run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def rare_pairs(words: DataFrame, similarity: float) -> DataFrame:
    """(token, item, class, size) for the rarest labelled pairs of each text: one more than the edits it allows can touch."""
    counts = words.sparkSession.sparkContext.broadcast(_counters(words.select("words")))

    def run(batch: pa.RecordBatch):
        tokens, n = [], []
        for data in batch.column("words"):
            own = labelled_pairs(data)
            order = np.lexsort((own, counts.value[(own % np.uint64(COUNTERS)).astype(np.int64)]))
            tokens.append(own[order[: int(2 * (1 - similarity) * len(own) + 1e-9) + 1]])
            n.append(len(tokens[-1]))
        at = pa.array(np.repeat(np.arange(len(n)), n))
        yield {"token": np.concatenate(tokens).view(np.int64), **{c: batch.column(c).take(at) for c in ("item", "class", "size")}}

    return map_batches(words.select("item", "words", "class", "size"), run, "token long, item long, class long, size int")


def _over_rare_pairs(tokens: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``texts`` (item, size, words, class) of different classes that agree in a token and may be alike by lengths and words.

    Over a token, the texts of a smaller class that have it meet a larger one as a whole, by the range of its lengths there, and once
    whatever tokens they share; no two texts of a class meet. Tokens travel with all that this takes, and are dealt out by token only.
    """
    by_token, by_class = Window.partitionBy("token"), Window.partitionBy("token", "class")
    ends = tokens.withColumns({"low": F.min("class").over(by_token), "high": F.max("class").over(by_token)}).where("low < high")
    shared, path = stored(ends.select("token", "item", "class", "size", F.count(F.lit(1)).over(by_class).alias("n")), "rare")
    parts = shared.select("token", "class", "size").repartition("token").groupBy("token", "class").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high")
    ).select("token", F.struct("n", "class", "low", "high").alias("two"))
    longer = F.greatest("size", "two.low")  # of a text and the nearest length, unless it lies between
    apart = F.greatest(F.col("two.low") - F.col("size"), F.col("size") - F.col("two.high"))
    met = shared.join(parts, "token").where((F.struct("n", "class") < F.struct("two.n", "two.class")) & (apart <= _most(longer, similarity)))
    own, own_path = stored(met.select("item", F.col("two.class").alias("other")).distinct(), "rare")
    pairs = _within_edits(own, texts, similarity)
    forget(tokens.sparkSession, path, own_path)
    return pairs


def _tallies(texts: DataFrame) -> DataFrame:
    """(item, class, size, tally): how often the words of each text fall on each of ``TALLY`` counters, 255 standing for more as well.

    An edit changes two counters by one at most, one up and one down, so texts whose counters differ by more either way are not alike.
    """
    def run(batch: pa.RecordBatch):
        tally = []
        for data in batch.column("words"):
            slot = mix(np.frombuffer(data.as_buffer(), "<u4").astype(np.uint64)) % np.uint64(TALLY)
            tally.append(np.minimum(np.bincount(slot.astype(np.int64), minlength=TALLY), 255).astype(np.uint8).tobytes())
        yield {"tally": tally, **{c: batch.column(c) for c in ("item", "class", "size")}}

    return map_batches(texts.select("item", "class", "size", "words"), run, "item long, class long, size int, tally binary")


def _within_edits(own: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a text and one of the class that it meets, by ``own`` (item, other), that lengths and tallies do not rule out.

    Members of a class and the texts that meet it come together in blocks of about ``BLOCK`` of either, and only pairs left are rows.
    """
    tallies, path = stored(_tallies(texts), "tallies")
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    members = tallies.groupBy("class").agg(F.count(F.lit(1)).alias("n")).select("class", blocks_of("n").alias("parts"))
    asked = own.groupBy(F.col("other").alias("class")).agg(F.count(F.lit(1)).alias("n")).select("class", blocks_of("n").alias("times"))
    shape, shape_path = stored(members.join(asked, "class"), "blocks")
    key, salt = ["class", "part", "time"], lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = tallies.join(shape, "class").withColumns({"part": salt("parts"), "meets": F.lit(False)}).withColumn("time", every("times"))
    here = own.withColumnRenamed("other", "class").join(shape, "class").join(tallies.drop("class"), "item")
    here = here.withColumns({"time": salt("times"), "meets": F.lit(True)}).withColumn("part", every("parts"))
    cells = [*key, "meets", "item", "size", "tally"]
    rows = there.select(cells).unionByName(here.select(cells)).repartition(*key).sortWithinPartitions(*key, "meets")
    pairs = rows.mapInArrow(lambda batches: _left_pairs(batches, similarity), "a long, b long").distinct()
    out, _ = stored(pairs, "pairs")
    forget(own.sparkSession, path, shape_path)
    return out


def _left_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the blocks in ``batches``, which are sorted, each block's members before the texts that meet them; a block may span batches."""
    drop_kept(__name__)
    block, held = None, None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("class", "part", "time")], axis=1)
        meets = batch.column("meets").to_numpy(zero_copy_only=False)
        item, size = batch.column("item").to_numpy(), batch.column("size").to_numpy().astype(np.int64)
        tally = np.frombuffer(b"".join(batch.column("tally").to_pylist()), np.uint8).reshape(-1, TALLY)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (meets[1:] != meets[:-1])) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)]):
            if start == end:
                continue
            own = (item[start:end], size[start:end], tally[start:end])
            if block != tuple(key[start]):
                block, held = tuple(key[start]), None
            if not meets[start]:
                held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own))
                continue
            if held is None:  # the hash gave this part no member
                continue
            one, many = (own, held) if len(own[0]) <= len(held[0]) else (held, own)
            for i in range(len(one[0])):
                k = _unruled(one[1][i], one[2][i], many[1], many[2], similarity)
                a.append(np.minimum(many[0][k], one[0][i])), b.append(np.maximum(many[0][k], one[0][i]))
        if held is not None:
            held = tuple(x.copy() for x in held)  # not the whole batch
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
    give_back()


def _unruled(size: int, tally: np.ndarray, sizes: np.ndarray, tallies: np.ndarray, similarity: float) -> np.ndarray:
    """Places of the texts whose sizes and tallies allow the similarity to one text's."""
    longer = np.maximum(sizes, size)
    most = np.floor((1 - similarity) * longer + 1e-9)
    near = np.flatnonzero(longer - np.minimum(sizes, size) <= most)
    apart = tallies[near].astype(np.int16) - tally.astype(np.int16)
    more, fewer = np.maximum(apart, 0).sum(axis=1, dtype=np.int64), np.maximum(-apart, 0).sum(axis=1, dtype=np.int64)
    return near[np.maximum(more, fewer) <= most[near]]


def _may_link(similarity: float) -> Column:
    """Whether lengths and marks of a text and its hub allow the similarity."""
    longer, shorter = F.greatest("size", "hub_size"), F.least("size", "hub_size")
    most = _most(longer, similarity)
    return (longer - shorter <= most) & (_lacking("", "hub_") <= most) & (_lacking("hub_", "") <= most)


def links(docs: DataFrame, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links (a, b) between the different texts of ``docs`` (digest, text), their classes, and the number of every text (digest, item).

    Every two texts of a bucket are aligned unless they are in one class already or their lengths, marks or rarest pairs of words rule them out.
    """
    spark = docs.sparkSession
    # The numbers are stored with the signatures, so a lost executor does not change them.
    signed, signed_path = stored(signatures(docs, sketches).withColumn("item", F.monotonically_increasing_id()), "signatures")
    rows = signed.select(F.explode("keys").alias("key"), "item").where("key <> 0")
    keys, keys_path = stored(_shared(rows), "buckets")
    # Copies are dropped before they travel; only texts that share a bucket are kept for the alignments.
    met = signed.join(keys.select("item").distinct(), "item", "left_semi").select("digest", "item")
    words, words_path = stored(word_rows(docs.dropDuplicates(["digest"]).join(met, "digest").select("item", "text")), "words")
    numbers, _ = stored(signed.select("digest", "item"), "numbers")
    forget(spark, signed_path)
    live, live_path = stored(keys.join(words.select("item", "size", *MARKS), "item").withColumns({"class": F.col("item"), "n": F.lit(1)}), "buckets")
    forget(spark, keys_path)
    found = spark.createDataFrame([], "a long, b long")
    known = spark.createDataFrame([], "item long, class long")
    cells = ("item", "class", "size", *MARKS)
    for _ in range(ROUNDS):
        # Texts of a bucket's small classes come first: they meet the large class as a whole. Four orders of hubs: a document
        # meets several members of its class, but not another one in every bucket.
        first = F.min(F.struct("n", F.xxhash64("item", F.pmod("key", F.lit(4))).alias("h"), *cells)).alias("hub")
        hubs = live.groupBy("key").agg(first).select("key", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in cells])
        pairs, pairs_path = stored(live.join(hubs, "key").where((F.col("class") != F.col("hub_class")) & _may_link(similarity)).select(
            F.least("item", "hub_item").alias("a"), F.greatest("item", "hub_item").alias("b")
        ).distinct(), "pairs")
        good, _ = stored(_aligned(pairs, words, similarity), "links")
        found = found.unionByName(good)
        if not good.isEmpty():
            known = classes(found)
        rows, rows_path = stored(_open(live.select("key", "item", "size", *MARKS), known), "buckets")
        forget(spark, live_path, pairs_path)
        live, live_path = rows, rows_path
    left = words.join(live.groupBy("item").agg(F.first("class").alias("class")), "item")
    left, left_path = stored(left, "words")
    tokens, tokens_path = stored(rare_pairs(left, similarity), "rare")
    pairs = _over_rare_pairs(tokens, left, similarity)
    good, _ = stored(_aligned(pairs, left, similarity), "links")
    forget(spark, words_path, live_path, left_path, tokens_path)
    found = found.unionByName(good).distinct()
    return found, known if good.isEmpty() else classes(found), numbers


def near_classes(docs: DataFrame, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """(item, class, least, class_id, n_docs, n_links) for every distinct text of ``docs`` (doc_id, text); item is its digest.

    ``class_id`` is the smallest doc_id of the class (``least`` the text's own), ``n_docs`` the rows of the class; null texts are empty texts, and
    equal texts are always one class. ``n_links`` counts the text's links to different texts.
    """
    texts = docs.groupBy(digest().alias("item")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found, known, numbers = links(docs.select(digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text")), sketches, similarity)
    partners = found.select(F.explode(F.array("a", "b")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_links"))
    linked = known.join(partners, "item").join(numbers, "item").select("digest", "class", "n_links")
    known = texts.join(linked, texts["item"] == linked["digest"], "left").select(
        "item", F.coalesce(F.col("class").cast("string"), F.hex("item")).alias("class"), "least", "n", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    whole = known.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_docs"))
    return known.join(whole, "class").select("item", "class", "least", "class_id", "n_docs", "n_links")


def digest() -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


@register("op2_near_dedup")
def op2(spark, sf_dir) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_docs in the class, n_links of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = stored(near_classes(docs), "near")
    return docs.select("doc_id", digest().alias("item")).join(found, "item").select("doc_id", "class_id", "n_docs", "n_links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each class the document with the smallest doc_id stays; of repeated rows with that id and text, one.

    Ids are joined beside the texts' digests, so a text that a third of all documents share is spread over the tasks.
    """
    found, _ = stored(near_classes(docs.select("doc_id", "text")), "near")
    first = F.min(F.struct(F.col("least").isNull(), "least", "item")).alias("kept")
    keep = found.groupBy("class").agg(first).select(F.col("kept.item").alias("__item"), _key("kept.least").alias("__id"))
    rows = docs.withColumns({"__item": digest(), "__id": _key("doc_id")})
    kept = rows.join(keep, ["__item", "__id"], "left_semi").dropDuplicates(["__item", "__id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
