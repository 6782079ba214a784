"""Substring deduplication by hashing units: the earliest occurrence of every repeated passage stays, the others go.

A unit is a piece of a line: lines end at line breaks, and within them at the end of a sentence and at cuts that the two words
around them decide, so a passage has the same inner units wherever it is pasted. Units are compared by the hashes of their words
in lower case. Their digests are counted over all documents, and the occurrence with the smallest (doc_id, place) stays.

One repeated unit may be a common phrase. Removed are runs of consecutive repeated units that have at least ``RUN_WORDS`` words
together, or that fill whole lines and have at least ``LINE_WORDS`` words. Whole lines of fewer words, ``SHORT_WORDS`` at least, go
where they are in ``LINE_DOCS`` documents or more: their digests are counted by themselves. Of any passage that repeats, the words before its first
inner cut and after its last one can be left, fewer than ``CUT`` at either end; a passage of more than 50 words loses the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, map_batches, register, stored, table, with_fields
from .words import FAR, anchors, blocks, mix, scan, span_hash

RUN_WORDS, LINE_WORDS = 20, 8
#: Words and documents from which a line of fewer than ``LINE_WORDS`` words is boilerplate.
SHORT_WORDS, LINE_DOCS = 2, 5
#: Of so many consecutive places between two words, the one with the smallest hash of the two is a cut.
CUT = 12
_ENDS = np.array([ord(c) for c in ".!?。！？"], np.uint32)
#: Beside the place of a unit goes so much of its text's hash, to tell texts under one doc_id apart.
_TAG = 24
#: Keeps the digests of whole lines apart from those of units.
_LINE = np.uint64(0xA0761D6478BD642F)


def units(texts: list[str]) -> dict[str, np.ndarray]:
    """The units of all texts in order: text ``doc``, number ``pos`` in it, ``hash``, ``words``, code points ``start`` to ``end``.

    ``opens`` and ``closes`` tell whether a unit begins or ends its line, ``line`` and ``line_words`` are the whole line's hash and words. The units of a line cover it without its line break.
    """
    w = scan(texts)
    n = len(w.hash)
    if not n:
        nothing = np.zeros(0, np.int64)
        return dict.fromkeys(("doc", "pos", "hash", "words", "start", "end", "opens", "closes", "line", "line_words"), nothing)
    at = w.start + w.offset[w.doc]
    till = w.end + w.offset[w.doc]
    breaks = np.concatenate([[0], np.cumsum(w.points == 10)])
    ends = np.concatenate([[0], np.cumsum(np.isin(w.points, _ENDS))])
    line = np.ones(n, bool)
    line[1:] = (breaks[at[1:]] > breaks[till[:-1]]) | (w.doc[1:] != w.doc[:-1])
    cut = line.copy()
    cut[1:] |= ends[at[1:]] > ends[till[:-1]]
    # Texts lie apart by one sign, so cuts of one do not depend on its neighbours.
    apart = np.full(n + CUT * len(texts), FAR)
    place = np.arange(n) + CUT * w.doc
    apart[place[1:]] = np.where(w.doc[1:] != w.doc[:-1], FAR, mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]))
    low = np.zeros(len(apart), bool)
    low[anchors(apart, CUT)] = True
    cut |= low[place] & (apart[place] != FAR)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n)
    doc, opens = w.doc[first], line[first]
    closes = np.append(opens[1:], True)
    newline = np.append(np.flatnonzero(w.points == 10), len(w.points))
    line_start = np.concatenate([[0], newline[:-1] + 1])[np.searchsorted(newline, at[first], "left")]
    line_end = newline[np.searchsorted(newline, at[first], "left")]
    start = np.where(opens, line_start, at[first])
    end = np.where(closes, line_end, np.append(start[1:], 0))
    pos = np.arange(len(first)) - np.searchsorted(doc, doc, "left")
    begin = first[opens]
    of = np.cumsum(opens) - 1
    whole = span_hash(w.hash, begin, np.append(begin[1:], n))
    return {
        "doc": doc, "pos": pos, "hash": span_hash(w.hash, first, last), "words": last - first,
        "start": start - w.offset[doc], "end": end - w.offset[doc], "opens": opens, "closes": closes,
        "line": whole[of], "line_words": np.diff(np.append(begin, n))[of],
    }


def removed(u: dict[str, np.ndarray], own: slice, repeated: np.ndarray, run_words: int, line_words: int, lines=()) -> list[tuple[int, int]]:
    """Spans (start, end) to remove from one text, given the numbers of its units that occur earlier and of the first units of ``lines`` that go."""
    flag = np.zeros(own.stop - own.start, bool)
    flag[repeated] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(u["words"][own])])
    opens, closes, start, end = (u[k][own] for k in ("opens", "closes", "start", "end"))
    gone = [(int(k), int(k + np.argmax(closes[k:])) + 1) for k in lines]
    for a, b in zip(edge[::2], edge[1::2]):
        if total[b] - total[a] < run_words:  # then only the whole lines in it
            whole = np.flatnonzero(opens[a:b])
            back = np.flatnonzero(closes[a:b])
            if not len(whole) or not len(back) or whole[0] > back[-1]:
                continue
            a, b = a + whole[0], a + back[-1] + 1
            if total[b] - total[a] < line_words:
                continue
        gone.append((int(a), int(b)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(gone):
        if merged and a < merged[-1][1]:
            a, b = merged[-1][0], max(b, merged.pop()[1])
        merged.append((a, b))
    # A line that goes as a whole takes its line break along.
    return [(int(start[a]), int(end[b - 1]) + int(opens[a] and closes[b - 1])) for a, b in merged]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _tag() -> F.Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - _TAG)


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, and ``__spans``: (start, end) of what went, in code points of the old text.

    A null text stays null. Rows with the same doc_id and text are one document. A null doc_id ranks first.
    """
    def cut(batch: pa.RecordBatch):
        ids, tags = batch.column("doc_id"), np.asarray(batch.column("tag"))
        for at, part in blocks(batch.column("text").to_pylist(), 1 << 20):
            u = units(part)
            doc = u["doc"] + at
            place = (u["pos"].astype(np.int64) << _TAG) | tags[doc]
            yield {"digest": u["hash"].view(np.int64), "doc_id": ids.take(pa.array(doc)), "place": place, "short": np.zeros(len(doc), bool)}
            k = np.flatnonzero(u["opens"] & (u["line_words"] >= SHORT_WORDS) & (u["line_words"] < line_words))
            line = mix(u["line"][k].view(np.uint64) ^ _LINE).view(np.int64)
            yield {"digest": line, "doc_id": ids.take(pa.array(doc[k])), "place": place[k], "short": np.ones(len(k), bool)}

    rows, path = stored(
        map_batches(docs.select("doc_id", _tag().alias("tag"), "text").where("text is not null"), cut, "digest long, doc_id long, place long, short boolean"), "units"
    )
    tag = F.col("place").bitwiseAND((1 << _TAG) - 1)
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place")).alias("first"), F.first("short").alias("short"))
    counted = counted.where(f"n >= if(short, {LINE_DOCS}, 2)")
    in_docs = rows.where("short").select("digest", "doc_id", tag.alias("tag")).distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("docs"))
    common = in_docs.where(F.col("docs") >= LINE_DOCS)
    counted = counted.join(common, "digest", "left").where("not short or docs is not null")
    later = rows.join(counted.select("digest", "first"), "digest").where(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    place = F.shiftright("place", _TAG).cast("int")
    found = later.groupBy(_id("doc_id").alias("__id"), tag.alias("__tag")).agg(
        F.collect_set(F.when(~F.col("short"), place)).alias("__repeated"), F.collect_set(F.when(F.col("short"), place)).alias("__lines")
    )
    found, _ = stored(found, "repeated")
    forget(docs.sparkSession, path)
    joined = docs.withColumns({"__id": _id("doc_id"), "__tag": _tag()}).join(found, ["__id", "__tag"], "left").drop("__id", "__tag")
    schema = with_fields(docs.schema, "__spans array<struct<start:long,end:long>>")

    def apply(batch: pa.RecordBatch):
        texts, repeated, lines = batch.column("text").to_pylist(), batch.column("__repeated"), batch.column("__lines")
        new, spans = list(texts), [[] for _ in texts]
        hit = np.flatnonzero(np.asarray(repeated.is_valid()))
        for at, part in blocks([texts[i] for i in hit], 1 << 20):
            u = units(part)
            first = np.searchsorted(u["doc"], np.arange(len(part) + 1), "left")
            for k in range(len(part)):
                i = int(hit[at + k])
                own = slice(int(first[k]), int(first[k + 1]))
                gone = removed(u, own, repeated[i].values.to_numpy(), run_words, line_words, lines[i].values.to_numpy())
                new[i] = without(part[k], gone)
                spans[i] = [{"start": a, "end": min(b, len(part[k]))} for a, b in gone]
        columns = dict(zip(batch.schema.names, batch.columns))
        yield columns | {"text": new, "__spans": spans}

    return map_batches(joined, apply, schema)


def _id(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@register("op9_line_dedup")
def op9(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, the text that stays, n_removed code points and the spans removed from the old text."""
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "text", gone.alias("n_removed"), F.col("__spans").alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: repeated passages go from the texts, and a document with no word left goes; ``n_chars`` follows the text."""
    found = dedup(docs)
    names = [F.col(f"`{c}`") if c != "n_chars" else F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) for c in docs.columns]
    return found.where((F.size("__spans") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")).select(*names)
