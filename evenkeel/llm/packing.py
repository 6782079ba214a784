"""Vector best-fit packing of tokenized documents into sequences.

Every piece needs tokens, one document place and attention (its length squared); a sequence has a capacity of each. Pieces are
taken by falling length, and a piece goes into the open sequence that, of those that hold it in every dimension, scores best:
the smallest weighted norm of what would stay free, or the greatest weighted dot product of need and free space.

Pieces are dealt by hash into shards of about ``SHARD`` pieces, packed side by side; each shard wastes at most its last, part-filled
sequences, so a table of any size is packed in tasks of one size.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import kept_by_workers, map_batches, register, stored, table, with_fields
from .words import Numbering, blocks, span_hash

LIMIT, END_ID, SHARD = 4096, 1, 16_384
#: Text in which the tokenizer's Unicode classes, lower case and composition are the simple ones below; other text takes its own path.
_PLAIN = re.compile("[\t-\r -~ -ÿĀ-įı-ſ‐-‧]*")
_LETTER, _NUMBER = re.compile("[a-zªµºß-öø-ÿĀ-ſ]"), re.compile("[0-9²³¹¼-¾]")
#: Bytes of distinct pre-tokens and their encodings that a worker remembers before its memory starts anew.
_REMEMBER = 1 << 25


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 white space, 1 letters, 2 numbers, 3 the rest."""
    one = lambda c: 1 if _LETTER.match(c) else 2 if _NUMBER.match(c) else 0 if c.isspace() else 3
    return np.array([one(chr(i)) for i in range(0x2030)], np.uint8)


def pre_tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain texts in lower case joined by line breaks; each pre-token's text, start, end there and hash.

    A pre-token is a run of letters, one number, a run of other signs, or an apostrophe with s, t, re, ve, m, ll or d.
    """
    joined = "\n".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = np.zeros(len(points) + 3, np.uint8)
    kind[: len(points)] = _kinds()[points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = (kind[1: len(points)] != kind[: max(0, len(points) - 1)]) | (kind[1: len(points)] == 2)
    at = np.flatnonzero(points == 39)
    at = at[edge[at] & (kind[at + 1] == 1)]
    if len(at):
        a, b = points[at + 1], np.where(at + 2 < len(points), points[np.minimum(at + 2, len(points) - 1)], 0)
        ord_ = {c: ord(c) for c in "stmdrvle"}
        one = (a == ord_["s"]) | (a == ord_["t"]) | (a == ord_["m"]) | (a == ord_["d"])
        two = ((a == ord_["r"]) | (a == ord_["v"])) & (b == ord_["e"]) | (a == ord_["l"]) & (b == ord_["l"])
        edge[at[one | two] + 1] = False
        edge[at[one] + 2] = edge[at[two] + 3] = True
    cuts = np.flatnonzero(edge)
    word = kind[cuts[:-1]] > 0
    start, end = cuts[:-1][word], cuts[1:][word]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.searchsorted(np.cumsum(lengths + 1), start, "right")
    return joined, doc, start, end, span_hash(points.astype(np.uint64), start, end)


class Encoder:
    """The ids of texts exactly as the tokenizer gives them; each distinct pre-token is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The last id of a pre-token, and no other one, ends a word in the vocabulary.
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pre-tokens one after another, and how many each has."""
        rows = [" ".join(words[k: k + 256]) for k in range(0, len(words), 256)]
        ids = [e.ids for e in self.tokenizer.encode_batch(rows, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(ids), np.uint32)
        size = np.diff(np.flatnonzero(np.concatenate([[True], self.last[ids]])))
        if len(size) != len(words):
            raise RuntimeError("the tokenizer does not mark the ends of words")
        return ids, size

    def _clear(self):
        """Of every pre-token known by its hash: its code points (``letters`` from ``begin`` on) and its ids (``flat`` from ``at`` on)."""
        self.known, self.flat, self.letters = Numbering(), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.at, self.size, self.begin, self.length = (np.zeros(0, np.int64) for _ in range(4))

    def _same(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each pre-token is, sign by sign, the one that its hash stands for."""
        length = end - start
        same = self.length[number] == length
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(first, length)
        kept = np.minimum(np.repeat(self.begin[number], length) + within, len(self.letters) - 1)
        differ = points[np.repeat(start, length) + within] != self.letters[kept]
        return same & (np.add.reduceat(np.append(differ, False), first) == 0) if len(length) else same

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if 48 * self.known.count + 4 * (len(self.flat) + len(self.letters)) > _REMEMBER:
            self._clear()
        plain = np.array([_PLAIN.fullmatch(t) is not None for t in texts], bool)
        joined, doc, start, end, key = pre_tokens([t for t, easy in zip(texts, plain) if easy])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        number = self.known.find(key)
        if (number < 0).any():
            fresh, where = np.unique(key[number < 0], return_index=True)
            where = np.flatnonzero(number < 0)[where]
            words = [joined[a:b] for a, b in zip(start[where], end[where])]
            ids, size = self._encode(words)
            length = end[where] - start[where]
            self.begin = np.concatenate([self.begin, len(self.letters) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.letters = np.concatenate([self.letters, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
            self.known.add(fresh)
            number = self.known.find(key)
        # A text with a pre-token that only shares another one's hash is encoded by itself.
        easy = np.flatnonzero(plain)
        plain[easy[np.unique(doc[~self._same(points, start, end, number)])]] = False
        size = self.size[number]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[number] - (ends - size), size) + np.arange(int(size.sum()))]
        cut = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(easy) + 1), "left")]
        place = np.cumsum(np.isin(np.arange(len(texts)), easy)) - 1
        return [
            ids[cut[k]: cut[k + 1]] if good else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            for text, good, k in zip(texts, plain, place)
        ]


@kept_by_workers(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def token_pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of ``docs`` (doc_id, text): the ids of a document and ``end_id``, cut every ``limit``.

    ``ids`` are unsigned 32-bit numbers, least byte first. A null text is an empty one, whose only piece is ``end_id``.
    """
    def run(batch: pa.RecordBatch):
        encode, ids = encoder(path), batch.column("doc_id")
        for at, part in blocks(batch.column("text").to_pylist(), 1 << 20):
            doc, piece, length, data = [], [], [], []
            for i, own in enumerate(encode(part)):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(own), limit):
                    cut = own[k: k + limit]
                    doc.append(at + i), piece.append(k // limit), length.append(len(cut)), data.append(cut.tobytes())
            start = np.array(piece, np.int64) * limit
            yield {"doc_id": ids.take(pa.array(doc, pa.int64())), "piece": piece, "start": start, "length": length, "ids": data}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights=(1.0, 1.0, 1.0), score: str = "norm") -> np.ndarray:
    """The sequence of each piece, given lengths in falling order; capacities of tokens, documents and attention."""
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
    most, w = np.array(capacity, float)[:, None], np.array(weights, float)[:, None]
    if len(lengths) and (need > most).any():
        raise ValueError("a piece needs more than a sequence has")
    free = np.empty((3, max(1, len(lengths))))
    open_ = np.empty(max(1, len(lengths)), np.int64)  # numbers of the sequences that still take something
    n, made = 0, 0
    out = np.empty(len(lengths), np.int64)
    least = need.min(axis=1) if len(lengths) else None
    scale = w / most ** 2
    for i in range(len(lengths)):
        own = need[:, i: i + 1]
        fits = np.flatnonzero((free[0, :n] >= own[0]) & (free[1, :n] >= own[1]) & (free[2, :n] >= own[2]))
        if len(fits):
            left = free[:, fits]
            # Of equal scores the sequence opened first.
            k = fits[((left - own) ** 2 * scale).sum(0).argmin() if score == "norm" else (left * own * scale).sum(0).argmax()]
        else:
            k, n = n, n + 1
            free[:, k], open_[k] = most[:, 0], made
            made += 1
        free[:, k] -= own[:, 0]
        out[i] = open_[k]
        if (free[:, k] < least).any():  # takes nothing more
            free[:, k: n - 1], open_[k: n - 1] = free[:, k + 1: n], open_[k + 1: n].copy()
            n -= 1
    return out


def pack(pieces: DataFrame, limit: int = LIMIT, documents: int | None = None, attention: int | None = None,
         weights=(1.0, 1.0, 1.0), score: str = "norm", shard: int = SHARD) -> DataFrame:
    """``pieces`` (doc_id, piece, length, …) with ``sequence_id`` and ``offset``.

    A sequence holds at most ``limit`` tokens, ``documents`` pieces and ``attention`` as the sum of squared lengths (by default
    as many as the tokens allow). Equal pieces are told apart by all their columns, so the result is the same on every run.
    """
    capacity = (limit, documents or limit, attention or limit * limit)
    shards = max(1, -(-pieces.count() // shard))
    names = [c for c in pieces.columns if dict(pieces.dtypes)[c] != "binary"]
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    schema = with_fields(dealt.schema, "sequence_id long, offset long", drop="__shard")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *[(c, "ascending") for c in names if c != "length"]])
        length = rows.column("length").to_numpy()
        own = best_fit(length, capacity, weights, score)
        order = np.argsort(own, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.searchsorted(own[order], own[order], "left")
        offset = np.empty(len(own), np.int64)
        offset[order] = before - before[first]
        sequence = own + (rows.column("__shard").to_numpy() << 32)
        return rows.drop_columns(["__shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("__shard").applyInArrow(run, schema)


def packed(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``.

    The places of the pieces are enough to write the sequences: join them to :func:`token_pieces` and sort by offset.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, path, limit).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces")[0], limit)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, pieces): the ids of every sequence, its pieces in order; a sequence is bounded by its capacity."""
    keys = ["doc_id", "piece"]
    both = pieces.select(*keys, "ids").join(places.select(*keys, "sequence_id", "offset"), keys)
    return both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("pieces"))


@register("op6_best_fit_packing")
def op6(spark, sf_dir) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last: the pieces of all documents with their places, as in :func:`packed`."""
    return packed(docs)
