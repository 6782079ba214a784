"""Language identification by prediction by partial matching: byte context trees with escapes, frozen after training.

Every language has a tree of byte contexts of up to ``ORDER`` bytes. A byte seen after its longest context costs
``-log2 n/(N+t)`` bits (n times seen there, N bytes and t distinct bytes seen there); a byte not seen there first pays the
escape ``-log2 t/(N+t)`` and is coded by the context one byte shorter; below the empty context all 256 bytes cost 8 bits.
The language with the shortest code of the whole text wins.

Training counts come from at most ``SAMPLE_DOCS`` labelled documents a language, of at most ``SAMPLE_CHARS`` code points
each (the smallest hashes of their texts), so the model is of bounded size and travels with the tasks. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_batches, register, table, with_fields
from .words import blocks

ORDER, SAMPLE_DOCS, SAMPLE_CHARS = 3, 400, 20_000
#: A text that no language codes in so many bits a byte is not prose of a learned language; real misfits lie at 5 to 6.
MAX_BITS = 6.5
#: ASCII letters in lower case; all other ASCII bytes are one blank sign, as digits and signs belong to no language.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def grams(data: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it as one number, over all texts; and where each text begins and ends."""
    pad = b" " * order
    joined = np.frombuffer(b"".join(pad + d for d in data) + pad, np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    start = np.cumsum(sizes + order) - sizes
    gram = joined.astype(np.uint32)
    for back in range(1, order + 1):
        gram[back:] |= joined[:-back].astype(np.uint32) << np.uint32(8 * back)
    return gram, start, start + sizes


class Lookup:
    """Numbers to rows by open addressing, for whole arrays at a time; -1 where a number is unknown."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            at, pick = np.unique(slot[free], return_index=True)
            won = left[free][pick]
            self.keys[at], self.rows[at] = keys[won], won
            keep = ~np.isin(left, won)
            left, slot = left[keep], (slot[keep] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        rows = self.rows[slot]
        open_ = np.flatnonzero((rows >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            rows[open_] = self.rows[slot[open_]]
            open_ = open_[(rows[open_] >= 0) & (self.keys[slot[open_]] != keys[open_])]
        return rows


class Model:
    """Code lengths of all known (context, byte) pairs under every language, by order."""

    def __init__(self, counts: dict[str, dict[int, int]], order: int = ORDER):
        self.order, self.langs = order, sorted(counts)
        self.keys, self.contexts, self.cost, self.escape = [], [], [], []
        shape = len(self.langs)
        for k in range(order + 1):  # contexts of k bytes
            mask = (1 << 8 * (k + 1)) - 1
            each = []
            for lang in self.langs:
                gram = np.fromiter(counts[lang].keys(), np.uint32, len(counts[lang])) & np.uint32(mask)
                n = np.fromiter(counts[lang].values(), np.int64, len(counts[lang]))
                key, at = np.unique(gram, return_inverse=True)
                each.append((key, np.bincount(at, n, len(key))))
            keys = np.unique(np.concatenate([key for key, _ in each])) if each else np.zeros(0, np.uint32)
            contexts = np.unique(keys >> np.uint32(8)) if k else np.zeros(1, np.uint32)
            below = self.cost[-1][np.searchsorted(self.keys[-1], keys & np.uint32(mask >> 8))] if k else np.full((len(keys), shape), 8.0)
            cost, escape = np.empty((len(keys), shape)), np.zeros((len(contexts), shape))
            for i, (key, n) in enumerate(each):
                at = np.searchsorted(contexts, key >> np.uint32(8)) if k else np.zeros(len(key), np.int64)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escape[seen, i] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                context = np.searchsorted(contexts, keys >> np.uint32(8)) if k else np.zeros(len(keys), np.int64)
                cost[:, i] = escape[context, i] + below[:, i]
                cost[np.searchsorted(keys, key), i] = -np.log2(n / (total[at] + kinds[at]))
            self.keys.append(keys), self.contexts.append(contexts), self.cost.append(cost), self.escape.append(escape)
        self.found = self.known = None

    def __getstate__(self):
        return self.__dict__ | {"found": None, "known": None}

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language."""
        if self.found is None:
            self.found, self.known = [Lookup(k) for k in self.keys], [Lookup(c) for c in self.contexts]
        rows = self.found[-1](gram)
        out = self.cost[-1][rows]
        left, extra = np.flatnonzero(rows < 0), 0.0
        out[left] = 0
        for k in range(self.order, 0, -1):  # not seen after its k bytes: escape to k - 1
            if not len(left):
                return out
            context = (gram[left] >> np.uint32(8)) & np.uint32((1 << 8 * k) - 1)
            at = self.known[k](context)
            out[left] += np.where((at >= 0)[:, None], self.escape[k][at], 0.0)
            shorter = self.found[k - 1](gram[left] & np.uint32((1 << 8 * k) - 1))
            hit = shorter >= 0
            out[left[hit]] += self.cost[k - 1][shorter[hit]]
            left = left[~hit]
        out[left] += self.escape[0][0] + 8.0
        return out

    def score(self, texts: list[str | None]) -> dict:
        """``lang_pred``, ``score`` (the winner's share of probability) and ``bits`` a byte, for whole texts."""
        pred, score, bits = [], [], []
        for _, part in blocks(texts):
            data = [folded(t) for t in part]
            gram, start, end = grams(data, self.order)
            total = np.zeros((len(part), len(self.langs)))
            full = np.flatnonzero(end > start)
            if len(full) and self.langs:
                pairs = np.stack([start[full], end[full]], 1).ravel()
                total[full] = np.add.reduceat(self.lengths(gram), pairs, axis=0)[::2]
            for text, raw, row in zip(part, data, total):
                if not self.langs or not _has_letter(text, raw):
                    pred.append("und"), score.append(0.0), bits.append(None)
                    continue
                best = int(row.argmin())
                pred.append(self.langs[best])
                score.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
                bits.append(float(row[best] / len(raw)))
        return {"lang_pred": pred, "score": score, "bits": bits}


def _has_letter(text: str, raw: bytes) -> bool:
    return any(c.isalpha() for c in text) if raw.strip() else False


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from ``text`` and non-null ``lang`` of documents that are not held out."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") <= sample_chars) & (F.length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    sample = labelled.select("lang", "text").withColumn("__rank", rank).where(F.col("__rank") <= sample_docs)

    def count(batch: pa.RecordBatch):
        lang = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text").to_pylist()
        for name in sorted(set(lang)):
            gram, start, end = grams([folded(texts[i]) for i in np.flatnonzero(lang == name)], order)
            key, n = np.unique(np.concatenate([gram[a:b] for a, b in zip(start, end)]), return_counts=True)
            yield {"lang": [name] * len(key), "gram": key.astype(np.int64), "n": n}

    counted = map_batches(sample.select("lang", "text"), count, "lang string, gram long, n long")
    counts: dict[str, dict[int, int]] = {}
    for lang, gram, n in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts.setdefault(lang, {})[gram] = n
    return Model(counts, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__lang_pred``, ``__score`` and ``__bits``; null, empty and letterless texts are ``und`` with score 0."""
    names = {"__lang_pred": "lang_pred", "__score": "score", "__bits": "bits"}
    schema = with_fields(docs.schema, "__lang_pred string, __score double, __bits double")

    def run(batch: pa.RecordBatch):
        found = model.score(batch.column("text").to_pylist())
        yield dict(zip(batch.schema.names, batch.columns)) | {k: found[v] for k, v in names.items()}

    return map_batches(docs, run, schema)


@register("op5_language_id")
def op5(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, and the bits a byte under the predicted language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
        F.col("__score").alias("score"), F.col("__bits").alias("bits"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a language (``und``, or more than ``MAX_BITS`` bits a byte) go."""
    found = identify(docs, train(docs))
    return found.where((F.col("__lang_pred") != "und") & (F.col("__bits") <= MAX_BITS)).select(*[F.col(f"`{c}`") for c in docs.columns])
