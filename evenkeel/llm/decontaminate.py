"""Benchmark decontamination: CGK random-walk embedding, repeated bit sampling over item-sized windows, exact edit check.

Texts and items are sequences of words. A CGK walk reads a window with a pointer: at step j it writes the word under the pointer
and moves on by R(j, word), a random bit that every walk fixes for all texts. Sequences a few edits apart then agree in most
steps, so edit distance becomes Hamming distance. Every repetition samples ``BITS`` steps of a walk, spread over the window, and
a window whose sampled words equal an item's is a candidate. Items are taken in classes of lengths from n to 2n words, whose windows
have n/2: an item has several, so an edit in one leaves others. Windows of texts and items begin at the smallest of every 8
consecutive words, the same places in both. Behind the end of a text lies one same sign.

Candidates are checked exactly: the item is aligned with the text around the window, with free ends, and leaks when its words
need at most ``EDITS`` of their number in edits. Short items can be missed
even without an edit, as their windows must begin at places a text visits; ``tests/llm`` measures the recall.

The items travel with the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS`` words, so their size is bounded;
more items mean more passes over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, register, table
from .words import FAR, anchors, blocks, mix, scan

EDITS, BITS, SAMPLES, WALKS = 0.2, 4, 12, 2
#: Shorter items are common phrases; they match only without an edit (a fifth of fewer than 5 words is none).
MIN_WORDS = 5
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Windows begin at the smallest of so many consecutive words.
ANCHOR = 8
_SLICE = 1 << 15
_GATE = 18


def step_bits(hashes: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
    """R(j, word) for all steps, packed by eights: byte b holds steps 8b to 8b + 7."""
    out = []
    for at in range(0, steps, 64):
        seeded = mix(hashes ^ mix(np.full(1, 1000 * (walk + 1) + at, np.uint64))[0])
        whole = seeded.view(np.uint8).reshape(-1, 8)
        out += [np.ascontiguousarray(whole[:, k]) for k in range(8)]
    return out


def plan(window: int, walk: int, samples: int = SAMPLES, bits: int = BITS) -> list[set[int]]:
    """The sampled steps of each repetition, one from each equal part of the window's steps."""
    rng = np.random.default_rng(977 + walk)
    return [{int(p * 2 * window) for p in (np.arange(bits) + rng.random(bits)) / bits} for _ in range(samples)]


class Items:
    """The items of one block, cut into the windows that are embedded."""

    def __init__(self, ids: list, texts: list[str | None], edits: float = EDITS, min_words: int = MIN_WORDS):
        words = scan([t or "" for t in texts])
        self.ids, self.words, self.edits, self.groups = ids, [], edits, []
        for i in range(len(texts)):
            self.words.append(words.hash[words.first[i]: words.first[i + 1]])
        # A class holds lengths up to twice its shortest one; its windows have half of that length.
        todo = sorted((len(w), i) for i, w in enumerate(self.words) if len(w) >= min_words)
        while todo:
            least = todo[0][0]
            last = next((k for k, (n, _) in enumerate(todo) if n > 2 * least), len(todo))
            size = max(1, least // 2)
            windows = []
            for n, i in todo[:last]:
                starts = anchors(self.words[i], ANCHOR, inside=True)
                windows += [(i, int(at)) for at in starts[starts <= n - size]] or [(i, 0)]
            self.groups.append((size, windows))
            todo = todo[last:]

    def window(self) -> int:
        return max((size for size, _ in self.groups), default=0)


def embed(hashes: np.ndarray, starts: np.ndarray, wanted: list[list[int]], bits: list[np.ndarray], out: list[np.ndarray]) -> None:
    """Walk from all starts; at step j fold the word under the pointer into the keys ``out[r]`` of the repetitions ``wanted[j]``."""
    at = starts.copy()
    move = np.empty(len(at), np.uint8)
    for j, repetitions in enumerate(wanted):
        if repetitions:
            here = hashes[at]
            for r in repetitions:
                out[r] *= np.uint32(0x9E3779B1)
                out[r] ^= here
        if j + 1 < len(wanted):
            np.take(bits[j >> 3], at, out=move)
            move >>= np.uint8(j & 7)
            move &= np.uint8(1)
            at += move


def semi_global(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits that turn the item into some part of the text, and where such a part ends (the first one)."""
    row = np.zeros(len(text) + 1, np.int32)
    step = np.arange(len(text) + 1, dtype=np.int32)
    for i, word in enumerate(item, 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != word), out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Search:
    """Finds the places of a block of items in whole texts."""

    def __init__(self, items: Items, walks: int = WALKS, samples: int = SAMPLES, bits: int = BITS):
        self.items, self.walks, self.samples, self.bits, self.tables = items, walks, samples, bits, None

    def __getstate__(self):
        return self.__dict__ | {"tables": None, "listed": None}

    def _prepare(self):
        """Sampled steps and the keys of the items, by walk: a walk serves all length classes at once."""
        items, self.tables = self.items, []
        self.listed = [w.tolist() for w in items.words]
        steps = 2 * items.window()  # a pointer moves every second step on average, so these steps read the window once
        for walk in range(self.walks):
            wanted: list[list[int]] = [[] for _ in range(steps)]
            groups, n = [], 0
            for size, own in items.groups:
                for sampled in plan(size, walk, self.samples, self.bits):
                    for j in sampled:
                        wanted[j].append(n)
                    groups.append(own)
                    n += 1
            while wanted and not wanted[-1]:
                wanted.pop()
            keys = []
            for n, own in enumerate(groups):
                parts = [np.append(items.words[i][at:], np.full(steps, FAR)) for i, at in own]
                hashes = np.concatenate(parts)
                starts = np.cumsum([0] + [len(x) for x in parts])[:-1]
                only = [[0] if n in w else [] for w in wanted]
                out = [np.zeros(len(own), np.uint32)]
                embed(short(hashes), starts, only, step_bits(hashes, walk, len(wanted)), out)
                gate = np.zeros(1 << _GATE, bool)
                gate[out[0] >> np.uint32(32 - _GATE)] = True
                order = np.argsort(out[0], kind="stable")
                keys.append((gate, out[0][order], np.array(own)[order]))  # (item, place of the window in it)
            self.tables.append((wanted, keys))
        self.steps = steps

    def candidates(self, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Rows (start, item, place in it) of windows that share a sampled key with one of an item; they start at the given words."""
        found = []
        for walk, (wanted, keys) in enumerate(self.tables):
            bits, low = step_bits(hashes, walk, len(wanted)), short(hashes)
            for at in range(0, len(words), _SLICE):
                starts = words[at: at + _SLICE]
                out = [np.zeros(len(starts), np.uint32) for _ in keys]
                embed(low, starts, wanted, bits, out)
                for key, (gate, sorted_keys, owners) in zip(out, keys):
                    maybe = np.flatnonzero(gate[key >> np.uint32(32 - _GATE)])
                    left = np.searchsorted(sorted_keys, key[maybe], "left")
                    count = np.searchsorted(sorted_keys, key[maybe], "right") - left
                    if count.any():
                        own = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
                        found.append(np.column_stack([np.repeat(starts[maybe], count), owners[own]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, word after the last, edits) of the best place of every item that a text holds."""
        if self.tables is None:
            self._prepare()
        out = []
        if not self.items.groups:
            return out
        for first_text, part in blocks(texts, 1 << 20):
            words = scan(part)
            # Every text is followed by enough of one sign that a window never reads the next text.
            gap = self.steps + ANCHOR
            n = np.diff(words.first)
            place = words.first[:-1] + np.arange(len(part)) * gap
            hashes = np.full(len(words.hash) + gap * len(part), FAR)
            moved = np.arange(len(words.hash)) + np.repeat(np.arange(len(part)) * gap, n)
            hashes[moved] = words.hash
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            by_text: dict[tuple[int, int], list[int]] = {}
            starts = anchors(hashes, ANCHOR)
            starts = starts[hashes[starts] != FAR]
            start, item, at = self.candidates(hashes, starts).T
            doc = np.searchsorted(place, start, "right") - 1
            for d, i, begin in zip(doc.tolist(), item.tolist(), (start - place[doc] - at).tolist()):
                by_text.setdefault((d, i), []).append(begin)
            for (doc, item), starts in by_text.items():
                own, listed = self.items.words[item], self.listed[item]
                most = int(self.items.edits * len(own) + 1e-9)
                text = words.hash[words.first[doc]: words.first[doc + 1]]
                done = -1
                for start in sorted(starts):
                    low, high = max(0, start - most), min(len(text), start + len(own) + most)
                    if high <= done:
                        continue
                    done = high
                    near = set(text[low:high].tolist())
                    if sum(w not in near for w in listed) > most:  # each missing word is an edit
                        continue
                    cost, end = semi_global(own, text[low:high])
                    if cost <= most and (cost, low) < best.get((doc, item), (most + 1, 0, 0))[:2]:
                        back, begin = semi_global(own[::-1], text[low: low + end][::-1])
                        best[doc, item] = (cost, low + end - begin, low + end)
            out += [(first_text + d, i, a, b, c) for (d, i), (c, a, b) in sorted(best.items())]
        return out


def short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash, for the sampled keys; the exact check compares all 64."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def item_blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_words: int = BLOCK_WORDS):
    """The items (item_id, text) in blocks of bounded size, fetched one after another."""
    ids, texts, held = [], [], 0
    for row in items.where(F.length("text") > 0).select("item_id", "text").toLocalIterator():
        if ids and (len(ids) == most_items or held + len(row.text) > 6 * most_words):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id), texts.append(row.text)
        held += len(row.text)
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, edits: float = EDITS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, n_edits): the best place of every item in every document that holds it.

    Null and empty texts and items, and items under ``min_words`` words, match nothing. Items with a null id are kept under it.
    """
    out = None
    for ids, texts in item_blocks(items):
        search, ids = Search(Items(ids, texts, edits, min_words)), list(ids)

        def run(batch: pa.RecordBatch, search=search, ids=ids):
            found = search(batch.column("text").to_pylist())
            rows = pa.array([f[0] for f in found], pa.int64())
            yield {
                "doc_id": batch.column("doc_id").take(rows), "item_id": [ids[f[1]] for f in found],
                "first_word": [f[2] for f in found], "end_word": [f[3] for f in found], "n_edits": [f[4] for f in found],
            }

        schema = "doc_id long, item_id long, first_word long, end_word long, n_edits long"
        part = map_batches(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, end_word long, n_edits long")
    return out


def clean(docs: DataFrame, items: DataFrame, edits: float = EDITS, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns; decided in the task that reads them, without a shuffle."""
    for ids, texts in item_blocks(items):
        search = Search(Items(ids, texts, edits, min_words))

        def run(batch: pa.RecordBatch, search=search):
            bad = {f[0] for f in search(batch.column("text").to_pylist())}
            kept = batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))
            yield dict(zip(kept.schema.names, kept.columns))

        docs = map_batches(docs, run, docs.schema)
    return docs


@register("op1_decontaminate")
def op1(spark, sf_dir) -> DataFrame:
    """Per leak: doc_id, item_id, the words of the document from first_word up to end_word, and the edits."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
