"""Edit-aware token counts: a segment tree of counts over pieces of each document; an edit encodes only what it touches again.

A document is cut into leaves of ``LEAF`` code points and on to the next place that no pre-token spans: behind a letter that no letter
follows. Leaves are encoded for themselves and their counts sum up to the document's. An edit takes the leaves it touches and one
neighbour on each side (the boundary context, since an edit can join or split pre-tokens at a border), cuts their new text into leaves
anew, so leaves split and merge, and encodes those that are not among the old ones. Where their number stays the sums on the way to
the root are updated; where it changes the sums, not the counts, are built again, once for about ``LEAF`` code points that come or go.

Trees are stored as the leaves' lengths, counts and digests. A later load of the same documents takes over the leaves that its text
still begins and ends with and encodes what is between.

One run of letters, or text without any letter, is one leaf however long, as the merges of one pre-token cannot be cut exactly.
"""

from __future__ import annotations

import base64
from hashlib import blake2b

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept_by_workers, map_batches, register, table, with_fields

LEAF = 512
_BORDER = regex.compile(r"(?<=\p{L})(?=\P{L})")
LEAVES = "array<struct<n_chars: int, n_tokens: int, digest: binary>>"


@kept_by_workers(2)
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, one for each worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in pieces that begin at borders of pre-tokens; the encodings of the pieces make up the text's."""
    out, begin = [], 0
    while border := _BORDER.search(text, begin + max(1, size)):
        out.append(text[begin: border.start()])
        begin = border.start()
    return [*out, text[begin:]]


class CountTree:
    """Sums of code points and tokens over the leaves of one document, as a binary tree in two lists."""

    def __init__(self, text: str, count, size: int = LEAF):
        self.count, self.size, self.parts = count, size, leaves(text, size)
        self.encoded = 0  # code points encoded since the tree was built
        self._build([count(part) for part in self.parts])

    def _build(self, counts: list[int]) -> None:
        self.base = 1 << max(0, (len(self.parts) - 1).bit_length())
        empty = [0] * (self.base - len(self.parts))
        self.chars = [0] * self.base + [len(part) for part in self.parts] + empty
        self.tokens = [0] * self.base + counts + empty
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        for values in (self.chars, self.tokens):
            values[node] = values[2 * node] + values[2 * node + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.parts)

    def counts(self) -> list[int]:
        return self.tokens[self.base: self.base + len(self.parts)]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a code point (the last one for the end of the text), and where that leaf begins."""
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace ``remove`` code points from ``at`` on; places beyond the text mean its end."""
        at = min(max(at, 0), self.chars[1])
        remove = min(max(remove, 0), self.chars[1] - at)
        first, begin = self._find(at)
        last, _ = self._find(max(at, at + remove - 1))
        left, right = max(first - 1, 0), min(last + 1, len(self.parts) - 1)
        begin -= sum(len(p) for p in self.parts[left:first])
        old = self.parts[left: right + 1]
        known = dict(zip(old, self.counts()[left: right + 1]))
        whole = "".join(old)
        pieces = leaves(whole[: at - begin] + insert + whole[at - begin + remove:], self.size)
        if not pieces[-1] and len(self.parts) - len(old) + len(pieces) > 1:
            pieces.pop()
        counts = []
        for piece in pieces:
            if piece not in known:
                known[piece] = self.count(piece)
                self.encoded += len(piece)
            counts.append(known[piece])
        if len(pieces) != len(old):  # leaves were split or merged
            all_counts = self.counts()
            all_counts[left: right + 1] = counts
            self.parts[left: right + 1] = pieces
            self._build(all_counts)
            return
        touched = set()
        for i, (piece, n) in enumerate(zip(pieces, counts), left):
            self.parts[i], node = piece, self.base + i
            self.chars[node], self.tokens[node] = len(piece), n
            touched.add(node // 2)
        while touched - {0}:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched if node > 1}


def digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def carried(text: str, stored: list[dict], count, size: int = LEAF) -> tuple[list[dict], int]:
    """The leaves of a text, given those stored for an earlier version of it, and the code points that were encoded for them.

    Leaves that the text still begins and ends with are taken over, but for the one next to a change: it is the change's boundary context.
    """
    head = begin = 0
    while head < len(stored) and digest(text[begin: begin + stored[head]["n_chars"]]) == stored[head]["digest"]:
        begin += stored[head]["n_chars"]
        head += 1
    if head == len(stored) and begin == len(text):
        return stored, 0
    tail, end = len(stored), len(text)
    while tail > head and end - stored[tail - 1]["n_chars"] >= begin and digest(
            text[end - stored[tail - 1]["n_chars"]: end]) == stored[tail - 1]["digest"]:
        tail -= 1
        end -= stored[tail]["n_chars"]
    if head:
        head -= 1
        begin -= stored[head]["n_chars"]
    if tail < len(stored):
        end += stored[tail]["n_chars"]
        tail += 1
    known = {leaf["digest"]: leaf["n_tokens"] for leaf in stored[head:tail]}
    middle, encoded = [], 0
    for piece in leaves(text[begin:end], size):
        own = digest(piece)
        if own not in known:
            known[own] = count(piece)
            encoded += len(piece)
        if piece or not stored:
            middle.append({"n_chars": len(piece), "n_tokens": known[own], "digest": own})
    return stored[:head] + middle + stored[tail:], encoded


def recount(docs: DataFrame, trees: DataFrame | None = None, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, n_encoded, leaves) of ``docs`` (doc_id, text): their trees as a table, from that of an earlier load if given.

    Documents the earlier load does not have, and such without an id, are encoded whole; of several trees under one id one is taken. A
    null text is empty and has no leaves. Documents meet their trees by id, so only rows of leaves are read again, no earlier text.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.select("doc_id", "text")
    if trees is None:
        rows = docs.withColumn("leaves", F.lit(None).cast(LEAVES))
    else:
        rows = docs.join(trees.groupBy("doc_id").agg(F.max_by("leaves", F.size("leaves")).alias("leaves")), "doc_id", "left")

    def run(batch: pa.RecordBatch):
        ranks = encoding(path)
        count = lambda text: len(ranks.encode_ordinary(text))
        made = [carried(text or "", stored or [], count, leaf) if text else ([], 0)
                for text, stored in zip(batch.column("text").to_pylist(), batch.column("leaves").to_pylist())]
        yield {"doc_id": batch.column("doc_id"), "n_tokens": [sum(x["n_tokens"] for x in own) for own, _ in made],
               "n_encoded": [n for _, n in made], "leaves": [own for own, _ in made]}

    return map_batches(rows.select("doc_id", "text", "leaves"), run, f"doc_id long, n_tokens long, n_encoded long, leaves {LEAVES}")


def edited_counts(docs: DataFrame, edits: Column, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``__before`` and ``__after`` (tokens before and after the edits) and ``__encoded`` (code points encoded for them).

    ``edits`` gives each row its edits in order, an array of (at, remove, insert); nulls in it change nothing. A null text is empty.
    The tree lives as long as its row is worked on: rows are independent, so a lost executor costs its own rows only.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = with_fields(docs.schema, "__before long, __after long, __encoded long")

    def run(batch: pa.RecordBatch):
        ranks = encoding(path)
        count = lambda text: len(ranks.encode_ordinary(text))
        before, after, encoded = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("__edits").to_pylist()):
            tree = CountTree(text or "", count, leaf)
            before.append(tree.total())
            for e in own or ():
                if e and e["at"] is not None:
                    tree.edit(e["at"], e["remove"] or 0, e["insert"] or "")
            after.append(tree.total()), encoded.append(tree.encoded)
        columns = dict(zip(batch.schema.names, batch.columns))
        yield columns | {"__before": before, "__after": after, "__encoded": encoded}

    return map_batches(docs.withColumn("__edits", edits), run, schema)


def sample_edits() -> Column:
    """Three edits of every text: 16 code points in the middle give way to the first 24, a third in its first word is put twice, the end goes."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda at, remove, insert: F.struct(
        F.floor(at).cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), insert.alias("insert"))
    return F.array(
        edit(n / 2, 16, F.substring("text", 1, 24)), edit(n / 3, 0, F.substring_index("text", " ", 1)), edit(n - 8, 16, F.lit("")),
    )


@register("op7_token_counts")
def op7(spark, sf_dir) -> DataFrame:
    """Per document: doc_id, n_tokens, n_tokens_edited after three edits, n_encoded code points encoded for them, n_chars."""
    rows = edited_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), sample_edits())
    return rows.select(
        "doc_id", F.col("__before").alias("n_tokens"), F.col("__after").alias("n_tokens_edited"), F.col("__encoded").alias("n_encoded"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
    )
