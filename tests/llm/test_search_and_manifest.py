"""URL rules, lexical search and the Merkle manifest against brute force, with nulls, ties, repeated rows, long texts and no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import lexical, manifest, url_filter


# --- URL rules

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(url, rules, default="allow"):
    host, path = plain_parts(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def test_url_rules_against_brute_force(spark):
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "", "ü"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/a", "/ab", "b", "é"]) for _ in range(rng.randint(0, 4)))
    rules = {(host(), "/" + path().lstrip("/") if rng.random() < 0.8 else ""): rng.choice(["allow", "block"]) for _ in range(120)}
    rules = [(h, p, v) for (h, p), v in rules.items() if h]
    tail = lambda: rng.choice(["", "?q=/a", "#x", "?a#b", "/"])
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{host().upper()}{'/' + path() if rng.random() < 0.9 else ''}{tail()}" for _ in range(600)]
    urls += [None, "", "no scheme/a", "://", "x://?", "a://b://c/d", "http://" + "a." * 3000 + "ab/" + "a/" * 3000, *["http://a.ab/ab/"] * 300]
    pages = spark.createDataFrame([(i % 500 or None, u, "k", "v", 7) for i, u in enumerate(urls)], "page_id int, url string, rule string, __key string, __row int")
    out = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    got = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in out)
    assert got == Counter((i % 500 or None, u, *plain_rule(u, rules)) for i, u in enumerate(urls))
    assert out[0].asDict().keys() == {"page_id", "url", "__key", "__row", "host", "path", "rule", "verdict"}


def test_url_rules_edges(spark):
    schema = "host string, path string, verdict string"
    pages = spark.createDataFrame([(1, "http://A.com/x"), (2, "http://b.org"), (None, None)], "page_id int, url string")
    of = lambda rules, frame=pages: {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(frame, spark.createDataFrame(rules, schema), default="block").collect()}
    assert of([]) == {1: (None, "block"), 2: (None, "block"), None: (None, "block")}
    assert of([("COM", "/", "allow"), ("com", "/", "block")])[1] == ("com/", "block")
    everything = of([(None, None, "allow"), ("com", "/x", "block")])
    assert everything == {1: ("com/x", "block"), 2: ("", "allow"), None: ("", "allow")}
    assert of([("com", "/", "allow")], pages.limit(0)) == {}


def test_nested_stacks_cross_chunks(spark):
    """Points far behind the start of an interval, in other chunks than its rule, still lie in it."""
    points = spark.range(20000).select(F.col("id").alias("__row"), F.format_string("m%05d", "id").alias("__key"))
    prefixes = spark.createDataFrame([("m", 1), ("m0", 2), ("m00", 3), ("m01", 4), ("z", 5), ("", 0)], "__key string, __value int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, path = url_filter.enclosing(points, prefixes, "test")
        assert spark.read.parquet(path).select("__chunk").distinct().count() == 8
        got = {r["__row"]: [e.value for e in r["__open"]] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i in (0, 999, 1000, 1999, 2000, 9999, 10000, 19999):
        key = f"m{i:05d}"
        assert got[i] == [v for k, v in [("", 0), ("m", 1), ("m0", 2), ("m00", 3), ("m01", 4)] if key.startswith(k)]
    assert len(got) == 20000


# --- lexical search

def plain_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words = [find(t) for _, t in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(w for own in words for w in set(own))
    out = []
    for item, text in items:
        scored = []
        for (doc, _), own in zip(docs, words):
            tf, m = Counter(own), 10 + (90 * len(own) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(find(text)) if tf[w])
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        out += [(item, rank, doc, score) for rank, (*_, doc, score) in enumerate(sorted(scored, key=lambda s: s[:2] + (s[2] or 0,))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 18), (300, 12)])
def test_search_against_brute_force(spark, shard, block):
    rng = random.Random(3)
    vocabulary = [a + b for a in "abÉé" for b in "xyzXü"] + ["the", "7", "x-y"]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.2)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(150)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (900, None), (901, ""), (902, "?! ."), (903, "the " * 50_000 + "ax"), *[(1000 + i, docs[9][1]) for i in range(30)]]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, docs[9][1]), (50, None), (51, ""), (52, "unknownword"), (None, "ax the")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, term string, shard int").repartition(4)
    found = lexical.search(frame, spark.createDataFrame(items, "item_id long, text string"), shard=shard, block=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == plain_search(docs, items)


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0 == lexical.search(docs, items.limit(0)).count()
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] in ([(1, 1, 1)], [])


def test_nra_stops_early_and_resolves_ties():
    """Lists with few great impacts are not read to their ends; all documents at the last place's score are kept."""
    rng = np.random.default_rng(1)
    size = 50_000
    lists = []
    for _ in range(3):
        docs = rng.permutation(size)
        impacts = np.sort(rng.integers(1, 50, size))[::-1].copy()
        lists.append((docs, impacts))
    for docs, impacts in lists:  # 12 documents lead every list, the last 5 of them with equal totals
        own = np.flatnonzero(docs < 12)
        rest = np.delete(docs, own)
        docs[:] = np.concatenate([np.arange(12), rest])
        impacts[:12] = [900, 800, 700, 600, 500, 400, 300, 200, 200, 200, 200, 200]
    found, exact, read = lexical.nra(lists, size, 10)
    total = np.zeros(size, np.int64)
    for docs, impacts in lists:
        total[docs] += impacts
    assert set(found) >= set(range(12)) and (exact == total[found]).all()
    assert read < 1000
    for trial in range(30):
        lists = []
        for _ in range(rng.integers(1, 6)):
            docs = rng.permutation(300)[: rng.integers(0, 300)]
            lists.append((docs, np.sort(rng.integers(0, 4, len(docs)))[::-1]))
        total = np.zeros(300, np.int64)
        for docs, impacts in lists:
            total[docs] += impacts
        found, exact, _ = lexical.nra(lists, 300, 10, depth=4)
        assert (exact == total[found]).all()
        best = sorted(((-int(total[d]), d) for d in range(300) if total[d] > 0))[:10]
        assert sorted((-int(s), d) for d, s in zip(found, exact))[:10] == best


# --- manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, i):
    return [(level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else None, bool((i >> k) & 1)) for k, level in enumerate(levels[:-1])]


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    key = lambda lang: (lang is not None, (lang or "").encode())
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=key)
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [plain_tree(map(plain_leaf, groups[g])) for g in names]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for j, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            path = plain_path(trees[j], i) + plain_path(top, j)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            acc = plain_leaf((*row[:3], row[3] + 1, row[4]) if hit else row)
            for other, left in path:
                acc = H(acc) if other is None else H(other, acc) if left else H(acc, other)
            out.append((row[0], plain_leaf(row), trees[j][-1][0], top[-1][0], H(*[s for s, _ in path if s]), acc, acc == top[-1][0]))
    return out, dict(zip(names, trees))


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows():
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", "é", ""]), rng.randint(0, 9) or None, rng.choice(["", "é" * i, "x:y\n"])) for i in range(150)]
    rows += [(7, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 3, "t"), (3, "b", "en", 1, "1"), (3, "a", "en", 1, "2")]
    return rows + [rows[4]] * 40 + [(500, "s", "one", 10, "long " * 100_000)]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_against_brute_force(spark, monkeypatch, tmp_path, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = manifest_rows()
    spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", __rank string, level int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want, trees = plain_manifest(rows)
    got = manifest.op13(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert got[0].asDict().keys() == {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}
    assert {r.verified for r in got} == {True, False}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    _, buckets, _, _, _ = manifest.manifest(docs, manifest.leaf_digest([F.col(c) for c in manifest.COLUMNS]), F.col("lang"), [F.col("doc_id")])
    found = {(r.group, r.level, r.lo, r.hi, r.digest) for r in manifest.nodes(buckets).collect()}
    label = lambda g: "0" if g is None else "1" + g
    assert found == {
        (label(g), k, i << k, min((i + 1) << k, len(tree[0])), d) for g, tree in trees.items() for k, level in enumerate(tree) for i, d in enumerate(level)
    }


def test_manifest_of_one_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "s", "en", 2, "t")], DOCS).write.parquet(f"{tmp_path}/a/documents.parquet")
    (one,) = manifest.op13(spark, f"{tmp_path}/a").collect()
    leaf = plain_leaf((1, "s", "en", 2, "t"))
    assert (one.leaf, one.subroot, one.root, one.proof_sha256) == (leaf, leaf, leaf, H(""))
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert manifest.op13(spark, f"{tmp_path}/b").count() == 0
