"""The operators on small tables with nulls, ties, repeated rows, odd columns and no rows; SQL where there is some."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, database
from conftest import SF_SMALL, SF_TINY

import corpus_pipeline
import public_tokenizers
from evenkeel.llm import ORACLE, QUERIES, common, decontaminate, fingerprint, language_id, line_dedup, near_dedup, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `class` string, __at string"
VOCABULARY = [f"{a}{b}" for a in "bcdfgklm" for b in ("ando", "emi", "urtel", "ixas", "o", "ansa", "erre")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(6)]
    passage = prose(rng, 70)
    near = base[0].split()
    near[10], near[50] = "new", "words"
    texts = [*base, base[0], " ".join(near), base[1], f"{prose(rng, 30)} {passage} {prose(rng, 30)}", f"{prose(rng, 40)}\n{passage}", None, "", "", "?!", "x"]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "k", "z") for i, t in enumerate(texts)]
    rows += [(3, base[3], "en", "s", 1, "k", "z"), (None, base[5], "en", "s", 1, "k", "z"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, database(SF_TINY), SF_TINY, name) is None


def test_near_classes(spark, docs, empty):
    found = {r.item: r for r in near_dedup.near_classes(docs.select("doc_id", "text")).collect()}
    by_id = {}
    for r in docs.select("doc_id", near_dedup.digest().alias("item")).collect():
        by_id.setdefault(r.doc_id, set()).add(found[r.item].class_id)
    assert by_id[0] == by_id[6] == by_id[7] == {0} and by_id[8] == {1} and by_id[3] == {3} and by_id[11] == by_id[12] == {11}
    assert by_id[9] == {9} and by_id[None] == {5, 11}
    kept = near_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 11, 14, 15]
    assert near_dedup.near_classes(empty.select("doc_id", "text")).count() == 0 == near_dedup.stage(spark, empty, "").count()


def test_near_classes_against_all_pairs(spark):
    """Groups of edited copies that share a passage with unrelated texts: the classes of all pairs are found."""
    rng = random.Random(9)
    passage, texts = prose(rng, 60), []
    for _ in range(12):
        base = (prose(rng, 80) + " " + passage + " " + prose(rng, 40)).split()
        for _ in range(4):
            own = list(base)
            for _ in range(4):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(9999)}"
            texts.append(" ".join(own))
    rows = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.n_docs) for r in rows) == sorted((4 * (i // 4), 4) for i in range(48))


def test_near_classes_of_a_star(spark):
    """Copies near their original but not near each other: the classes and links are those of all pairs that share a bucket."""
    rng = random.Random(12)
    original = [rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(200)]
    texts = [original]
    for k in range(240):
        own = list(original)
        for at in rng.sample(range(200), 24):
            own[at] = f"edit{k}x{at}"
        texts.append(own)
    alone = [" ".join(original[:30]) + " " + prose(rng, 170) for _ in range(40)]
    plain = [" ".join(t) for t in texts] + alone
    keys = near_dedup.sketch(plain)
    words = near_dedup.scan(plain)
    cut = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    parent = list(range(len(plain)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            if root(i) != root(j) and (keys[i] == keys[j]).any() and near_dedup.alike(cut[i], cut[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    size = {}
    for i in range(len(plain)):
        size[root(i)] = size.get(root(i), 0) + 1
    assert size[0] > 225 and sum(root(i) == i for i in range(241, len(plain))) == 40
    found = near_dedup.near_classes(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).collect()
    assert sorted((r.least, r.class_id, r.n_docs) for r in found) == [(i, root(i), size[root(i)]) for i in range(len(plain))]


def around_a_passage(rng, inside, outside):
    """Copies of a text with a tenth of new words each, and texts that have seven tenths of it."""
    base = [f"{rng.choice(VOCABULARY)}{rng.randrange(30)}" for _ in range(200)]
    texts = []
    for k in range(inside + outside):
        own = list(base)
        for at in rng.sample(range(200), 20 if k < inside else 60):
            own[at] = f"{rng.choice(VOCABULARY)}{rng.randrange(30)}"
        texts.append(" ".join(own))
    return texts


def test_pairs_left_of_a_class_and_its_neighbours(spark, monkeypatch):
    """A class and many texts around the same passage: few pairs become rows, none that is alike is missing, in blocks of any size."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    texts = around_a_passage(random.Random(6), 60, 40)
    rows = near_dedup.word_rows(spark.createDataFrame(list(enumerate(texts)), "item long, text string"))
    rows = rows.selectExpr("*", "if(item < 60, 0, item) as class")
    pairs = near_dedup._over_rare_pairs(near_dedup.rare_pairs(rows, 0.8), rows, 0.8)
    found = [(r.a, r.b) for r in pairs.collect()]
    words = near_dedup.scan(texts)
    cut = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    alike = {(i, j) for j in range(60, 100) for i in range(j) if (i < 60 or i != j) and near_dedup.alike(cut[i], cut[j])}
    assert alike <= set(found) and len(found) == len(set(found)) < 60 * 40 / 4
    assert all(b >= 60 for _, b in found)


def test_blocks_over_several_batches():
    """Members of a block and the texts that meet it may lie in any batches; every pair is judged once."""
    rng = np.random.default_rng(2)
    rows = [(c, p, 0, m, 100 * c + 10 * p + k + 50 * m) for c in range(3) for p in range(2) for m in (False, True) for k in range(rng.integers(1, 9))]
    rows.append((3, 0, 0, True, 900))  # a part without members
    n = len(rows)
    tally = rng.integers(0, 2, (n, near_dedup.TALLY)).astype(np.uint8) * (rng.random((n, 1)) < 0.5)
    size = rng.integers(400, 2000, n)
    columns = [np.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(columns[k]) for k in range(5)] + [pa.array(size.astype(np.int32)), pa.array([t.tobytes() for t in tally])],
        names=["class", "part", "time", "meets", "item", "size", "tally"],
    )
    expected = set()
    for i in range(n):
        for j in range(n):
            if rows[i][:3] == rows[j][:3] and not rows[i][3] and rows[j][3]:
                longer, apart = max(size[i], size[j]), tally[i].astype(int) - tally[j]
                if max(longer - min(size[i], size[j]), apart[apart > 0].sum(), -apart[apart < 0].sum()) <= int(0.2 * longer + 1e-9):
                    expected.add((min(rows[i][4], rows[j][4]), max(rows[i][4], rows[j][4])))
    for step in (1, 3, n):
        out = near_dedup._left_pairs((batch.slice(at, step) for at in range(0, n, step)), 0.8)
        got = [pair for b in out for pair in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == sorted(expected) and 0 < len(got)


def test_workers_drop_what_other_operators_kept(spark):
    """A worker that packed does not hold the tokenizer while another operator runs; a second task that packs finds it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)

    def held(module):
        def build(piece):
            yield {"n": [packing.encoder.cache_info().currsize]}

        build.__module__ = module
        return build

    for module, n in ((packing.__name__, 1), (near_dedup.__name__, 0)):
        assert packing.token_pieces(docs, path).count() == 1
        # every worker of the session that is asked holds one or none
        assert max(r.n for r in common.map_batches(docs, held(module), "n long").collect()) <= n
    packing.encoder(path)
    common.drop_kept(packing.__name__)
    assert packing.encoder.cache_info().currsize
    common.drop_kept(near_dedup.__name__)
    assert not packing.encoder.cache_info().currsize


def test_batches_are_bounded(spark):
    """Long texts: no Arrow batch of ours is larger than a piece and a row, however many rows it might have."""
    def build(piece):
        yield {"n": [piece.column("text").buffers()[2].size]}

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('long text ', 1000) as text")
    assert max(r.n for r in common.map_batches(texts, build, "n long").collect()) <= common.PIECE + 10_000


def test_line_dedup(spark, docs, empty):
    rows = line_dedup.dedup(docs)
    assert rows.columns == [*docs.columns, "__spans"]
    old = {(r.doc_id, r.text): r for r in docs.collect()}
    out = {}
    for r in rows.collect():
        out.setdefault(r.doc_id, []).append(r)
    passage = docs.where("doc_id = 10").first().text.split("\n")[1]
    first, later = out[9][0], out[10][0]
    assert passage in first.text and not first["__spans"] and passage not in later.text and len(later.text.split()) <= 40 + 2 * (line_dedup.CUT - 1)
    assert out[6][0].text.strip() == "" and out[0][0].text == docs.where("doc_id = 0").first().text and out[11][0].text is None
    for r in out[10] + out[8]:
        text = docs.where(f"doc_id = {r.doc_id}").first().text
        assert r.text == line_dedup.without(text, [(s.start, s.end) for s in r["__spans"]])
    assert len(old) and line_dedup.dedup(empty).count() == 0
    assert line_dedup.stage(spark, docs, "").columns == docs.columns


def test_line_dedup_short_lines(spark):
    """Short lines of several documents go but for the first one; those of few documents stay, however often in one."""
    rng = random.Random(8)
    texts = []
    for k in range(12):
        own = [f"{prose(rng, 6)} own{k}", "Read more. Follow us today", f"{prose(rng, 30)} own{k}"]
        texts.append("\n".join(own + (["Few hold this"] if k < 4 else ["Twice here"] * 3 if k == 4 else [])))
    texts.append("Read more. Follow us today, and other words")
    found = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0] == texts[0] and found[12] == texts[12]
    assert all(found[k] == texts[k].replace("Read more. Follow us today\n", "") for k in range(1, 12))


def test_decontaminate(spark, docs, empty):
    text = docs.where("doc_id = 2").first().text.split()
    items = spark.createDataFrame([(7, " ".join(text[20:50]).upper()), (8, None), (9, ""), (10, "x"), (None, " ".join(text[60:80]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.first_word, r.end_word, r.n_edits) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(2, 7, 20, 50, 0), (2, None, 60, 80, 0)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.leaks(empty, items).count() == 0 == decontaminate.leaks(docs, items.limit(0)).count()


def test_language_id(spark, empty):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).where(language_id.held_out(language_id.F.col("doc_id"))).collect()
    assert sum(r["__lang_pred"] == r.lang for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 !?"), (3, "  ")], "doc_id long, text string")
    assert {(r["__lang_pred"], r["__score"]) for r in language_id.identify(odd, model).collect()} == {("und", 0.0)}
    assert {r["__lang_pred"] for r in language_id.identify(docs.limit(3), language_id.train(empty)).collect()} == {"und"}
    assert language_id.stage(spark, empty, "").count() == 0
    assert zlib.crc32(b"5") % 3 == spark.range(5, 6).select((language_id.F.crc32(language_id.F.lit("5").cast("binary")) % 3).alias("m")).first().m


def test_packing(spark, docs, empty):
    rows = packing.packed(docs, limit=64).collect()
    assert all(r.length <= 64 and r.start == 64 * r.piece for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length == 1 for r in rows if r.doc_id in (11, 12, 13)) == 3
    assert packing.packed(empty).count() == 0


def test_next_row_and_fingerprints(spark, docs, empty):
    rows = fingerprint.with_next(docs.select("doc_id", "text").where("text is not null"), ["doc_id", "text"], ["text"]).collect()
    order = sorted((r for r in rows), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    assert [r.next_text for r in order] == [r.text for r in order[1:] + order[:1]]
    prints = docs.select("doc_id", fingerprint.fingerprint(fingerprint.F.coalesce("text", fingerprint.F.lit(""))).alias("f")).collect()
    by = {r.doc_id: r.f for r in prints}
    assert by[0] == by[6] and by[12] == by[14] == "" and len(by[15]) == 256
    same = lambda a, b: sum(by[a][k: k + 4] == by[b][k: k + 4] for k in range(0, 256, 4))
    assert same(0, 7) > 40 and same(0, 1) < 4
    assert fingerprint.with_next(empty.select("doc_id", "text"), ["doc_id", "text"], ["text"]).count() == 0


def test_fingerprint_against_plain(spark):
    """Points, marks and pairs by a plain loop over Spark's hashes of the 3-grams."""
    text = "a b c a b c a b c d e f g a b c"
    w = text.split()
    hashes = spark.createDataFrame([(i, *w[i: i + 3]) for i in range(len(w) - 2)], "i int, a string, b string, c string")
    x = fingerprint.F.xxhash64
    grams = [r.v for r in hashes.orderBy("i").select(x(x("a"), x("b"), x("c")).alias("v")).collect()]
    seen, points = {}, []
    for place, v in enumerate(grams):
        n = seen[v] = seen.get(v, -1) + 1
        points.append((v if n == 0 else spark.range(1).select(x(fingerprint.F.lit(v), fingerprint.F.lit(n)).alias("v")).first().v, place))
    points.sort()
    slots = []
    for j in range(fingerprint.SLOTS):
        mark = -(1 << 63) + j * ((1 << 64) // fingerprint.SLOTS)
        k = sum(v < mark for v, _ in points)
        pair = sorted((points[(k + d) % len(points)] for d in range(2)), key=lambda p: p[1])
        slots.append(spark.range(1).select(x(*[fingerprint.F.lit(p[0]) for p in pair]).alias("v")).first().v & 0xFFFF)
    got = spark.createDataFrame([(text,)], "text string").select(fingerprint.fingerprint(fingerprint.F.col("text")).alias("f")).first().f
    assert got == "".join(f"{s:04X}" for s in slots)


def test_odd_rows_of_native_operators(spark, docs, tmp_path):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", None), (1, 1, "assistant", None), (4, 0, None, "lone"), (None, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "what is x"), (1, None), (2, docs.where("doc_id = 3").first().text)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ORACLE:
        assert compare_rows(spark, con, str(tmp_path), name)
    for name in ("op7_token_counts", "op10_fingerprint", "op5_language_id"):
        assert QUERIES[name](spark, str(tmp_path)).count() == docs.count()


def compare_rows(spark, con, path, name):
    df, cur = QUERIES[name](spark, path), con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    key = lambda row: tuple("" if v is None else repr(v) for v in row)
    return sorted(df.select(*columns).collect(), key=key) == sorted(map(tuple, cur.fetchall()), key=key)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF_TINY).collect()
    assert rows and {len(STAGE) for STAGE in corpus_pipeline.STAGES} == {2}
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 4096


def test_preference_query_shares_turns(spark):
    """Both sides share all turns but the last one, and the completions differ only there."""
    rows = QUERIES["op3_preference_format"](spark, SF_TINY)
    turns = spark.read.parquet(f"{SF_TINY}/conversations.parquet").groupBy("conv_id").count()
    both = rows.join(turns, rows["pair_id"] == turns["conv_id"])
    assert both.count() == rows.count() > 0 == both.where("n_common < count - 1 or (n_common > 0) <> (prompt <> '')").count()
    assert rows.where("n_common > 0").count() > 0
