"""Count trees against counting anew: edits, appends, long runs of letters, stored trees."""

import random

import public_tokenizers

from evenkeel.llm import token_counts
from evenkeel.llm.token_counts import CountTree, encoding, leaves

RANKS = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ALPHABET = ["a", "word", " ", "  ", "\n", "'s", "'ll", "é", "漢字", "123", "²", "Ⅷ", ".", "...", "_", "-", "\t ", "Ünder", "́", "🙂", "ſ", "'", "St"]


def count(text):
    return len(RANKS.encode_ordinary(text))


def test_leaves_sum_up_to_the_whole():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(40)))
        parts = leaves(text, rng.randrange(6))
        assert "".join(parts) == text and sum(map(count, parts)) == count(text), text


def test_edits_against_a_recount():
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(120)))
        tree = CountTree(text, count, rng.choice([1, 4, 16]))
        for _ in range(25):
            at, remove, insert = rng.randrange(len(text) + 2), rng.choice([0, 1, 5, 400]), "".join(rng.choices(ALPHABET, k=rng.randrange(6)))
            at = min(at, len(text))
            text = text[:at] + insert + text[at + remove:]
            tree.edit(at, remove, insert)
            assert tree.text() == text and tree.total() == count(text)
            assert tree.chars[1] == len(text) and (all(tree.parts) or tree.parts == [""])


def test_the_last_append_costs_about_the_first():
    tree, spent = CountTree("A first line of text.", count), []
    for k in range(400):
        before = tree.encoded
        tree.edit(10 ** 9, 0, f" Then line {k} follows.")
        spent.append(tree.encoded - before)
    assert max(spent[-50:]) <= 3 * token_counts.LEAF and len(tree.parts) > 10
    assert max(map(len, tree.parts)) <= 2 * token_counts.LEAF and tree.total() == count(tree.text())


def test_leaves_merge_again():
    tree = CountTree("some words here, and more. " * 2000, count)
    tree.edit(100, 50000, "")
    assert len(tree.parts) < 20 and tree.total() == count(tree.text())
    tree.edit(0, 10 ** 9, "")
    assert (tree.parts, tree.total()) == ([""], 0)
    tree.edit(5, 3, "new")
    assert tree.total() == count("new")


def test_a_second_load_encodes_what_changed(spark):
    long = " ".join(f"word{k} and more," for k in range(5000))
    first = [(1, long), (2, "short text"), (3, None), (4, ""), (None, "no id"), (5, "x" * 5000), (6, long)]
    second = [(1, long[:40000] + " put in " + long[40000:]), (2, "short text, longer"), (3, "now some"), (4, None), (None, "no id"), (6, long), (7, "new")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    stored = token_counts.recount(frame(first))
    out = {r.doc_id: r for r in token_counts.recount(frame(second), stored).collect()}
    for doc_id, text in second:
        assert out[doc_id].n_tokens == count(text or "") and sum(x.n_chars for x in out[doc_id].leaves) == len(text or "")
    assert out[6].n_encoded == 0 and 0 < out[1].n_encoded <= 4 * token_counts.LEAF and out[7].n_encoded == 3
    third = {r.doc_id: r for r in token_counts.recount(frame(second), token_counts.recount(frame(second), stored)).collect()}
    assert all(third[d].n_encoded == 0 for d, _ in second if d is not None)
    assert token_counts.recount(frame(first).where("false"), stored).count() == 0


def test_carried_leaves_against_a_recount():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(80)))
        stored, _ = token_counts.carried(text, [], count, 5)
        for _ in range(4):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(rng.choices(ALPHABET, k=rng.randrange(4))) + text[at + rng.randrange(8):]
            stored, _ = token_counts.carried(text, stored, count, 5)
            assert sum(x["n_tokens"] for x in stored) == count(text) and sum(x["n_chars"] for x in stored) == len(text)


def test_tables(spark):
    """Null and empty texts, null edits, clashing columns, repeated rows and no rows."""
    docs = spark.createDataFrame([(1, "a few words", "x"), (1, "a few words", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, leaves string")
    out = token_counts.edited_counts(docs, token_counts.sample_edits())
    assert out.count() == 4 and out.where("text IS NULL").first()["__before"] == 0
    assert token_counts.edited_counts(docs.where("false"), token_counts.sample_edits()).count() == 0
    assert token_counts.recount(docs).where("doc_id = 1").count() == 2
