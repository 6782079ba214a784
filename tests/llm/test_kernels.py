"""The numpy parts of the operators against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from evenkeel.llm import decontaminate, html_text, language_id, line_dedup, near_dedup, packing, token_counts, words

ODD = ["", " ", "a", "Hello WÖRLD's  don't 12½ ²x", "...'s ''s it'll 'The l'été", "日本 <|endoftext|> İstanbul", "\x1ca b\ud800", "x  y \n\n z", "The the THE. " * 400]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, n, words_=range(4)):
    b = list(a)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(b) + 1)
        if kind == 0:
            b.insert(at, rng.choice(words_))
        elif at < len(b):
            b[at: at + 1] = [rng.choice(words_)] if kind == 1 else []
    return b


def test_scan_finds_words():
    texts = ["Ab, cd1_e", "", "日本 x", "É"]
    w = words.scan(texts)
    found = [texts[d][a:b].lower() for d, a, b in zip(w.doc, w.start, w.end)]
    assert found == ["ab", "cd1", "e", "日", "本", "x", "é"] and list(w.first) == [0, 3, 3, 6, 7]
    assert words.scan(["zz ab"]).hash[1] == w.hash[0]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randrange(4) for _ in range(rng.randrange(50))]
        b, most = edited(rng, a, rng.randrange(25)), rng.randrange(25)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert near_dedup.edits(x, y, most) == min(distance(a, b), most + 1)
        assert near_dedup.alike(x, y) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_marks_bound_edits():
    rng = random.Random(5)
    for _ in range(200):
        a = [str(rng.randrange(300)) for _ in range(rng.randrange(1, 120))]
        b = edited(rng, a, rng.randrange(30), ["new", "other", "7"])
        x = near_dedup.marks(words.scan([" ".join(a), " ".join(b)]))
        lacking = [sum(bin(int(v[i]) & ~int(v[1 - i]) & (1 << 64) - 1).count("1") for v in x.values()) for i in (0, 1)]
        assert max(lacking) <= distance(a, b)


def test_sketch_keeps_order_and_occurrence():
    rng = random.Random(3)
    text = [str(rng.randrange(500)) for _ in range(300)]
    near = edited(rng, text, 6, ["new"])
    other = [str(rng.randrange(500)) for _ in range(300)]
    a, b, c, d = near_dedup.sketch([" ".join(t) for t in (text, near, other, text)], 64)
    assert (a == d).all() and (a == b).sum() > 16 and (a == c).sum() == 0
    assert (near_dedup.sketch(["a b", "a b", "b a", ""], 4)[[0, 2]] != 0).all() and not near_dedup.sketch(["", "!"], 4).any()
    once, twice = near_dedup.sketch(["a b c d e", "a b c d e a b c d e"], 64)
    assert (once != twice).any()


def test_semi_global_and_search():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(15, 60))) for _ in range(40)] + ["too short", "", None]
    search = decontaminate.Search(decontaminate.Items(list(range(len(items))), items))
    exact = [" ".join(rng.choices(vocabulary, k=50)) + " " + items[i].upper().replace(" ", ", ") + " " + " ".join(rng.choices(vocabulary, k=9)) for i in range(40)]
    found = search(exact)
    assert [(d, i, c) for d, i, _, _, c in found] == [(i, i, 0) for i in range(40)] and all(a == 50 for _, _, a, _, _ in found)
    hit = 0
    for i in range(40):
        leak = edited(rng, items[i].split(), len(items[i].split()) // 8, ["x", "y"])
        text = rng.choices(vocabulary, k=30) + leak + rng.choices(vocabulary, k=30)
        got = search([" ".join(text)])
        hit += any(f[1] == i for f in got)
        for _, k, a, b, cost in got:
            assert cost <= 0.2 * len(items[k].split())
            assert distance(items[k].split(), text[a:b]) == cost
    assert hit >= 38  # recall of edited items
    assert search([None, "", "w1"]) == [] and decontaminate.Search(decontaminate.Items([], []))(["a"]) == []


@pytest.mark.parametrize("text", ODD)
def test_encoder_equals_tokenizer(text):
    encode = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    if "\ud800" in text:
        text = text.replace("\ud800", "?")
    want = encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in encode([text, "plain text", text])][::2] == [want, want]


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    for score in ("norm", "dot"):
        for documents, attention in ((100, 10_000), (3, 10_000), (100, 4_000)):
            lengths_ = lengths[lengths ** 2 <= attention]
            own = packing.best_fit(lengths_, (100, documents, attention), score=score)
            for k in range(own.max() + 1):
                part = lengths_[own == k]
                assert part.sum() <= 100 and len(part) <= documents and (part ** 2).sum() <= attention
    own = packing.best_fit(lengths, (100, 100, 10_000))
    assert own.max() + 1 <= -(-lengths.sum() // 100) * 1.05
    assert len(packing.best_fit(np.zeros(0), (10, 10, 100))) == 0


def test_units_cover_their_lines():
    texts = ["Ab cd. Ef gh\n - ij kl\n\nmn", "", "!!\nx", "One two three " * 40]
    u = line_dedup.units(texts)
    for d, text in enumerate(texts):
        own = u["doc"] == d
        pieces = [text[a:b] for a, b in zip(u["start"][own], u["end"][own])]
        lines = [line for line in text.split("\n") if re.search(r"\w", line)]
        assert "".join(pieces) == "".join(lines) and list(u["pos"][own]) == list(range(own.sum()))
    # The same passage has the same inner units wherever it stands.
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(99)}" for _ in range(80))
    a, b = line_dedup.units([f"some words before {passage} and after"]), line_dedup.units([f"x\nother {passage}"])
    common = set(a["hash"].tolist()) & set(b["hash"].tolist())
    assert sum(n for h, n in zip(a["hash"].tolist(), a["words"]) if h in common) > 50


def test_count_tree_follows_edits():
    ranks = token_counts.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    count = lambda text: len(ranks.encode_ordinary(text))
    rng = random.Random(2)
    for text in [t.replace("\ud800", "") for t in ODD]:
        tree, now = token_counts.CountTree(text, count, 40), text
        assert tree.total() == count(text)
        for _ in range(8):
            at, remove = rng.randrange(len(now) + 2), rng.choice([0, 1, 3, 200])
            insert = rng.choice(["", " ", "a", "  b", "\n", "foo bar's 12", " x" * 30])
            tree.edit(at, remove, insert)
            at = min(at, len(now))
            now = now[:at] + insert + now[at + remove:]
            assert tree.text() == now and tree.total() == count(now)


def test_language_costs_match_a_plain_model():
    """Code lengths by dictionaries: longest seen context first, escape to the shorter one, 8 bits below the empty one."""
    train = {"a": b"abracadabra abra", "b": b"bonbon bobo bonobo"}
    counts = {}
    for lang, data in train.items():
        gram, start, end = language_id.grams([data])
        counts[lang] = dict(Counter(gram[start[0]: end[0]].tolist()))
    model = language_id.Model(counts)

    def plain(lang, context, byte):
        seen = Counter()
        padded = b"   " + train[lang]
        for k in range(3, len(padded)):
            if padded[k - len(context): k] == context:
                seen[padded[k]] += 1
        n, kinds = sum(seen.values()), len(seen)
        if seen[byte]:
            return -np.log2(seen[byte] / (n + kinds))
        escape = -np.log2(kinds / (n + kinds)) if n else 0
        return escape + (plain(lang, context[1:], byte) if context else 8)

    text = b"abonbra zq bo"
    gram, start, end = language_id.grams([text])
    got, padded = model.lengths(gram)[start[0]: end[0]], b"   " + text
    want = [[plain(lang, padded[k - 3: k], padded[k]) for lang in model.langs] for k in range(3, len(padded))]
    assert np.allclose(got, want)
    out = model.score(["abra", None, "", "12 !", "bonbon"])
    assert out["lang_pred"] == ["a", "und", "und", "und", "b"] and out["score"][1] == 0


def test_html_text():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="sidebar"><p>Side text. Long enough, surely.</p></div>
<main><div class="content"><h2>Head &amp; tail</h2><p>First   para, with <a href=x>link</a> text. It goes on.<p>Second para.
And more, and more.</p><ul><li>one item<li>two item</ul><aside>Pull</aside><form>Name <input></form></div>
<div id="comments"><p>Great post! I liked it, really.</p></div></main><script>var a = "</p>";</script><footer>&copy; x</footer></body></html>"""
    assert html_text.extract(page) == "Head & tail\nFirst para, with link text. It goes on.\nSecond para. And more, and more.\none item\ntwo item"
    assert html_text.extract("just &lt;text") == "just <text"
    assert [html_text.extract(x) for x in (None, "", "<nav>menu</nav>", "<p><b")] == ["", "", "", "<b"]


def test_html_text_keeps_what_is_beside_the_body():
    para = "<p>A paragraph of the body, long enough, with some words in it. It goes on and on.</p>"
    body = f"<div>{para * 20}</div>"
    found = html_text.extract(f"<body><nav>menu</nav><article><h1>Title</h1><p>Lead.</p>{body}</article><footer>x</footer></body>")
    assert found.split("\n")[:2] == ["Title", "Lead."] and found.count("A paragraph") == 20 and "menu" not in found
    two = html_text.extract(f"<main><article><section>{para * 23}</section><section>{para * 2}</section></article></main>")
    assert two.count("A paragraph") == 25


def test_words_of_one_hash_keep_their_own_ids():
    """The Thue-Morse word and its mirror share every polynomial hash modulo 2**64; their ids are their own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from evenkeel.llm.packing import Encoder, pre_tokens

    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    mirror = word.translate(str.maketrans("ab", "ba"))
    *_, hashes = pre_tokens([word, mirror])
    assert hashes[0] == hashes[1]
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    texts = [f"x {word} y", f"{mirror} z", "some words", "", None or "é 漢字", f"{word} {mirror}"]
    encode = Encoder(path)
    for part in (texts, texts[::-1], ["some words again", mirror]):
        assert [list(ids) for ids in encode(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]
