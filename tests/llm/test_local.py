"""The numpy parts against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import decontaminate, extract, language, licenses, near_dups, repetition, substrings, token_counts, words

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#", max_size=60)), max_size=6)


def split(text):
    return [w for w in SPLIT.split(text or "") if w]


def blocks(texts, limit=30):
    return list(words.text_blocks(pa.array(texts, pa.string()), limit))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_span_hashes(texts):
    seen = {}
    rows = collections.defaultdict(list)
    for block in blocks(texts):
        begin, end, row = block.words()
        hashes = words.span_hash(block.prefix(), begin, end)
        for b, e, r, h in zip(begin, end, row, hashes, strict=True):
            word = bytes(block.data[b:e])
            rows[block.first + r].append(word.decode())
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [rows[i] for i in range(len(texts))] == [split(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=9), min_size=1, max_size=4), st.data())
def test_forward_sums_all_segmentations(texts, data):
    pieces = sorted({b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca"})
    probs = np.array(data.draw(st.lists(st.floats(0.01, 1), min_size=len(pieces), max_size=len(pieces))) + [0.0])[:, None]
    keys = language.piece_keys(pieces)
    order = np.argsort(keys)

    def total(word):
        if not word:
            return 1.0
        return sum(probs[i, 0] * total(word[len(p) :]) for i, p in enumerate(pieces) if word.startswith(p))

    model = language.LanguageModel(["xx"], keys[order], order, probs)
    got = model.word_scores([t.encode() for t in texts])[:, 0]
    assert got == pytest.approx([np.log(total(t.encode())) for t in texts], rel=1e-9)


def brute_repeats(text):
    w = split(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    longest = 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            longest = max(longest, n if n >= 8 else 0)
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), longest


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_repetition(limit):
    rng = random.Random(7)
    texts = [None, "", "one", "a  #b\x1c é\n\nq\nq"]
    for _ in range(120):
        w = [rng.choice(rng.choice(["ab", "abc", "abcdefghijkl"])) for _ in range(rng.randint(0, 60))]
        if len(w) > 12:
            w += w[3 : 3 + rng.randint(7, 12)]
        texts.append("".join(x + rng.choice([" ", "\n"]) for x in w))
    got = []
    for block in blocks(texts, limit):
        j = repetition.judge(block, repetition.Limits())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
        got += list(zip(*(j[k].tolist() for k in names), strict=True))
    assert got == [brute_repeats(t) for t in texts]


def test_repetition_verdict():
    plain = " ".join(f"w{i}" for i in range(400))
    once = f"{plain} {' '.join(f'w{i}' for i in range(30))}"  # 60 of 430 words
    far = f"{plain} " + " ".join(f"w{i}" for i in range(101)) + " " + " ".join(f"v{i}" for i in range(700))
    (block,) = blocks([plain, once, far, f"{plain} {plain}", "few words"], 1 << 20)
    j = repetition.judge(block, repetition.Limits())
    assert j["kept"].tolist() == [True, True, False, False, False]
    assert j["base_failed"].tolist() == [False, False, False, True, True]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**32), st.sampled_from(["most", "first"]))
def test_allotment(size, seed, rule):
    rng = np.random.default_rng(seed)
    cuts = np.unique(rng.integers(0, size + 1, 6))
    end = np.append(np.sort(rng.choice(size, rng.integers(0, size), replace=False)) + 1, size)
    end = np.unique(end)
    begin = np.concatenate([[0], end[:-1]])
    low, high = cuts[:-1], cuts[1:]
    if rng.random() < 0.5:
        low, high = low[::2], high[::2]
    want = []
    for b, e in zip(begin, end, strict=True):
        held = [max(0, min(e, h) - max(b, lo)) for lo, h in zip(low, high, strict=True)]
        touched = [k for k, n in enumerate(held) if n]
        want.append((max(touched, key=lambda k: (held[k], -k)) if rule == "most" else touched[0]) if touched else -1)
    assert token_counts.allot(begin, end, low, high, rule).tolist() == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        a = [rng.randint(1, 40) for _ in range(rng.randint(1, 70))]
        b = [rng.randint(1, 40) if rng.random() < 0.1 else x for x in a if rng.random() > 0.08] or [1]
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    got = near_dups.similar([a for a, _ in pairs], [b for _, b in pairs], near_dups.NearSettings(band=2))
    want = [edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert got.tolist() == want and 20 < sum(want) < 180


def test_order_matters_to_the_sketch():
    s = near_dups.NearSettings()
    a = " ".join(f"w{i}" for i in range(100))
    halves = a.split()
    (block,) = blocks([a, a.upper().lower(), " ".join(halves[50:] + halves[:50]), "w1 w2"], 1 << 20)
    _, whole, sizes, keys = near_dups.sketch(block, s)
    assert (keys[0] == keys[1]).all() and whole[0] == whole[1] != whole[2] and sizes.tolist() == [100, 100, 100, 2]
    assert (keys[0] == keys[2]).sum() < s.keys  # the same k-mers but for a few, in another order


def local_score(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (1 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_local_alignment():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, text = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, begin, end = decontaminate.align(item, text)
        assert score == local_score(item, text)
        assert score == local_score(item, text[begin:end])


def test_no_local_alignment_beats_its_bound():
    rng = np.random.default_rng(6)
    for _ in range(200):
        item, text = (rng.integers(0, 12, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(item, text)[0] <= decontaminate.most_score(np.unique(item), text) <= len(text)


def test_band_count():
    for similarity in (0.4, 0.64, 0.9):
        n = licenses.bands_needed(similarity, 1, 1e-4)
        assert (1 - similarity) ** n <= 1e-4 < (1 - similarity) ** (n - 1)


def test_license_windows():
    s = licenses.ScanSettings()
    index = licenses.build_index(licenses.TEMPLATES, s)
    filler = " ".join(f"f{i}" for i in range(50))
    for name, text in licenses.TEMPLATES.items():
        (block,) = blocks([f"{filler} {text} {filler}".lower(), filler, text.lower()], 1 << 20)
        found = {(row, lic): (share, a, b) for row, lic, share, a, b in licenses.scan(block, index, s)}
        n = len(re.findall("[0-9a-z]+", text.lower()))
        assert found[0, name] == (1.0, 50, 50 + n) and found[2, name] == (1.0, 0, n)
        assert all(row != 1 for row, _ in found)
    edited = licenses.TEMPLATES["BSD"].replace("conditions", "terms").lower()
    (block,) = blocks([f"{filler} {edited}"], 1 << 20)
    assert [(r, lic) for r, lic, *_ in licenses.scan(block, index, s)] == [(0, "BSD")]


def test_run_index_shares_match_brute_force():
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    groups = np.array([rng.randint(0, 3) for _ in texts])
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, packed = substrings.suffix_order(data, starts, groups)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    suffix = lambda i: texts[owner[i]][i - starts[owner[i]] :]
    want = sorted(range(len(data)), key=lambda i: (groups[owner[i]], [x + 1 for x in suffix(i)], owner[i]))
    assert order.tolist() == want
    shared = substrings.RunIndex.build(data, starts, groups, order, packed).stream(len(data))
    for a, b in zip(order[:-1], order[1:], strict=True):
        x, y = suffix(a), suffix(b)
        n = 0
        while groups[owner[a]] == groups[owner[b]] and n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        assert shared[b] == n


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and you agree to that with all of it</div><!-- <p>hidden</p> -->
<article><h1>A  Title &amp; more</h1><p>First <b>bold</b>ly&nbsp;said.<p>Second &lt;p&gt; line<br>goes on
<div class="share-links"><a href=x>Share</a></div><aside>Related things</aside><form>Name <input></form>
<table><tr><td>cell</td></tr></table></article>
<section id="comments"><p>I like this very much, it is the best of all</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "A Title & more\nFirst boldly said.\nSecond <p> line goes on\ncell"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<p") == ""
    assert extract.main_text(PAGE[: PAGE.index("cell") + 4]).endswith("cell")


def test_main_text_without_article_element():
    good = "The house of the king is in the north and it was built by the men who had come from the sea. " * 3
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>The House</h2><p>{good}</p><p>It is old.</p><p>{good}</p><p>Buy now</p><ul><li><a href=3>More</a></ul>"
    assert extract.main_text(page).split("\n") == ["The House", good.strip(), "It is old.", good.strip()]


def test_similar_texts_share_a_rare_token():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(5, 60))
        a = rng.integers(0, 12, n).astype(np.uint32)
        b, edits = a.tolist(), int(0.2 * n)
        for _ in range(int(rng.integers(0, edits + 1))):
            at = int(rng.integers(0, len(b)))
            kind = rng.integers(3)
            b[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(100))]
        b = np.array(b, np.uint32)
        if not near_dups.similar([a], [b], near_dups.NearSettings())[0]:
            continue
        uses = rng.integers(0, 50, 1 << near_dups.RARITY_BITS)
        left, right = (near_dups.rare_tokens(x, uses, 0.8) for x in (a, b))
        assert np.isin(left, right).any()
        one, other = near_dups.signature(a), near_dups.signature(b)
        lost = [sum(int(x).bit_count() for x in (p & ~q).view(np.uint64)) for p, q in ((one, other), (other, one))]
        assert max(lost) <= int(0.2 * max(len(a), len(b)) + 1e-6)


def test_blocks_of_texts_find_what_pairs_of_texts_find():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 12, int(rng.integers(5, 30))).astype(np.uint32) for _ in range(31)]
    texts += [np.where(rng.random(len(x)) < 0.1, 99, x).astype(np.uint32) for x in texts]
    ids, classes = np.arange(62), np.arange(62) % 50
    one, other = (near_dups.Block.of(ids[k::2], classes[k::2], texts[k::2]) for k in (0, 1))
    got = set(map(tuple, near_dups.likely_pairs(one, other, 0.8).T.tolist()))
    s = near_dups.NearSettings()
    pairs = [(u, v) for u in range(62) for v in range(u + 1, 62) if (u + v) % 2 and classes[u] != classes[v]]
    longer = {p: max(len(texts[p[0]]), len(texts[p[1]])) for p in pairs}
    common = {p: near_dups.common_words(texts[p[0]], texts[p[1]]) >= longer[p] - int(0.2 * longer[p] + 1e-9) for p in pairs}
    assert got == {p for p in pairs if common[p]}
    alike = near_dups.similar([texts[u] for u, _ in pairs], [texts[v] for _, v in pairs], s)
    assert {p for p, x in zip(pairs, alike, strict=True) if x} <= got and alike.any()


def test_hopeless_alignments_are_given_up_but_no_other():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1000, (40, 200)).astype(np.uint32)
    b = np.where(rng.random(a.shape) < rng.random((40, 1)), 5000, a).astype(np.uint32)
    n = np.full(40, 200)
    whole = near_dups.banded_distance(a, b, n, n, 40)
    most = np.full(40, 40)
    some = near_dups.banded_distance(a, b, n, n, 40, most)
    assert ((whole <= most) == (some <= most)).all() and (some[whole <= most] == whole[whole <= most]).all()
    assert (whole <= most).any() and (some != whole).any()
