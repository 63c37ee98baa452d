"""Search, alignment of tokenizers and near vectors: edge rows, and against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import alignment, cover_tree, lexical

from edge_rows import CLASHES, EDGE_ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# ---- search ----


def brute_search(docs, items, k=10):
    cut = [(doc_id, collections.Counter(TERM.findall((text or "").translate(UPPER)))) for doc_id, text in docs]
    cut = [(d, c) for d, c in cut if c]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    df = collections.Counter(t for _, c in cut for t in c)
    out = []
    for item_id, text in items:
        wanted, scored = set(TERM.findall((text or "").translate(UPPER))), []
        for doc_id, c in cut:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, doc_id, -score) for r, (score, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [(1, "The CAT and the dog"), (2, None), (3, ""), (None, "haus mann, é"), (1, "The CAT and the dog"), (4, "no such terms qqq"), (5, "word x" + "x" * 199_999)]


def test_search_of_edge_rows(spark, edge, no_rows):
    items = spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id long, text string, score int")
    docs = [(r[0], r[1]) for r in EDGE_ROWS]
    assert found(lexical.search(edge, items)) == brute_search(docs, ITEMS)
    assert found(lexical.search(no_rows, items)) == [] == found(lexical.search(edge, items.limit(0)))
    with pytest.raises(TypeError):
        lexical.search(edge.withColumn("doc_id", F.col("doc_id").cast("string")), items)


def test_search_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Wort", "straße", "a", "B", "c1", "c2", *[f"t{i}" for i in range(60)]]
    docs = [(rng.randrange(200) if rng.random() < 0.9 else None, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", "!", "\n", "_x"])) for _ in range(400)]
    docs += [docs[5]] * 15 + [(1000 + i, "tie tie") for i in range(30)]
    items = [(i, ",".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)] + [(99, "TIE")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items)
    assert found(lexical.search(d, i)) == want
    # small tiles, and several blocks of items
    assert found(lexical.search(d, i, lexical.SearchSettings(item_chars=200, doc_rows=3, terms=2, items=2))) == want
    assert found(lexical.search(d, i, lexical.SearchSettings(k=3))) == brute_search(docs, items, 3)


# ---- tokenizers ----


@pytest.fixture(scope="module")
def sides():
    from pathlib import Path

    from tokenizers import Tokenizer

    files = alignment.Files(Path(alignment.A_FILE).read_bytes(), Path(alignment.B_FILE).read_bytes())
    a, b = alignment.loaded(files)
    own = Tokenizer.from_file(alignment.A_FILE)
    own.encode_special_tokens = True
    return a, b, own


def brute_groups(text, sides):
    a, b, own = sides
    if not text:
        return []
    left, right, data = own.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text), (" " + text).encode()
    if not (b"".join(a.pieces[i] for i in left) == data == b"".join(b.pieces[i] for i in right)):
        return []
    ends = [np.cumsum([len(side.pieces[i]) for i in ids]).tolist() for side, ids in ((a, left), (b, right))]
    out, low = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(([i for i, e in zip(left, ends[0]) if low < e <= cut], [i for i, e in zip(right, ends[1]) if low < e <= cut], low, cut))
        low = cut
    return out


def brute_links(text, groups, sides):
    a, b, _ = sides
    out = []
    for left, right, low, _ in groups:
        x = low
        for i in left:
            y = low
            for j in right:
                if x < y + len(b.pieces[j]) and y < x + len(a.pieces[i]):
                    out.append((i, j))
                y += len(b.pieces[j])
            x += len(a.pieces[i])
    return out


TEXTS = ["the cat sat on the unbelievable mat", "", None, "<|endoftext|> plain <s> text", "héllo wörld straße", "日本語 and 🙂 emoji", "a  b   c", "▁odd", " lead", "tail ", "the cat sat on the unbelievable mat", "line\nline\r\n\ttab", "12345 67,890.12", "привет мир", "x" * 3000]


def test_align_against_brute_force(spark, sides):
    docs = [(k if k % 5 else None, t) for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_best int, chunk int").repartition(3)
    groups = [brute_groups(t, sides) for _, t in docs]
    links = [brute_links(t, g, sides) for (_, t), g in zip(docs, groups)]
    total = collections.Counter(x for ls in links for x in ls)
    most = collections.Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    want = []
    for (doc_id, _), g, ls in zip(docs, groups, links):
        line = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right, *_ in g)
        want.append((doc_id, sum(len(x[0]) for x in g), sum(len(x[1]) for x in g), len(g), len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    for chars in (1, 2000, 6_000_000):
        aligned = alignment.align(df, chunk_chars=chars)
        got = aligned.per_document()
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in aligned.counts.collect()} == {x: (n, n == most[x[1]]) for x, n in total.items()}


def test_token_groups(spark, sides):
    df = spark.createDataFrame([(1, t) for t in TEXTS], "doc_id long, text string").coalesce(1)
    got = [[(g["a"], g["b"], g["begin"], g["end"]) for g in r["groups"]] for r in alignment.token_groups(df).collect()]
    assert got == [brute_groups(t, sides) for t in TEXTS]


def test_align_edge_rows(spark, edge, no_rows):
    got = alignment.align(edge).per_document().collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in EDGE_ROWS), key=str)
    assert {(r["n_a"], r["count_sum"], r["groups_sha256"]) for r in got if r["doc_id"] in (3, 4)} == {(0, 0, "")}
    assert alignment.align(no_rows).per_document().count() == 0


# ---- vectors ----


def brute_vectors(rows, cosine=0.98):
    ok = [x is not None and label is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x, label in rows]
    n, above = len(rows), list(range(len(rows)))

    def find(k):
        while above[k] != k:
            k = above[k]
        return k

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    above[find(i)] = find(j)
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    out = [(r[0], links[k], least.get(find(k)), r[0] == least.get(find(k))) for k, r in enumerate(rows)]
    return sorted(out, key=str)


def vector_rows(seed, n=260, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for k in range(n):
        x = centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.3])
        rows.append((int(rng.integers(10_000)), (x * rng.choice([1, 1, 7])).astype(np.float32).tolist(), int(rng.integers(2))))
    rows += [rows[3]] * 4 + [(None, rows[3][1], rows[3][2]), (None, None, 1), (5, None, 1), (6, [0.0] * dim, 1), (7, [], 1), (8, rows[4][1], None), (9, [math.nan] * dim, 1)]
    rows += [(10, [math.inf] + [0.0] * (dim - 1), 1), (11, [None] + [1.0] * (dim - 1), 1), (12, [1.0, 2.0], 1), (13, [2.0, 4.0], 1), (14, [1e-30] * dim, 0), (15, [3e38] * dim, 0)]
    return rows


def near(spark, rows, settings):
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "vec_id long, embedding array<float>, label int, gid int, key string").repartition(5)
    got = cover_tree.near_vectors(df, settings)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("leaf, fan, levels", [(4096, 64, 12), (30, 8, 3), (12, 4, 2)])
def test_near_vectors_against_brute_force(spark, leaf, fan, levels):
    rows = vector_rows(leaf)
    assert near(spark, rows, cover_tree.TreeSettings(leaf=leaf, fan=fan, levels=levels)) == brute_vectors(rows)


def test_near_vectors_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert cover_tree.near_vectors(none).count() == 0
    with pytest.raises(TypeError):
        cover_tree.near_vectors(none.withColumn("vec_id", F.lit("a")))


@pytest.mark.parametrize("case", ["apart", "plane", "groups", "ball", "point"])
@pytest.mark.parametrize("two", [False, True])
def test_dual_traversal(case, two):
    rng = np.random.default_rng(1)
    x = {
        "apart": lambda: rng.normal(size=(600, 64)),
        "plane": lambda: rng.normal(size=(900, 2)),
        "groups": lambda: np.repeat(rng.normal(size=(20, 64)), 40, 0) + rng.normal(size=(800, 64)) * 0.05,
        "ball": lambda: rng.normal(size=(1, 64)) + rng.normal(size=(1200, 64)) * 0.07,
        "point": lambda: rng.normal(size=(1, 64)) + rng.normal(size=(1200, 64)) * 0.001,
    }[case]()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half, weights = len(x) // 2, rng.integers(1, 4, len(x))
    hits = x @ x.T >= 0.98
    np.fill_diagonal(hits, False)
    if two:
        hits[:half, :half] = hits[half:, half:] = False
    links = cover_tree.Links(weights)
    one = cover_tree.Tree(x[:half] if two else x, 64)
    cover_tree.dual_traversal(one, cover_tree.Tree(x[half:], 64) if two else one, half * two, links, 0.98)
    assert (links.n == hits @ weights).all()

    def parts(pairs):
        above = list(range(len(x)))

        def find(k):
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            above[max(a, b)] = min(a, b)
        return [find(k) for k in range(len(x))]

    edges = np.concatenate(links.edges, axis=1).T if links.edges else []
    assert len(edges) <= 12 * len(x)
    assert parts(edges) == parts(zip(*np.nonzero(hits)))


def test_nets_cover_and_nest():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 8)), 20, 0) + rng.normal(size=(600, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.Tree(x, 64)
    stack, split = [tree.root], 0
    while stack:
        node = stack.pop()
        assert node.centre in node.members
        apart = cover_tree.distance(x[node.members] @ x[node.centre])
        assert apart.max() <= node.radius + 1e-6
        children = tree.split(node)
        if children:
            split += 1
            assert node.centre in [c.centre for c in children]
            assert sorted(np.concatenate([c.members for c in children])) == sorted(node.members)
            assert all(c.radius <= node.radius / 2 + 1e-6 for c in children)
            stack += children
    assert split > 1
