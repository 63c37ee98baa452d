"""Operators on edge rows, and against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontaminate, extract, language, licenses, mixing, near_dups, ngram_lm, repetition, substrings, token_counts, words
from auditloom.llm.components import components

from edge_rows import CLASHES, EDGE_ROWS

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPLIT.split(text or "") if w]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def held(doc_id, parts, part):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


# ---- language ----


def test_language(spark, edge, no_rows):
    df = edge.union(no_rows.select("*", *[F.lit(0).alias(c) for c in CLASHES]))
    model = language.train_languages(df.where("doc_id IS NOT NULL"), texts_per_language=50, rounds=2)
    assert model.languages == ["de", "en"]
    judged = language.with_language(df, model, "judged")
    assert judged.columns == [*df.columns, "judged"]
    got = {(r["doc_id"], r["text"]): r["judged"] for r in judged.collect()}
    assert judged.count() == len(EDGE_ROWS)
    for (doc_id, text), r in got.items():
        if not any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in ("de", "en") and 0.5 <= r["score"] <= 1
    assert got[1, EDGE_ROWS[0][1]]["lang_pred"] == "en" and got[2, EDGE_ROWS[2][1]]["lang_pred"] == "de"
    nothing = language.train_languages(no_rows)
    assert nothing.languages == []
    assert {r["language"]["lang_pred"] for r in language.with_language(edge.drop("language"), nothing).collect()} == {"und"}
    assert language.with_language(no_rows, model).count() == 0


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    parts = {"en": "the of and to ing tion ea th wh er".split(), "de": "der die und ung sch keit ein ich pf ü".split(), "fr": "le la que eau oi é è ment eux de".split()}
    docs = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(20)), lang) for i, lang in enumerate(list(parts) * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.train_languages(df.where(~out))
    test = language.with_language(df.where(out), model).select("lang", "language.lang_pred").collect()
    assert len(test) > 20 and sum(a == b for a, b in test) >= 0.97 * len(test)


def test_held_out(spark):
    df = spark.range(200).select("id", language.held_out(F.col("id"), 5, 1).alias("h"), language.held_out(F.lit(None).cast("long"), 5, 1).alias("n"))
    assert all(r["h"] == held(r["id"], 5, 1) and r["n"] is False for r in df.collect())


# ---- pages ----


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a &amp;  b</p></article>", "old"), (None, None, None, None), (2, "", "", ""), (1, "u", "<article><p>a &amp;  b</p></article>", "old")], "page_id long, url string, html string, text string")
    assert rows(extract.extract_text(pages).select("page_id", "text")) == [(1, "a & b"), (1, "a & b"), (2, ""), (None, "")]
    assert extract.extract_text(pages.limit(0)).count() == 0


def test_blocks_of_extracted_text_are_two_line_feeds_apart(spark):
    pages = spark.createDataFrame([(1, "<article><h1>a</h1><p>b  c</p><p>d</p></article>")], "page_id long, html string")
    assert extract.extract_text(pages).first()["text"] == "a\n\nb c\n\nd"


# ---- tokens ----


def test_section_tokens(edge, no_rows):
    got = token_counts.section_tokens(edge)
    assert got.columns == ["doc_id", "section", "begin", "end", "n_tokens", "doc_tokens"]
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY, token_counts.PATTERN)
    sums = collections.Counter()
    for r in got.collect():
        sums[r["doc_id"], r["doc_tokens"]] += r["n_tokens"]
    want = collections.Counter()
    for doc_id, text, *_ in EDGE_ROWS:
        if text:
            n = len(encoding.encode_ordinary(text))
            want[doc_id, n] += n
    assert sums == want
    assert token_counts.section_tokens(no_rows).count() == 0


def test_section_tokens_of_fields(spark):
    text = "title here\nthe body, and more\nend"
    df = spark.createDataFrame([(1, text, [(0, 11), (11, 30)]), (2, None, [(0, 1)]), (3, "é", None)], "doc_id long, text string, spans array<struct<begin: int, end: int>>")
    got = {(r["doc_id"], r["section"]): r for r in token_counts.section_tokens(df, F.col("spans")).collect()}
    assert set(got) == {(1, -1), (1, 0), (1, 1), (3, -1)}
    assert sum(r["n_tokens"] for k, r in got.items() if k[0] == 1) == got[1, 0]["doc_tokens"]
    with pytest.raises(ValueError):
        token_counts.section_tokens(df, rule="half")


# ---- mixing ----


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= per * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else per * weight[s]
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(spark, edge, no_rows):
    rng = random.Random(2)
    docs = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "b", "é", "Z", "z1", None, "", "big", "big", "big"])) for i in range(1500)]
    docs += [(None, "n n", "a"), (7, docs[7][1], docs[7][2]), (9000, None, "empty only")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_sources(df).collect()
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len(split(text))
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 15 + 1e-6 for s in sizes)
    again = mixing.mix_sources(df.repartition(3)).select("doc_id", "size", "source", "copies")
    assert rows(again) == rows(spark.createDataFrame(got).select("doc_id", "size", "source", "copies"))
    assert mixing.mix_sources(no_rows).count() == 0 and mixing.mix_documents(no_rows).count() == 0
    assert mixing.mix_sources(edge).count() == len(EDGE_ROWS)
    mixed = mixing.mix_documents(edge)
    # a column of its own of that name is replaced
    assert mixed.columns == [*[c for c in edge.columns if c != "mix_copies"], "mix_copies"] and 0 < mixed.count() <= len(EDGE_ROWS)


# ---- leaks ----


def test_leaks(spark, edge, no_rows):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)] + [(None, "no id here at all"), (9, None), (10, "too short")]
    filler = lambda n: " ".join(word() for _ in range(n))
    edited = [w if i % 6 else word() for i, w in enumerate(items[1][1].split())]
    docs = [
        (1, f"{filler(40)} {items[0][1]} {filler(40)}"), (2, f"{filler(500)}, {' '.join(edited).upper()}."), (3, filler(300)),
        (4, items[2][1]), (5, " ".join(items[3][1].split()[:5])), (4, items[2][1]), (None, items[2][1]), (6, None), (7, ""),
    ]
    docs += [(100 + k, f"{items[4][1]} {filler(5)}") for k in range(60)]  # leaked nearly everywhere
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (4_000_000, 200):  # one block, or several
        s = decontaminate.LeakSettings(block_chars=chars)
        got = decontaminate.find_leaks(df, bench, s)
        pairs = sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str)
        assert pairs == sorted([(1, 0), (2, 1), (4, 2), (4, 2), (None, 2), *[(100 + k, 4) for k in range(60)]], key=str)
        assert rows(decontaminate.without_leaks(df, bench, s).select("doc_id")) == [(3,), (5,), (6,), (7,)]
    span = got.where("doc_id = 1").first()
    assert (span["score"], span["first_word"], span["end_word"]) == (1.0, 40, 70)
    assert decontaminate.without_leaks(edge, bench).columns == edge.columns
    assert decontaminate.find_leaks(no_rows, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(docs)


def test_leaks_of_one_edited_copy_in_many_documents(spark):
    """Its left n-grams are frequent, and the edits leave more than 16 of the item's n-grams without any document."""
    item = [f"i{k}" for k in range(40)]
    edited = " ".join("other" + w if k in (3, 9, 15, 21, 27, 33) else w for k, w in enumerate(item))
    docs = [(k, f"{edited} d{k}") for k in range(50)] + [(100 + k, f"{' '.join(item[22:])} d{k}") for k in range(50)]
    df = spark.createDataFrame([*docs, (200, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {**{k: 28 / 40 for k in range(50)}, **{100 + k: 18 / 40 for k in range(50)}}
    assert rows(decontaminate.without_leaks(df, bench).select("doc_id")) == [(200,)]


# ---- licenses ----


def test_licenses(spark, edge, no_rows):
    text = f"{'pad ' * 30}\nReleased under the MIT License.\n{'pad ' * 10}"
    df = spark.createDataFrame([(1, text), (1, text), (None, text.upper()), (2, None), (3, "")], "doc_id long, text string")
    assert rows(licenses.scan_licenses(df)) == [(1, "MIT", 1.0, 30, 35), (1, "MIT", 1.0, 30, 35), (None, "MIT", 1.0, 30, 35)]
    assert licenses.scan_licenses(edge).count() == 0 and licenses.scan_licenses(no_rows).count() == 0
    with pytest.raises(ValueError):
        licenses.build_index({"short": "two words"}, licenses.ScanSettings())


def test_repetition_column(edge, no_rows):
    got = repetition.with_repetition(edge.drop("repetition"))
    by = {(r["doc_id"], r["text"]): r["repetition"] for r in got.collect()}
    assert got.count() == len(EDGE_ROWS)
    for (_, text), r in by.items():
        assert r["n_words"] == len(split(text)) and r["base_failed"] and not r["kept"]
    assert by[8, "word " * 60_000]["n_repeat_words"] == 60_000
    assert repetition.with_repetition(no_rows).count() == 0


# ---- repeated strings ----


def brute_removed(docs, length):
    count, data = collections.Counter(), [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "anchor", "group"), [(20, 6, 4000), (21, 4, 2)])
def test_repeated_strings(spark, length, anchor, group):
    """The second case splits nearly all groups by longer anchors."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    base, line, docs = [text(60) for _ in range(6)], text(14), []
    for i in range(90):
        t = text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 50)
            t += rng.choice(base)[a : a + rng.randint(5, 40)] + text(rng.randint(0, 6)) + rng.choice(["", line])
        docs.append((i, t))
    docs += [(200, "ab" * 40), (201, None), (202, ""), (None, docs[3][1]), (203, docs[5][1]), (204, "\0" * 60), (4, docs[4][1]), (205, "aaaab" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = substrings.with_repeats(df, "repeats", substrings.RepeatSettings(length, anchor, 400, group))
    got = marked.select("doc_id", substrings.removal_digest(F.col("text"), F.col("repeats")).alias("d")).select("doc_id", "d.*")
    assert rows(got) == brute_removed(docs, length)


def test_without_repeats(spark, edge, no_rows):
    passage = "".join(random.Random(6).choices("abcdefgh é", k=300))
    docs = [(1, f"first {passage} end"), (2, passage), (3, f"{passage} third"), (4, None), (5, ""), (6, "short")]
    got = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), changed="cut")
    assert {r["doc_id"]: r["cut"] for r in got.collect()} == {1: True, 3: True, 4: False, 5: False, 6: False}
    assert got.where("doc_id = 6").first()["text"] == "short" and got.where("doc_id = 4").first()["text"] is None
    out = substrings.without_repeats(edge)
    assert out.columns == edge.columns
    # the two long texts repeat themselves and go as a whole
    assert {r["doc_id"] for r in out.collect()} == {1, 2, None, 3, 4, 5, 6, 7}
    assert substrings.without_repeats(no_rows).count() == 0


# ---- language model ----


def brute_scores(docs, share, discount=0.75):
    tokens = lambda t: [*split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), "</s>"]
    train = [tokens(t) for i, t in docs if not held(i, 5, 1)]
    count = collections.Counter(w for t in train for w in t)
    total, distinct = sum(count.values()), len(count)
    least = max(2, share * total)
    core = {w for w, n in count.items() if n >= least} | {"<s>", "</s>"}
    grams = {
        n: {g: c for g, c in collections.Counter(tuple(["<s>", *t][i : i + n]) for t in train for i in range(len(t) + 2 - n)).items() if c >= least and core >= set(g)}
        for n in (2, 3)
    }

    def prob(word, history):
        if not history:
            return (count[word] + 0.5) / (total + 0.5 * (distinct + 1))
        seen = {g: c for g, c in grams[len(history) + 1].items() if g[:-1] == history}
        if not seen:
            return prob(word, history[1:])
        uses = grams[2][history] if len(history) == 2 else len(train) if history == ("<s>",) else count[history[0]]
        rest = 1 - sum(c - discount for c in seen.values()) / uses
        return max(seen.get((*history, word), discount) - discount, 0) / uses + rest * prob(word, history[1:])

    out = []
    for i, text in docs:
        t = ["<s>", *tokens(text)]
        out.append((
            i, held(i, 5, 1), len(t) - 1, sum(count[w] > 0 for w in t[1:]), total,
            sum(math.log10(prob(w, ())) for w in t[1:]), sum(math.log10(prob(t[j], tuple(t[max(0, j - 2) : j]))) for j in range(1, len(t))),
        ))
    return sorted(out, key=lambda r: (str(r[0]), r[6]))


@pytest.mark.parametrize("share", [2e-6, 0.02])
def test_lm_scores(spark, share):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "the", "dog", "é", "xxxxx"]
    docs = [(i, " ".join(rng.choices(vocabulary[: rng.randint(1, 7)], k=rng.randint(0, 12)))) for i in range(60)]
    docs += [(None, "a b c"), (61, None), (62, ""), (3, "the dog the dog"), (3, "the dog the dog"), (63, "zzz qqq\tA")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_lm.score_texts(df, language.held_out(F.col("doc_id"), 5, 1), ngram_lm.LmSettings(share=share, chunk_bytes=100))
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (str(r[0]), r[6]))
    want = brute_scores(docs, share)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], abs=1e-9)


def test_lm_arcs_do_not_thin_out_with_size(spark):
    docs = [(k, "x " * 2_500_000 if k == 0 else "rare pair") for k in [k for k in range(20) if not held(k, 5, 1)][:4]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_lm.score_texts(df, language.held_out(F.col("doc_id"), 5, 1)).where("n_tokens = 3").collect()
    assert len(got) == 3 and all(r["score"] - r["base_score"] > 10 for r in got)


def test_lm_edges(edge, no_rows):
    out = language.held_out(F.col("doc_id"), 5, 1)
    assert ngram_lm.score_texts(edge, out).count() == len(EDGE_ROWS)
    assert ngram_lm.score_texts(no_rows, out).count() == 0
    untrained = ngram_lm.score_texts(edge, F.lit(True)).where("doc_id = 4").first()
    assert (untrained["n_tokens"], untrained["n_known"], untrained["train_tokens"], untrained["base_score"], untrained["score"]) == (1, 0, 0, 0.0, 0.0)


# ---- near-duplicates ----


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = rows(components(spark.createDataFrame(links, "u long, v long")))
    assert got == sorted([*[(i, 0) for i in range(41)], *[(i, 100) for i in range(100, 160)], (200, 200), (201, 200)], key=str)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    passage, docs = text(40), []
    for c in range(25):  # classes of copies with an edit every 25 words; half share a passage
        base = text(rng.randint(60, 200)) + (passage if c % 2 else [])
        for _ in range(rng.randint(1, 4)):
            docs.append((len(docs), " ".join(w if rng.random() > 0.04 else "edit" + w for w in base)))
    docs += [(500, docs[0][1]), (500, docs[0][1]), (None, docs[0][1].upper()), (501, None), (502, ""), (503, "--"), (504, "a b"), (505, "A, b."), (506, "a c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dups.near_duplicate_classes(df)
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for _, t in docs]
    group = list(range(len(docs)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = words[a], words[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and root(a) != root(b):
                near = 5 * (max(len(x), len(y)) - edit(x, y)) >= 4 * max(len(x), len(y))
                if near:
                    group[max(root(a), root(b))] = min(root(a), root(b))
    classes = collections.defaultdict(list)
    for k in range(len(docs)):
        classes[root(k)].append(docs[k][0])
    want = []
    for members in classes.values():
        ids = [i for i in members if i is not None]
        want += [(i, min(ids), len(members)) for i in members]
    assert rows(got.select("doc_id", "class_id", "class_rows")) == sorted(want, key=str)
    kept = near_dups.one_per_class(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(i for i in m if i is not None) for m in classes.values())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_duplicates_that_share_only_keys_of_many_texts(spark):
    """One key for each text, which most have from a passage of all; each pair has 20 words of its own."""
    passage, docs = [f"p{k}" for k in range(60)], []
    for k in range(40):
        own = [f"own{k}x{j}" for j in range(20)]
        docs += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join([*passage, *own[:-1], "edit"]))]
    s = near_dups.NearSettings(keys=1)
    (block,) = words.text_blocks(pa.array([t for _, t in docs], pa.string()))
    keys = near_dups.sketch(block, s)[3][:, 0].tolist()
    hot = [k for k in range(40) if keys[2 * k] == keys[2 * k + 1] and keys.count(keys[2 * k]) > s.few]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"), s).collect()}
    assert len(hot) > 10 and all(got[2 * k] == got[2 * k + 1] == 2 * k for k in hot)


def test_near_duplicate_edges(edge, no_rows):
    assert near_dups.near_duplicate_classes(edge).count() == len(EDGE_ROWS)
    kept = near_dups.one_per_class(edge)
    assert kept.columns == edge.columns
    # rows without a letter or digit all stay
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None, 3, 4, 5, 6, 7, 8, 9], key=str)
    assert near_dups.one_per_class(no_rows).count() == 0 and near_dups.near_duplicate_classes(no_rows).count() == 0


def test_large_group_of_near_texts_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]

    def edited(n, tag):
        out = list(base)
        for k in rng.sample(range(100), n):
            out[k] = f"{tag}x{k}"
        return " ".join(out)

    # two groups whose texts are alike within each and just not across: all pairs across share rare tokens
    texts = [edited(4, f"a{k}") for k in range(40)]
    base = [w if k % 8 else f"other{k}" for k, w in enumerate(base)]
    texts += [edited(4, f"b{k}") for k in range(40)]
    words = near_dups._word_lists([pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array(texts)], ["id", "text"])])
    lists = spark.createDataFrame([tuple(r.values()) for b in words for r in b.to_pylist()], "text_id long, words binary")
    left = spark.createDataFrame([(k, 100, k // 40) for k in range(80)], "text_id long, n_words long, class long")
    kept, stored = {}, near_dups.stored

    def noted(df, name):
        kept[name] = stored(df, name)
        return kept[name]

    monkeypatch.setattr(near_dups, "stored", noted)
    got = near_dups._rest(left, lists, near_dups.NearSettings()).collect()
    # one group lies in a few blocks; the other one's texts are far from the same head, and stay alone
    assert kept["near-held"].count() <= 50
    common = {(u, v): len(set(texts[u].split()) & set(texts[v].split())) for u in range(40) for v in range(40, 80)}
    assert {tuple(r) for r in got} == {p for p, n in common.items() if n >= 80}
