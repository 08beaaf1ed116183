"""M-tree search, Merkle manifests and phrase mining against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import mtree, phrases
from pairlab.llm.merkle import as_hex, digest, encode_fields, fold_path, merkle_manifest, proof_digest
from pairlab.llm.mtree import MTree, Unit, integer_vector, sortable, top_inner_products
from pairlab.llm.phrases import mine_phrases

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, idx int, tree string, w1 string, `a b` string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def odd_rows():
    random.seed(11)
    words = ["Stone", "river", "light", "été", "x", "don't", "größe", "and"]
    texts = [None, "", "\n\t ", "a", "The end. The end; the END", "z" * 3000, " ".join(words * 500), "one two three " * 300]
    texts += [" ".join(random.choices(words, k=random.randint(5, 80))).replace("x ", "x, ") for _ in range(50)]
    rows = [(i, t, ["en", None, "de", "", "und"][i % 5], "s", None if i % 6 == 0 else i, 1, "t", "w", "c") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, "no key", "en", "s", 1, 1, "t", "w", "c"), (9, "same key", "en", "s", 1, 1, "t", "w", "c"), (None,) * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, plus=0) -> str:
    values = {**row, "n_chars": None if row["n_chars"] is None else row["n_chars"] + plus}
    return sha("".join("-" if values[c] is None else f"{len(str(values[c]).encode())}:{values[c]}" for c in COLUMNS))


def fold_up(nodes, arity):
    """Root of some digests, and the siblings of every place by level as (left ones, right ones)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for leaf, i in enumerate(at):
            run, slot = runs[i // arity], i % arity
            paths[leaf].append((run[:slot], run[slot + 1 :]))
            at[leaf] = i // arity
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_matches_a_tree_in_memory(docs, arity):
    groups = collections.defaultdict(list)
    for row in (r.asDict() for r in docs.collect()):
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: fold_up([leaf for *_, leaf in sorted(groups[g])], arity) for g in order}
    root, upper = fold_up([low[g][0] for g in order], arity)
    want = []
    for g, above in zip(order, upper):
        for (known, key, leaf), path in zip(sorted(groups[g]), low[g][1]):
            siblings = "".join("".join([*left, *right]) for left, right in path + above)
            want.append((key if known else None, leaf, low[g][0], root, sha(siblings)))
    got = merkle_manifest(docs, COLUMNS, arity=arity, keep={"lang": F.col("lang")})
    got = got.withColumn("folded", fold_path(F.col("leaf"), F.col("path")))
    rows = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), "folded").collect()
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    assert {r["folded"] for r in rows} == {root}


def test_manifest_tells_a_changed_row(docs, nothing):
    changed = digest(encode_fields(COLUMNS, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}))
    got = merkle_manifest(docs, COLUMNS, keep={"n_chars": F.col("n_chars"), "changed": changed})
    rows = got.select("n_chars", (fold_path(as_hex(F.col("changed")), F.col("path")) == F.col("root")).alias("same")).collect()
    assert all(r["same"] == (r["n_chars"] is None) for r in rows)
    assert merkle_manifest(nothing, COLUMNS).collect() == []
    one = docs.filter("doc_id = 3")
    row = merkle_manifest(one, COLUMNS).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == []
    with pytest.raises(ValueError):
        merkle_manifest(docs, COLUMNS, arity=1)


def products(rows, every, k, scale=1024):
    """All products by Python's integers."""
    good = {}
    for key, vector in rows:
        if key is not None and vector and all(x is not None and np.isfinite(x) for x in vector):
            good[(key, tuple(vector))] = [int(np.floor(x * scale)) for x in vector]
    out = collections.Counter()
    for (key, _), q in good.items():
        if key % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), other) for (other, _), v in good.items() if other != key and len(v) == len(q))
        for rank, (score, other) in enumerate(scores[:k], 1):
            out[key, rank, other, max(-(2**63), min(2**63 - 1, -score))] += 1
    return out


def test_top_products_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL", 40)
    monkeypatch.setattr(mtree, "UNIT", 25)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = [(centres[i % 6] + rng.normal(size=8) * 0.2).astype(float).tolist() for i in range(300)]
    vectors[:40] = [vectors[0]] * 40  # copies
    vectors[50:60] = [[0.0] * 8, [-1.0] * 8, None, [], [None] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0, 3.0], [2.0, 2.0, 3.0], [1e30] * 8]
    vectors[60] = [-1e30] * 8
    rows = list(enumerate(vectors)) + [(10, vectors[100]), (5, vectors[0]), (5, vectors[0]), (None, vectors[1])]
    schema = "vec_id bigint, embedding array<double>, query_id int, score string, cell int"
    df = spark.createDataFrame([(a, b, 1, "s", 2) for a, b in rows], schema).repartition(3)
    got = collections.Counter(tuple(r) for r in top_inner_products(df, every=10, k=7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == products(rows, 10, 7)
    assert top_inner_products(df.limit(0)).collect() == []
    assert top_inner_products(df.filter("vec_id = 100"), every=10).collect() == []
    few = top_inner_products(df.filter("vec_id in (100, 101, 102)"), every=100).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_a_tree_avoids_computations_and_loses_none():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 3
    flat = np.concatenate([c + rng.normal(size=(100, 16)) * 0.05 for c in centres])
    whole = np.stack([integer_vector(v, 1024.0) for v in flat])
    norms = float(np.sqrt((whole.astype(float) ** 2).sum(axis=1).max())) + 1
    unit = Unit(whole, np.arange(len(whole)), norms)
    seen = []
    far = MTree._far
    MTree._far = lambda self, point, places: seen.append(len(places)) or far(self, point, places)
    try:
        for q in range(0, 4000, 250):
            want = sorted(((int(s), -i) for i, s in enumerate(whole @ whole[q]) if i != q), reverse=True)[:10]
            assert sorted(((s, -i) for s, i in unit.best(whole[q], q, 10, np.inf)), reverse=True) == want
    finally:
        MTree._far = far
    assert sum(seen) < 16 * 400
    for page, centre in zip(unit.tree.pages, unit.tree.routing):
        members = page.entries if page.leaf else np.array([unit.tree.routing[c] for c in page.entries])
        assert page.parent == pytest.approx(unit.tree._far(unit.tree.points[centre], members))


def test_scores_of_any_size_sort_as_texts():
    numbers = [0, 1, 9, 10, 99, 10**30, -1, -9, -10, -(10**30), 2**63, -(2**63) - 1]
    assert sorted(numbers) == sorted(numbers, key=sortable)


def brute_phrases(rows, least, share, best):
    one, two, three = (collections.Counter() for _ in range(3))
    for text, lang in rows:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n, counts in ((1, one), (2, two), (3, three)):
                counts.update((lang or "und" if lang is None else lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    total, found = collections.Counter(), []
    for (lang, _), n in one.items():
        total[lang] += n
    for counts in (two, three):
        for (lang, *words), a in counts.items():
            if a < least:
                continue
            longer = [f for x, f in three.items() if x[0] == lang and f >= least and len(words) == 2 and tuple(words) in (x[1:3], x[2:4])]
            if any(100 * f >= share * a for f in longer):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = (one if k == 1 else two)[lang, *words[:k]], (one if len(words) - k == 1 else two)[lang, *words[k:]]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((lang, score, a, " ".join(words), left, right))
    out = []
    for lang in {f[0] for f in found}:
        own = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[1], -f[2], f[3].encode()))
        out += [(lang, i, p, a, left, right, total[lang], s) for i, (_, s, a, p, left, right) in enumerate(own[:best], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,share,best", [(10, 50, 2000), (2, 50, 5), (3, 90, 12), (1, 30, 40)])
def test_phrases_match_brute_force(docs, least, share, best):
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in mine_phrases(docs, least=least, share=share, best=best).collect())
    assert got == brute_phrases(rows, least, share, best)


def test_later_waves_open_what_the_first_leaves(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FIRST_WAVE", 1)
    monkeypatch.setattr(phrases, "WIDER", 2)
    rng = random.Random(4)
    lines = [" ".join(rng.choices("abcdefgh", k=30)) for _ in range(60)]
    lines += [f"{a} {b} {c}" for a, b, c in (("new", "york", "city"), ("old", "grey", "wolf"), ("mad", "red", "fox")) for _ in range(20)]
    df = spark.createDataFrame([(t, "en") for t in lines], "text string, lang string")
    for best in (1, 3, 8, 60):
        got = sorted(tuple(r) for r in mine_phrases(df, least=3, best=best).collect())
        assert got == brute_phrases([(t, "en") for t in lines], 3, 50, best)


def test_phrases_of_an_empty_table(nothing):
    assert mine_phrases(nothing).collect() == []


def test_long_texts_lose_no_phrase_between_segments(monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 7)
    rng = random.Random(2)
    text = " ".join(rng.choices(["a", "bb", "ccc", "d.", "e"], k=400)).encode()
    lists = list(phrases._segments(text))
    assert len(lists) > 20
    words = [w for x in lists for w in x]
    assert words == text.replace(b".", b" . ").split()
    mark, ids = np.uint64(0), {w: np.uint64(i + 1) for i, w in enumerate(sorted({*words} - {b"."}))} | {b".": np.uint64(0)}
    coded = [np.array([ids[w] for w in x], np.uint64) for x in lists]
    whole = np.concatenate(coded)
    for size in (2, 3):
        want = collections.Counter(tuple(whole[i : i + size]) for i in range(len(whole) - size + 1) if (whole[i : i + size] != mark).all())
        buffer, got = phrases._Buffer(), collections.Counter()
        for i, part in enumerate(coded):
            buffer.parts.append(part)
            if i % 3 == 0 or i == len(coded) - 1:
                grams, counts = phrases._count(phrases._grams(*buffer.take(size), size, mark))
                for gram, n in zip(grams, counts):
                    got[tuple(gram)] += int(n)
        assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**15 - 1, 10**15, 10**15), (3 * 10**11, 7 * 10**11, 10**12 - 1), (10, 10, 10), (11, 10**15, 999_999_999_999_999)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases._parts_of(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * r) for a, left, r in cases]
