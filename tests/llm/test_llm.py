"""The operators of the training-data folder against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pairlab.llm import lm
from pairlab.llm.bpe import bpe_decode, bpe_encode, load_bpe
from pairlab.llm.components import connected_components
from pairlab.llm.importance import kth_largest, keep_sampled, resample
from pairlab.llm.langid import identify_languages, keep_identified
from pairlab.llm.metric_join import cosine_components
from pairlab.llm.packing import WordTokens, load_words, pack_documents, plan_packing
from pairlab.llm.quality_rules import apply_rules, measure
from pairlab.llm.sharding import assign_shards, number_slots, write_shards
from pairlab.llm.simhash import BKTree, keep_first_of_groups, shard_blocks, simhash_components
from pairlab.llm.token_rollup import TokenLedger, count_tokens, deletes, inserts, later_copies, revisions

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, ids int, label int, `a b` string"
WORDS = ["stone", "river", "The", "light", "of", "été", "mañana", "größe", "and", "1234", "don't", "x", "naïve", "blue.", "end"]


def odd_texts():
    random.seed(5)
    prose = [" ".join(random.choices(WORDS, k=random.randint(60, 150))) for _ in range(25)]
    return [
        None, "", " ", "\n\t ", "a", "a b", "a b c", "!!! ???", "  two  spaces \n\n line", "<|endoftext|> in <|startoftext|> text",
        "é́ ﬁ İΣς 中文 😀‍😀", "z" * 5000, "the same line\n" * 400, " ".join(WORDS * 3000), prose[0], prose[0], prose[1] + " tail", prose[1], *prose,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None, ""][i % 4], None if i % 7 == 0 else f"s{i % 2}", i, "k", 1, 2, "c") for i, t in enumerate(odd_texts())]
    rows += [rows[20], (None, "no key", "en", "s0", 1, "k", 1, 2, "c"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_bpe_matches_the_library(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for key, text in texts_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        want[key, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    got = collections.Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe_decode(bpe_encode(docs, BYTE), BYTE).collect())
    assert got == want
    assert bpe_encode(nothing, BYTE).count() == 0


def test_bpe_on_random_text():
    from tokenizers import Tokenizer

    random.seed(2)
    library, own = Tokenizer.from_file(BYTE), load_bpe(BYTE)
    letters = "ab \n\t'stre0123!?.,é中😀 　\x1c<|endoftext|>"
    for _ in range(1500):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert own.decode_packed(np.array([255], "<u4").tobytes()).decode() == library.decode([255], skip_special_tokens=False)


def test_word_tokens_match_the_library():
    from tokenizers import Tokenizer

    random.seed(4)
    library = Tokenizer.from_file(WORD)
    letters = "ab AÀ\n\t'stre0123!?.é中😀İΣς ́<|endoftext|>ﬁ࢏"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(1500)] + ["", "the The THE"]
    for text, coded in zip(texts, load_words(WORD)(texts)):
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_tokens_encode_new_words_together():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, words):
            self.words, self.given = words, []

        def encode_batch_fast(self, texts, **options):
            self.given += texts
            return self.words.encode_batch_fast(texts, **options)

    random.seed(14)
    library, tokens = Tokenizer.from_file(WORD), WordTokens(WORD, memo=300)
    tokens.words = Counted(tokens.words)
    made = ["".join(random.choices("abcdefgé", k=random.randint(5, 9))) for _ in range(1000)]
    texts = [" ".join(random.choice(made) + random.choice(["", "", ".", "!?", "'s", "7"]) for _ in range(n)) for n in (0, 1, 400, 400, 400)]
    for _ in range(3):  # the memo loses words between
        assert [np.frombuffer(c, "<u4").tolist() for c in tokens(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tokens.words.given) < 30
    tokens.words.given.clear()
    assert tokens([]) == [] and tokens(["", " \n"]) == [b"", b""] and not tokens.words.given
    tokens.is_last[:] = False  # without marked ends each word is encoded alone
    assert np.frombuffer(tokens(["new Words, x9"])[0], "<u4").tolist() == library.encode("new Words, x9", add_special_tokens=False).ids


def test_batches_are_cut_by_bytes():
    from pairlab.llm.packing import _by_bytes

    texts = [b"", b"abc", b"de", b"fghijklm", b"", b"n", b"o"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert [b.column("text").to_pylist() for b in _by_bytes([batch, batch.slice(3, 0)], 5)] == [texts[:3], texts[3:4], texts[4:]]


@pytest.mark.parametrize("capacity", [1, 2, 7, 30, 100])
def test_plan_places_every_piece_once(capacity):
    random.seed(capacity)
    for _ in range(60):
        counts = {random.randint(1, capacity): random.randint(0, 30) for _ in range(random.randint(0, 20))}
        placed, bins = collections.Counter(), collections.defaultdict(list)
        for s in plan_packing(counts, capacity):
            for k in range(s.count):
                placed[s.length, s.first + k] += 1
                bins[s.sequence + k // s.each].append((s.offset + k % s.each * s.length, s.length))
        assert placed == collections.Counter((n, i) for n, c in counts.items() for i in range(c))
        for members in bins.values():
            end = 0
            for offset, length in sorted(members):
                assert offset == end
                end += length
            assert end <= capacity and sum(3 * n > capacity for _, n in members) <= 2
    with pytest.raises(ValueError):
        plan_packing({0: 1}, 4)


def test_packing_whole_documents(docs, nothing):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(WORD), collections.Counter()
    for key, text in texts_of(docs):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 256)):
            want[key, piece, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())] += 1
    rows = pack_documents(docs, WORD, capacity=256).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:i]) for i in range(len(members))]
        assert sum(n for _, n in members) <= 256
    filled = sorted(sum(n for _, n in members) for members in bins.values())
    assert filled[0] + filled[1] > 256  # no two sequences would go into one
    assert pack_documents(nothing, WORD).count() == 0


def brute_components(ids, linked):
    reach = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(reach[a], reach[b])
            if reach[a] != low or reach[b] != low:
                reach[a] = reach[b] = low
                changed = True
    return reach


def test_connected_components(spark, rows):
    random.seed(8)
    for n, m in ((60, 40), (40, 80), (50, 0)):
        links = [(random.randrange(n), random.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 130)] if m else [])
        found = dict(rows(connected_components(spark.createDataFrame(links, "a bigint, b bigint"))))
        nodes = {x for a, b in links if a != b for x in (a, b)}
        want = brute_components({x for e in links for x in e}, links)
        assert found == {x: want[x] for x in nodes}


def test_cosine_components_match_all_pairs(spark, monkeypatch):
    from pairlab.llm import metric_join

    for name, value in (("CELL", 20), ("HELD", 16), ("STREAMED", 32), ("AT_ONCE", 8)):
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    near = np.concatenate([base, base[:20] + 0.2 * rng.normal(size=(20, 6)), np.tile(base[0], (25, 1)), base[5:15] * 3, rng.normal(size=(60, 6))])
    vectors = {i: v.astype(np.float32).tolist() for i, v in enumerate(near)}
    odd = {1000: None, 1001: [0.0] * 6, 1002: [float("nan")] * 6, 1003: [float("inf"), *[1.0] * 5], 1004: [None, *[1.0] * 5], 1005: [], 1006: [1.0, 2.0], 1007: [1.0, 2.0]}
    table = spark.createDataFrame([*vectors.items(), *odd.items(), (None, vectors[0])], "vec_id bigint, embedding array<float>").withColumn("node", F.lit("x"))
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9] + [(1006, 1007)]
    n, reach = collections.Counter(x for e in linked for x in e), brute_components([*vectors, *odd], linked)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine_components(table).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (n[i], reach[i], reach[i] == i) for i in [*vectors, *odd]}
    assert cosine_components(table.limit(0)).count() == 0


def test_sharding(spark, docs, nothing, tmp_path):
    numbered = number_slots(assign_shards(docs, weights=(1.0,) * 5), then=("text",)).collect()
    assert len(numbered) == docs.count() and set(numbered[0].asDict()) >= set(docs.columns)
    slots = collections.defaultdict(list)
    for r in numbered:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    five = dict(assign_shards(keys, weights=(1.0,) * 5).collect())
    six = dict(assign_shards(keys, weights=(1.0,) * 6).collect())
    assert all(six[k] in (five[k], 5) for k in five) and 500 < sum(s == 5 for s in six.values()) < 830
    heavy = collections.Counter(dict(assign_shards(keys, weights=(3.0, 1.0)).collect()).values())
    assert 2850 < heavy[0] < 3150
    with pytest.raises(ValueError):
        assign_shards(keys, weights=(1.0, 0.0))
    write_shards(assign_shards(keys, weights=(1.0,) * 3), str(tmp_path / "shards"))
    assert dict(spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "shard").collect()) == dict(assign_shards(keys, weights=(1.0,) * 3).collect())
    assert number_slots(assign_shards(nothing)).count() == 0


def plain_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(spark, docs, nothing):
    prints = [(k, plain_fingerprint(t)) for k, t in texts_of(docs) if k is not None]
    linked = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 3]
    reach = brute_components([k for k, _ in prints], linked)
    want = collections.Counter((k, f"{p:016x}", reach[k]) for k, p in prints)
    rows = simhash_components(docs).collect()
    assert collections.Counter(tuple(r) for r in rows if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert simhash_components(nothing).count() == 0
    kept = keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == collections.Counter({**{k: 1 for k, r in reach.items() if r == k}, None: 2})


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    random.seed(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(random.choices(letters, k=6)) for _ in range(80)) for _ in range(30)]
    rows = [(7, t, i) for i, t in enumerate(texts)] + [(7, texts[0], 50), (3, texts[1], 51), (9, texts[2], 52), (8, texts[0].upper(), 53), (None, texts[4], 54)]
    for parts in (1, 4):
        kept = keep_first_of_groups(spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(parts)).collect()
        assert sorted(r["n"] for r in kept) == [0, *range(2, 30), 51, 54]


def test_simhash_of_large_shards(spark, monkeypatch):
    from pairlab.llm import simhash

    monkeypatch.setattr(simhash, "TREE_SIZE", 10)
    random.seed(9)
    start, prints = random.getrandbits(64), set()
    for _ in range(90):
        value = start
        for bit in random.sample(range(64), random.randint(0, 6)):
            value ^= 1 << bit
        prints.add(value)
    prints = list(enumerate(prints)) + [(1000 + i, random.getrandbits(64)) for i in range(50)]
    table = spark.createDataFrame([(n, p - (1 << 64) if p >> 63 else p) for n, p in prints], "node bigint, fingerprint bigint")
    for radius in (1, 3):
        linked = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= radius]
        want = brute_components([n for n, _ in prints], linked)
        edges = [(r["a"], r["b"]) for r in simhash.fingerprint_links(table, radius).collect()]
        assert brute_components([n for n, _ in prints], edges) == want
    assert shard_blocks(10, 3) == 4 and shard_blocks(10**9, 3) > 4


def test_bk_tree_finds_all_within_the_radius():
    random.seed(1)
    tree, values = BKTree(), [random.getrandbits(12) for _ in range(300)]
    for v in values:
        tree.add(v)
    for v in values[:40]:
        assert sorted(tree.near(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]
    assert list(BKTree().near(1, 64)) == []


def test_quality_measures(docs, nothing):
    want = collections.Counter()
    for key, text in texts_of(docs):
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        want[key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)] += 1
    got = measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert apply_rules(docs).count() == docs.count() and apply_rules(nothing).count() == 0


def test_adaptive_fences_reject_outliers_of_their_group(spark):
    random.seed(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(random.choices(letters, k=n))
    rows = [(i, " ".join(word(5 if i % 2 else 12) for _ in range(80)), "en" if i % 2 else "de", f"s{i % 3}") for i in range(600)]
    rows += [(1000, " ".join(word(60) for _ in range(80)), "en", "s0"), (1001, " ".join(word(5) + "#*$" for _ in range(80)), "de", "new"), (1002, "few words", "en", "s1")]
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), least_docs=50).collect()}
    assert found[1000] == found[1001] == (False, False) and found[1002] == (True, False)
    assert all(found[i] == (False, True) for i in range(600))


def test_every_fence_decides_beyond_the_base_rules(spark):
    random.seed(7)
    word = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    plain = lambda n=5, size=100: " ".join(word(n) for _ in range(size))
    rows = [(i, plain(), "en", "even") for i in range(300)]
    rows += [(i, plain(3 + i % 9), "en", "wide") for i in range(300, 600)]
    line = plain(5, 6)
    odd = {
        "long": plain(9),
        "short": plain(2, 120),
        "symbols": " ".join(word(5) + ("#" if i % 5 == 0 else "") for i in range(100)),
        "lines": "\n".join("same line\n" + plain(5, 12) for _ in range(8)),
        "words": " ".join([line] * 6 + [plain(5, 60)]),
    }
    rows += [(1000 + i, text, "en", "even") for i, text in enumerate(odd.values())]
    rows += [(2000, odd["long"], "en", "wide")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: r for r in apply_rules(docs).collect()}
    for i, name in enumerate(odd):
        assert (found[1000 + i]["base_failed"], found[1000 + i]["kept"]) == (False, False), name
    assert found[2000]["kept"] and all(found[i]["kept"] for i in range(600))


def test_base_scores_and_filter(docs, nothing):
    trained = lm.not_held_out("doc_id")
    learn = collections.Counter()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()), None]
    fold = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 != 2
    for key, text in texts_of(docs):
        if fold(key):
            learn.update(tokens(text))
    n, v = sum(learn.values()), len(learn)
    want = collections.Counter()
    for key, text in texts_of(docs):
        words = tokens(text)
        base = sum(math.log10((learn[w] + 1) / (n + v + 1)) for w in words)
        want[key, not fold(key), len(words), sum(learn[w] > 0 for w in words), n, round(base, 6)] += 1
    for head in (lm.HEAD, 4):
        old, lm.HEAD = lm.HEAD, head
        rows = lm.score_texts(docs, trained).collect()
        lm.HEAD = old
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score_texts(nothing, trained).count() == 0
    assert {r["train_tokens"] for r in lm.score_texts(docs, F.lit(False)).collect()} == {0}


def test_filter_holds_every_count(docs):
    model, counts = lm.fit_model(docs, least_pair=1)
    for row in counts.collect():
        for keys, sums in ((row["words"], row["n_words"]), (row["pairs"], row["n_pairs"])):
            keys, sums = np.frombuffer(keys, "<u8"), np.frombuffer(sums, "<i8")
            assert (model.filter.level(keys) >= lm.levels_of(sums)).all()  # no false negative
    strange = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    assert (model.filter.level(strange) > 0).mean() < 0.1


def test_filter_leaves_nothing_out(docs):
    model, counts = lm.fit_model(docs)
    hasher, sums = lm.WordHasher(), [collections.Counter(), collections.Counter()]
    for _, text in texts_of(docs):
        words = lm.words_of(text.encode(), hasher)
        for n, keys in zip(sums, (words, lm.pairs_of(words))):
            n.update(keys.tolist())
    held = 0
    for n in sums:
        keys, tops = np.array(list(n), np.uint64), lm.levels_of(np.array(list(n.values())))
        assert (tops == 1).any() and (model.filter.level(keys) >= tops).all()
        held += int(tops.sum())
    assert sum(8 * len(r["bits"]) for r in counts.collect()) >= lm.BITS_PER_LEVEL * held


def test_scores_follow_the_quantised_counts(docs):
    texts = [lm.words_of(t.encode(), lm.WordHasher()) for _, t in texts_of(docs)]
    words, pairs = collections.Counter(), collections.Counter()
    for own in texts:
        words.update(own.tolist())
        pairs.update(lm.pairs_of(own).tolist())

    def read(counts):
        levels = {k: int(lm.levels_of(np.array([n]))[0]) for k, n in counts.items()}
        mean = {l: np.mean([n for k, n in counts.items() if levels[k] == l]) for l in set(levels.values())}
        return {k: mean[l] for k, l in levels.items()}

    w, p, n, v = read(words), read(pairs), sum(words.values()), len(words)
    want = []
    for own in texts:
        before = [int(lm.END), *own.tolist()[:-1]]
        together = [min(p[k], w[a], w[b]) for k, a, b in zip(lm.pairs_of(own).tolist(), before, own.tolist())]
        single = [(w[b] + 1) / (n + v + 1) for b in own.tolist()]
        want.append(sum(math.log10((c + lm.MU * s) / (w[a] + lm.MU)) for c, s, a in zip(together, single, before)))
    got = [r["score"] for r in lm.score_texts(docs, F.lit(True)).collect()]
    near = sum(abs(a - b) < 0.02 * abs(b) for a, b in zip(sorted(got), sorted(want)))
    assert len(got) == len(want) and near >= 0.9 * len(want)


def test_gumbel_top_k(spark, docs, nothing):
    random.seed(7)
    good = [" ".join(random.choices(WORDS[:9], k=80)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in random.choices(WORDS, k=80)) for _ in range(50)]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id bigint, text string, gumbel string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)], "doc_id bigint, quality int")
    found = {r["doc_id"]: r["kept"] for r in resample(table, labels).collect()}
    assert found == {i: i < 150 for i in range(200)}
    kept = keep_sampled(table, labels)
    assert kept.columns == table.columns and {r[0] for r in kept.select("doc_id").collect()} == set(range(150))
    assert resample(nothing, labels).count() == 0 and keep_sampled(nothing, labels).count() == 0
    assert keep_sampled(docs, labels.limit(0)).count() == docs.count()  # nothing to compare with


def test_length_does_not_decide(spark):
    random.seed(13)
    say = {"en": "the house and that thing with other ways".split(), "de": "der die und nicht klein zwischen haus weg".split()}
    clean = lambda l, n: " ".join(random.choices(say[l], k=n))
    rows = [(i, clean(("en", "de")[i % 2], 100)) for i in range(400)]
    rows += [(1000 + i, clean(("en", "de")[i % 2], n)) for i, n in enumerate((300, 300, 3000, 3000, 20_000, 20_000))]
    rows += [(2000 + i, " ".join("##%d@@" % random.randrange(99) for _ in range(20))) for i in range(40)]
    labels = [(i, 1) for i in range(400) if i % 2 == 0 or i % 20 < 18]  # German is covered a little less
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = {r["doc_id"]: (r["log_weight"], r["kept"]) for r in resample(table, labels).collect()}
    assert found[1005][0] < -15  # the plain sum would lose the long German document
    assert all(kept == (i < 2000) for i, (_, kept) in found.items())
    assert {r["doc_id"] for r in keep_sampled(table, labels).collect()} == {i for i, _ in rows if i < 2000}


def test_kth_largest(spark):
    random.seed(3)
    values = [random.choice([0.0, -1.5, random.gauss(0, 1e6), random.random()]) for _ in range(500)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 499, 500):
        assert kth_largest(table, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(table, "v", 501) is None and kth_largest(table, "v", 0) is None and kth_largest(table.limit(0), "v", 1) is None


def test_language_profiles(spark, docs, nothing):
    random.seed(2)
    say = {"en": "the house and that thing with other ways".split(), "de": "der die und nicht schön größer zwischen".split(), "fr": "le la être où naïf chaque toujours".split()}
    rows = [(i, " ".join(random.choices(say[l], k=30)), l) for i, l in enumerate(random.choices(list(say), k=120))]
    rows += [(500, None, "en"), (501, "123 !!", "en"), (502, "", None), (503, "the house and other things", None)]
    found = {r["doc_id"]: r for r in identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(found[i]["lang_pred"] == l for i, _, l in rows[:120])
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (500, 501, 502)) and found[503]["lang_pred"] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert identify_languages(docs).count() == docs.count() and identify_languages(nothing).count() == 0
    kept = keep_identified(docs.withColumn("__language", F.lit(1)))
    assert kept.columns == [*docs.columns, "__language"] and kept.filter(F.col("text").isNull() | (F.col("text") == "!!! ???")).count() == 0


def test_rollups_follow_signed_batches(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    counted = count_tokens(docs, WORD, "v1").cache()
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    want = collections.Counter()
    for _, text, source, lang in rows:
        want[source, lang] += count(text)
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    total = lambda: {(r["source"], r["lang"]): r["n_tokens"] for r in ledger.totals(["in", "out", "fix"]).collect() if r["n_tokens"]}
    assert ledger.commit("in", inserts(counted)) and not ledger.commit("in", inserts(counted))
    assert total() == {k: v for k, v in want.items() if v}
    first = {}
    for key, text, *_ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    copies = later_copies(counted)
    assert sorted(r["doc_id"] for r in copies.collect()) == sorted(k for k, t, *_ in rows if k is not None and k > first[t or ""])
    assert ledger.commit("out", deletes(counted)) and total() == {} and ledger.totals(["in", "out"]).count() == 0
    assert ledger.commit("fix", revisions(counted.withColumn("new", F.col("n_tokens") * 2), "n_tokens", "new"))
    assert total() == {k: v for k, v in want.items() if v}
    (tmp_path / "ledger/batch=fix/_SUCCESS").unlink()
    assert total() == {} and ledger.commit("fix", inserts(counted))  # an unmarked batch is replaced
    assert total() == {k: v for k, v in want.items() if v}
    assert ledger.commit("none", inserts(count_tokens(nothing, WORD, "v1"))) and ledger.totals([]).count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", inserts(counted))


def test_queries_and_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pairlab.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    one = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, where).collect()}
    for key, text in texts_of(docs)[:20]:
        assert one[key]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    here = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, here, where)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert out.columns == docs.columns and 0 < out.count() <= here.count()
        here, before = out, here
    assert {r[0] for r in here.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, where).count() == here.count()
