"""Keys of any type, repeated keys in the rollups, and rank-order distances against plain Python."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pairlab.llm.langid import PROFILE, identify_languages
from pairlab.llm.metric_join import cosine_components
from pairlab.llm.queries import QUERIES
from pairlab.llm.simhash import keep_first_of_groups, simhash_components

WORD = public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,2)"])
def test_simhash_with_keys_of_any_type(spark, kind):
    random.seed(3)
    texts = [" ".join(random.choices("stone river light blue 7 of and".split(), k=60)) for _ in range(12)]
    texts = [*texts, *texts[:5], texts[0], None, ""]
    rows = [(i + 1 if i != 3 else None, t) for i, t in enumerate(texts)]
    numbered = spark.createDataFrame(rows, "n bigint, text string")
    as_kind = {"string": "lpad(n, 3, '0')", "date": "date_add(date'2020-01-01', cast(n AS INT))"}.get(kind, f"cast(n AS {kind})")
    keyed = numbered.selectExpr(f"{as_kind} AS doc_id", "text", "n").repartition(3)
    name = {r["n"]: r["doc_id"] for r in keyed.collect()}
    want = simhash_components(numbered.withColumnRenamed("n", "doc_id")).collect()
    found = simhash_components(keyed)
    assert found.schema["doc_id"].dataType == keyed.schema["doc_id"].dataType == found.schema["component_id"].dataType
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(
        ((name[r[0]], r[1], name[r[2]] if r[2] is not None else None) for r in want), key=order
    )
    kept = {r["n"] for r in keep_first_of_groups(keyed).collect()}
    assert kept == {r["n"] for r in keep_first_of_groups(numbered.withColumn("doc_id", numbered["n"])).collect()}
    assert simhash_components(keyed.limit(0)).count() == 0


def test_cosine_with_text_keys(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 6))
    rows = [(i, (base[i % 8] + rng.normal(size=6) * 0.05).tolist()) for i in range(30)] + [(30, None), (31, [0.0] * 6), (None, base[0].tolist())]
    numbered = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    keyed = numbered.selectExpr("'v' || lpad(vec_id, 4, '0') AS vec_id", "embedding")
    label = lambda n: None if n is None else f"v{n:04d}"
    want = [(label(r[0]), r[1], label(r[2]), r[3]) for r in cosine_components(numbered).collect()]
    assert sorted(map(tuple, cosine_components(keyed).collect()), key=str) == sorted(want, key=str)


def test_rollup_query_with_repeated_keys(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [(3, "s", "en", 1, "a second text"), (5, "s", "en", 1, "the first text"), (5, "s", "en", 1, "a second text")]
    rows += [(5, "s", "en", 1, "a second text"), (6, None, None, 1, None), (7, "t", "de", 1, ""), (None, "s", "en", 1, "a second text")]
    rows += [(9, "t", "de", 1, "word " * 3000), (8, "t", "de", 1, "word " * 3000)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for key, *_, text in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    want = collections.defaultdict(lambda: [0, 0])
    for key, source, lang, _, text in rows:
        if key is None or key <= first[text or ""]:
            want[source, lang][0] += 1
            want[source, lang][1] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    found = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()}
    assert found == dict(want) and found["s", "en"][0] == 3


def _plain_grams(text):
    """Counts of the 1- to 3-grams of a text's words; a gram's code packs its code points."""
    words, word = [], ""
    for c in [*(text or ""), " "]:
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    counts = collections.Counter()
    for word in words:
        padded = f" {word} "
        counts.update(word)
        counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return counts


def _in_order(counts):
    code = lambda gram: sum(ord(c) << 21 * i for i, c in enumerate(reversed(gram)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:PROFILE]


def test_rank_order_distances_match_plain_python(spark):
    random.seed(8)
    say = {
        "en": "the house and that thing with other ways Stone don't".split(),
        "de": "der die und nicht schön größer zwischen Übung".split(),
        "fr": "le la être où naïf chaque toujours".split(),
    }
    rows = []
    for i in range(150):
        lang = random.choice(list(say))
        other = random.choice(list(say))
        rows.append((i, " ".join(random.choices(say[lang] + say[other][:3], k=random.randint(1, 40))), lang))
    rows += [(200, "İstanbul ß x 12 3-4 !", "en"), (201, None, "fr"), (202, "123", None), (203, "the la der", None), (None, "und und", "fr")]
    totals = collections.defaultdict(collections.Counter)
    out = {i: zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else True for i, *_ in rows}
    for i, text, lang in rows:
        if lang is not None and not out[i]:
            totals[lang].update(_plain_grams(text))
    profiles = {lang: {g: n for n, g in enumerate(_in_order(totals[lang]))} for lang in sorted(totals)}

    def predict(text):
        own = _in_order(_plain_grams(text))
        if not own:
            return "und", 0.0
        far = {l: sum(abs(p[g] - n) if g in p else PROFILE for n, g in enumerate(own)) for l, p in profiles.items()}
        best = min(far, key=lambda l: (far[l], l))
        return best, 1.0 - far[best] / (PROFILE * len(own))

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    found = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in identify_languages(docs).collect()}
    assert found == {i: (out[i], *predict(text)) for i, text, _ in rows}
