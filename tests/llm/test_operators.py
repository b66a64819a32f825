"""Corpus operators against plain versions of the same rules, and on odd rows."""

import collections
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lexline.llm import (
    bpe,
    decontaminate,
    language,
    licenses,
    neardup,
    ngram_lm,
    packing,
    quality,
    sharding,
    toxicity,
    unigram,
)
from lexline.llm.components import components
from lexline.llm.registry import tokenizer_file
from tests_llm_rules import brute_components, brute_counts, brute_spans, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
rng = random.Random(11)


def prose(n, letters="abcdefgh", seed=None):
    r = random.Random(seed) if seed is not None else rng
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(n))


LONG = prose(6_000, seed=1)
BASE = prose(80, seed=2)


def odd_rows():
    words = BASE.split()
    rows = [
        (1, BASE),
        (2, BASE.upper()),
        (3, " ".join(words[:-3])),
        (4, " ".join([*words[:40], "new", *words[40:]])),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one two three"),
        (9, "One  two\nthree"),
        (10, LONG),
        (11, LONG + " end"),
        (12, "Ünï cödé 日本 🙂 text"),
        (13, "12 34 !! --"),
        (14, "a a a a a a a a a a a a a a a a a a a a a a a a"),
        (None, "null key row with some words"),
        (15, "repeated row here"),
        (15, "repeated row here"),
    ]
    return [(k, t, "en" if (k or 0) % 2 else None, "s", len(t or "")) for k, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Near-duplicates


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(leader_rounds=0, block=7)])
def test_near_duplicates_equal_brute_force(spark, settings):
    r, docs = random.Random(5), {}
    for base in range(6):
        words = prose(r.choice([3, 6, 20, 60, 150]), seed=base).split()
        for _ in range(12):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                own[r.randrange(len(own))] = prose(1)
            docs[len(docs) * 3 + 1] = " ".join(own)
    df = spark.createDataFrame([(k, t) for k, t in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, settings=settings).collect()}
    assert got == brute_components(docs)


def test_near_duplicates_odd_rows(odd, none):
    found = neardup.near_duplicates(odd)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert found.count() == odd.count()
    assert got[2] == got[3] == got[4] == {(1, False)} and got[1] == {(1, True)}
    assert got[5] == {(5, True)} and got[6] == {(6, True)} and got[7] == {(7, True)}
    assert got[8] == {(8, True)} and got[9] == {(8, False)} and got[11] == {(10, False)}
    assert got[15] == {(15, True)} and got[None] == {(None, True)}
    assert neardup.near_duplicates(none).count() == 0


def test_registers_estimate_similarity():
    s, probes = neardup.Settings(), neardup._probes(neardup.Settings())
    r = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        whole = r.integers(0, 1 << 63, 1_200, dtype=np.uint64)
        a, b = np.unique(whole[:1_000]), np.unique(whole[200:])
        rows = neardup.densify(np.array([neardup.registers(x, s) for x in (a, b)]), probes)
        n = np.array([1_000.0])
        errors.append(neardup.estimate(rows[:1], rows[1:], n, n, s)[0] - 800 / 1_200)
    assert abs(np.mean(errors)) < 0.02


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 20)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    assert got == {i: 1 for i in range(1, 21)} | {k: 100 for k in range(100, 130)}


# Sharding


def test_shards_are_whole_exact_and_gapless(spark, odd, none):
    df = spark.range(1_003).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(9).alias("Slot"))
    got = rows_of(sharding.shuffle_into_shards(df, shards=5, blocks=16, parts=4), "doc_id", "shard", "slot")
    assert sorted(g[0] for g in got) == list(range(1_003))
    sizes = collections.Counter(g[1] for g in got)
    assert sorted(sizes.values()) == [200, 200, 201, 201, 201]
    assert all(sorted(g[2] for g in got if g[1] == s) == list(range(n)) for s, n in sizes.items())
    again = rows_of(sharding.shuffle_into_shards(df, shards=5, blocks=16, parts=4), "doc_id", "shard", "slot")
    assert sorted(got) == sorted(again)
    assert sharding.shuffle_into_shards(odd, shards=3, blocks=4, parts=2).count() == odd.count()
    assert sharding.shuffle_into_shards(none, shards=3, blocks=4, parts=2).count() == 0


def test_rows_that_share_a_key_are_dealt_like_others(spark):
    df = spark.range(960).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = rows_of(sharding.shuffle_into_shards(df, shards=4, blocks=16, parts=4), "text", "shard", "slot")
    assert len({g[0] for g in got}) == 960
    assert sorted(g[1:] for g in got) == [(s, n) for s in range(4) for n in range(240)]


def test_matrix_has_its_sums(spark):
    rows, columns = [5, 0, 17, 100, 3, 40, 1, 34], [50, 0, 30, 120]
    got = sorted(rows_of(sharding.communication_matrix(spark, rows, columns, 1), "block", "counts"))
    assert [b for b, _ in got] == list(range(8))
    assert [sum(c) for _, c in got] == rows
    assert [sum(c) for c in zip(*[c for _, c in got], strict=True)] == columns


def test_hypergeometric_follows_its_law(spark):
    n, (total, marked, drawn) = 20_000, (50, 20, 10)
    longs = [F.lit(x).cast("long") for x in (total, marked, drawn)]
    u = (F.col("id") + 0.5) / n
    got = dict(rows_of(spark.range(n).groupBy(sharding.hypergeometric(*longs, u).alias("k")).count(), "k", "count"))
    for k in range(11):
        chance = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert abs(got.get(k, 0) - n * chance) <= 2


# Language


def test_language_held_out_and_odd_rows(spark, odd, none):
    kinds = {"xx": "abcd", "yy": "efgh", "zz": "ijkl"}
    rows = [(i, prose(30, kinds[k], seed=i), k) for i, k in enumerate(list(kinds) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 4 <> 2"), language.Settings(per_language=30, landmarks=5))
    got = language.predict(docs.where("doc_id % 4 = 2"), model).collect()
    assert len(got) == 45 and all(r["lang"] == r["lang_pred"] for r in got)
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    odd_got = language.predict(odd.withColumn("Lang_Pred", F.lit(1)), model)
    by = {r["doc_id"]: r for r in odd_got.collect()}
    assert odd_got.count() == odd.count()
    assert all(by[k]["lang_pred"] == "und" and by[k]["lang_score"] == 0 for k in (5, 6, 7, 13))
    assert by[12]["lang_pred"] in kinds and by[10]["lang_pred"] in kinds
    assert language.fit(none) is None
    assert {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


def test_language_of_long_texts_only_is_learned(spark):
    settings = language.Settings(per_language=30, landmarks=5, train_chars=300)
    kinds = {"xx": ("abcd", 300), "yy": ("efgh", 30)}
    rows = [(i, prose(kinds[k][1], kinds[k][0], seed=i), k) for i, k in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, k in rows if k == "xx") > 300
    got = language.sample(docs, settings).collect()
    assert {len(r["text"]) for r in got if r["lang"] == "xx"} == {300}
    assert all(any(r["text"] in t for _, t, k in rows if k == r["lang"]) for r in got)
    assert any(r["text"] not in {t[:300] for _, t, _ in rows} for r in got if r["lang"] == "xx")
    model = language.fit(docs.where("doc_id % 4 <> 2"), settings)
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(docs, model).collect())


# Decontamination


def test_automaton_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        letters = r.choice(["ab", "abc", "abcdefgh"])
        items = [(i, " ".join(r.choice(letters) for _ in range(r.randint(0, 25)))) for i in range(r.randint(0, 8))]
        machine = decontaminate.SuffixAutomaton([(str(k), decontaminate.words(t)) for k, t in items], 10)
        for _ in range(5):
            text = " ".join(r.choice(letters + "x") for _ in range(r.randint(0, 60)))
            text += " " + (r.choice(items)[1] if items else "")
            spans, names, _ = machine.scan(decontaminate.words(text))
            assert (len(decontaminate.words(text)), sum(b - a for a, b in spans), sorted(names)) == brute_spans(text, items)


@pytest.mark.parametrize("max_words", [250_000, 30])
def test_spans_found_and_removed(spark, odd, none, max_words):
    items = [(1, prose(30, seed=8)), (2, "Two-word item"), (2, "Two-word item"), (3, ""), (4, None), (5, prose(12, seed=9)), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"Before, {items[0][1]}. After the passage there are more words, twenty or so, to keep the rest of it whole "
             "and long enough that less than half of the words of this text are hit by what the item has.",
             "A two word ITEM.", items[5][1], "nothing at all", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Items", F.lit(0))
    found = decontaminate.find_spans(docs, bench, max_words=max_words)
    known = [i for i in items if i[0] is not None]
    for r in found.collect():
        hit = sum(s["to"] - s["from"] for s in r["spans"])
        assert (r["n_words"], hit, r["items"]) == brute_spans(r["text"], known)
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(found).collect()}
    at_once = decontaminate.remove_passages(docs, bench, max_words=max_words).collect()
    assert {r["doc_id"]: r["text"] for r in at_once} == left
    assert left[0].startswith("Before, . After") and left[3] == "nothing at all" and left[4] is None and left[5] == ""
    assert 2 not in left and 1 not in left
    assert decontaminate.find_spans(none, bench).count() == 0
    whole = decontaminate.find_spans(odd, bench.limit(0))
    assert whole.count() == odd.count() and whole.where(F.size("spans") > 0).count() == 0


@pytest.mark.parametrize("max_words", [250_000, 8])
def test_whole_short_items_are_cut(spark, max_words):
    items = [(1, "How far is the moon, exactly?"), (2, prose(30, seed=8)), (3, "lone")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    before, after = prose(40, "ABCDE", seed=6), prose(40, "ABCDE", seed=7)
    texts = [f"{before} how far IS the moon exactly; {after}", f"{before} how far is the moon {after}", f"{before} (lone) {after}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.find_spans(docs, bench, max_words=max_words)
    left = dict(rows_of(decontaminate.remove_spans(found), "doc_id", "text"))
    assert left == {0: f"{before} ; {after}", 1: texts[1], 2: f"{before} () {after}"}
    assert decontaminate.find_spans(decontaminate.remove_spans(found), bench).where(F.size("spans") > 0).count() == 0


# Toxicity


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_matcher_equals_distances():
    r = random.Random(4)
    for _ in range(40):
        terms = ["".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(6)]
        machine = toxicity.Matcher(terms, [], fuzzy_from=4)
        for _ in range(80):
            word = "".join(r.choice("abcd") for _ in range(r.randint(1, 7)))
            want = 0
            if any(edits(word, t) <= 1 for t in terms if len(t) >= 4):
                want = toxicity.FUZZY
            if word in terms:
                want = toxicity.EXACT
            assert machine.kind(word) == want, (terms, word)


def test_toxicity_learns_terms_misspellings_and_quotation(spark, odd, none):
    r, rows, labels = random.Random(6), [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = prose(40, seed=i).split()
        if toxic:
            words.insert(r.randrange(40), r.choice(["wretch", "scoundrel", "vilpox", "vilgat", "vilmen", "viltor"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, marks.where("doc_id % 5 <> 0 or doc_id is null"))
    assert {"wretch", "scoundrel"} <= set(lexicon.terms)
    got = toxicity.score(docs.where("doc_id % 5 = 0"), lexicon).collect()
    assert all((x["toxicity"] >= 0.5) == (x["doc_id"] % 3 == 0) for x in got)
    assert lexicon.counts("you wrecth and scoundrell") == (0, 0, 2, 0)
    assert lexicon.counts('he wrote "wretch" here, she said wretch') == (0, 0, 0, 2)
    assert lexicon.score("a plain text") < 0.5 and lexicon.score(None) == lexicon.score("")
    assert toxicity.score(odd.withColumn("Toxicity", F.lit("x")), lexicon).count() == odd.count()
    assert toxicity.score(none, lexicon).count() == 0
    blank = toxicity.fit(docs, marks.limit(0))
    assert {x["toxicity"] for x in toxicity.score(odd, blank).collect()} == {0.5}


# Licenses


def test_licenses_found_whole_in_part_and_not(spark, odd, none):
    apache = licenses.TEMPLATES[1][1]
    words = apache.split()
    texts = {
        1: f"{prose(50)}\nReleased under the MIT License.\n{prose(30)}",
        2: f"{prose(700)} {apache} {prose(9)}",
        3: f"{prose(20)} {' '.join(words[3:])} {prose(20)}",
        4: f"{prose(20)} {' '.join(words[:12])} {prose(20)}",
        5: "Released under the MIT Licence.",
        6: "This work is LICENSED under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("LICENSES", F.lit(1))
    got = {r["doc_id"]: {x["license"]: x["containment"] for x in r["licenses"]} for r in licenses.find_licenses(docs).collect()}
    assert got[1] == {"mit": 1.0} and got[2] == {"apache-2.0": 1.0}
    assert 0.75 <= got[3]["apache-2.0"] < 1 and got[5] == {} and got[4].get("apache-2.0", 1.0) == 1.0
    assert got[6] == {"gpl-3.0": 1.0, "cc-by-nc-4.0": 1.0}
    found = licenses.find_licenses(odd)
    assert found.count() == odd.count() and found.where(F.size("licenses") > 0).count() == 0
    assert licenses.find_licenses(none).count() == 0
    assert licenses.find_licenses(odd, (("empty", ""),)).where(F.size("licenses") > 0).count() == 0


def test_licenses_of_a_family_are_told_apart(spark):
    gnu = {name: licenses._gnu_notices(*of) for name, *of in licenses._GNU}
    texts = [(name, t) for name, ts in gnu.items() for t in ts]
    texts += [(name, f"{ts[-1]}; if not, write to the Free Software Foundation, Inc.") for name, ts in gnu.items()]
    texts += licenses._whole_texts()
    texts += [(name, t) for name, t in licenses.NOTICES if name != "bsd"]
    texts += [
        ("gpl-2.0,gpl-3.0", f"{gnu['gpl-3.0'][2]} {gnu['gpl-2.0'][2]}"),
        ("lgpl-2.1", " ".join(gnu["lgpl-2.1"][2].split()[3:-3])),
        ("bsd", f"{licenses._BSD}:"),
        ("", "This work is licensed under the GNU General Public License, version 9."),
        ("", "This work is licensed under a Creative Commons License."),
    ]
    rows = [(i, f"{prose(30)}\n{t}\n{prose(20)}") for i, (_, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = licenses.find_licenses(docs)
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: ",".join(x["license"] for x in r["licenses"]) for r in found.collect()}
    assert [(i, got[i]) for i in range(len(texts))] == [(i, name) for i, (name, _) in enumerate(texts)]


# Token counts


@pytest.mark.parametrize("seed", range(3))
def test_unigram_counts_equal_the_tokenizer(seed):
    r = random.Random(seed)
    pieces = {"".join(r.choice("ab▁c") for _ in range(r.randint(1, 4))) for _ in range(40)}
    pieces = [p for p in pieces if "▁" not in p[1:]]
    vocabulary = [("<unk>", 0.0), *[(p, -float(r.randint(1, 4))) for p in pieces]]
    whole = Tokenizer(models.Unigram(vocabulary, 0, False))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = unigram.Unigram(vocabulary)
    for _ in range(300):
        text = "".join(r.choice("abcx yz") for _ in range(r.randint(1, 40)))
        assert own.text_count(text) == len(whole.encode(text, add_special_tokens=False).ids), text


def test_token_counts_of_a_public_file(spark, odd, none):
    path = tokenizer_file("piece_bpe_32k.model")
    whole = Tokenizer(models.Unigram(unigram.vocabulary(path), 0, False))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    for r in unigram.token_counts(odd.withColumn("N_Tokens", F.lit(0)), path).collect():
        assert r["n_tokens"] == (len(whole.encode(r["text"], add_special_tokens=False).ids) if r["text"] else 0)
    assert unigram.token_counts(none, path).count() == 0


# Packing


def test_packing_gives_back_every_id(spark, odd, none):
    path = tokenizer_file("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame(
        [(20, "two  spaces <|endoftext|>  in a row \n\n x", None, None, 0), (21, "it's 12,5 € and\tmore \n y", None, None, 0)], SCHEMA
    )
    docs = odd.unionByName(extra)
    got = packing.pack(docs.repartition(3), path, length=64).collect()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    own = sorted((r["sequence_id"] * 64 + r["offset"], r) for r in got)
    assert [at for at, _ in own] == list(np.cumsum([0, *[r["length"] for _, r in own]])[:-1])
    assert all(r["offset"] + r["length"] <= 64 for r in got)
    seen, stream = collections.Counter(), []
    for _, r in own:
        assert r["start"] == len(stream)
        stream += np.frombuffer(r["ids"], "<u4").tolist()
        if len(stream) == r["doc_tokens"]:
            seen[r["doc_id"], tuple(stream)] += 1
            stream = []
    want = collections.Counter()
    for (k, t), n in texts.items():
        want[k, tuple([*(whole.encode(t, add_special_tokens=False).ids if t else []), 0])] += n
    assert seen == want
    assert packing.pack(none, path).count() == 0


def test_words_of_many_texts_are_encoded_together_once():
    path = tokenizer_file("byte_bpe_50k.json")
    model, whole, r = bpe.ByteBpe(path), Tokenizer.from_file(path), random.Random(3)
    parts = [*"ab ,.\n\t1'sé€\r中\x1c", *["  ", " ", " \n", "\u3000", "\x85", "\u200b", "'ll", "<|endoftext|>", " word"]]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None]
    got = [own for _, run in packing.runs(pa.array(texts), pa.array(texts), 5000) for own in model.ids(run)]
    for t, own in zip(texts, got, strict=True):
        assert np.frombuffer(own, model.dtype).tolist() == whole.encode(t or "", add_special_tokens=False).ids, t
    assert model.ids(pa.array([], pa.string())) == []
    # 200 texts of 1,000 words, 500 different ones: one call for all of them and one for each first word.
    words = [f"{chr(97 + i % 26)}{i}," for i in range(500)]
    run, seen, encoder = [" ".join(r.choices(words, k=1000)) for _ in range(200)], [], model.words

    class Counted:
        def encode_to_numpy(self, text, **options):
            seen.append(len(text))
            return encoder.encode_to_numpy(text, **options)

    model.words = Counted()
    got = model.ids(pa.array(run))
    assert [np.frombuffer(own, model.dtype).tolist() for own in got] == [
        e.ids for e in whole.encode_batch(run, add_special_tokens=False)
    ]
    assert len(seen) == 201 and max(seen) <= 500 * 6


def test_runs_are_bounded_by_bytes():
    texts = pa.array(["a" * 7, None, "", "b" * 20, "c" * 3, "d" * 3])
    got = [(k.to_pylist(), t.to_pylist()) for k, t in packing.runs(pa.array(range(6)), texts, 10)]
    assert [k for k, _ in got] == [[0, 1, 2], [3], [4, 5]]
    assert [t for _, ts in got for t in ts] == texts.to_pylist()


# Language model


def test_scores_equal_counting_and_either_way_of_probing(spark, odd, none):
    docs = odd.where("doc_id is not null").withColumn("LM_score", F.lit("x"))
    train = F.col("doc_id") % 7 != 2
    counts = collections.Counter()
    for r in docs.collect():
        if r["doc_id"] % 7 != 2:
            counts.update([*WORD.findall(lower(r["text"])), None])
    n, v = sum(counts.values()), len(counts)
    runs = [
        ngram_lm.Settings(),
        ngram_lm.Settings(frequent=3, segment_tokens=500),
        ngram_lm.Settings(frequent=3, segment_tokens=500, broadcast_bytes=0),
    ]
    results = []
    for s in runs:
        got = ngram_lm.score(docs, train, settings=s).collect()
        assert len(got) == docs.count()
        for r in got:
            tokens = [*WORD.findall(lower(r["text"])), None]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
            assert r["lm_score"] < 0
        results.append(sorted((r["doc_id"], round(r["lm_score"], 9)) for r in got))
    assert results[1] == results[2]
    assert ngram_lm.score(none, F.lit(True)).count() == 0
    untrained = ngram_lm.score(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in untrained} == {0} and {r["train_tokens"] for r in untrained} == {0}


def test_segments_are_sent_to_blocks_of_texts_not_to_each(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "_BLOCK", 150)
    docs = spark.createDataFrame([(i, prose(40, "abc", seed=i % 50)) for i in range(120)], "doc_id long, text string").repartition(3)
    runs = []
    for most in (1 << 20, 0):
        s = ngram_lm.Settings(frequent=3, segment_tokens=40, broadcast_bytes=most)
        got = ngram_lm.score(docs, F.col("doc_id") < 10, settings=s)
        runs.append(sorted((r["doc_id"], round(r["lm_score"], 9)) for r in got.collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 120
    readers = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "bits#" in x and " read(" in x]
    assert readers and all("CoGroups" in x for x in readers)


def test_blocks_stay_whole_and_their_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "_BLOCK", 20_000)
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024", "spark.sql.files.maxPartitionBytes": "8192"}
    docs = spark.range(3_000).select("id", F.concat_ws(" ", F.lit("a b"), F.col("id") % 50, F.md5(F.col("id").cast("string"))).alias("text"))
    docs = docs.coalesce(2).localCheckpoint()
    runs = []
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        for most in (1 << 20, 0):
            got = ngram_lm.score(docs, F.col("id") < 1_000, settings=ngram_lm.Settings(segment_tokens=500, broadcast_bytes=most))
            runs.append(sorted((r["id"], round(r["lm_score"], 9)) for r in got.select("id", "lm_score").collect()))
    finally:
        for key in small:
            spark.conf.unset(key)
    assert runs[0] == runs[1] and len(runs[0]) == 3_000
    plan = got.select("id", "lm_score")._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.splitlines() if " rate(" in x or " probes(" in x]
    assert len(steps) == 2 and all("text#" in x and "_block#" in x for x in steps)
    shown = got.select("id", "lm_score")._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, x in enumerate(shown) if "Exchange hashpartitioning(_block" in x]
    assert not any("text#" in x for i in dealt for x in shown[i + 1 : i + 2])


def test_texts_are_hashed_together_as_alone():
    texts = pa.array(["a b", None, "", " ", "x", "\u00c0\u00c9  b\x0bc\td\r\n", "A b", None, "\n", "b a  ", "a" * 600_000, "b"])
    for some in (texts, texts.slice(2, 7), texts.slice(0, 0)):
        token, length = ngram_lm.many_tokens(some)
        alone = [ngram_lm.tokens(t) for t in some.to_pylist()]
        assert length.tolist() == [len(t) for t in alone]
        assert token.tolist() == [int(h) for t in alone for h in t]
        if alone:
            assert ngram_lm.many_bigrams(token, length).tolist() == [int(h) for t in alone for h in ngram_lm.bigrams(t)]


def test_filter_reads_back_levels():
    s, r = ngram_lm.Settings(), np.random.default_rng(2)
    hashes = np.unique(r.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    counts = np.minimum(r.zipf(1.5, len(hashes)), 10**6)
    read = ngram_lm.Filter({0: ngram_lm.fill(hashes, counts, s)}, 1, s)
    true = ngram_lm.levels(counts, s.base)
    got = read.level(hashes)
    assert (got >= true).all() and (got > true).mean() < 0.03
    assert (read.level(r.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.03


# Quality


def test_quality_counts_equal_brute_force(spark, odd, none):
    part = prose(9)
    extra = [(30, f"{part} x {part} {part}\n\n{part}\n{part}\n #a |b|\x0b<c>"), (31, "a b a b a b a b a b a b")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = quality.with_counts(docs.withColumn("N_Words", F.lit("x")))
    assert got.count() == docs.count()
    for r in got.collect():
        assert tuple(r[c] for c in quality.COUNTS[:5]) == brute_counts(r["text"])
    assert quality.with_counts(none).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 50, 700, 3_000) for k in (0, 1, 3, 10, 25) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p"))
    for k, n, p in rows_of(df, "k", "n", "p"):
        exact = sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
        assert p == (1.0 if k >= 0.02 * n else pytest.approx(exact, rel=1e-8))


def test_cutoffs_keep_good_documents(spark, odd, none):
    r, rows, labels = random.Random(9), [], []
    for i in range(4_000):
        bad = i % 4 == 0
        words = prose(25, seed=i).split()
        if bad:
            words = [w + "$$$" for w in words]
        elif r.random() < 0.002:
            words = [w + "*" for w in words]
        rows.append((i, " ".join(words), "aa" if i < 3_900 else "bb"))
        labels.append((i, 0 if bad else 1))
    docs = quality.with_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    marks = spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")
    limits = quality.fit(docs, marks).cache()
    found = {(x["stratum"], x["rule"]): x for x in limits.collect()}
    best = found["aa", "symbol_share"]
    assert best["bad_above"] == 975 and best["good_above"] <= 0.005 * best["n_good"]
    assert not any(s == "bb" for s, _ in found)  # too few labels to prove anything
    judged = quality.judge(docs, limits).where("lang = 'aa'").select("doc_id", "kept").collect()
    assert not any(x["kept"] for x in judged if x["doc_id"] % 4 == 0)
    assert sum(x["kept"] for x in judged if x["doc_id"] % 4) > 0.98 * 2_925
    empty = quality.fit(quality.with_counts(none), marks)
    assert empty.count() == 0
    plain = quality.judge(quality.with_counts(odd), empty)
    assert all(x["kept"] != x["base_failed"] for x in plain.collect()) and plain.count() == odd.count()




def test_probabilities_of_a_context_add_up_to_one(spark):
    """But for what chance leaves of the share of words that the filter takes for followers."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("needs the test tables")
    s = ngram_lm.Settings()
    learned = spark.read.parquet(str(path)).select("text")
    counts = ngram_lm.word_counts(learned).cache()
    rows = counts.toPandas()
    n, v = int(rows["c"].sum()), len(rows)
    segments = 1 + n // s.segment_tokens
    stored = ngram_lm.train_filter(learned, segments, s).toPandas()
    model = ngram_lm.Filter(dict(zip(stored["segment"], stored["bits"], strict=True)), segments, s)
    known = ngram_lm.known_words(counts, float(n + v + 1), v * stored["wrong"].mean(), s)
    words = np.append(rows["hash"].to_numpy(np.int64).view(np.uint64), np.uint64(1))  # and one that is unknown
    ranked = rows.sort_values("c", ascending=False)["hash"].to_numpy(np.int64).view(np.uint64)
    contexts = [ranked[i] for i in sorted({0, 1, 2, 5, 20, 100, len(ranked) // 10, len(ranked) // 2, len(ranked) - 1})]
    for context in contexts:
        pairs = [np.array([context, w]) for w in words]
        alone = ngram_lm._text_scores([pairs[0][:1]], model.level, known, s)[0]
        total = (10 ** (ngram_lm._text_scores(pairs, model.level, known, s) - alone)).sum()
        assert 0.95 <= total <= 1.05, (context, total)
    first = ngram_lm._text_scores([np.array([w]) for w in words], model.level, known, s)
    assert 0.95 <= (10**first).sum() <= 1.05
    counts.unpersist()
