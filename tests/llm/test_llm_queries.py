"""The registered queries of the corpus operators on the smallest tables, against plain versions."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from lexline.llm import unigram
from lexline.llm.registry import tokenizer_file
from lexline.session import durable
from tests_llm_rules import brute_components, brute_counts, brute_spans, lower

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def rows(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return dict(rows("documents", "doc_id, text"))


def result(spark, name):
    got = QUERIES[name](spark, DATA).collect()
    return got, {r["doc_id"]: r for r in got}


def test_op1(spark, docs):
    got, by = result(spark, "op1_neardup")
    want = brute_components(docs)
    assert len(got) == len(docs)
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in by.items()} == {
        k: (n, c, c == k) for k, (n, c) in want.items()
    }


def test_op2(spark, docs):
    got, by = result(spark, "op2_sharding")
    assert sorted(by) == sorted(docs) and len(got) == len(docs)
    for k, r in by.items():
        raw = None if docs[k] is None else docs[k].encode()
        assert r["size"] == len(raw or b"") + 1 and r["text_crc32"] == (None if raw is None else zlib.crc32(raw))
        assert r["law"] == "rows" and r["grown_shard"] is None
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op3(spark, docs):
    got, by = result(spark, "op3_language")
    lang = dict(rows("documents", "doc_id, lang"))
    assert sorted(by) == sorted(docs) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in by.items())
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op4(spark, docs):
    got, by = result(spark, "op4_decontamination")
    items = rows("benchmark", "item_id, text")
    assert len(got) == len(docs)
    for k, r in by.items():
        n, hit, names = brute_spans(docs[k], items)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            n, hit, len(names), digest, hit > 0,
        )


def test_op5(spark, docs):
    got, by = result(spark, "op5_toxicity")
    assert sorted(by) == sorted(docs) and len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in by.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op6(spark, docs):
    got, by = result(spark, "op6_licenses")
    notices = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
        "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.",
    }
    assert len(got) == len(docs)
    for k, r in by.items():
        assert r["licenses"] == ",".join(n for n, t in sorted(notices.items()) if t in docs[k])


def test_op7(spark, docs):
    got, by = result(spark, "op7_token_counts")
    whole = Tokenizer(models.Unigram(unigram.vocabulary(tokenizer_file("piece_bpe_32k.model")), 0, False))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert len(got) == len(docs)
    assert all(r["n_tokens"] == len(whole.encode(docs[k], add_special_tokens=False).ids) for k, r in by.items())


def packed_exactly(got, texts):
    whole, own = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), collections.defaultdict(list)
    for r in got:
        own[r["doc_id"]].append(r)
    assert sorted(own) == sorted(texts)
    for k, pieces in own.items():
        ids, at = [*(whole.encode(texts[k] or "", add_special_tokens=False).ids), 0], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    ends = [0, *np.cumsum([n for _, _, n in places])]
    assert [s * 1_024 + o for s, o, _ in places] == ends[:-1]
    assert all(o + n <= 1_024 for _, o, n in places)


def test_op8(spark, docs):
    packed_exactly(result(spark, "op8_packing")[0], docs)


def test_op9(spark, docs):
    got, by = result(spark, "op9_language_model")
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    tokens = {k: [*WORD.findall(lower(t)), None] for k, t in docs.items()}
    counts = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, total = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    assert len(got) == len(docs)
    for k, r in by.items():
        ws = tokens[k]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[k], len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / total) for w in ws))
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_op10(spark, docs):
    got, by = result(spark, "op10_quality")
    assert len(got) == len(docs)
    for k, r in by.items():
        n, chars, symbols, dup, repeat = brute_counts(docs[k])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


def test_pipeline_stages_and_result(spark, docs):
    kept = spark.read.parquet(f"{DATA}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = durable(stage(spark, kept, DATA))
        assert after.columns == kept.columns
        left[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        kept = after
    assert left["language"] == docs
    passing = {k: brute_counts(t) for k, t in docs.items()}
    passing = {k: t for k, t in docs.items() if passing[k][0] >= 20 and 100 * passing[k][4] <= 30 * passing[k][0]}
    assert set(left["quality"]) <= set(passing)
    want = {k for k, (_, c) in brute_components(left["quality"]).items() if c == k}
    assert set(left["near_duplicates"]) == want
    items = rows("benchmark", "item_id, text")
    for k, t in left["near_duplicates"].items():
        n, hit, _ = brute_spans(t, items)
        assert (k in left["decontamination"]) == (2 * hit <= n)
        if k in left["decontamination"]:
            assert (left["decontamination"][k] == t) == (hit == 0)
    packed_exactly(QUERIES["pipeline"](spark, DATA).collect(), left["decontamination"])


def test_stages_keep_columns_of_clashing_names(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("*", "doc_id AS N_Words", "'x' AS kept", "1.5 AS items")
    odd = spark.createDataFrame([(None, None, None, "s", None), (-1, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = own.limit(40).unionByName(odd, allowMissingColumns=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = durable(stage(spark, docs, DATA))
        assert left.columns == docs.columns
        assert all(r["N_Words"] == r["doc_id"] and r["kept"] == "x" for r in left.where("doc_id >= 0").collect())
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 40


def test_near_duplicates_are_dropped_row_by_row(spark):
    text = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abcdefg"}
    near = text["c"] + " end"
    given = [
        (1, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["b"] + " end"), (2, text["c"]), (5, near),
        (5, text["d"]), (5, text["e"]), (7, text["f"]), (7, text["f"]), (None, text["g"]), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(given)], "doc_id long, text string, _at long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert left.columns == docs.columns
    got = sorted(r["_at"] for r in left.collect())
    assert [i for i in got if i not in (2, 3, 8, 9)] == [0, 4, 6, 7, 10, 11, 12]
    assert len({2, 3} & set(got)) == len({8, 9} & set(got)) == 1
