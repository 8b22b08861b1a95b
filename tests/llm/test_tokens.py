"""Problems 7 and 8: ids against the tokenizers library, the transducer, and packing against brute force."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def words():
    return tokens.vocabulary(tokens.TOKENIZERS, tokens.VOCABULARY)


def ids_of(text):
    import numpy as np

    return np.frombuffer(tokens.Encoder().packed(text), dtype=np.int32).tolist()


CASES = ["", " ", "\n\n  a", "we've it's they'll DON'T", "<|endoftext|> x", "𠮷野 branch\t\topened 📈", "中国人民银行２０２３年", "a" * 3000, "=" * 2000 + "-" * 999, "á é ​.", "e\u0301" * 700, "x\r\ny", "١٢٣", "\ufeff# x"]


@pytest.mark.parametrize("text", CASES)
def test_ids_of_cases(text, library):
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_of_any_text(text):
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json") if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    t.encode_special_tokens = True
    test_ids_of_any_text.t = t
    assert ids_of(text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark, data, library):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    for row in tokens.encode_texts(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        assert list(row.ids) == (library.encode(row.text, add_special_tokens=False).ids if row.text else [])


def test_transducer_is_exact_in_constant_memory(words):
    random.seed(3)
    for alphabet in ("ab的中国人ー", "thequickbrown", "a"):
        widths = []
        for length in (2000, 6000):
            part = "".join(random.choice(alphabet) for _ in range(length)).encode()
            transducer = tokens.Transducer(words)
            got = list(transducer.run([part[i : i + 700] for i in range(0, len(part), 700)]))
            assert b"".join(words.tokens[i] for i in got) == part
            assert all(words.fits(a, b) for a, b in zip(got, got[1:]))  # neighbours that stay apart make the one encoding
            widths.append(transducer.widest)
        assert widths[0] == widths[1]


def test_decoding(words):
    for text in CASES:
        assert tokens.decode(ids_of(text), words) == text


def test_odd_tables(spark):
    rows = [(1, None, "c"), (1, "", "c"), (2, "ab", "c"), (2, "ab", "c"), (None, "x" * 200_000, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    got = tokens.encode_texts(frame).collect()
    assert len(got) == 5 and sorted(len(r.ids) for r in got)[:2] == [0, 0]
    assert tokens.encode_texts(frame.limit(0)).count() == 0
    placed = packing.pack_texts(frame, capacity=100)
    assert placed.where("n_tokens > 100").count() == 0 and placed.groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 100").count() == 0
    assert packing.pack_texts(frame.limit(0)).count() == 0 and placed.where("doc_id = 2").count() == 2


def best_fill(lengths, room):
    return max(sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room)


def test_fullest_against_brute_force():
    random.seed(5)
    for _ in range(200):
        items = [random.randint(1, 12) for _ in range(random.randint(0, 9))]
        room = random.randint(0, 40)
        counts = {k: items.count(k) for k in items}
        chosen = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert all(n <= counts[k] for k, n in chosen.items())
        assert sum(k * n for k, n in chosen.items()) == best_fill(items, room)


def test_plan_places_every_item_once():
    random.seed(6)
    for _ in range(30):
        histogram = {k: random.randint(0, 50) for k in random.sample(range(1, 65), 20)}
        plan, used, seen = packing.plan(histogram, 64), {}, {}
        for length, first, last, container, copies in plan:
            for rank in range(first, last):
                c = container + (rank - first) // copies
                used[c] = used.get(c, 0) + length
                seen[length] = seen.get(length, 0) + 1
        assert max(used.values()) <= 64 and seen == {k: n for k, n in histogram.items() if n}
        total = sum(k * n for k, n in histogram.items())
        least = max(-(-total // 64), sum(n for k, n in histogram.items() if k > 32))
        assert len(used) <= least * 11 / 9 + 1
        assert sorted(used) == list(range(len(used)))


def test_packing_a_hot_length(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("bigint").alias("n"))
    placed = packing.pack_items(frame, "n", 50)
    assert placed.count() == 3000 and placed.select("doc_id").distinct().count() == 3000
    used = placed.groupBy("container").agg(F.sum("n").alias("u"))
    assert used.where("u > 50").count() == 0 and used.count() <= frame.agg(F.sum("n")).first()[0] / 50 * 1.02 + 1


def test_pieces_of_a_long_text(spark):
    frame = spark.createDataFrame([(1, " word" * 10_000)], "doc_id bigint, text string")
    rows = packing.pack_texts(frame).orderBy("piece_no").collect()
    assert [r.n_tokens for r in rows] == [4096, 4096, 1808] and [r.token_start for r in rows] == [0, 4096, 8192] and len({r.container for r in rows}) == 3
