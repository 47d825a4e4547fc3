"""The Katz scores against a direct evaluation over dictionaries."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoplytic.llm import katz, queries
from shoplytic.llm.common import discard, stored


def _brute_force(rows, order):
    """Scores by recursion over plain dictionaries of word tuples."""
    training = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    texts = [["<s>", *katz_words(t), "</s>"] for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for words, train in zip(texts, training, strict=True):
        if train:
            for k in range(1, order + 1):
                counts[k].update(tuple(words[i - k + 1 : i + 1]) for i in range(k - 1, len(words)))
    starts = counts[1].pop(("<s>",), 0)
    tokens, types = sum(counts[1].values()), len(counts[1])
    stats = [None]
    for k in range(1, order + 1):
        of = Counter(counts[k].values())
        stats.append(
            katz.Statistics(sum(counts[k].values()), len(counts[k]),
                            tuple(of[c] for c in range(1, katz.LAST_DISCOUNTED + 2)))
        )
    factors = [None, *[s.discounts() for s in stats[1:]]]

    def cut(k, c):
        return c * factors[k][min(c, katz.LAST_DISCOUNTED + 1)]

    seen = sum(cut(1, c) for c in counts[1].values())
    total = tokens if seen < tokens * (1 - 1e-12) else tokens + 1
    contexts = defaultdict(list)
    for k in range(2, order + 1):
        for gram in counts[k]:
            contexts[gram[:-1]].append(gram)

    def times(context):
        return starts if context == ("<s>",) else counts[len(context)][context]

    def p(gram):
        if len(gram) == 1:
            c = counts[1][gram]
            return cut(1, c) / total if c else 1 - seen / total
        context, c = gram[:-1], counts[len(gram)][gram]
        n = times(context)
        if not n:
            return p(gram[1:])
        mass = sum(cut(len(g), counts[len(g)][g]) for g in contexts[context])
        raised = mass >= n * (1 - 1e-12)
        if c:
            return cut(len(gram), c) / (n + raised)
        lower = sum(p(g[1:]) for g in contexts[context])
        return (1 - mass / (n + raised)) / (1 - lower) * p(gram[1:])

    found = []
    for words, train in zip(texts, training, strict=True):
        known = [counts[1][(w,)] for w in words[1:]]
        base = sum(math.log10((c + 0.5) / (tokens + 0.5 * (types + 1))) for c in known)
        score = sum(
            math.log10(p(tuple(words[max(0, i - order + 1) : i + 1]))) for i in range(1, len(words))
        )
        found.append((not train, len(known), sum(c > 0 for c in known), tokens, base, score))
    return found, p, contexts, counts


def katz_words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def _corpus(seed, rows=60):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    return [
        (i, " ".join(pick.choices(vocabulary, weights, k=pick.randint(0, 40))).title())
        for i in range(rows)
    ]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, documents, order, monkeypatch):
    monkeypatch.setattr(katz, "RANGE_TOKENS", 200)
    rows = _corpus(order)
    expected, *_ = _brute_force(rows, order)
    got = katz.score_documents(documents(rows).repartition(5), order).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, e in zip(got, expected, strict=True):
        assert tuple(r)[1:5] == e[:4]
        assert r["base_score"] == pytest.approx(e[4], abs=1e-9)
        assert r["score"] == pytest.approx(e[5], abs=1e-9)


def test_contexts_add_up_to_one():
    rows = _corpus(9)
    _, p, contexts, counts = _brute_force(rows, 3)
    words = [g[0] for g in counts[1]] + ["never seen"]
    assert sum(p((w,)) for w in words) == pytest.approx(1)
    for context in list(contexts)[:40]:
        assert sum(p((*context, w)) for w in words) == pytest.approx(1)


def test_odd_rows(spark, documents, odd_texts):
    expected, *_ = _brute_force(odd_texts, 2)
    got = katz.score_documents(documents(odd_texts)).collect()
    assert len(got) == len(odd_texts)
    assert sorted((r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == (
        sorted((e[1], round(e[4], 6), round(e[5], 6)) for e in expected)
    )


def test_empty_table_and_no_training(spark, documents):
    assert katz.score_documents(documents([])).collect() == []
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = katz.score_documents(documents([(held_out, "a b")])).first()
    assert (row["held_out"], row["n_known"], row["train_tokens"]) == (True, 0, 0)
    assert (row["base_score"], row["score"]) == (0.0, 0.0)


def test_small_blocks_change_nothing(spark, documents):
    rows = _corpus(3)
    blocks = katz.token_blocks(documents(rows).coalesce(1), 100).collect()
    assert len(blocks) > 5 and sum(len(b["doc_ids"]) for b in blocks) == len(rows)
    assert max(len(b["tokens"]) for b in blocks) <= 100


def test_discounts_fall_back_where_counts_are_thin():
    thin = katz.Statistics(10, 3, (3, 0, 1, 0, 0, 0)).discounts()
    assert np.allclose(thin[1:6], [0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]) and thin[6] == 1


def test_query_backs_off_from_trigrams(spark, documents, tmp_path):
    rows = _corpus(5)
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    expected, *_ = _brute_force(rows, 3)
    got = queries.op9_katz_backoff(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx([e[5] for e in expected], abs=1e-9)


def test_only_what_is_needed_is_kept_and_moved(spark, monkeypatch, tmp_path):
    rows = [(i, "a b c a b d " * (i % 3 + 1)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = []
    monkeypatch.setattr(katz, "discard", lambda df: dropped.append(df.inputFiles()) or discard(df))
    scored = katz.score_documents(docs, 3)
    assert scored.count() == 12
    folders = {f.rpartition("/")[0].removeprefix("file:") for files in dropped for f in files}
    assert len(dropped) == 2 and len(folders) == 2
    assert all("/sums-" in f and not os.path.exists(f) for f in folders)
    blocks = stored(katz.token_blocks(docs), "blocks")
    counts = [katz.gram_counts(blocks, k, 8, katz.count_kind(99)) for k in (1, 2)]
    assert dict(counts[0].dtypes)["counts"] == "array<int>"
    answers = katz._answers(counts, [], 2)
    assert answers.filter("owned IS NOT NULL").select("level").distinct().collect() == [(2,)]
    assert katz._answers(counts, []).filter("owned IS NOT NULL").count() == 0
    assert katz.count_kind(1 << 31) == "long"
    spark.range(3).write.parquet(str(tmp_path / "own"))
    discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_weights_go_through_ranges_only_where_they_matter(spark, documents, monkeypatch):
    held_out = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(train[0], "only here twice only here"), (train[1], "x y z"), (train[2], "x y v"),
            (held_out, "x y u"), (train[3], "p q r"), (train[4], "p q s")]
    rows += [(i, "often a") for i in train[5:13]]
    blocks = stored(katz.token_blocks(documents(rows).coalesce(1), 1), "blocks")
    asked = {}
    for part in katz.gram_counts(blocks, 2, 8).collect():
        asked.setdefault(part["block"], []).extend(zip([part["range"]] * 99, part["asked"]))
    found = {}
    for row in blocks.toArrow().to_batches():
        for number, block, whole in katz._blocks_of(katz.pa.Table.from_batches([row]), 2):
            flags = [flag for _, flag in sorted(asked[number], key=lambda pair: pair[0])]
            found[whole.column("doc_ids")[0].as_py()[0]] = [
                flags[i] for i in block.levels[1].index[block.levels[1].valid]
            ]
    local, unasked, sent = katz.LOCAL, katz.UNASKED, katz.ASKED
    assert found[train[0]] == [local] * 6
    # "<s> x", "x y", then "y z" and the end: a text that is not trained on has the first two.
    assert found[train[1]] == [sent, sent, local, local]
    assert found[train[3]] == [unasked, unasked, local, local]
    assert found[train[5]] == [sent, sent, sent]
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 1)
    whole = katz.token_blocks
    monkeypatch.setattr(katz, "token_blocks", lambda docs: whole(docs, 1))
    expected, *_ = _brute_force(rows, 3)
    got = {r["doc_id"]: r for r in katz.score_documents(documents(rows), 3).collect()}
    assert [got[i]["score"] for i, _ in rows] == pytest.approx([e[5] for e in expected], abs=1e-9)


def test_arrays_travel_packed(spark):
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 1 << 16, dtype=np.uint64))
    sent = katz._pieces(7, 8, keys, times=np.ones(len(keys), np.int64))
    assert katz._joined_keys(sent.column("keys")).tolist() == keys.tolist()
    assert katz._joined(sent.column("times"), np.int64).tolist() == [1] * len(keys)
    assert sum(map(len, sent.column("keys").to_pylist())) < 6.9 * len(keys)
    assert sum(map(len, sent.column("times").to_pylist())) < 0.1 * len(keys)
    empty = katz._pieces(7, 8, keys[:0], times=np.empty(0, np.int64))
    assert len(empty) == 0 and len(katz._joined_keys(empty.column("keys"))) == 0
    assert katz._unpacked(katz._packed(keys[:0]), np.uint64).tolist() == []


def _small_blocks(monkeypatch, tokens):
    whole = katz.token_blocks
    monkeypatch.setattr(katz, "token_blocks", lambda docs: whole(docs, tokens))
    monkeypatch.setattr(katz, "RANGE_TOKENS", 200)


def test_blocks_keep_to_themselves_what_no_other_has(spark, documents, monkeypatch):
    _small_blocks(monkeypatch, 1)
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    held_out = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(train[0], "a b c d"), (train[1], "a b c e"), (train[2], "f b c d"),
            (held_out, "x b c e y"), (train[3], "n o")]
    kept, sent = katz._stored_in_turns, {}

    def watched(session, frames, name):
        table = kept(session, frames, name)
        sent[name] = table.collect()
        return table

    monkeypatch.setattr(katz, "_stored_in_turns", watched)
    expected, _, _, counts = _brute_force(rows, 3)
    scored = {r["doc_id"]: r["score"] for r in katz.score_documents(documents(rows), 3).collect()}
    assert [scored[i] for i, _ in rows] == pytest.approx([e[5] for e in expected], abs=1e-9)
    grams = [r for r in sent["sums-2"] if r["level"] == 3 and r["range"] >= 0]
    # Two have "<s> a b", two "a b c", four "b c d" or "b c e", two "c d </s>".
    assert sum(r["size"] for r in grams) == 2 + 2 + 4 + 2
    alone = [r["tally"] for r in sent["sums-2"] if r["level"] == 3 and r["range"] < 0]
    assert len(alone) == len(rows)
    shared = {("<s>", "a", "b"), ("a", "b", "c"), ("b", "c", "d"), ("b", "c", "e"),
              ("c", "d", "</s>")}
    assert sum(t[1] for t in alone) == len(set(counts[3]) - shared)
    # Only the held-out text meets an unseen word after a context of others: "c e" and "e".
    used = [
        katz._unpacked(r["used"], np.uint8).sum() for r in sent["sums-3"] if r["level"] == -3
    ]
    assert sum(used) == 1


@pytest.mark.parametrize("order", [4, 5])
def test_scores_of_higher_orders_over_many_blocks(documents, order, monkeypatch):
    _small_blocks(monkeypatch, 80)
    rows = _corpus(order, 40)
    expected, *_ = _brute_force(rows, order)
    got = katz.score_documents(documents(rows).repartition(3), order).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx([e[5] for e in expected], abs=1e-9)


def test_tables_are_stored_packed(documents, monkeypatch):
    tables = {}

    def watched(keep):
        def kept(*args):
            table = keep(*args)
            tables[table.inputFiles()[0].split("/")[-2]] = table
            return table

        return kept

    for name in ("stored", "_stored_in_turns"):
        monkeypatch.setattr(katz, name, watched(getattr(katz, name)))
    katz.score_documents(documents(_corpus(2, 10)), 3)
    arrays = {c: k for t in tables.values() for c, k in t.dtypes if c in katz.CARRIED | katz.ANSWERED}
    assert set(arrays) == {*katz.CARRIED, *katz.ANSWERED} and set(arrays.values()) == {"binary"}


def test_packed_numbers_take_the_bytes_they_need():
    few = np.arange(3, dtype=np.int64)
    assert katz._packed(few)[4] == 1 and katz._packed(few * 0)[4] == 0
    for values in (few, few * 0, -few, few.astype(np.float64), few > 1, few[:0]):
        back = katz._unpacked(katz._packed(values), values.dtype)
        assert back.dtype == values.dtype and back.tolist() == values.tolist()


def test_hashes_that_agree_in_leading_bits_are_told_apart():
    pick = np.random.default_rng(5)
    near = np.concatenate([np.uint64(5 << 60) + np.arange(7, dtype=np.uint64)] * 9)
    far = pick.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for keys in (near, np.concatenate([near[::-1], far, near, far[::2]]), far[:1], far[:0], far[[0, 0]],
                 pick.permutation(np.arange(5000, dtype=np.uint64)).repeat(2) + far[0]):
        assert katz._sorting(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_slices_of_texts_change_nothing(monkeypatch):
    texts = katz.pa.array(["a b", None, "", "c " * 50, " a  C", "b"])
    whole = katz._hashed(texts)
    monkeypatch.setattr(katz, "SLICE_BYTES", 4)
    sizes, hashes = katz._hashed(texts)
    assert sizes.tolist() == whole[0].tolist() == [2, 0, 0, 50, 2, 1]
    assert hashes.tolist() == whole[1].tolist()
