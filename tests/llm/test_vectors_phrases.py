"""Hard negatives, phrase collocations and nearest neighbours against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import collocations, hard_negatives, neighbours, vector_shards
from emberwatch.llm.double_array import build

VECTORS = "vec_id long, embedding array<double>, label int, score double, row string"


def _rows(rows):
    return sorted(tuple(r) for r in rows)


def _vector_table(spark, rng, count, dim, kinds=4):
    """Clusters of unequal lengths, repeated vectors, and rows that take no part."""
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(count):
        x = centres[i % 6] * rng.uniform(0.1, 3) + rng.normal(size=dim) * 0.3
        rows.append((i, [float(v) for v in np.round(x, 2 if i % 3 else 1)], i % kinds, 0.0, "x"))
    rows[3] = (3, rows[0][1], 1, 0.0, "x")
    rows += [(count + i, rows[1][1], i % kinds, 0.0, "x") for i in range(12)]
    odd = [
        (5000, None, 1, 0.0, None), (5100, [1.0] * (dim - 1) + [None], 1, 0.0, None),
        (5200, [1.0] * (dim - 1) + [math.nan], 1, 0.0, None), (5300, [math.inf] * dim, 1, 0.0, None),
        (5400, [0.0] * dim, 1, 0.0, None), (5500, [1.0] * dim, None, 0.0, None), (None, [1.0] * dim, 1, 0.0, None),
        (5600, [0.5, 0.25], 2, 0.0, None), (5601, [0.5, 0.5], 2, 0.0, None), (5602, [0.25, 0.25], 1, 0.0, None),
        (5700, [], 1, 0.0, None),
    ]
    return spark.createDataFrame(rows + odd, VECTORS).repartition(3), rows + odd


def _whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def _nearest(rows, every, k):
    able = [(i, r[0], r[1]) for i, r in enumerate(rows) if r[0] is not None and _whole(r[1]) and any(r[1])]
    found = []
    for at, query, x in able:
        if query % every:
            continue
        far = []
        for other, vec_id, y in able:
            if other != at and len(x) == len(y):
                total = 0.0
                for a, b in zip(y, x, strict=True):
                    total += (a - b) * (a - b)
                far.append((math.sqrt(total), vec_id))
        found += [(query, rank, i, d) for rank, (d, i) in enumerate(sorted(far)[:k], 1)]
    return sorted(found)


def test_nearest_neighbours_against_brute_force(spark):
    table, rows = _vector_table(spark, np.random.default_rng(1), 2400, 9)
    got = _rows(neighbours.nearest_neighbours(table, every=40).collect())
    wanted = _nearest(rows, 40, 10)
    both = {r[:3] for r in got} & {r[:3] for r in wanted}
    assert len(got) == len(wanted) and len(both) >= 0.99 * len(wanted)
    assert {r for r in got if r[0] >= 5000} == {r for r in wanted if r[0] >= 5000}
    assert all(a in wanted for a in got if a[:3] in both)


def test_nearest_neighbours_in_rounds_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(vector_shards, "FIRST_SHARDS", 2)
    monkeypatch.setattr(vector_shards, "WIDER", 2)
    monkeypatch.setattr(vector_shards, "SHARD_BYTES", 5_000)
    table, rows = _vector_table(spark, np.random.default_rng(2), 900, 6)
    got = _rows(neighbours.nearest_neighbours(table, every=100).collect())
    wanted = _nearest(rows, 100, 10)
    assert len(set(got) & set(wanted)) >= 0.99 * len(wanted) and len(got) == len(wanted)
    assert neighbours.nearest_neighbours(table.limit(0)).collect() == []
    # Rows of one id are rows of their own.
    same = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert _rows(neighbours.nearest_neighbours(same).collect()) == [(0, 1, 0, 0.0)] * 2 + [(0, 2, 1, 1.0)] * 2


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(3)
    for dim in (3, 64, 130):
        vectors, queries = rng.normal(size=(700, dim)), rng.normal(size=(20, dim)) * 2
        codes = neighbours.Codes(vectors)
        real = ((queries[:, None, :] - vectors[None]) ** 2).sum(axis=2) / codes.scale**2
        assert (codes.lower_bounds(queries) <= real + 1e-9).mean() > 0.998


def _negatives(rows, every, positives=5, negatives=10):
    able = [
        (i, r[0], [math.floor(256 * x) for x in r[1]], r[2])
        for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and _whole(r[1])
    ]
    found = []
    for at, anchor, x, label in able:
        if anchor % every:
            continue
        scores = [
            (-sum(a * b for a, b in zip(x, y, strict=True)), vec_id, other, kind)
            for other, vec_id, y, kind in able if len(x) == len(y) and other != at
        ]
        for score, positive, _, _ in sorted(s for s in scores if s[3] == label)[:positives]:
            band = sorted(s for s in scores if s[3] != label and 30 * -score <= 100 * -s[0] <= 90 * -score)
            found += [(anchor, positive, n, s[1], -score, -s[0]) for n, s in enumerate(band[:negatives], 1)]
    return sorted(found)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vector_shards, "FIRST_SHARDS", 2)
        monkeypatch.setattr(vector_shards, "WIDER", 2)
        monkeypatch.setattr(vector_shards, "SHARD_BYTES", 5_000)
    table, rows = _vector_table(spark, np.random.default_rng(4), 800, 5)
    got = _rows(hard_negatives.hard_negatives(table, every=20).collect())
    wanted = _negatives(rows, 20)
    assert len(wanted) > 500
    assert got == wanted
    assert hard_negatives.hard_negatives(table.limit(0)).collect() == []


def test_coordinate_ranges_exclude_rows_and_lose_none():
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(2000, 4)) * 300)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    bucket = hard_negatives.Bucket(np.arange(2000), vectors, lengths)
    excluded = 0
    for query in vectors[:50]:
        length = float(np.sqrt(query @ query))
        scores = vectors @ query
        least = int(np.sort(scores)[-20])
        at = bucket.candidates(query / length, length, least)
        assert set(np.flatnonzero(scores >= least)) <= set(at)
        excluded += 2000 - len(at)
        assert bucket.candidates(query / length, length, int(length * bucket.longest) + 2) is None
    assert excluded > 50 * 1000


def test_large_integers_are_exact(spark):
    big = 2.0**22
    rows = [(0, [big, 3.0], 0), (7, [big, 1.0], 9), (1, [big, 2.0], 0), (2, [big * 0.7, 5.0], 1), (3, [1e300, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = _rows(hard_negatives.hard_negatives(table).collect())
    assert got == [r for r in _negatives(rows[:4], 100)] and got


# --- phrases ------------------------------------------------------------------------------


def _phrases(rows, min_count, longest, top, absorb):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    able = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    scored = []
    for (lang, words), a in able.items():
        if any(
            other == lang and len(longer) > len(words) and 100 * b >= absorb * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (other, longer), b in able.items()
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored.append((lang, -score, -a, " ".join(words).encode(), left, right))
    found, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def _texts(rng):
    words = ["Alpha", "beta", "été", "the", "of", "x", "new", "york", "city", "\xa0q", "日本", "y\x00z"]
    rows = []
    for i in range(160):
        picked = rng.choice(words, size=int(rng.integers(0, 60)), p=np.array([6, 5, 4, 20, 15, 5, 9, 9, 9, 3, 3, 2]) / 90)
        text = ""
        for w in picked:
            text += w + rng.choice([" ", "\t ", ", ", "\n", ". ", " "], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])
            if w == "new" and rng.random() < 0.6:
                text += "York City "
        rows.append((text, ["en", "de", None][i % 3]))
    return [*rows, (None, "en"), ("", None), (" \n", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("words,block,longest", [(500_000, 250_000, 3), (4, 9, 3), (5, 20, 4)])
def test_collocations_against_brute_force(spark, words, block, longest):
    rows = _texts(np.random.default_rng(6))
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, word string, n int")
    found = collocations.collocations(docs.repartition(5), words=words, block=block, longest=longest, min_count=4, top=15)
    wanted = _phrases(rows, 4, longest, 15, 50)
    assert len(wanted) > 25
    assert _rows(found.collect()) == wanted


def test_collocations_in_slices_of_the_hashes(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_TOKENS", 1_000)
    monkeypatch.setattr(collocations, "TRIES", 2)
    rows = _texts(np.random.default_rng(12))
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.collocations(docs.repartition(3), block=9, min_count=4, top=15)
    assert _rows(found.collect()) == _phrases(rows, 4, 3, 15, 50)


def test_number_arrays_and_batches_are_bounded(spark, monkeypatch):
    staged, stage = {}, collocations.stage

    def kept(df, label):
        staged[label] = stage(df, label)
        return staged[label]

    monkeypatch.setattr(collocations, "stage", kept)
    text = "new york city " * 60_000
    docs = spark.createDataFrame([(text, "en"), ("old york", "en")], "text string, lang string")
    found = collocations.collocations(docs.coalesce(1)).collect()
    assert {r.phrase: r.a for r in found} == {"new york city": 60_000, "york city new": 59_999, "city new york": 59_999}
    longest = staged["numbers"].agg(F.max(F.length("numbers"))).first()[0]
    assert longest <= 4 * ((1 << 15) + 2)
    # The settings of the session are as before.
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "77") == "77"


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "hash", len, raising=False)
    rows = [("en", b"aa", 3), ("en", b"bb", 5), ("de", b"aa", 4), ("en", b"c", 0), ("en", b"dd", 9)]
    table = pa.table({n: pa.array(c) for n, c in zip(("lang", "word", "number"), zip(*rows, strict=True), strict=True)})
    words = collocations.Words(table.to_batches(max_chunksize=2))
    assert words.find("en", [b"dd", b"aa", b"xx", b"c", b"yyy", b"bb"]) == [9, 3, -1, 0, -1, 5]
    assert words.find("de", [b"aa", b"bb", b"c"]) == [4, -1, -1] and words.find("fr", [b"aa"]) == [-1]


def test_collocations_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a b", "en")], docs.schema)).collect() == []


def test_scores_beyond_64_bits(spark):
    counted = {1: spark.createDataFrame([(0, 9 * 10**12), (1, 8 * 10**12)], "w0 int, n long")}
    pairs = spark.createDataFrame([(0, 1, 7 * 10**12)], "w0 int, w1 int, n long")
    row = collocations._cut(pairs, counted, 2).first()
    assert row.score == 10**6 * 49 * 10**24 // (72 * 10**24)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 7)
    text = b"aa bbbb cccccccccccc d, e  ff\tggg.hhhh ii" * 5
    cut = list(collocations.parts(text))
    assert len(cut) > 9 and b"".join(cut) == text
    assert [t for p in cut for t in collocations.tokens(p)] == collocations.tokens(text)


def test_distinct_phrases_with_one_hash():
    phrases = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [5, 6]], dtype=np.int32)
    found, _ = collocations.distinct(phrases, np.array([7, 7, 7, 7, 1], dtype=np.uint64))
    assert found.tolist() == [[5, 6], [1, 2], [3, 4]]
    assert len(collocations.distinct(phrases[:0], np.zeros(0, np.uint64))[0]) == 0


def test_double_array_holds_exactly_its_sequences():
    rng = np.random.default_rng(8)
    for count, symbols, length in ((1, 1, 2), (40, 4, 3), (3000, 700, 2), (2000, 70_000, 3)):
        drawn = np.unique(rng.zipf(1.4, size=(count * 3, length)) % symbols, axis=0)[:count]
        trie = build(drawn[rng.permutation(len(drawn))])
        flat = drawn.ravel()
        assert set(trie.ends(flat, length, np.arange(0, len(flat), length))) == set(trie.accept)
        assert len(set(trie.accept)) == len(drawn)
        text = rng.zipf(1.4, size=5000) % symbols
        held = {tuple(x) for x in drawn.tolist()}
        inside = sum(tuple(text[i : i + length].tolist()) in held for i in range(len(text) - length + 1))
        assert len(trie.ends(text, length, np.arange(len(text) - length + 1))) == inside


def test_label_expression_and_other_columns(spark):
    table, rows = _vector_table(spark, np.random.default_rng(9), 200, 4)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = [(r[0], r[1], (r[2] + 1) % 10 if r[0] is not None and r[2] is not None and r[0] % 7 == 0 else r[2]) for r in rows]
    got = _rows(hard_negatives.hard_negatives(table, label=shifted, every=50).collect())
    assert got == _negatives(rows, 50)
