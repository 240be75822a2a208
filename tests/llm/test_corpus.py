"""Corpus operators against brute force on small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from emberwatch.llm import (
    decontaminate, exact_dedup, langid, line_dedup, lm_score, near_dedup, packing, secrets, toxicity, warc,
)
from emberwatch.llm.oracles import ORACLES
from emberwatch.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
BASE = " ".join(f"w{i}" for i in range(60))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, texts, extra=True):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # Columns whose names the operators use inside.
    return frame.withColumns({"score": F.lit("x"), "kept": F.lit("y")}) if extra else frame


def near_texts():
    rng = random.Random(4)
    words = BASE.split()
    texts = [BASE, BASE, None, "", " \n\t", "one", "one two", "One  TWO", "Long " * 5000]
    for _ in range(40):  # near copies from a few to many changed words
        copy = list(words)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy[: rng.choice([60, 60, 55, 48])]))
    return texts


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR) is None


# --- exact --------------------------------------------------------------------------------


@pytest.mark.parametrize("digits", [32, 1])
def test_exact_dedup_keeps_different_texts_of_one_hash_apart(spark, digits):
    texts = ["a b", "ab ", "AB", None, "", "\t", "c", "é ü", "éü", "a b", *[str(i) for i in range(40)]]
    key = lambda sha: F.substring(sha, 1, digits)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, texts), key_of=key).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    for body, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
            assert r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()


# --- lines --------------------------------------------------------------------------------


def brute_lines(texts):
    lines = [
        (d, k, lower(line).split())
        for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))
    ]
    lines = [x for x in lines if len(x[2]) >= line_dedup.MIN_WORDS]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {(d, k) for i, (d, k, w) in enumerate(lines) if any(near(w, x) for *_, x in lines[:i])}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(2)
    texts = [None, "", "short line", "short line", "\n\n"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = [f"w{i}" for i in range(rng.choice([8, 9, 15, 16, 17, 30]))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                i = rng.randrange(len(words))
                change = rng.randrange(3)
                if change == 0:
                    words[i] = f"x{rng.randrange(3)}"
                elif change == 1:
                    del words[i]
                else:
                    words.insert(i, f"x{rng.randrange(3)}")
            lines.append((" " if rng.random() < 0.5 else "  ").join(words).upper())
        texts.append("\n".join(lines))
    gone = brute_lines(texts)
    assert gone
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    for d, t in enumerate(texts):
        kept = None if t is None else "\n".join(
            x for k, x in enumerate(t.split("\n")) if (d, k) not in gone
        )
        assert got[d]["text"] == kept
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_reaches_every_line(spark):
    rng = random.Random(12)
    short = ["les.", "LES.", "released under the MIT license.", "one two three four five six seven", "}", "日本", "é"]
    long = ["a b c d e f g h", "a b c d e f g", "日本語の文は空白なしで書かれる", "日本語の文は空白なしに書かれる", "ภาษาไทยเขียนติดกัน"]
    texts = ["\n".join(rng.choice([*short, *long, "", " \t"]) for _ in range(rng.randrange(6))) for _ in range(20)]
    texts += [None, "released under the BSD license.", "one two three four five six eight", "ภาษาไทยเขียนติดกับ"]
    units = re.compile("[\u3040-\u30ff\u4e00-\u9fff\u0e01-\u0e4d]|[^ \t\u3040-\u30ff\u4e00-\u9fff\u0e01-\u0e4d]+")
    seen, want = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = units.findall(lower(line))
            gone = w and any(
                w == x or min(len(w), len(x)) >= 8 and (
                    len(w) == len(x) and sum(a != b for a, b in zip(w, x, strict=True)) == 1
                    or abs(len(w) - len(x)) == 1
                    and any(max(w, x, key=len)[:i] + max(w, x, key=len)[i + 1 :] == min(w, x, key=len)
                            for i in range(max(len(w), len(x))))
                )
                for x in seen
            )
            seen.append(w)
            kept += [] if gone else [line]
        want.append(None if t is None else "\n".join(kept))
    query = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs_of(spark, texts), every_line=True).collect()}
    assert [query[i] for i in range(len(texts))] == want
    assert want[-3:-1] == texts[-3:-1]  # one changed word of few is another line


def test_line_dedup_by_rows_where_ids_repeat_or_are_null(spark):
    long = "one two three four five six seven eight nine"
    rows = [
        (7, "x\nkeep me A", 1), (7, "y\nx", 2), (None, "alpha\ny", 3), (None, "beta two\nUNIQUE text", 4),
        (8, "same row\nhere", 5), (8, "same row\nhere", 6), (None, None, 7), (9, "", 8), (3, f"\t {long}", 9),
        (None, f"{long.upper()} ten\nbeta   TWO", 10), (None, "alpha\u00a0\n\u00c9t\u00e9\n\u00e9t\u00e9\n\u00c9T\u00e9", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").coalesce(1)
    got = {r["n_lines"]: r["text"] for r in line_dedup.line_dedup(docs, every_line=True, counts=False).collect()}
    assert got == {
        1: "x\nkeep me A", 2: "y", 3: "alpha", 4: "beta two\nUNIQUE text", 5: "same row\nhere", 6: "",
        7: None, 8: "", 9: f"\t {long}", 10: "", 11: "alpha\u00a0\n\u00c9t\u00e9\n\u00e9t\u00e9",
    }
    counted = line_dedup.line_dedup(docs.drop("n_lines"), every_line=True)
    assert counted.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert counted.agg(F.sum("n_dropped")).first()[0] == 7


# --- near copies --------------------------------------------------------------------------


@pytest.mark.parametrize("hubs", [8, 1])
def test_near_dedup_equals_all_pairs(spark, monkeypatch, hubs):
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    texts = near_texts()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        n = min(4, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    docs = docs_of(spark, texts).unionByName(
        spark.createDataFrame([(None, BASE, "x", "y")], "doc_id long, text string, score string, kept string")
    )
    rows = near_dedup.near_dedup(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), root(i))
        assert got[i]["kept"] == (root(i) == i)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    rows = near_dedup.sketches([pool[:300], pool[100:], pool[:1], np.zeros(0, np.uint64)])
    assert np.isfinite(rows[:3]).all() and np.isinf(rows[3]).all()
    assert abs((rows[0] == rows[1]).mean() - 0.5) < 0.2


# --- archives -----------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 7)
    rows = [(i, f"https://b{i % 3}.example/p?{i % 4}", "x" * (i % 5) + "\r\n\r\nWARC/1.1é") for i in range(30)]
    rows += [(30, None, None), (31, "http://a b\r\nc/", ""), (32, "", "y" * 200_000), (None, "u", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("start", F.lit(1))
    index = warc.archive_round_trip(pages, str(tmp_path / "a"), min_payload=0).orderBy("position").collect()
    assert [r["position"] for r in index] == list(range(len(rows)))
    order = [(r["urlkey"], r["captured"]) for r in index]
    assert order == sorted(order)
    best = defaultdict(lambda: -1)
    for i, _, html in rows:
        best[html or ""] = max(best[html or ""], -1 if i is None else i)
    for r in index:
        html = dict((i, h or "") for i, _, h in rows)[r["page_id"]]
        assert r["payload_bytes"] == len(html.encode())
        if r["page_id"] is not None:
            response = r["page_id"] == best[html]
            assert r["record_type"] == ("response" if response else "revisit")
            assert r["refers_to"] == (None if response else best[html])
    empty = warc.archive_round_trip(pages.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# --- contamination ------------------------------------------------------------------------


def test_contamination_equals_scan(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 14])))) for i in range(12)]
    items += [(90, "Short, ONE"), (91, ""), (92, None), (93, items[0][1])]
    items += [(None, " ".join(f"n{i}" for i in range(12))), (None, "nameless"), (None, None)]
    texts = [" ".join(rng.choice([*vocabulary, "zz"]) for _ in range(80)) for _ in range(30)]
    texts += [None, "", "a short; one two", items[1][1] + " " + items[1][1], "x " * 3000 + items[2][1]]
    texts += [texts[0], "été " + items[3][1].upper(), f"a {items[-3][1]} nameless b"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, t in items:
        w = pattern.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])] |= {str(item)} - {"None"}
    docs = docs_of(spark, texts)
    for size in (4_000_000, 60):  # one block and several
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, benchmark, block_bytes=size).collect()}
        for i, t in enumerate(texts):
            w, hit, names = pattern.findall(lower(t)), set(), set()
            for key, own in windows.items():
                for k in range(len(w) - len(key) + 1):
                    if tuple(w[k : k + len(key)]) == key:
                        hit |= set(range(k, k + len(key)))
                        names |= own
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(names), digest)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    assert decontaminate.contamination(clean, benchmark).where("contaminated").count() == 0
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[30] is None and all(by_id[i] == texts[i] for i in got if not got[i]["contaminated"])


def test_decontaminate_blocks_cut_together(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    stem, outer = words("s", 12), words("o", 20).split()
    items = [(str(k), f"{stem} {words(f'e{k}x', 5)}") for k in range(6)] + [("outer", " ".join(outer)), ("in", words("n", 15))]
    texts = [f"before {stem} {words(f'e{k}x', 5)} after" for k in range(6)]
    # Only once other items are gone do the words of one stand together.
    texts += [" ".join([*outer[:7], x, *outer[7:14]]) for x in (items[-1][1], items[0][1], items[1][1])]
    texts += [f"{words('n', 7)} {' '.join(outer)} {' '.join(f'n{i}' for i in range(7, 15))}", "clean text", None, ""]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    docs = docs_of(spark, texts)
    assert len(list(decontaminate.blocks_of(benchmark, decontaminate.WINDOW, 60))) > 4
    one, several = (
        {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, block_bytes=n).collect()}
        for n in (decontaminate.BLOCK_BYTES, 60)
    )
    assert several == one
    assert [(one[i] or "").split() for i in range(len(texts))] == [
        *[["before", "after"]] * 6, *[[]] * 4, ["clean", "text"], [], []
    ]


def test_suffix_array():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 200):
        text = np.append(rng.integers(1, 3, n), 0)
        assert list(decontaminate.suffix_array(text)) == sorted(range(n + 1), key=lambda i: list(text[i:]))


# --- secrets ------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def test_secret_spans_equal_regexes(spark):
    rng = random.Random(6)
    parts = ["token", "api_key", "AKIA", "secret", "Passwd", "abcdef0123", "0" * 8, "=", ":", " ", '"', "\n", "é",
             "A" * 9, "12345678", "ghp_", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "é" * 3000 + "token = abcdefgh", "0a" * 40_000]
    for r in secrets.scan_secrets(docs_of(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = ("assign", "access", "hex")
        spans = [f"{names[k]}:{a}:{b}" for a, k, b in sorted(want)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_secret_matches_take_time_in_proportion():
    compiled = secrets.compile_rules()
    rng = random.Random(7)
    whole = [re.compile(f"{r.head}{r.body}+".encode(), re.I if r.any_case else 0) for r in compiled.rules]
    head = [re.compile(r.head.encode(), re.I if r.any_case else 0) for r in compiled.rules]
    parts = [b"eyJ", b"eyJhb", b".", b"/", b"a", b"token", b"=", b" ", b"ghp_", b"x" * 20, b"\xc3\xa9"]
    for _ in range(150):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        for i, rule in enumerate(compiled.rules):
            # Greedy on these rules is longest.
            want = [m.span() for m in whole[i].finditer(data) if m.end() - head[i].match(data, m.start()).end() >= rule.least]
            assert secrets.matches(compiled, i, data) == want
    data = b"eyJ" * 350_000 + b"/eyJaaa.bbb.cccccccccccc"
    begin = time.perf_counter()
    found = [secrets.matches(compiled, i, data) for i in range(len(compiled.rules))]
    assert time.perf_counter() - begin < 30  # a walk from every start would take days
    assert sum(map(len, found)) == 1


# --- packing ------------------------------------------------------------------------------


def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = ["word " * rng.randrange(400) + "Straße\n\n x" for _ in range(60)]
    texts += [None, "", "a   b  c ", "<|endoftext|> x", "y" * 30_000, " z", "\n"]
    rows = packing.pack(docs_of(spark, texts), with_ids=True).collect()
    whole = Tokenizer.from_file(packing.tokenizer_file())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            at += r["length"]
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= packing.SEQUENCE


# --- models -------------------------------------------------------------------------------


def sentences(rng, kind, count):
    words = {"aa": "tra lo mi sen", "bb": "kö üt ach zen"}[kind].split()
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(count))


def test_language_learns_and_rejects(spark):
    rng = random.Random(8)
    rows = [(i, sentences(rng, kind, 30), kind) for i in range(200) for kind in ("aa", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.labelled_rows(docs, F.col("lang"), F.lit(True)))
    texts = [sentences(rng, "aa", 20), sentences(rng, "bb", 20), None, "", "123 !", "é", "x" * 50_000]
    labels, score, rejected = langid.predict_texts(model, pa.array(texts))
    assert labels[:5] == ["aa", "bb", "und", "und", "und"] and labels[5] in ("aa", "bb")
    assert list(rejected[:5]) == [False, False, True, True, True] and ((score >= 0) & (score <= 1)).all()
    none = langid.train(langid.labelled_rows(docs.limit(0), F.col("lang"), F.lit(True)))
    assert langid.predict_texts(none, pa.array(["a"]))[0] == ["und"]


def test_toxicity_learns(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice("the of and a in day sun".split()) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "scum"])
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts[:240], labels[:240], 1 / 3)
    score = toxicity.score_texts(model, [*texts[240:], b"", b"fine " * 20_000])
    right = (score[:60] >= 0.5) == np.array(labels[240:], dtype=bool)
    assert right.mean() > 0.9 and ((score >= 0) & (score <= 1)).all() and score[60] < 0.5
    assert toxicity.score_texts(toxicity.fit([], [], 0.0), [b"x"])[0] < 0.5


def test_lm_base_scores(spark):
    texts = [*["The cat sat on the mat", "the dog", None, "", "a\tB\nunseen" + "q" * 9000] * 6, "only here"]
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r for r in lm_score.lm_score(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""] for t in texts]
    counts = defaultdict(int)
    for i, own in enumerate(tokens):
        for w in own if not held[i] else ():
            counts[w] += 1
    total, distinct = sum(counts.values()), len(counts)
    for i, own in enumerate(tokens):
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(own), total)
        assert r["n_known"] == sum(w in counts for w in own)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def lm_bins(counts):
    """Exact totals of a {word: count}."""
    bucket = lm_score.bucket_of(lm_score.hashes_of(list(counts)))
    tokens, words = np.zeros(lm_score.BUCKETS), np.zeros(lm_score.BUCKETS)
    np.add.at(tokens, bucket, list(counts.values()))
    np.add.at(words, bucket, 1)
    return lm_score.Bins(int(tokens.sum()), len(counts), tokens, words)


def test_lm_probabilities_add_up_to_one_after_training():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(700)]
    texts = [b" ".join(words[min(699, int(rng.expovariate(0.01)))] for _ in range(30)) for _ in range(400)]
    learned = lm_score.stream_of(texts)
    counts = defaultdict(int)
    for text in texts:
        for word in lm_score.tokens_of(text):
            counts[word] += 1
    bins = lm_bins(counts)
    trainer = lm_score.Trainer(lm_score.starting(bins))
    kinds = [*counts, b"never seen"]
    c = np.array([float(counts.get(k, 0)) for k in kinds])

    def of_all(before):
        """Probabilities of every kind of token after the two words."""
        flat = [x for k in kinds for x in (*before, k)]
        stream = lm_score.Stream(lm_score.hashes_of(flat), np.arange(0, len(flat) + 1, 3))
        every = lm_score.log10_tokens(trainer.w, bins, stream, np.array([1.0 * counts.get(x, 0) for x in flat]))
        return 10 ** every[2::3]

    base = (c + 0.5) / (c.sum() + 0.5 * (len(counts) + 1))
    assert np.allclose(of_all([b"w1", b"w2"]), base, rtol=1e-3)  # where training starts
    seen = np.array([1.0 * counts[w] for t in texts for w in lm_score.tokens_of(t)])
    before = lm_score.log10_tokens(trainer.w, bins, learned, seen).sum()
    trainer.learn(learned)
    assert lm_score.log10_tokens(trainer.w, bins, learned, seen).sum() > before
    for context in ([b"w1", b"w2"], [b"w3", b"never seen"], [b"", b""]):
        assert abs(of_all(context).sum() - 1) < 1e-4


def test_lm_contexts_grow_with_the_tokens():
    sizes = [lm_score.contexts_for(10**i) for i in range(14)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 8 and sizes[8] == 1 << 10 and sizes[10] > sizes[8]
    assert all(lm_score.unflat(lm_score.starting(lm_bins({b"a": n})).flat()).contexts == lm_score.contexts_for(n)
               for n in (1, 10**8))


def test_lm_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lm_score, "hashes_of", lambda words: np.array([len(w) for w in words], dtype=np.uint64))
    words = [b"a", b"bb", b"cc", b"ddd", b"bb"]  # one word twice, two words of one hash
    known = lm_score.Known(words, np.array([1.0, 2.0, 3.0, 4.0, 2.0]))
    asked = [b"cc", b"ddd", b"bb", b"a", b"cc"]
    assert known.counts_of(asked, lm_score.hashes_of(asked)).tolist() == [3, 4, 2, 1, 3]
    assert lm_score.Known([b"a", b"a"], np.ones(2)).counts_of([b"a"], lm_score.hashes_of([b"a"])).tolist() == [1]


def test_lm_model_beats_the_base_on_held_out_documents(spark):
    for sf in ("0.01", "0.1"):
        found = QUERIES["op10_lm_score"](spark, f"/root/testdata/sf{sf}")
        held = found.where("held_out").agg(*(F.sum(x).alias(x) for x in ("score", "base_score", "n_tokens"))).first()
        model, base = held["score"] / held["n_tokens"], held["base_score"] / held["n_tokens"]
        print(f"sf{sf}: log10 a held-out token, model {model:.3f}, base {base:.3f}")
        assert model > base


def test_lm_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a c"), (None, None), (7, ""), (7, "\x0b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x"))
    got = lm_score.lm_score(docs.withColumn("word", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [
        ("1", 3), ("1", 3), ("7", 1), ("7", 1), ("None", 1), ("None", 3)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert lm_score.lm_score(docs.where("doc_id = 5")).collect() == []


def test_pipeline_near_copies_with_odd_ids(spark):
    import corpus_pipeline

    body = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcde"}
    near = body["a"].replace("a39", "z")
    rows = [(1, body["a"]), (2, near), (2, body["b"])]  # one id on a near copy and on other text
    rows += [(3, body["c"]), (3, body["c"]), (None, body["d"]), (None, body["d"])]  # equal rows
    rows += [(None, body["e"]), (9, body["e"]), (None, near), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()]
    want = [(1, body["a"]), (2, body["b"]), (3, body["c"]), (None, body["d"]), (9, body["e"]), (4, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    now = docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, now, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
        now = out
    before = spark.read.parquet(str(tmp_path / "benchmark"))
    assert {r[0] for r in now.select("doc_id").distinct().collect()} == {
        r[0] for r in before.select("doc_id").collect()
    }
