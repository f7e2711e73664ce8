"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.llm import language_id, lattice_lm
from lodeline.llm import decontaminate as dc
from lodeline.llm import line_dedup as ld
from lodeline.llm.catalog import vocabulary
from lodeline.llm.common import UPPER
from lodeline.llm.components import components
from lodeline.llm.cuckoo import CuckooFilter
from lodeline.llm.packing import OPEN_BINS, best_fit, pack_documents, sequences
from lodeline.llm.simhash import keep_one, near_duplicates, near_links, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = " \t\n\x0b\x0c\r"
LONG = "A line that many of the documents hold, Again and again."


def low(s):
    return s.translate(str.maketrans(UPPER, UPPER.lower()))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def doc(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = "the of And to éclair Straße x1 naïve data, spark: ÉTÉ a b".split(" ")
    rows = [doc(1, None), doc(2, ""), doc(3, "\n\n"), doc(4, "..."), doc(5, "word"), doc(6, "word " * 3000)]
    for i in range(7, 60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(0, ("\t" if i % 2 else "") + (LONG if i % 4 else LONG.upper()) + " ")
        rows.append(doc(i, "\n".join(lines)))
    rows += [doc(60, rows[20][1]), doc(61, rows[20][1] + " tail"), rows[30]]
    return rows


# Line dedup.
def dedup_brute(rows, min_docs=3, min_chars=20):
    key = lambda x: low(x.strip(BLANK))
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(x.strip(BLANK)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(held[key(x)]) < min_docs or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def dedup_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "text").collect()))


def test_line_dedup(spark, docs):
    got = ld.dedup_lines(frame(spark, docs).withColumn("n_lines", F.lit("mine")).withColumn("keys", F.lit(1)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "keys", "n_lines", "n_dropped"]
    assert dedup_rows(got) == dedup_brute(docs)
    assert sum(r[2] for r in dedup_rows(got)) > 10


def test_line_dedup_without_sent_filters(spark, docs, monkeypatch):
    monkeypatch.setattr(ld, "MAX_SENT_BYTES", 0)
    assert dedup_rows(ld.dedup_lines(frame(spark, docs))) == dedup_brute(docs)


def test_line_dedup_is_reversible(spark, docs):
    a, b, c = (frame(spark, [d for d in docs[:-1] if d[0] % 3 == k]) for k in (0, 1, 2))
    index = ld.LineIndex(spark).insert(a).insert(b)
    before = sorted(map(tuple, index.repeated.select("k1", "k2", "n_docs", "top").collect()))
    index.insert(c)
    assert dedup_rows(index.dedup(frame(spark, docs[:-1]))) == dedup_brute(docs[:-1])
    index.delete(c)
    assert sorted(map(tuple, index.repeated.select("k1", "k2", "n_docs", "top").collect())) == before
    index.delete(a)
    only_b = [d for d in docs[:-1] if d[0] % 3 == 1]
    assert dedup_rows(index.dedup(b)) == dedup_brute(only_b)
    index.delete(b)
    assert index.repeated.count() == 0
    entries = sum((t != 0).sum() for r in index.filters.collect() for t in CuckooFilter.from_bytes(bytes(r["filter"])).layers)
    assert entries == 0


def test_line_dedup_edges(spark):
    empty = ld.dedup_lines(frame(spark, []))
    assert empty.count() == 0
    # Ties: the largest id keeps every occurrence; a row without an id neither counts nor loses.
    rows = [doc(1, LONG), doc(2, LONG), doc(3, f"{LONG}\nx\n{LONG}"), doc(None, LONG)]
    assert sorted(ld.dedup_lines(frame(spark, rows)).select("doc_id", "n_dropped").collect(), key=str) == [
        (1, 1), (2, 1), (3, 0), (None, 0)
    ]
    # Two documents are too few, however often a row is repeated.
    rows = [doc(1, LONG), doc(1, LONG), doc(1, LONG), doc(2, LONG)]
    assert ld.dedup_lines(frame(spark, rows)).agg(F.sum("n_dropped")).first()[0] == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200), st.integers(1, 4))
def test_cuckoo_filter(moves, buckets):
    f, held = CuckooFilter(buckets), Counter()
    hashed = lambda k: np.frombuffer(hashlib.blake2b(str(k).encode(), digest_size=16).digest(), "<i8")
    for put, k in moves:
        k1, k2 = map(int, hashed(k))
        if put:
            f.insert(k1, k2)
            held[k] += 1
        elif held[k]:
            assert f.delete(k1, k2)
            held[k] -= 1
    f = CuckooFilter.from_bytes(f.to_bytes())
    for k, n in held.items():
        if n:
            assert f.contains(*hashed(k).reshape(2, 1))[0]
    assert sum((t != 0).sum() for t in f.layers) == sum(held.values())


# SimHash.
def simhash_brute(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", low(text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_brute(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_simhash_values(docs):
    for d in docs:
        assert simhash(d[1]) == simhash_brute(d[1])


def test_near_duplicates(spark, docs):
    got = {(r.doc_id, r.fp, r.component_id) for r in near_duplicates(frame(spark, docs)).collect()}
    fps = {d[0]: simhash_brute(d[1]) for d in docs}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = groups_brute(fps, links)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == {(i, signed(fps[i]), root[i]) for i in fps}
    assert near_duplicates(frame(spark, docs)).count() == len(docs)
    kept = keep_one(frame(spark, docs).withColumn("fp", F.lit(0)))
    assert {r.doc_id for r in kept.collect()} == set(root.values()) and kept.columns[-1] == "fp"
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_links_are_all_pairs_once(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = list({b ^ sum(1 << p for p in rng.sample(range(64), k)) for b in base for k in (0, 1, 1, 2, 2, 3, 3)})
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = sorted(tuple(sorted(r)) for r in near_links(spark.createDataFrame(rows, "fp long, rep long")).collect())
    want = sorted((a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == want and len(want) > 40


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    odd = [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(1, 1), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()))
    real = [(a, b) for a, b in chain + star + odd if a is not None and a != b]
    assert got == groups_brute({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Lattice language model.
def test_lattice_sums_all_segmentations():
    p = lattice_lm.pieces_of(vocabulary())
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(p.size)))
    lattice = lattice_lm.Lattice(p, log_p)
    by = {s: log_p[i] for i, s in p.spelled.items()}
    for word in (b"the", b"a", "été".encode(), b"nations", b"\xff\x00"):
        s = word.decode("latin-1") + lattice_lm.FINAL
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            if all(x in by for x in parts):
                total += math.exp(sum(by[x] for x in parts))
        assert lattice.log_prob(word) == pytest.approx(math.log(total), rel=1e-9)


def test_merges_are_the_tokenizers_own():
    p = lattice_lm.pieces_of(vocabulary())
    for word in ("the", "thereofing", "straße", "été", "zzxqj"):
        own = p.tokenizer.encode(word, add_special_tokens=False).ids
        assert [t.id for t in p.merge(word.encode().decode("latin-1").translate(p.stand_in))] == own


def test_word_probabilities_sum_to_one():
    counts = {"a": 5, "b": 1, "c": 1, "d": 2}
    n1, n2 = 2, 1
    end, log_p = lattice_lm.word_model(9, 4, n1, n2, 3)
    spelled = {w: math.log(0.1) for w in "abcdefghij"}
    total = math.exp(end) + sum(math.exp(log_p(counts.get(w, 0), s)) for w, s in spelled.items())
    assert total == pytest.approx(1)
    end, log_p = lattice_lm.word_model(0, 0, 0, 0, 0)
    assert math.exp(end) + sum(math.exp(log_p(0, s)) for s in spelled.values()) == pytest.approx(1)


def test_lattice_scores(spark, docs, monkeypatch):
    def run():
        return lattice_lm.lattice_scores(frame(spark, docs).withColumn("train", F.lit("x")), vocabulary()).collect()

    got = sorted(map(tuple, run()))
    monkeypatch.setattr(lattice_lm, "HEAD", 0)  # no word is sent: all meet the table by a join
    for a, b in zip(got, sorted(map(tuple, run()))):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", low(t or "")) if x] + ["\0end"]
    c = Counter(w for i, t, *_ in docs if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    p = lattice_lm.pieces_of(vocabulary())
    counts = np.zeros(p.size)
    for w in c:
        if w != "\0end":
            for t in p.merge(w.encode().decode("latin-1").translate(p.stand_in)):
                counts[t.id] += 1
    used = [*p.spelled]
    log_p = np.full(p.size, -np.inf)
    log_p[used] = np.log((counts[used] + 0.5) / (counts[used].sum() + 0.5 * len(used)))
    assert np.exp(log_p).sum() == pytest.approx(1)
    lattice = lattice_lm.Lattice(p, log_p)
    ends = c["\0end"]
    m, types = n - ends, v - 1
    n1, n2 = (sum(k == x for w, k in c.items() if w != "\0end") for x in (1, 2))
    d = min(0.95, max(0.1, n1 / (n1 + 2 * n2)))
    p_end = (ends + 0.5) / (n + 1)
    prob = lambda w: (1 - p_end) * (max(0, c[w] - d) / m + d * types / m * math.exp(lattice.log_prob(w.encode())))
    want = []
    for i, t, *_ in docs:
        ws = words(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = sum(math.log10(prob(w)) for w in ws[:-1]) + math.log10(p_end)
        want.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lattice_lm.lattice_scores(frame(spark, []), vocabulary()).count() == 0


# Decontamination.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BENCH = [(1, "one two Three four five six seven eight nine ten eleven"), (2, "short, ITEM"), (3, None), (4, "..."),
         (10, "one two three four five six seven eight nine ten"), (2, "short item")]


def hits_brute(rows, bench):
    wins = defaultdict(set)
    for i, t in bench:
        w = WORD.findall(low(t or ""))
        for p in range(len(w) - min(10, len(w)) + 1 if w else 0):
            wins[tuple(w[p : p + 10])].add(str(i))
    out = []
    for i, t, *_ in rows:
        w, hit, items = WORD.findall(low(t or "")), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[p : p + k]))) is not None:
                    hit |= set(range(p, p + k))
                    items |= found
        out.append((i, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaked(docs):
    text = "Intro. One, two three-four five six seven eight nine ten eleven; end"
    return [*docs, doc(70, text), doc(71, text + " and " + text), doc(72, "a short item, short item short item"), doc(None, text),
            doc(73, "one two three four five six seven eight nine"), doc(74, "éone two three four five six seven eight nine ten")]


@pytest.mark.parametrize("bench", [BENCH, BENCH[:1], []])
def test_contamination(spark, leaked, bench):
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = hits_brute(leaked, bench)
    for sent in (dc.MAX_SENT_WINDOWS, 0):
        got = dc.contamination(frame(spark, leaked).withColumn("row", F.lit(1)), b, max_sent=sent)
        got = got.select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert dc.contamination(frame(spark, []), b).count() == 0


def test_remove_documents_and_spans(spark, leaked):
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    d = frame(spark, leaked).withColumn("w", F.lit(1))
    kept = dc.remove_documents(d, b)
    clean = [x[0] for x in hits_brute(leaked, BENCH) if not x[2]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str) and kept.columns == d.columns
    cut = {r.doc_id: r.text for r in dc.remove_spans(d, b).collect()}
    assert cut[70] == "Intro. ,  -       ; end"
    assert cut[1] is None and cut[72] == "a  ,    " and cut[73] == "one two three four five six seven eight nine"
    assert sum(n for _, n, *_ in hits_brute([doc(i, t) for i, t in cut.items()], [])) == sum(
        n - h for i, n, h, _ in hits_brute({x[0]: x for x in leaked}.values(), BENCH)
    )


# Packing.
def check_packing(rows, got, size=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            cut = np.array(ids[at : at + size], "<u4")
            want[(i, k, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by), sum(r.length for r in got)


def test_packing(spark, docs):
    odd = [doc(80, "x y\x1cz ́e é <|endoftext|> Don't stop!!"), doc(81, "İ ΑΣ ß ﬁ 1234   a"), doc(None, "no id")]
    rows = docs + odd
    n, tokens = check_packing(rows, pack_documents(frame(spark, rows).withColumn("row", F.lit(1)), vocabulary()).collect())
    assert n <= math.ceil(tokens / 2048) + 1
    assert pack_documents(frame(spark, []), vocabulary()).count() == 0
    whole = sequences(frame(spark, rows), vocabulary()).collect()
    assert len(whole) == n and sum(len(bytes(r.ids)) // 4 for r in whole) == tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300), st.sampled_from([1, 3, 1000]))
def test_best_fit(lengths, open_bins):
    size, free = 40, {}
    for length, b, o in zip(lengths, *best_fit(lengths, size, open_bins), strict=True):
        if open_bins == 1000:  # nothing closes early: the fullest bin that fits, or a new one
            fits = [f for f in free.values() if f >= length]
            assert free.get(b, size) == (min(fits) if fits and length < size else size)
        assert o == size - free.get(b, size)
        free[b] = free.get(b, size) - length
        assert free[b] >= 0
    assert sorted(free) == list(range(len(free)))


def test_open_bins_are_few_and_close(docs):
    """Pieces in input order: few open bins give another packing than no bound, at about the same number of sequences."""
    rng = random.Random(2)
    lengths = [2048 if rng.random() < 0.2 else rng.randint(20, 1400) for _ in range(20_000)]
    some, all_open = best_fit(lengths, 2048, OPEN_BINS)[0], best_fit(lengths, 2048, 10**9)[0]
    least = sum(lengths) / 2048
    assert OPEN_BINS <= 512 and some != all_open
    assert max(some) + 1 <= 1.02 * least and max(all_open) + 1 <= max(some) + 1


def test_best_fit_closes_the_fullest_first():
    assert best_fit([30, 20, 10, 9], 40, 1)[0] == [0, 1, 1, 1]
    assert best_fit([30, 20, 10, 9], 40, 2)[0] == [0, 1, 0, 1]


# Language identification.
def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs, ~held)
    assert model == language_id.fit(docs.repartition(7), ~held)
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "Привет, как дела сегодня", "en"), (5, "the", None)]
    got = language_id.predict(docs.where(held).withColumn("score", F.lit("x")), model).collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert right > 0.97 and sum(r.rejected for r in got) == 0
    assert all(0 <= r.score <= 1 for r in got)
    p = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model).collect()}
    assert all(p[i].lang_pred == "und" and p[i].rejected and p[i].score == 0 for i in (1, 2, 3))
    assert p[4].rejected and p[4].lang_pred != "und"
    assert not p[5].rejected
    none = language_id.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), none).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Ab c, déf!! ghi " * 7 + "…ß"
    whole = language_id.ngram_counts(text)
    for block in (1, 2, 3, 5, 16):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert (language_id.ngram_counts(text) == whole).all()
