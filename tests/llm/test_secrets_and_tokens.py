"""Secret scan and token alignment against brute force, with the cases of nulls, long texts, repeats and clashing names."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from lodeline.llm import secret_scan as ss
from lodeline.llm import token_alignment as ta
from lodeline.llm.catalog import vocabulary

SF = "/root/testdata/sf0.001"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
RANKS = vocabulary("byte_bpe_50k.tiktoken")
rng = random.Random(11)
RANDOM = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_brute(text):
    """The base patterns as the contract writes them: all matches, then those too short dropped."""
    spans = []
    for kind, pattern, flags, fits in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) > 5),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) > 19),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) > 23),
    ):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "", flags) if fits(m)]
    return sorted(spans, key=lambda s: (s[1], ss.KINDS.index(s[0])))


def test_op12(spark):
    larger = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    got = entry.queries()["op12_secret_scan"](spark, larger).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    n = 0
    for r in got:
        base = base_brute(docs[r["doc_id"]])
        n += len(base)
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[0] == k for b in base) for k in ss.BASE_KINDS]
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [(k, int(s), int(e)) for k, s, e in spans if k != "dense"] == base
        assert r["n_dense"] == 0
    assert n


CASES = {
    f"my key is {RANDOM} ok": [f"dense:10:{10 + len(RANDOM)}"],
    f"é ü {RANDOM}": [f"dense:4:{4 + len(RANDOM)}"],
    f"PassWord = '{RANDOM}'": [f"assign:0:{12 + len(RANDOM)}"],
    "ſecret=abcdefgh toKen=abcdefgh": [],
    "token=abc token: abcdef": ["assign:10:23"],
    "AKIA" + "B" * 16 + " AKIA" + "B" * 15: ["access:0:20"],
    "f" * 24 + "F" + "0" * 23: ["hex:0:24"],
    "secret:" + "ab12" * 6: ["assign:0:31", "hex:7:31"],
    hashlib.sha1(b"x").hexdigest().upper(): [],
    "550E8400-E29B-41D4-A716-446655440000": [],
    "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=": [],
    "data:image/png;base64," + RANDOM: [],
    "getHTTPResponseCodeForServer my_variable_name_for_counting org/apache/spark/sql/catalyst": [],
    "JIRA-2024-000123-ABC user_id_2024_01_31_backup 4984469013682918 2024-01-31_10-20-30": [],
    "Donaudampfschifffahrtsgesellschaft internationalization " * 3: [],
    "leelleauxeneaumentonêpaelleauxeneau": [],
}


@pytest.mark.parametrize("text", CASES)
def test_spans(text):
    base = ss.base_spans(text)
    encode = ss._encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary
    spans = sorted(base + ss.dense_spans(text, base, encode))
    assert [f"{ss.KINDS[k]}:{s}:{e}" for s, k, e in spans] == CASES[text]


def test_random_strings_are_found_and_words_are_not():
    encode = ss._encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary
    found = sum(
        bool(ss.dense_spans(f"a {''.join(rng.choice(string.ascii_letters + string.digits + '+/') for _ in range(32))} b", [], encode))
        for _ in range(500)
    )
    assert found >= 495
    words = ["".join(rng.choice("the ing tion ver lich heit que elle eau ment ente".split()) for _ in range(7)) for _ in range(500)]
    assert not any(ss.dense_spans(w, [], encode) for w in words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="tokensecrpawd_=: \"'AKI09afé\n", max_size=120))
def test_base_patterns(text):
    assert [(ss.KINDS[k], s, e) for s, k, e in ss.base_spans(text)] == base_brute(text)


def test_secret_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, f"token={RANDOM}", None), (3, f"token={RANDOM}", None), (None, "a " * 300_000 + RANDOM, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    df = df.withColumns({c: ss.F.lit(c) for c in ("secrets", "kind", "start", "_doc", "_keys")})
    out = ss.find_secrets(df, RANKS, public_tokenizers.PATTERN)
    assert sorted(out.columns) == sorted(df.columns)
    got = {(r["doc_id"], r["a.b"]): [tuple(s) for s in r["secrets"]] for r in out.collect()}
    assert out.count() == 5 and got[1, "x"] == got[2, "y"] == [] and got[3, None] == [("assign", 0, 46)]
    assert got[None, "z"] == [("dense", 600_000, 600_040)]
    hidden = {r["doc_id"]: r["text"] for r in ss.masked(df, RANKS, public_tokenizers.PATTERN).where("doc_id is not null").collect()}
    assert hidden == {1: None, 2: "", 3: "*" * 46}
    assert ss.find_secrets(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_alignment(texts):
    """Whole texts encoded at once; groups from common ends; links from all overlapping ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    enc = ta._Encoders(A, B)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    per_doc = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        ea, eb = np.cumsum([0, *(len(enc.bytes_a[i]) for i in x)]), np.cumsum([0, *(len(enc.bytes_b[i]) for i in y)])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(enc.bytes_a[i] for i in x) != raw or b"".join(enc.bytes_b[i] for i in y) != raw:
            per_doc.append(None)
            continue
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups = []
        for lo, hi in zip(cuts, cuts[1:]):
            side = [",".join(str(i) for i, e in zip(ids, ends[1:]) if lo < e <= hi) for ids, ends in ((x, ea), (y, eb))]
            groups.append("|".join(side))
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(max(0, np.searchsorted(eb, ea[i], "right") - 1), len(y))
                 if eb[j] < ea[i + 1] and ea[i] < eb[j + 1]] if len(x) < 60 else _links(x, y, ea, eb)
        per_doc.append((len(x), len(y), groups, links))
    counts = defaultdict(int)
    for d in per_doc:
        for pair in set(d[3]) if d else ():
            counts[pair] += 1
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for d in per_doc:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        best = sum(counts[p] == top[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), sha(";".join(groups))))
    return out


def _links(x, y, ea, eb):
    """Every stretch between neighbouring ends of either side lies in one token of each."""
    ends = np.union1d(ea[1:], eb[1:])
    return [(x[i], y[j]) for i, j in zip(np.searchsorted(ea[1:], ends), np.searchsorted(eb[1:], ends))]


def spark_alignment(spark, texts):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    df = df.withColumns({c: ta.F.lit(1) for c in ("row", "pair", "pairs", "times", "a.b", "best")}).repartition(3)
    return [tuple(r)[1:] for r in sorted(ta.align_documents(df, A, B).collect())]


def test_op13(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = entry.queries()["op13_token_alignment"](spark, SF)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    want = brute_alignment([r["text"] for r in rows])
    assert sorted(tuple(r) for r in got.collect()) == [(r["doc_id"], *w) for r, w in zip(rows, want)]


ODD = [
    None, "", " ", "  ", "\n", " \n", "a\n b", "a  b", " a", "a ", "   x   y ", "\xa0 x", "a b  c", "<s>hi</s> <unk> <|endoftext|> <0x41>",
    "▁under", "a ▁ b", "a\x00b\x1c c", "ééé 日本語 текст 🙂🙂 👨‍👩‍👧", "don't I'll we've", "12345 67.89 -- ...", "word " * 5000, "x" * 20000,
    "same text", "same text", "tab\tand \t tab", "ﬁ Ａ ½", "́a é",
]


def test_alignment_cases(spark, monkeypatch):
    want = brute_alignment(ODD)
    assert spark_alignment(spark, ODD) == want
    assert [w[0] for w in want[:2]] == [0, 0] and sum(w[0] == 0 for w in want) >= 4
    monkeypatch.setattr(ta, "HEAD", 3)
    assert spark_alignment(spark, ODD) == want
    assert ta.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\tTheé1-'▁日　"), max_size=60))
def test_units_encode_like_whole_texts(text):
    enc = _enc()
    (got,) = enc.encode([text])
    x = _whole_a().encode(" " + text, add_special_tokens=False).ids if text else []
    y = enc.b.encode(text) if text else []
    raw = (" " + text).encode()
    kept = bool(text) and b"".join(enc.bytes_a[i] for i in x) == raw == b"".join(enc.bytes_b[i] for i in y)
    assert (got is not None) == kept
    if kept:
        assert got[0].tolist() == x and got[1].tolist() == y


def _enc():
    return ta._encoders(A, B)


@functools.cache
def _whole_a():
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_align(data):
    end = data.draw(st.integers(1, 60))
    ends = [sorted({*data.draw(st.sets(st.integers(1, end), max_size=40)), end}) for _ in range(2)]
    stretches, groups = ta.align(*(np.array(e, np.int64) for e in ends))
    got = sorted([(i + t, i + t + 1, j + t, j + t + 1) for i, j, k in stretches for t in range(k)] + groups)
    common = sorted(set(ends[0]) & set(ends[1]))
    want, i, j = [], 0, 0
    for c in common:
        p, q = ends[0].index(c) + 1, ends[1].index(c) + 1
        want.append((i, p, j, q))
        i, j = p, q
    assert got == want


def test_long_runs_are_jumped(monkeypatch):
    ends = np.arange(1, 100_001, dtype=np.int64)
    stretches, groups = ta.align(ends, ends)
    assert stretches == [(0, 0, 100_000)] and not groups
    shifted = np.delete(ends, 500)
    stretches, groups = ta.align(ends, shifted)
    assert groups == [(500, 502, 500, 501)] and [k for _, _, k in stretches] == [500, 99_498]
