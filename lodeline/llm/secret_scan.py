"""Secrets in texts: known shapes by pattern, random strings by their token efficiency.

Language is cheap for a subword vocabulary: words of four languages, invented ones included, take
one token for two characters and more. Random strings take nearly one per character. So a run
of key characters with few characters per token is random, and what remains is to leave out the random
strings that are no secrets: digests, UUIDs, numbers, and identifiers made of words and numbers.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import map_arrow

# The patterns of the base kinds, in their order, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "dense")
_named = ("passw", "secret", "token", "apikey", "api_key")

# Runs that may be random. What touches an accented Latin letter is part of a word.
MIN_CHARS = 20
_run = re.compile(rf"(?<![A-Za-z0-9+/_=~À-ɏ-])[A-Za-z0-9+/_=~-]{{{MIN_CHARS},}}+(?![À-ɏ])")
# Characters per token below which a run is random; letters of one case need to be rarer still.
MAX_RATIO = 1.8
MAX_RATIO_LETTERS = 1.5
# Mean length of the words and numbers of an identifier; parts of random strings are shorter.
MIN_PART = 3.0
# Lengths of common digests in hexadecimal, names before digests in base 64.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_digest_name = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-=]", re.I)
_hex_only = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch
_uuid = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I).fullmatch
_no_letters = re.compile(r"[^A-Za-z]+").fullmatch
_one_case = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").fullmatch
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+").findall
_state: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _state:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _state[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _state[path]


def known(run: str) -> bool:
    """A digest, a UUID, a number, or an identifier of words and numbers."""
    if _no_letters(run) or _uuid(run) or _digest_name.match(run):
        return True
    if _hex_only(run) and len(run) in DIGEST_CHARS:
        return True
    parts = _parts(run)
    return len(parts) > 1 and sum(map(len, parts)) / len(parts) >= MIN_PART


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of what the patterns find."""
    spans = []
    low = text.lower()
    if any(name in low for name in _named):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def dense_spans(text: str, base: list[tuple[int, int, int]], encode) -> list[tuple[int, int, int]]:
    """Random runs outside the ``base`` spans, by characters per token."""
    found, taken, at = [], sorted((s, e) for s, _, e in base), 0
    reach = 0
    for m in _run.finditer(text):
        run = m.group().strip("-_/+~").lstrip("=")
        if len(run) < MIN_CHARS or text.endswith("base64,", 0, m.start()):
            continue
        start = m.start() + m.group().index(run)
        end = start + len(run)
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > start or known(run):
            continue
        limit = MAX_RATIO_LETTERS if _one_case(run) else MAX_RATIO
        if len(run) < limit * len(encode(run)):
            found.append((start, 3, end))
    return found


def find_secrets(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end), by start, then kind in order of ``KINDS``.

    Offsets count code points, the end is exclusive. ``assign``, ``access`` and ``hex`` are the leftmost
    matches of their patterns, which may overlap other kinds; ``dense`` are random runs outside them.
    ``ranks`` is the path of a rank file that every machine has, ``pattern`` what splits text before its
    merges. A null or empty text has no secrets. A column ``secrets`` is replaced; any others stay.
    """
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(part: pa.RecordBatch):
        encode = _encoder(ranks, pattern).encode_ordinary
        out = []
        for t in part[at].to_pylist():
            spans = base_spans(t) if t else []
            if t:
                spans = sorted(spans + dense_spans(t, spans, encode))
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, schema)], [*part.schema.names, "secrets"])

    docs = docs.drop("secrets")
    names = docs.columns
    at = names.index(text)
    # By position, as names with dots do not pass to Arrow functions.
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    added = docs.select("*", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("secrets"))
    return map_arrow(docs, run, added.schema).toDF(*names, "secrets")


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined; empty without any."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with every character of a secret replaced by ``*``; a null text stays null."""
    found = find_secrets(docs, ranks, pattern, text)
    last = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    col = F.col(f"`{text}`")

    def step(acc, s):
        start = F.greatest(acc["at"], s["start"])
        end = F.greatest(start, s["end"])
        kept = F.substring(col, (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        return F.struct(F.concat(acc["out"], kept, F.repeat(F.lit("*"), (end - start).cast("int"))).alias("out"), end.alias("at"))

    whole = lambda acc: F.concat(acc["out"], F.substring(col, (acc["at"] + 1).cast("int"), F.length(col)))
    return found.withColumn(text, F.aggregate("secrets", last, step, whole)).drop("secrets")
