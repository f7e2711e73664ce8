"""Alignment of two tokenizations of the same bytes.

A text is encoded by a byte-level vocabulary A and a piece vocabulary B; both give the byte offsets
where tokens end. Equal stretches are jumped along the diagonal: from a common boundary, slices of both
end arrays at the current index shift are compared, doubled while equal and halved to the first
difference. There the irregular group is walked to its next common end, which sets a new shift.

How often two ids meet is counted over all texts. Each text keeps its pairs with their numbers; pairs
in many texts are few and sent to the tasks, the others are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import byte_alphabet, map_arrow
from lodeline.session import stored

CACHE_UNITS = 400_000
SHORT_UNIT = 8
LONG_UNIT = 64
# Pairs that are sent to the tasks hold at least this share of all pairs, so they are at most as many.
HEAD = 200_000
BATCH = 256
CACHE_GROUPS = 500_000
FIRST_STEP = 2
# Fixed value: the pattern of words of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_cuts = re.compile(r"(?<! )(?= \S)").split
_odd = re.compile(r"(?:^| )(?:\s|\Z)").search
_byte_piece = re.compile(r"<0x([0-9A-Fa-f]{2})>").fullmatch
_state: dict = {}


class _Encoders:
    """Ids of both vocabularies, with a bounded cache of short units.

    A unit is a space and what follows up to the next space between other characters. A's pattern starts
    a new word there, and no piece of B goes on behind such a space, so units are encoded alone. Where a
    vocabulary B has such pieces, a text is one unit.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.bytes_a = _byte_level(a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _byte_piece(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}

    def units(self, text: str) -> list[str]:
        if self.whole:
            return [" " + text]
        if _odd(text):
            return [u for u in _cuts(" " + text) if u]
        return (" " + text.replace(" ", "\0 ")).split("\0") if "\0" not in text else [" " + w for w in text.split(" ")]

    def _encode(self, units: list[str]) -> None:
        of_b = self.bytes_b.__getitem__
        for unit, y in zip(units, self.b.encode([u[1:] for u in units], num_threads=1)):
            same = b"".join(map(of_b, y)) == unit.encode()
            self.cache[unit] = (array("i", self.a(unit)).tobytes(), array("i", y).tobytes()) if same else None

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both vocabularies, or None where a text is empty or its bytes are not kept."""
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            # Short units come back most often.
            kept = {u: v for u, v in cache.items() if len(u) <= SHORT_UNIT}
            cache.clear()
            if len(kept) < CACHE_UNITS // 2:
                cache.update(kept)
        split = [self.units(t) if t else [] for t in texts]
        new = [u for u in set().union(*split) if u not in cache]
        for lo in range(0, len(new), 4096):
            self._encode(new[lo : lo + 4096])
        out = []
        for units in split:
            found = list(map(cache.__getitem__, units))
            if not found or None in found:
                out.append(None)
            else:
                x, y = (np.frombuffer(b"".join(part), np.int32) for part in zip(*found))
                out.append((x, y))
        for u in new:
            if len(u) > LONG_UNIT:
                del cache[u]
        return out


def _byte_level(path: str):
    """(function from a text to ids, bytes of each id) of a byte-level vocabulary file.

    Where every merge makes the next id, as usual, ids are ranks and the quicker encoder gives the same.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab, merges = byte_alphabet(), spec["model"]["vocab"], spec["model"]["merges"]
    of = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in alphabet for c in token):  # a special token need not be
            of[i] = "".join(map(alphabet.__getitem__, token)).encode("latin-1")
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"].get("type") == "ByteLevel"
    plain = plain and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space")
    if plain and made == list(range(256, 256 + len(made))):
        import tiktoken

        ranks = {of[i]: i for i in [*made, *(i for i in vocab.values() if len(of[i]) == 1)]}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, of
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), of


def _encoders(a: str, b: str) -> _Encoders:
    if (a, b) not in _state:
        _state[a, b] = _Encoders(a, b)
    return _state[a, b]


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Stretches (i, j, n) of one-to-one tokens and irregular groups (i, i end, j, j end).

    Together, by i, they are all groups in order. Both arrays are rising int64 and end alike.
    """
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n, m, i, j = len(list_a), len(list_b), 0, 0
    stretches, groups = [], []
    while i < n:
        if list_a[i] == list_b[j]:
            # Double while the slices at this shift are equal, then halve to the first difference.
            k, step, room, grows = 1, FIRST_STEP, min(n - i, m - j), True
            while k < room and step:
                t = min(step, room - k)
                at, to = 8 * (i + k), 8 * (j + k)
                if raw_a[at : at + 8 * t] == raw_b[to : to + 8 * t]:
                    k += t
                    step = 2 * step if grows else step // 2
                else:
                    grows, step = False, t // 2
            stretches.append((i, j, k))
            i, j = i + k, j + k
            if i >= n:
                break
        p, q = i, j
        x, y = list_a[p], list_b[q]
        while x != y:
            if x < y:
                p += 1
                x = list_a[p]
            else:
                q += 1
                y = list_b[q]
        groups.append((i, p + 1, j, q + 1))
        i, j = p + 1, q + 1
    return stretches, groups


class _Written(dict):
    """One-to-one groups as text, by key; emptied when it holds too many."""

    def __missing__(self, key: int) -> str:
        if len(self) > CACHE_GROUPS:
            self.clear()
        self[key] = text = f"{key >> 32}|{key & 0xFFFFFFFF}"
        return text


_written = _Written()
_irregular: dict[tuple[bytes, bytes], tuple[str, list[int]]] = {}


def _group(a: bytes, b: bytes, size_a: np.ndarray, size_b: np.ndarray) -> tuple[str, list[int]]:
    """(text, link keys) of a group by the ids of its tokens, which tell where they end."""
    ids_a, ids_b = np.frombuffer(a, np.int32).tolist(), np.frombuffer(b, np.int32).tolist()
    p = q = 0
    x, y = size_a[ids_a[0]], size_b[ids_b[0]]
    keys = [ids_a[0] << 32 | ids_b[0]]
    while x != y:
        if x < y:
            p += 1
            x += size_a[ids_a[p]]
        else:
            q += 1
            y += size_b[ids_b[q]]
        keys.append(ids_a[p] << 32 | ids_b[q])
    return ",".join(map(str, ids_a)) + "|" + ",".join(map(str, ids_b)), keys


def linked(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[str, int, np.ndarray]:
    """(groups as text, number of groups, key of each link: id of A above 32 bits, id of B below).

    ``size_a`` and ``size_b`` are the bytes of every id of a vocabulary. Irregular groups come back, so
    what they look like is kept for some of them.
    """
    stretches, groups = align(size_a[ids_a].cumsum(), size_b[ids_b].cumsum())
    keys = np.zeros(0, np.int64)
    if stretches:
        first_a, first_b, long = np.array(stretches).T
        inside = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        keys = (ids_a[np.repeat(first_a, long) + inside].astype(np.int64) << 32) | ids_b[np.repeat(first_b, long) + inside]
    single = list(map(_written.__getitem__, keys.tolist()))
    if not groups:
        return ";".join(single), len(single), keys
    raw_a, raw_b = ids_a.tobytes(), ids_b.tobytes()
    text: list[str] = []
    more: list[int] = []
    done, at = 0, iter(stretches)
    stretch = next(at, None)
    for i, i_end, j, j_end in groups:
        if stretch and stretch[0] < i:
            text += single[done : done + stretch[2]]
            done += stretch[2]
            stretch = next(at, None)
        key = (raw_a[4 * i : 4 * i_end], raw_b[4 * j : 4 * j_end])
        known = _irregular.get(key)
        if known is None:
            known = _group(*key, size_a, size_b)
            if len(_irregular) > CACHE_GROUPS // 2:
                _irregular.clear()
            if i_end - i + j_end - j <= SHORT_UNIT:
                _irregular[key] = known
        text.append(known[0])
        more += known[1]
    text += single[done:]
    return ";".join(text), len(text), np.concatenate([keys, np.array(more, np.int64)])


def aligned(docs: DataFrame, a: str, b: str, keep_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) of ``docs`` (doc_id, text).

    ``pairs`` are the distinct links of a text, ``times`` how often it has each. A text that is null, empty
    or not kept byte by byte has no tokens. ``row`` numbers the rows, so repeated doc_ids stay apart.
    """
    counts = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")

    def run(part: pa.RecordBatch):
        enc = _encoders(a, b)
        rows, ids, texts = (part[c].to_pylist() for c in ("row", "doc_id", "text"))
        for lo in range(0, len(texts), BATCH):
            cols: dict[str, list] = {c: [] for c in (*counts, "groups_sha256", "groups")}
            pairs, times = [], []
            for row, doc, both in zip(rows[lo:], ids[lo:], enc.encode(texts[lo : lo + BATCH])):
                groups, n, keys = "", 0, np.zeros(0, np.int64)
                n_a = n_b = 0
                if both:
                    n_a, n_b = len(both[0]), len(both[1])
                    groups, n, keys = linked(*both, enc.size_a, enc.size_b)
                key, time = np.unique(keys, return_counts=True)
                pairs.append(key)
                times.append(time)
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                for c, v in zip(cols, (row, doc, n_a, n_b, n, len(keys), digest, groups)):
                    cols[c].append(v)
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t)))
                for x, t in ((pairs, np.int64), (times, np.int32))
            ]
            arrays = [pa.array(cols[c], pa.int64()) for c in counts] + [pa.array(cols["groups_sha256"], pa.string()), *lists]
            names = [*counts, "groups_sha256", "pairs", "times"]
            if keep_groups:
                arrays.append(pa.array(cols["groups"], pa.string()))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(arrays, names)

    ddl = ", ".join(f"{c} long" for c in counts) + ", groups_sha256 string, pairs array<long>, times array<int>"
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(keyed, run, ddl + (", groups string" if keep_groups else ""))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of stored ``found`` a pair is linked; best of its A id, ties included."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "pair_counts")
    id_a = F.shiftrightunsigned("pair", 32)
    top = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("top"))
    return stored(
        counts.withColumn("a", id_a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs"
    )


def align_documents(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs`` (doc_id, text).

    n_links: overlapping token occurrences; count_sum: over them, in how many rows their id pair is linked;
    n_best: those whose count is their A id's highest. Repeated rows are documents of their own. Columns
    other than doc_id and text are ignored; an empty table gives no rows.
    """
    found = stored(aligned(docs, a, b), "aligned")
    counts = pair_counts(found)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // HEAD))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    met = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    sums = [
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
    ]
    often = met.where("n is not null").groupBy("row").agg(*sums)
    rare = met.where("n is null").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
    both = often.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(both, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
