"""Operator 3: personal data by fixed patterns plus a semi-Markov conditional random field.

Patterns give the base spans. The field scores whole candidate segments (runs of tokens, ``MAX_TOKENS`` at
most for a personal-data segment) with features of the segment as a whole - shape, digits, checksum, what
stands next to it - and dynamic programming chooses segment boundaries and types together. A segment of
personal data holds a digit or an ``@`` in each of its chunks but for punctuation between them and the chunks next
to a free-standing ``@``, so text without either needs no lattice, and such regions are decoded one by one. Base spans are fixed: segments may not touch them, and the field adds
what it finds beside them.

The field is trained here, on regions of all documents but one in ``HELD_OUT``. Labels: the base spans, and copies
of them in forms that the patterns cannot see, which are what the field is for: phones without country code, dotted,
spaced or as digits after a cue word, mail addresses with blanks around the ``@``, card numbers with other
separators, spaced addresses. Copies that are no personal data teach where to stop: broken checksums, address parts
beyond 255, other groupings, bare numbers. Of each sort of region those with the smallest hashes are used: ``TRAIN_PLAIN``
without a span, ``TRAIN_KIND`` of every other sort (twice as many negative copies), ``PER_DOC`` from a
document at most and equal ones once. So there are labels whenever the patterns find anything that can be
labelled. That bounded sample is all the driver holds (a region is ``TRAIN_CHARS`` characters at most); the weights,
``BUCKETS`` hashed features per type, are broadcast. All documents are searched, whole. :func:`evaluate` counts hits
and errors per kind on the held-out documents.

Null text is empty; a document without spans has counts 0 and empty lists; repeated rows are searched one by
one; an empty table gives an empty table and trains nothing (no weights: nothing is added). Offsets are code
points, ends exclusive. Other columns are not read.
"""

from __future__ import annotations

import re
from ast import literal_eval
from bisect import insort
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, map_arrow, staged, text_chunks, texts_of, unstage

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
MAX_TOKENS = 14
BUCKETS = 1 << 13
TRAIN_PLAIN, TRAIN_KIND, PER_DOC, EPOCHS, COPIES = 300, 60, 3, 4, 3
#: A trained region is this many tokens and characters long at most; longer ones are decoded but not learned from.
TRAIN_TOKENS, TRAIN_CHARS = 40, 400
#: One document in so many, by hash of its text, is kept out of the training.
HELD_OUT = 5
#: Sorts of training regions: plain, base spans by kind, copies by kind, copies that are none.
N_SORTS = 2 * len(KINDS) + 2

SEED = re.compile("[0-9@]")
CHUNK = re.compile(r"\S+")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive runs that start where a digit run starts match what the plain pattern matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches: a run of local characters that ends in ``@``, then a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    if not SEED.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_only_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


#: What may stand between two chunks of one region: a few blanks, with one piece of punctuation among them.
_BETWEEN = re.compile(r"[^\S\n]{1,3}(?:[^\w\s@]{1,2}[^\S\n]{1,3})?")


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Token lists of the runs of chunks that hold a digit or an ``@``, or stand next to a free end of an ``@``."""
    bounds: list[list[int]] = []
    last, wanted = None, False  # the chunk before, and whether it ends with an @
    for m in CHUNK.finditer(text):
        a, b = m.span()
        seed = SEED.search(text, a, b)
        if seed or wanted:
            if seed and text[a] == "@" and last and last[1] + 3 >= a and (not bounds or bounds[-1][1] < last[1]):
                a = last[0]
            if bounds and a <= bounds[-1][1]:
                bounds[-1][1] = b
            elif bounds and (gap := _BETWEEN.match(text, bounds[-1][1])) and gap.end() == a:
                bounds[-1][1] = b
            else:
                bounds.append([a, b])
        wanted = bool(seed) and text[b - 1] == "@"
        last = m.span()
    return [[t.span() for t in TOKEN.finditer(text, a, b)] for a, b in bounds]


@lru_cache(1 << 16)
def _slot(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


kept_by_worker(_slot.cache_clear)


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "A", re.sub("[0-9]+", "0", s))[:24]


def segment_features(text: str, start: int, end: int) -> list[int]:
    s = text[start:end]
    digits = _only_digits(s)
    n = len(digits)
    parts = [p.strip() for p in s.split(".")]
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    dotted = f"{four},{four and all(len(p) <= 3 and int(p) <= 255 for p in parts)}"
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    word = re.search(r"(\S*)\s?$", text[max(0, start - 24):start]).group(1).lower()
    return [_slot(f) for f in (
        "bias", f"shape={_shape(s)}", f"digits={min(n, 20)}", f"first={_shape(s[:1])}", f"last={_shape(s[-1:])}",
        f"luhn={14 <= n <= 19 and luhn(digits)}", f"dotted={dotted}", f"at={s.count('@')}",
        f"runs={'-'.join(str(len(r)) for r in re.findall('[0-9]+', s))[:16]}", f"prev={word[-12:]}",
        f"cut={before.isalnum()},{after.isalnum()}", f"cue={word.strip('.:') in CUE_WORDS},{n}", f"card={n >= 14},{luhn(digits)}",
        f"on={bool(re.match('[ .-]{0,3}[0-9]', text[end:end + 4]))},{bool(re.search('[0-9][ .-]{0,3}$', text[max(0, start - 4):start]))}", f"letters={any(map(str.isalpha, s))},{n > 0}")]


#: Words that announce a phone number in copies, and what a segment's feature takes for one.
CUES = ("phone:", "tel:", "call", "Phone", "tel.", "mobile:")
CUE_WORDS = frozenset(c.strip(".:").lower() for c in CUES)


class Lattice:
    """Segments of one region: their token bounds, features, and which labels they may bear."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.n, bounds, feats, entity = len(tokens), [], [], []
        seed = np.cumsum([0, *[bool(SEED.search(text[a:b])) for a, b in tokens]])
        for j in range(1, self.n + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                inside = seed[j] > seed[i]
                if inside or j - i == 1:
                    bounds.append((i, j))
                    feats.append(segment_features(text, tokens[i][0], tokens[j - 1][1]))
                    entity.append(inside)
        self.bounds, self.feats = bounds, np.array(feats)
        self.closed = np.zeros((len(bounds), len(LABELS)), bool)
        self.closed[[j - i > 1 for i, j in bounds], 0] = True
        self.closed[~np.array(entity), 1:] = True

    def scores(self, weights: np.ndarray) -> np.ndarray:
        s = weights[:, self.feats].sum(2).T
        s[self.closed] = -np.inf
        return s


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def decode(lattice: Lattice, weights: np.ndarray, moves: np.ndarray) -> list[tuple[int, int, int]]:
    """Best segmentation: (first token, end token, label) of its personal-data segments. Ties: earlier label."""
    s = lattice.scores(weights)
    best = np.full((lattice.n + 1, len(LABELS)), -np.inf)
    best[0, 0] = 0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    into: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, (i, j) in enumerate(lattice.bounds):
        if i not in into:
            come = best[i][:, None] + moves
            into[i] = come.max(0), come.argmax(0)
        value = into[i][0] + s[k]
        for y in np.flatnonzero(value > best[j]):
            best[j, y] = value[y]
            back[j, y] = (i, into[i][1][y])
    out, j, y = [], lattice.n, int(best[lattice.n].argmax())
    while j > 0:
        i, before = back[j, y]
        if y:
            out.append((i, j, y))
        j, y = i, int(before)
    return out[::-1]


def _gradient(lattice: Lattice, gold: dict[tuple[int, int], int], weights: np.ndarray, moves: np.ndarray):
    """Expected minus observed: per segment and label, and per pair of labels in a row."""
    s = lattice.scores(weights)
    k_labels = len(LABELS)
    alpha = np.full((lattice.n + 1, k_labels), -np.inf)
    beta = np.full((lattice.n + 1, k_labels), -np.inf)
    alpha[0, 0], beta[lattice.n] = 0, 0
    into = {}
    for k, (i, j) in enumerate(lattice.bounds):
        if i not in into:
            into[i] = _lse(alpha[i][:, None] + moves, 0)
        alpha[j] = np.logaddexp(alpha[j], into[i] + s[k])
    outer = np.full((len(s), k_labels), -np.inf)
    for k in range(len(s) - 1, -1, -1):
        i, j = lattice.bounds[k]
        outer[k] = s[k] + beta[j]
        beta[i] = np.logaddexp(beta[i], _lse(moves + outer[k][None, :], 1))
    z = _lse(alpha[lattice.n], 0)
    expect = np.exp(np.array([into[i] for i, _ in lattice.bounds]) + outer - z)
    pair = np.zeros_like(moves)
    for k, (i, _) in enumerate(lattice.bounds):
        pair += np.exp(alpha[i][:, None] + moves + outer[k][None, :] - z)
    last = 0
    for k, b in enumerate(lattice.bounds):
        if b in gold:
            expect[k, gold[b]] -= 1
            pair[last, gold[b]] -= 1
            last = gold[b]
    return expect, pair


def _gold(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], int] | None:
    """Segments and labels of a region that base spans label; None if a span cuts a token."""
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    out, free = {}, np.ones(len(tokens), bool)
    for a, kind, b in spans:
        if b <= tokens[0][0] or a >= tokens[-1][1]:
            continue
        if a not in first or b not in last or last[b] - first[a] > MAX_TOKENS:
            return None
        if free[first[a]:last[b]].all():
            free[first[a]:last[b]] = False
            out[first[a], last[b]] = kind + 1
    return out | {(i, i + 1): 0 for i in np.flatnonzero(free)}


def _groups(digits: str, parts: list[str]) -> list[str]:
    return parts if len(parts) > 1 else [digits[:3], digits[3:6], digits[6:]]


def copies(kind: int, s: str) -> list[tuple[str, bool, bool]]:
    """Other forms of a base span: (text, whether it still is personal data, whether a cue word goes before it)."""
    digits = _only_digits(s)
    if KINDS[kind] == "email":
        local, domain = s.rsplit("@", 1)
        return [(f"{local} @ {domain}", True, False), (f"{local} @{domain}", True, False), (f"{local}@ {domain}", True, False)]
    if KINDS[kind] == "ip":
        parts = s.split(".")
        wrong = [*parts[:3], str(256 + crc32(s.encode()) % 744)]
        return [(" . ".join(parts), True, False), (". ".join(parts), True, False), (".".join(wrong), False, False), (" . ".join(wrong), False, False)]
    if KINDS[kind] == "card":
        four = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + crc32(s.encode()) % 8) % 10)
        bad = [wrong[i:i + 4] for i in range(0, len(wrong), 4)]
        return [(sep.join(four), True, False) for sep in (".", "  ", " - ")] + [
            (sep.join(bad), False, False) for sep in (" ", ".", "", "-")]
    code = re.match(r"\+[0-9]+[\x20.-]+(?=[(0-9])", s)
    if not code:
        return []
    own = s[code.end():]
    d = _only_digits(own)
    if len(d) < 7:
        return []
    g = _groups(d, re.findall("[0-9]+", own))
    return [(own, True, False), (".".join(g), True, False), (" - ".join(g), True, False), ("-".join(g), True, False),
            (f"({g[0]})  {'-'.join(g[1:])}", True, False), (f"({g[0]}) {'-'.join(g[1:])}", True, False), (d, True, True), (d, True, True),
            (f"{d[:3]}-{d[3:5]}-{d[5:9]}", False, False), (d, False, False), (f"{d[:4]}-{d[4:6]}-{d[6:8]}", False, False)]


def examples(text: str) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int, int]], int]]:
    """(text, tokens, spans, sort) of the regions of a text, and of ``COPIES`` copies that are personal data and as many
    that are none, if there are, of each region with one span."""
    out = []
    spans, at = base_spans(text), 0
    held: list[tuple[int, int, int]] = []
    for tokens in regions(text):
        a, b = max(0, tokens[0][0] - 24), tokens[-1][1] + 2
        while at < len(spans) and spans[at][0] < tokens[-1][1]:
            held.append(spans[at])
            at += 1
        held = [x for x in held if x[2] > tokens[0][0]]
        own = [(s - a, k, e - a) for s, k, e in held]
        piece = text[a:b]
        here = [(s - a, e - a) for s, e in tokens]
        for sort in {k + 1 for _, k, _ in own} or {0}:
            out.append((piece, here, own, sort))
        if len(own) != 1 or len(tokens) > TRAIN_TOKENS:
            continue
        (s, k, e), = own
        forms = copies(k, piece[s:e])
        h = crc32(piece.encode("utf-8", "surrogatepass"))
        for true in (True, False):
            some = [f for f in forms if f[1] == true]
            for n in range(min(COPIES, len(some))):
                form, _, cue = some[(h + n) % len(some)]
                before = f"{CUES[h // 16 % len(CUES)]} " if cue else piece[:s]
                copy = before + form + ("." if (h // 128 + n) % 3 == 0 else "") + piece[e:]  # often at the end of a sentence
                lo, hi = len(before), len(before) + len(form)
                if any(x < hi and z > lo for x, _, z in base_spans(copy)):
                    continue  # the patterns see it after all
                for t in regions(copy):
                    if t[0][0] <= lo and hi <= t[-1][1]:
                        out.append((copy, t, [(lo, k, hi)] if true else [], len(KINDS) + 1 + k if true else N_SORTS - 1))
    return out


class _Sample:
    """Of each sort of region those with the smallest hashes."""

    def __init__(self):
        self.kept: list[list[tuple[int, str, str, str]]] = [[] for _ in range(N_SORTS)]

    @staticmethod
    def most(sort: int) -> int:
        return TRAIN_PLAIN if sort == 0 else TRAIN_KIND * (2 if sort == N_SORTS - 1 else 1)

    def add(self, text: str) -> None:
        own: dict[int, list] = {}
        for x, t, s, sort in examples(text):
            if len(t) > TRAIN_TOKENS or len(x) > TRAIN_CHARS:
                continue
            h = int.from_bytes(blake2b(f"{t[0][0]},{t[-1][1]},{s},{x}".encode("utf-8", "surrogatepass"), digest_size=8).digest()) >> 1
            have = self.kept[sort]
            if len(have) < self.most(sort) or h < have[-1][0]:
                own.setdefault(sort, []).append((h, x, t, s))
        for sort, found in own.items():
            have, taken = self.kept[sort], 0
            for h, x, t, s in sorted(found):
                if taken == PER_DOC:
                    break
                if _gold(t, s):
                    taken += 1
                    row = (h, x, str(t), str(s))
                    if row not in have:
                        insort(have, row)
                        del have[self.most(sort):]


def _held_out(text):
    return F.pmod(F.xxhash64(text, F.lit("held out")), F.lit(HELD_OUT)) == 0


def fit(data: list[tuple[str, list, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights (labels x buckets) and moves (labels x labels), by AdaGrad on the log-likelihood of (text, tokens, spans)."""
    ready = [(Lattice(x, t), _gold(t, s)) for x, t, s in data]
    weights, moves = np.zeros((len(LABELS), BUCKETS)), np.zeros((len(LABELS),) * 2)
    weights[1:, _slot("bias")] = -2.0
    w2, m2 = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(ready)):
            lattice, gold = ready[k]
            expect, pair = _gradient(lattice, gold, weights, moves)
            used, at = np.unique(lattice.feats, return_inverse=True)
            grad = np.zeros((len(LABELS), len(used)))
            for y in range(len(LABELS)):
                grad[y] = np.bincount(at.ravel(), np.repeat(expect[:, y], lattice.feats.shape[1]), len(used))
            w2[:, used] += grad * grad
            m2 += pair * pair
            weights[:, used] -= 0.3 * grad / np.sqrt(w2[:, used])
            moves -= 0.3 * pair / np.sqrt(m2)
    return weights, moves


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and moves of the field, from the documents that are not held out; None without labels."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter(
        F.col("text").rlike("[0-9@]") & ~_held_out(F.col("text")))

    def cut(batches):
        sample = _Sample()
        for b in text_chunks(batches, "text"):
            for text in texts_of(b, "text"):
                sample.add(text)
        out = [(sort, *row) for sort, kept in enumerate(sample.kept) for row in kept]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(
            (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["sort", "h", "piece", "tokens", "spans"])

    names = ["h", "piece", "tokens", "spans"]
    found = staged(map_arrow(rows, cut, "sort int, h long, piece string, tokens string, spans string"), "regions")
    picked = set()
    for sort in range(N_SORTS):
        some = found.filter(F.col("sort") == sort).select(*names).distinct().orderBy(*names).limit(_Sample.most(sort))
        picked.update(tuple(r) for r in some.collect())
    unstage(found)
    data = [(x, literal_eval(t), literal_eval(s)) for _, x, t, s in sorted(picked)]
    if not any(s for _, _, s in data):
        return None
    return fit(data)


def judged(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Per kind (number, hits, wrong ones, missed ones) of the field on the plain regions and copies of a text.

    A span that is none of the labels, but that the patterns take when it stands alone (they take the longest match and
    do not try again: two card numbers in a row are none to them), is neither a hit nor wrong.
    """
    out = [[k, 0, 0, 0] for k in range(len(KINDS))]
    for x, t, s, sort in examples(text):
        if 0 < sort <= len(KINDS):
            continue
        want = set(s)
        got = {(t[i][0], y - 1, t[j - 1][1]) for i, j, y in decode(Lattice(x, t), *model)}
        for _, k, _ in want & got:
            out[k][1] += 1
        for a, k, b in got - want:
            out[k][2] += base_spans(x[a:b]) != [(0, k, b - a)]
        for _, k, _ in want - got:
            out[k][3] += 1
    return [tuple(r) for r in out]


def evaluate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``kind, hits, wrong, missed`` of added spans on held-out documents: copies of base spans, and all plain regions."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter(
        F.col("text").rlike("[0-9@]") & _held_out(F.col("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        total = np.zeros((len(KINDS), 3), np.int64)
        for b in text_chunks(batches, "text"):
            for text in texts_of(b, "text"):
                total += np.array(judged(text, shared.value))[:, 1:]
        yield pa.RecordBatch.from_arrays([pa.array(KINDS), *[pa.array(c) for c in total.T]], ["kind", "hits", "wrong", "missed"])

    out = map_arrow(rows, count, "kind string, hits long, wrong long, missed long")
    return out.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("hits", "wrong", "missed")])


def all_spans(text: str, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[list, list]:
    """Base spans, and base and added ones together, as sorted (start, kind number, end)."""
    base = base_spans(text)
    if model is None or not SEED.search(text):
        return base, base
    added = []
    taken = iter(sorted((a, b) for a, _, b in base))
    held: list[tuple[int, int]] = []
    hold = next(taken, None)
    for tokens in regions(text):
        runs: list[list[tuple[int, int]]] = [[]]
        for a, b in tokens:
            while hold and hold[0] < b:
                held.append(hold)
                hold = next(taken, None)
            held = [h for h in held if h[1] > a]
            if held:
                runs.append([])
            else:
                runs[-1].append((a, b))
        for run in runs:
            if run:
                for i, j, y in decode(Lattice(text, run), *model):
                    added.append((run[i][0], y - 1, run[j - 1][1]))
    return base, sorted(base + added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base`` (listed base spans), ``spans`` (all, listed alike)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def search(batches):
        for b in text_chunks(batches, "text"):
            found = [all_spans(t, shared.value) for t in texts_of(b, "text")]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *counts, pa.array([listed(x) for x, _ in found], pa.string()),
                 pa.array([listed(x) for _, x in found], pa.string())],
                ["id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    out = map_arrow(rows, search, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, all spans of ``text_col`` replaced; a null text stays null."""
    names = docs.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def replace(batches):
        for b in text_chunks(batches, text_col):
            texts = [t if t is None or not SEED.search(t) else redact_text(t, all_spans(t, shared.value)[1])
                     for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(docs, replace, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
