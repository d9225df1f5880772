"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole candidate segments.

The field splits a stretch of text around figures and at-signs into segments, each of them an entity of one type or a
single piece outside. Features look at a segment as a whole: its shape, its number of digits, check sums, what stands
beside it. Others look at a pair: an entity's type, that of the entity before it, and whether the two touch. Dynamic
programming over ends and types of segments of at most PIECES pieces chooses all boundaries and types together. It is
fitted by gradient ascent on sentences made from templates, with a fixed seed, so nothing of the corpus teaches it.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id")
#: States between segments: the type of the last entity (or none yet), after it pieces outside or, touching, nothing.
NONE = len(KINDS)
STATES = 2 * (NONE + 1)
#: Pieces of the longest segment (an account number of 34 characters in fours has 23 at most), training sentences, passes, features (hashed).
PIECES, SENTENCES, PASSES, FEATURES = 24, 1000, 5, 1 << 14

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_PIECE = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind.

    Locals of addresses are read backwards from the at-sign, and runs of digits from their start, which finds the same
    matches and stays linear in long runs.
    """
    found = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        i = m.start()
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < m.start():
            found.append((i, 0, m.end()))
            last = m.end()
    if not _TRIGGER.search(text):
        return found
    for m in _IP.finditer(text):
        if octets(m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@lru_cache(1 << 16)
def _number(feature: str) -> int:
    h = 2166136261
    for c in feature.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


def _shape(s: str) -> str:
    """Digits as 9 with their number, letters as a, the rest as it is."""
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", re.sub(r"[^\W\d_]+", "a", s))


def features(s: str, left: str, right: str, word: str) -> list[int]:
    """Of a segment as a whole, between two characters, after a word."""
    digits = "".join(c for c in s if c.isascii() and c.isdigit())
    out = [_number("bias"), _number("shape" + re.sub(r"9\d+", "9", _shape(s))), _number("exact" + _shape(s)), _number(f"digits{min(len(digits), 20)}"), _number("word" + word.lower()[:12])]
    out.append(_number("edge" + ("a" if left.isalnum() else left if left in "@.+-#$%/_" else " ") + ("a" if right.isalnum() else right if right in "@%/_-" else " ")))
    if "@" in s:
        out.append(_number("at" + str(bool(re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", s)))))
    if 13 <= len(digits) <= 19:
        out.append(_number(f"luhn{luhn(digits)}"))
    if s.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        out.append(_number(f"octets{octets(s.split('.'))}"))
    if s[0] == "+":
        out.append(_number(f"plus{10 <= len(digits) <= 15}"))
    if s[0] == "(" or ")" in s:
        out.append(_number(f"round{s.count('(') == s.count(')')}"))
    return out


def segments(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Candidate entities (first piece, last piece + 1, features): with a digit or an at-sign, no blank or stop at an end."""
    out = []
    n = len(pieces)
    for i in range(n):
        a = pieces[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        left = text[a - 1] if a else " "
        before = re.search(r"(\w+)\W*$", text[max(0, a - 24) : a])
        sure = False
        for j in range(i, min(n, i + PIECES)):
            s, z = text[pieces[j][0]], pieces[j][1]
            if "\n" in text[pieces[j][0] : z] or s.isspace() and z - pieces[j][0] > 1:
                break
            sure = sure or s == "@" or s.isascii() and s.isdigit()
            if sure and text[z - 1].isalnum():
                out.append((i, j + 1, features(text[a:z], left, text[z] if z < len(text) else " ", before[1] if before else "")))
    return out


def outside(state: int) -> int:
    """The state after a piece outside."""
    return state if state > NONE else state + NONE + 1


class Field:
    """The weights, of segments by type and of pairs by state before and type, and decoding."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def stretches(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """Pieces around each digit and at-sign, overlapping neighbourhoods joined."""
        triggers = [m.start() for m in _TRIGGER.finditer(text)]
        a = 0
        while a < len(triggers):
            b = a
            while b + 1 < len(triggers) and triggers[b + 1] - triggers[b] <= 48:
                b += 1
            lo, hi = max(0, triggers[a] - 48), min(len(text), triggers[b] + 48)
            while lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum() and triggers[a] - lo < 200:
                lo -= 1
            pieces = [m.span() for m in _PIECE.finditer(text, lo, hi)]
            near = [k for k, (x, y) in enumerate(pieces) if _TRIGGER.search(text, x, y)]
            yield pieces[max(0, near[0] - PIECES) : near[-1] + PIECES]
            a = b + 1

    def decode(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Best segmentation: (start, kind, end) of its entities. States before NONE + 1 are of an entity that ends right here, others of pieces outside since."""
        candidates = segments(text, pieces)
        if not candidates:
            return []
        top = self.pairs.max(0)
        ends: list[list[tuple[int, list[float]]]] = [[] for _ in range(len(pieces) + 1)]
        for i, j, f in candidates:
            s = self.weights[f].sum(0)
            if (s + top).max() > 0:  # else leaving its pieces outside is better, whatever stands before
                ends[j].append((i, s.tolist()))
        n, low = len(pieces), float("-inf")
        pairs = self.pairs.tolist()
        best = [[low] * STATES for _ in range(n + 1)]
        back: list[list[tuple[int, int, int] | None]] = [[None] * STATES for _ in range(n + 1)]
        best[0][NONE + 1 + NONE] = 0.0
        for j in range(1, n + 1):
            now, before = best[j], best[j - 1]
            for state in range(STATES):
                to = outside(state)
                if before[state] > now[to]:
                    now[to], back[j][to] = before[state], (j - 1, state, -1)
            for i, s in ends[j]:
                for state in range(STATES):
                    if best[i][state] > low:
                        for t in range(NONE):
                            score = best[i][state] + s[t] + pairs[state][t]
                            if score > now[t]:
                                now[t], back[j][t] = score, (i, state, t)
        out, j = [], n
        state = max(range(STATES), key=best[n].__getitem__)
        while j:
            i, before, t = back[j][state]
            if t >= 0:
                out.append((pieces[i][0], t, pieces[j - 1][1]))
            j, state = i, before
        return out[::-1]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        return [x for p in self.stretches(text) for x in self.decode(text, p)]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence from templates and its entities (start, kind, end)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "la", "en", "ou", "ch", "é", "ción", "heit")) for _ in range(rng.randint(1, 4)))

    def card(n: int) -> str:
        head = rng.choice("3456") + d(n - 2)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def entity(t: int) -> str:
        if t == 0:
            return f"{w()}{rng.choice(('.', '_', '', '-'))}{rng.choice(('', d(2)))}@{w()}{rng.choice(('', d(1)))}.{rng.choice(('com', 'org', 'example.com', 'de', 'co.uk'))}".replace("é", "e").replace("ó", "o")
        if t == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if t == 2:
            c = card(rng.choice((15, 16, 16, 16, 19)))
            return c if rng.random() < 0.6 else rng.choice((" ", "-")).join(c[i : i + 4] for i in range(0, len(c), 4))
        if t == 3:
            return rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}"))
        # account numbers: country, two check digits, 11 to 30 more, some of them letters in a few countries; joined or in fours
        bank = rng.choice(("", "", d(4), "".join(rng.choice("ABCDEFGHIKLMNOPRSTUW") for _ in range(4))))
        number = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(2)) + d(2) + bank + d(rng.randint(11, 26))
        fours = " ".join(number[i : i + 4] for i in range(0, len(number), 4))
        return rng.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", fours, fours, number))

    def other() -> str:
        bad = d(16)
        return rng.choice((f"version {rng.randint(1, 20)}.{rng.randint(0, 9)}", f"{rng.randint(1, 9)}.{d(1)}.{d(1)}", f"{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"${d(2)}.{d(2)}", f"#{d(rng.randint(3, 8))}", f"{d(rng.randint(1, 9))}", bad if not luhn(bad) else bad[:-1], f"{d(2)}%", f"@{w()}", f"{w()}{d(2)}", f"{d(20)}", f"{d(6)}-{d(2)}", f"{w()} = {''.join(rng.choice('0123456789abcdef') for _ in range(40))}", f"{w()}={''.join(rng.choice('0123456789abcdef') for _ in range(18))}", "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(3)}"))

    text, spans = w(), []
    for _ in range(rng.randint(1, 3)):
        text += "".join(" " + w() for _ in range(rng.randint(0, 3))) + rng.choice((" ", ": ", " ", "\n"))
        if rng.random() < 0.55:
            t = rng.randrange(5) if not spans or rng.random() < 0.5 else spans[-1][1]  # lists often are of one kind
            e = entity(t)
            spans.append((len(text), t, len(text) + len(e)))
            text += e
        else:
            text += other()
        text += rng.choice(("", ".", ",", ""))
    return text + " " + w(), spans


def fit(sentences: int = SENTENCES, passes: int = PASSES, seed: int = 7) -> Field:
    """Weights by stochastic gradient ascent on the log likelihood of segmentations, by forward and backward sums over segments."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _made(rng)
        pieces = [m.span() for m in _PIECE.finditer(text)]
        found = segments(text, pieces)
        gold = {(a, z): t for a, t, z in spans}
        if found:
            data.append((len(pieces), np.array([x[0] for x in found]), np.array([x[1] for x in found]), [np.array(x[2]) for x in found], np.array([gold.get((pieces[i][0], pieces[j - 1][1]), -1) for i, j, _ in found])))
    weights, pairs = np.zeros((FEATURES, NONE)), np.zeros((STATES, NONE))
    weights[_number("bias")] = -1.0
    after = np.array([outside(x) for x in range(STATES)])
    for p in range(passes):
        rate = 0.3 / (1 + p)
        for n, first, last, feats, gold in data:
            flat = np.concatenate(feats)
            at = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
            score = np.zeros((len(feats), NONE))
            np.add.at(score, at, weights[flat])
            by_end, by_start = [np.flatnonzero(last == j) for j in range(n + 1)], [np.flatnonzero(first == i) for i in range(n + 1)]
            ahead, behind = np.full((n + 1, STATES), -np.inf), np.full((n + 1, STATES), -np.inf)
            ahead[0, NONE + 1 + NONE], behind[n] = 0.0, 0.0
            for j in range(1, n + 1):
                np.logaddexp.at(ahead[j], after, ahead[j - 1])
                k = by_end[j]
                if len(k):
                    inward = np.logaddexp.reduce(ahead[first[k]][:, :, None] + pairs, axis=1) + score[k]
                    ahead[j, :NONE] = np.logaddexp.reduce(inward, axis=0)
            for i in range(n - 1, -1, -1):
                behind[i] = behind[i + 1][after]
                k = by_start[i]
                if len(k):
                    outward = np.logaddexp.reduce(score[k] + behind[last[k]][:, :NONE], axis=0)
                    behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(pairs + outward, axis=1))
            total = np.logaddexp.reduce(ahead[n])
            chance = np.exp(np.minimum(ahead[first][:, :, None] + pairs + (score + behind[last][:, :NONE])[:, None, :] - total, 0))
            # what the sentence has, by state before
            state, right = NONE + 1 + NONE, {(int(first[k]), int(last[k])): k for k in np.flatnonzero(gold >= 0)}
            i = 0
            while i < n:
                k = next((k for (a, _), k in right.items() if a == i), None)
                if k is None:
                    state, i = outside(state), i + 1
                else:
                    chance[k, state, gold[k]] -= 1
                    state, i = int(gold[k]), int(last[k])
            np.add.at(weights, flat, -rate * chance.sum(1)[at])
            pairs -= rate * chance.sum(0)
    return Field(weights, pairs)


def spans(text: str | None, field: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) by start and kind: all base spans, and those of the field that overlap none."""
    text = text or ""
    if not _TRIGGER.search(text):
        return []
    base = base_spans(text)
    more = [x for x in field.find(text) if not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    return sorted([(*b, True) for b in base] + [(*x, False) for x in more])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """docs (doc_id, text) to doc_id and found: spans (start, end, kind, base) of the whole text, code points, end exclusive.

    A null text is empty and has none; repeated rows each get theirs; an empty table gives no rows; only these columns are
    read. Texts are read whole: time grows with the length of what stands around figures and at-signs; a run of digits
    or letters, however long, is one piece.
    """
    from aeolith.llm.common import small_batches

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[{"start": a, "end": z, "kind": KINDS[t], "base": own} for a, t, z, own in spans(x.as_py(), shared.value)] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["doc_id", "found"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.dtypes[0][1]}, found array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their hash, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    added = F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added")
    every = F.size("found").cast("long").alias("n_spans")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], added, every, F.sha2(joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"), joined("found").alias("spans"))
