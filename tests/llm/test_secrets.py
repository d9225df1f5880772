"""Secrets against Python's re and counting by hand."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from aeolith.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def left(text):
    """The text with blanks in place of the base spans, kind by kind."""
    text = ASSIGN.sub(lambda m: " " * len(m[0]) if len(m[2]) >= 6 else m[0], text or "")
    text = re.sub("AKIA[A-Z0-9]{16,}", lambda m: " " * len(m[0]), text)
    return re.sub("[0-9a-f]{24,}", lambda m: " " * len(m[0]), text)


def entropy(text):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", left(text)):
        s = m[0]
        if not re.search("[0-9]", s) and not (re.fullmatch("[A-Za-z]+", s) and re.search("[a-z]", s) and re.search("[A-Z]", s)) or any(re.search(p, s) for p in secrets.ALLOWED):
            continue
        bits = next(b for p, b in secrets.CLASSES if re.search(p, s))
        high = [i for i in range(len(s) - 19) if -sum(n / 20 * math.log2(n / 20) for n in Counter(s[i : i + 20]).values()) >= bits - 1e-9]
        if high:
            out.append((m.start() + high[0], 3, m.start() + high[-1] + 20))
    return out


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def test_against_re(spark):
    rng = random.Random(4)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = ["password=abc", "Token = \"x9-y_z.q\"", "api_key:'0123456'", "APIKEY=zzzzzz", "secret=secret=abcdef", "token=token:abcdef", "AKIA" + "Z9" * 9, "AKIAAKIA" + "X" * 11, "AKIA123", pick("0123456789abcdef", 40), "é\U0001f600", "\n",
             "12345678-1234-1234-1234-123456789abc", "9" * 30, "a" * 25 + "1", pick(b64, 44), "tail" + "ab1" * 10 + pick(b64, 30), "x" * 30, "EXAMPLE" + pick(b64, 30), "deadbeef" * 3, "secret: 'q'", "AKIA" + "Q7" * 8 + "/" + pick(b64, 40), pick(b64[:52], 50), "SomeCamelCaseNameOfAClassThatIsLong", "path/to/Some/other/Place/inThe/tree"]
    texts = [None, "", "plain words only"] + parts + [rng.choice((" ", "", ", ")).join(rng.sample(parts, rng.randint(2, 8))) for _ in range(200)] + ["password=" + "k" * 5 + " " + "z " * 30000 + parts[9]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS k0")
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(d)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        b = base(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in b) for x in range(3)], t
        assert got[i].base_sha256 == hashlib.sha256(joined(b).encode()).hexdigest(), t
        assert got[i].spans == joined(b + entropy(t)), t


def test_empty_table(spark):
    assert secrets.digest(secrets.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_long_texts(spark):
    """A megabyte of one run, of a run that is nearly words, of thousands of matches: no recursion, no square of the length."""
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["1 " + "a-b_" * 250_000, "1" + "a-b_" * 250_000, "x " + "".join(rng.choices(b64, k=1_000_000)), "password=abcdef " * 60_000, "token " * 100_000 + "7", "0123456789abcdef" * 60_000, ("".join(rng.choices(b64, k=24)) + " ") * 20_000]
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert time.perf_counter() - began < 120
    for i, t in enumerate(texts):
        b = base(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in b) for x in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(joined(b).encode()).hexdigest()
        if i in (0, 1, 4):
            assert got[i].n_entropy == len(entropy(t))
    assert got[2].spans.startswith("entropy:") and got[2].n_entropy == 1
