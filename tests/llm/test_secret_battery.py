"""The randomness battery against exact p-values, and texts of very many matches."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuelattice.llm import secrets


def chi_squared_tail(x, df):
    """Regularised upper incomplete gamma function by a continued fraction or a series."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-12:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    c, d = x + 1 - a, 0.0
    f = c
    for i in range(1, 500):
        n = -i * (i - a)
        b = x + 2 * i + 1 - a
        d = 1 / (b + n * d)
        c = b + n / c
        f *= c * d
    return front / f


def exact(text):
    """The combined p-value by plain Python."""
    alphabet = next(chars for _, chars, _ in secrets.ENCODINGS if set(text) <= set(chars))
    x, n, size = [alphabet.index(c) for c in text], len(text), len(alphabet)
    counts = np.bincount(x, minlength=size)
    chi = chi_squared_tail(float((counts.astype(float) ** 2).sum() * size / n - n), size - 1)
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    up = [2 * v >= size for v in x]
    a, runs = sum(up), 1 + sum(p != q for p, q in zip(up, up[1:], strict=False))
    both = 2 * a * (n - a)
    variance = both * (both - n) / (n * n * (n - 1))
    runs_p = tail((runs - both / n - 1) / math.sqrt(variance)) if variance > 0 else 0.0
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial = tail((sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False)) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return 1 - (1 - min(chi, runs_p, serial)) ** 3


def test_p_values(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(chars) for _ in range(n)) for _, chars, _ in secrets.ENCODINGS for n in (16, 20, 40, 90) for _ in range(6)]
    texts += ["internationalization", "theQuickBrownFoxJumpsOverIt", "0000000000000000", "abababababababababab", "a" * 30 + "1B", "0123456789abcdef0123456789abcdef"]
    got = {x.c: x.b for x in spark.createDataFrame([(x,) for x in texts], "c string").select("c", secrets.battery(F.col("c")).alias("b")).collect()}
    for x in texts:
        assert abs(got[x].p - exact(x)) < 0.02, x
        assert got[x].band == sum(len(x) >= b for b in secrets.BANDS)


def test_limits_count_each_string_once_and_follow_length(spark):
    r = random.Random(4)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    letters = secrets.UPPER + secrets.LOWER + secrets.DIGITS
    digits = [draw(secrets.DIGITS, 16) for _ in range(120)]
    keys = [draw(letters, 40) for _ in range(120)]
    words = ["".join(r.choice(["ing", "the", "tion", "and", "er", "ent"]) for _ in range(r.randint(5, 9))) for _ in range(300)]
    words = sorted({w for w in words if len(w) >= 16})
    docs = lambda rows: spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(rows)], "doc_id long, text string")
    rows = digits + keys + words
    found = {x.doc_id: "random" in x.spans for x in secrets.scan_secrets(docs(rows)).collect()}
    share = lambda a, b: sum(found[i] for i in range(a, b)) / (b - a)
    assert share(0, 120) > 0.5 and share(120, 240) > 0.8
    assert sum(found[i] for i in range(240, len(rows))) <= 0.05 * sum(found.values())
    assert secrets.limits(docs(rows)) == secrets.limits(docs(rows + [keys[0]] * 3000))


def test_a_text_of_very_many_matches(spark):
    n = 100_000
    text = "".join(f"token=abcd{i:06d} é " for i in range(n))
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    size = len(text) // n
    want = ",".join(f"assign:{i * size}:{i * size + 16}" for i in range(n))
    assert row.n_assign == n and row.spans == want and row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_redaction_of_long_texts_and_clashing_names(spark):
    """Overlapping spans, texts of several blocks, characters beyond the basic plane, and columns named as inner ones are."""
    r = random.Random(2)
    parts = ["password=hunter2222", "AKIA" + "A1" * 9, "😀é " * 50, "plain words here ", "secret: " + "0123456789abcdef" * 3, "x" * 40]
    texts = ["".join(r.choice(parts) + " " for _ in range(k)) for k in (1, 30, 900)]
    docs = spark.createDataFrame([(i, x, "own", 7) for i, x in enumerate(texts)], "doc_id long, text string, __spans string, spans int")
    spans = {x.doc_id: x.spans for x in secrets.scan_secrets(docs).collect()}
    got = secrets.redacted(docs).collect()
    assert got[0].__fields__ == docs.columns
    for row in got:
        text, at, want = texts[row.doc_id], 0, []
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans[row.doc_id].split(",") if s):
            if start >= at:
                want += [text[at:start], "[REDACTED]"]
            at = max(at, end)
        assert row.text == "".join(want) + text[at:] and (row["__spans"], row.spans) == ("own", 7)
