import math
import hashlib
import random
import re
import string

import pytest

from taxaloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def texts():
    rnd = random.Random(4)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    some = [
        None, "", " ", "token=abcdef", "token=abc", "TOKEN : 'a.b-c=d/e'", "secret: token :abcdefgh", "token==abcdef x api_key='xxxxxx'", "apikey=aaaaaa passwd:bbbbbb", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 14, "AKIA" + "A" * 15,
        hexes(24), hexes(23), "é" * 3 + hexes(40) + "g" + hexes(30), "password=" + hexes(30) + "K", "toKen=abcdef", "token=" + "x" * 200_000, "token=abcdef " * 3000, "a" * 300_000, "🤖 secret=\"" + hexes(50),
    ]
    for _ in range(150):
        some.append("".join(rnd.choice(["token", "=", ":", " ", '"', "'", "secret", "ab", "0f", "AKIA", hexes(12), "Z9", "é", ".", "-"]) for _ in range(rnd.randrange(40))))
    return some


def test_base_spans(make_docs):
    rows = [*enumerate(texts()), (None, "token=abcdef"), (3, "token=abcdef")]
    got = sorted(secrets.digests(secrets.find(make_docs(rows))).collect(), key=str)
    want = []
    for i, text in rows:
        spans = base(text)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(said.encode()).hexdigest(), said))
    for r, w in zip(got, sorted(want, key=str), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in w[5].split(",") if s]


def test_battery_finds_random_strings_and_leaves_structure(make_docs):
    rnd = random.Random(8)
    alphabet = string.ascii_letters + string.digits
    keys = ["".join(rnd.choice(alphabet) for _ in range(48)) for _ in range(60)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    plain = ["zzzzzzzzzzbbbbbbbbbbyyyyyyyyyyddddddddd" + str(i) for i in range(60)] + [f"chapter-{i}-of-the-book-of-books-and-more-books" for i in range(60)]
    rows = [(i, f"see {t} here") for i, t in enumerate(keys + plain)]
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.find(make_docs(rows))).collect()}
    found = sum(got[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys))
    assert found >= 0.85 * len(keys)
    assert not any(got[i] for i in range(len(keys), len(rows)))


@pytest.mark.parametrize("broadcast", [secrets.BROADCAST_BYTES, 0])
def test_redaction(spark, monkeypatch, broadcast):
    """Null ids, repeated ids and rows, clashing columns, empty and very long texts, and overlapping spans."""
    monkeypatch.setattr(secrets, "BROADCAST_BYTES", broadcast)
    key = "0f" * 12
    rows = [
        (1, f"x token=abcdef y {key}", "en", "s", 1), (2, None, None, None, None), (3, "clean", "en", "s", 5), (None, "token=abcdefgh x", "en", "s", 16), (None, "fine", None, None, 4),
        (4, "a token=abcdef", "en", "s", 14), (4, "a token=abcdef", "en", "s", 14), (4, "b secret: abcdefg", "en", "s", 17), (4, "b", "en", "s", 1), (5, "", "en", "s", 0),
        (6, "w " * 200_000 + "passwd=abcdef", "en", "s", 0), (7, f"{key}api_key=abcdefg token=é", "en", "s", 0), (8, "token=abcdef " * 2000, "en", "s", 0), (9, f"password={key}K é token=abcdef", "en", "s", 0),
    ]
    frame = spark.createDataFrame([(*r, "k", "g") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, gaps string").withColumnRenamed("lang", "row")
    out = secrets.redact(frame)
    assert out.schema == frame.schema

    def clean(text):
        if text is None:
            return None
        out, at, spans = [], 0, [list(s[1:]) for s in base(text)]
        merged = []
        for s, e in spans:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            out += [text[at:s], "[secret]"]
            at = e
        return "".join(out) + text[at:]

    want = [(i, clean(t), len(clean(t)) if t and clean(t) != t else n, "k", "g") for i, t, _, _, n in rows]
    assert sorted(((r.doc_id, r.text, r.n_chars, r.key, r.gaps) for r in out.collect()), key=str) == sorted(want, key=str)
    assert secrets.redact(frame.limit(0)).count() == 0


def test_tail_against_uniform_strings(spark):
    """p-values of random strings are about even for each length and alphabet, short ones included."""
    rnd = random.Random(5)
    cases = {("hex", 24): "0123456789abcdef", ("base64", 20): string.ascii_letters + string.digits + "+/", ("base64", 44): string.ascii_letters + string.digits + "+/", ("lower36", 30): string.digits + string.ascii_lowercase}
    rows = [(f"{k}", "".join(rnd.choice(a) for _ in range(k[1]))) for k, a in cases.items() for _ in range(2000)]
    got = {k: [] for k in map(str, cases)}
    for r in secrets.battery(spark.createDataFrame(rows, "k string, value string").repartition(4)).collect():
        if r.p is not None:
            got[r.k].append(r.p)
    assert all(len(p) > 1900 and 0.4 < sum(p) / len(p) < 0.6 and sum(x < 0.05 for x in p) < 0.1 * len(p) for p in got.values()), {k: (len(p), sum(p) / len(p), sum(x < 0.05 for x in p)) for k, p in got.items()}


def test_empty_table(make_docs):
    assert secrets.find(make_docs([])).count() == 0


def test_values_behind_a_name(make_docs):
    rnd = random.Random(13)
    alphabet = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rnd.choice(alphabet) for _ in range(46)) + "a1" for _ in range(60)]
    names = ["AWS_SECRET_ACCESS_KEY=", "sig=", "export X9_CREDENTIAL_OF_THE_HOST="]
    rows = [(i, f"{names[i % 3]}{k}{'=' * (i % 2)}") for i, k in enumerate(keys)]
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.find(make_docs(rows))).collect()}
    found = sum(f"random:{len(names[i % 3])}:{len(t)}" in got[i].split(",") for i, t in rows)
    assert found >= 0.85 * len(keys)


def reference_p(value):
    """The battery in plain Python."""
    body = value.rstrip("=")
    alphabet = next((a for a in secrets.ENCODINGS.values() if set(body) <= set(a)), None)
    if alphabet is None or len(body) < secrets.LEAST_RUN // 2:
        return None
    n, k = len(body), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    at = [alphabet.index(c) + 1 for c in body]
    pairs, equal = n * (n - 1) / 2 / k, sum(body.count(c) * (body.count(c) - 1) for c in set(body)) / 2
    spread = math.sqrt(pairs * (1 - 1 / k))
    root = 2 * spread / (1 - 2 / k + 2 * (n - 2) / k)
    z1 = 3 * root * (max(1 + (equal - 0.5 - pairs) / spread / root, 0.0) ** (1 / 3) - 1) + 1 / (3 * root)
    high = [a > k // 2 for a in at]
    ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * ones * (n - ones) / n + 1
    z2 = abs(runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    dev = [a - sum(at) / n for a in at]
    z3 = abs((sum(a * b for a, b in zip(dev, dev[1:])) / max(sum(a * a for a in dev), 1e-9) + 1 / (n - 1)) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (tail(z1), 2 * tail(z2), 2 * tail(z3)))
    return math.exp(-half) * (1 + half + half * half / 2)


def reference_thresholds(found, rate=secrets.RATE):
    """The least p-value of each stratum, by trying every bin."""
    out = {}
    for stratum in {s for _, s in found}:
        bins = [min(int(p * secrets.BINS), secrets.BINS - 1) for p, s in found if s == stratum]
        random = (sum(b >= secrets.BINS // 2 for b in bins) + secrets.PRIOR / 2) * 2
        fits = [b for b in range(secrets.BINS) if 1 - random * (1 - b / secrets.BINS) / (sum(c >= b for c in bins) + secrets.PRIOR * (1 - b / secrets.BINS)) <= rate]
        if fits:
            out[stratum] = max(fits[0] / secrets.BINS, secrets.FLOOR)
    return out


def test_battery_and_thresholds_against_a_reference(spark):
    rnd = random.Random(21)
    letters = string.ascii_letters + string.digits
    values = ["".join(rnd.choice(a) for _ in range(rnd.randrange(8, 90))) + "=" * rnd.randrange(3) for a in (letters + "+/", "0123456789abcdef", string.ascii_uppercase + "234567") for _ in range(150)]
    values += ["abcdefghijklmnopqrstuvwxyz0123", "a1" * 20, "version-2-of-the-long-name-here", "a" * 30, "____", "x" * 25 + "é"]
    got = {r.value: r.p for r in secrets.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    for v in values:
        want = reference_p(v)
        assert (got[v] is None) == (want is None) and (want is None or math.isclose(got[v], want, rel_tol=1e-3, abs_tol=1e-6)), v
    found = [(rnd.random() ** rnd.choice([1, 1, 6]), rnd.choice([20, 24, 32])) for _ in range(900)] + [(0.4, 64), (0.001, 128)] + [(rnd.random() / 5, 40) for _ in range(300)]
    limits = {r.stratum: r.least_p for r in secrets.thresholds(spark.createDataFrame(found, "p double, stratum int")).collect()}
    assert limits == pytest.approx(reference_thresholds(found))


@pytest.mark.parametrize("n", [1, 10, 100, 1000])
def test_random_keys_are_found_however_few_there_are(make_docs, n):
    """Of 20 corpora of one key, and of one of more: nine in ten at least; and of as many names and paths few."""
    rnd = random.Random(n)
    letters = string.ascii_letters + string.digits
    key = lambda: "".join(rnd.choice(letters) for _ in range(rnd.choice([24, 32, 40, 64]) - 2)) + "a1"
    corpora = [[key() for _ in range(n)] for _ in range(20 if n == 1 else 1)]
    found = false = 0
    for keys in corpora:
        names = [f"module_{k % 7}-of-package-{k}/sub_directory/file_number_{k}" for k in range(n)]
        rows = [(k, f"KEY={v}") for k, v in enumerate(keys)] + [(n + k, f"see {v} there") for k, v in enumerate(names)]
        got = {r.doc_id: r.spans for r in secrets.digests(secrets.find(make_docs(rows))).collect()}
        found += sum("random:4:" in got[k] for k in range(n))
        false += sum("random" in got[n + k] for k in range(n))
    assert found >= 0.9 * n * len(corpora) and false <= 0.1 * max(found, 1)
