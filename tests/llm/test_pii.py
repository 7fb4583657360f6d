import hashlib
import random
import re

from taxaloom.llm import pii


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans(make_docs):
    rnd = random.Random(9)
    parts = ["a", "B.b", "@", ".", "-", " ", "+", "1", "255", "4", "7", "(", ")", "é", "4111 1111 1111 1111", "10.0.0.1", "+1 (017) 555-7713", "x@y.zz", "\n"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))) for i in range(600)]
    rows += [(None, "a@b.c"), (7, "a@b.c"), (1000, None), (1001, ""), (1002, "1" * 50_000), (1003, "a" * 100_000), (1004, "a@" * 20_000), (1005, "1.2.3.4.5.6.7.8"), (1006, "+1" + "(" * 5000), (1007, "1." * 30_000)]
    got = pii.digests(pii.find(make_docs(rows))).collect()
    want = []
    for i, text in rows:
        spans = base(text) if i != 1003 else []
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_disguises_map_back(make_docs):
    cases = {
        "write to bob.smith (at) mail (dot) example [dot] com now": ("hidden_email", "bob.smith (at) mail (dot) example [dot] com"),
        "write to bob at mail dot example dot com now": ("hidden_email", "bob at mail dot example dot com"),
        "é bоb@exаmple.com!": ("hidden_email", "bоb@exаmple.com"),
        "call +１ (017) ５５５-7713 x": ("hidden_phone", "+１ (017) ５５５-7713"),
        "call plus one zero one seven five five five seven seven one three, ok": ("hidden_phone", "plus one zero one seven five five five seven seven one three"),
        "card four one one one 1111 1111 1111 one one one": None,
        "ip 10.0.٠.1 end": ("hidden_ip", "10.0.٠.1"),
        "bob (at) example.com": ("hidden_email", "bob (at) example.com"),
        "meet me at example.com or at dot": None,
        "one two three go": None,
    }
    rows = list(enumerate(cases))
    got = dict(pii.digests(pii.find(make_docs(rows))).select("doc_id", "spans").collect())
    for (i, text), want in zip(rows, cases.values(), strict=True):
        spans = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in got[i].split(",") if x)]
        assert spans == ([want] if want else []), text


def test_plain_neighbours_stay(make_docs):
    text = "a@b.cc and joe [at] host [dot] org"
    r = pii.digests(pii.find(make_docs([(1, text)]))).first()
    assert r.spans == f"email:0:6,hidden_email:11:{len(text)}"
    assert r.n_email == 1 and r.n_hidden_email == 1


def test_empty_table(make_docs):
    assert pii.find(make_docs([])).count() == 0


def test_prefilter_loses_nothing(make_docs):
    cases = {
        "write bob@example dot com now": "hidden_email:6:25",
        "bob@mail [dot] example (dot) com": "hidden_email:0:32",
        "bob@example[.]com": "hidden_email:0:17",
        "host 10 dot 0 dot 0 dot 1 is up": "hidden_ip:5:25",
        "host 10[.]0[.]0[.]1 is up": "hidden_ip:5:19",
        "host 10.0.zero.one": "hidden_ip:5:18",
        "+1 2125550 one two three": "hidden_phone:0:24",
        "plus 49 123 4567890": "hidden_phone:0:19",
        "at this point we met, one or two of us": "",
        "\u017fix \u017fix \u017feven one": "",
    }
    rnd = random.Random(10)
    parts = ["a", "bob", "@", " dot ", "[.]", "(dot)", " at ", ".", "-", " ", "+1 ", "12", "255", "one ", "zero", "plus ", "seven ", ",", "0", "\u0430", " point ", "555", "com"]
    rows = list(enumerate([*cases, *("".join(rnd.choice(parts) for _ in range(rnd.randrange(2, 22))) for _ in range(4000))]))
    rewrite = pii.Transducers()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(make_docs(rows)).collect()}
    names = pii.KINDS + pii.HIDDEN
    for (i, text), want in zip(rows, cases.values(), strict=False):
        assert ",".join(f"{names[k]}:{s}:{e}" for s, k, e in got[i]) == want, text
    for i, text in rows:
        assert got[i] == pii.find_all(text, rewrite), text


def test_spelled_ones_of_other_languages():
    rewrite = pii.Transducers()
    for said in ("plus trois trois un deux trois quatre cinq six sept huit", "plus vier neun eins ein drei vier fünf sechs sieben acht"):
        text = f"tel: {said} merci"
        assert (5, len(pii.KINDS) + 3, 5 + len(said)) in pii.find_all(text, rewrite)


def test_more_disguises(make_docs):
    cases = {
        "mail bob at example.com today": "hidden_email:5:23",
        "ask bob AT example.com today": "hidden_email:4:22",
        "ask bob.s at mail.example.com": "hidden_email:4:29",
        "look at example.com": "",
        "meet us at shop.example.org, mail later": "",
        "one nine two dot one six eight dot zero dot one up": "hidden_ip:0:47",
        "host 10 dot zero dot zero dot 1": "hidden_ip:5:31",
        "one dot one dot one dot one": "hidden_ip:0:27",
        "plus four nine double one triple two three four five": "hidden_phone:0:52",
        "four triple one double one double one four one one one three one one one six": "",
        "version one point two point three of it": "",
    }
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(make_docs(list(enumerate(cases))))).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def disguised(rnd):
    """An identifier in a disguise: the text, and its kind."""
    words = {c: w for w, c in pii.SPELLED.items() if w in ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "plus")}
    glyph = {c: many[0] for c, many in pii.LOOKALIKES.items()}
    name = lambda: "".join(rnd.choice("abcdefghijkmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9)))
    kind = rnd.choice(["email", "ip", "phone", "card"])
    if kind == "email":
        local, host, end = name(), name(), rnd.choice(["com", "org", "net"])
        way = rnd.randrange(4)
        if way == 0:
            return kind, local + rnd.choice([" at ", " (at) ", "[at]", " {at} ", " AT ", " arroba "]) + host + rnd.choice([" dot ", " (dot) ", "[dot]", " punto ", "[.]"]) + end
        if way == 1:
            return kind, f"{local}{rnd.choice([' (at) ', '[at]', ' AT ', '(@)'])}{host}.{end}"
        if way == 2:
            return kind, f"{local}@{host}{rnd.choice([' dot ', '[.]', ' (dot) '])}{end}"
        plain = f"{local}@{host}.{end}"
        at = [k for k, c in enumerate(plain) if c in glyph]
        spots = set(rnd.sample(at, min(len(at), 3)))
        return kind, "".join(glyph[c] if k in spots else c for k, c in enumerate(plain))
    if kind == "ip":
        parts = [str(rnd.randrange(256)) for _ in range(4)]
        if rnd.random() < 0.5:
            return kind, rnd.choice([" dot ", "[.]", " (dot) "]).join(parts)
        return kind, " dot ".join(" ".join(words[c] for c in p) for p in parts)
    if kind == "phone":
        digits = "+" + "".join(rnd.choice("123456789") for _ in range(rnd.randrange(10, 15)))
    else:
        digits = "".join(rnd.choice("123456789") for _ in range(15))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
    if rnd.random() < 0.5:
        return kind, " ".join(words[c] for c in digits)
    return kind, "".join(chr(0xFF10 + int(c)) if c.isdigit() and rnd.random() < 0.4 else c for c in digits[:-1]) + chr(0xFF10 + int(digits[-1]))


def test_a_thousand_disguises_and_running_text(make_docs):
    """Nearly all are found in full; running text with the same words gives next to nothing."""
    rnd = random.Random(33)
    planted = [disguised(rnd) for _ in range(1000)]
    rows = [(k, f"then {text} | it ended") for k, (_, text) in enumerate(planted)]
    prose = [
        "We met at one point and two or three of us looked at dot plots.", "At noon seven people from at least four places, plus one more, sat at the table.", "Nothing was at stake, point by point.", "Look at example.com or at shop.example.org for one or two offers.",
        "The score was two to one, then three to one, then four to three.", "Version 1.2.3 came at 10.30, version 2 at 11.", "She lives at 12 Dot Lane, at the back.", "One, two, three, four, five, six, seven: all at once!", "In 1999 and 2004 it cost 12 500 000 at most.",
        "He arrived at point zero at dawn.", "The dot on the i was at fault.", "From one to nine, eight at a time, zero point five each.",
    ]
    rows += [(2000 + k, " ".join(rnd.choice(prose) for _ in range(8))) for k in range(1000)]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(make_docs(rows))).collect()}
    found = {k: 0 for k in pii.KINDS}
    for k, (kind, text) in enumerate(planted):
        found[kind] += f"hidden_{kind}:5:{5 + len(text)}" in got[k].split(",")
    total = {kind: sum(p[0] == kind for p in planted) for kind in found}
    wrong = sum(bool(got[2000 + k]) for k in range(1000))
    print(found, total, wrong)
    assert all(found[k] >= 0.97 * total[k] for k in found), (found, total)
    assert wrong <= 20, wrong
