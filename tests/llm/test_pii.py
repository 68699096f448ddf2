import hashlib
import re

from linkwright.llm.pii import KINDS, personal_data, redacted, spans
from tests.llm.helpers import documents

# the strict patterns as they are defined, without possessive groups
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "é mail a.b@c.de, x@y.com_foo@bar.com q@w @z.com a@b@c.org 1@2.3.4.5", "a@b.c.d.e@f.g", "x@y.com@z.org_a@b.co",
    "ip 10.0.0.1 and 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4 1.2.3 999.1.2.3.4 😀 8.8.8.8",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 9 4111  1111 6011000990139424000 3 4757965300669737",
    "tel +49 (30) 123-456 78 and + 1 +1 +123456789 (+44.20.7946.0958) +1+2 +12345678901234567890 +1 ) ( 2",
    "call (415) 555-2671 or 030 1234567; a [at] b [dot] com", None, "", " ", "no digits here", "+1 415 555 2671 " * 50, "7 " * 5000, "9" * 3000, "a." * 3000 + "@", "a@" + "b." * 4000 + "c", "1.2.3.4 " * 300,
]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == k for x in want) for k in KINDS], r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(map(str, x)) for x in want).encode()).hexdigest(), r.doc_id
        assert {":".join(map(str, x)) for x in want} <= set(r.spans.split(",")) or not want


def test_base_against_plain_patterns(spark):
    rows = personal_data(documents(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    check(rows, TEXTS)


def test_no_python_in_the_plan(spark):
    plan = personal_data(documents(spark, TEXTS[:3]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction_and_empty(spark):
    found = spans(documents(spark, ["to a.b@c.de and 10.0.0.1!", "clean", None]), carry=("text",)).select("doc_id", redacted_text())
    assert [r.out for r in found.orderBy("doc_id").collect()] == ["to [EMAIL] and [IP]!", "clean", None]
    assert personal_data(documents(spark, [])).count() == 0
    assert [r.spans for r in personal_data(documents(spark, ["nothing", "nothing"])).collect()] == ["", ""]


def redacted_text():
    return redacted("accepted").alias("out")


def planted(n=300):
    """Texts with known spans, base and beyond it, and decoys that no one should take."""
    import random

    r = random.Random(5)

    def card():
        d = [4] + [r.randrange(10) for _ in range(14)]
        total = sum(x if i % 2 else (2 * x - 9 * (2 * x > 9)) for i, x in enumerate(d))
        return "".join(map(str, [*d, -total % 10]))

    def phone():
        return f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(10000):04d}"

    def ip():
        return ".".join(str(r.randrange(11, 256)) for _ in range(4))

    texts, more, secrets = [], [], []
    for i in range(n):
        out, extra, secret = "", [], []

        def put(kind, value, into, gap):
            nonlocal out
            out += gap
            into.append(f"{kind}:{len(out)}:{len(out) + len(value)}")
            out += value

        kind = i % 6
        if kind == 0:
            put("card", card(), extra, "thé pay ")
            put("card", card(), extra, " ")
        elif kind == 1:
            put("phone", phone(), extra, "ring ")
            put("card", card(), extra, " ")
        elif kind == 2:
            put("secret", "".join(r.choice("0123456789abcdef") for _ in range(40)), secret, 'x token = "')
            out += '" end'
        elif kind == 3:  # a number that is no card
            d = card()
            out += f"no {'7' + d[1:]} there"
        elif kind == 4:
            out += f"mail a.{i}@mail.example.com or {ip()} or {phone()} or {card()}, so"
        else:
            out += f"plain words {r.randrange(1000)} of {r.randrange(3000)} und so weiter"
        texts.append(out)
        more.append(extra)
        secrets.append(secret)
    return texts, more, secrets


def test_precision_and_recall_of_added_spans(spark):
    texts, more, secrets = planted()
    rows = personal_data(documents(spark, texts)).collect()
    check(rows, texts)
    added = wanted = right = 0
    for r in rows:
        base = {":".join(map(str, x)) for x in brute(texts[r.doc_id])}
        got = {x for x in r.spans.split(",") if x and x not in base}
        want = {x for x in more[r.doc_id] if x not in base}
        added, wanted, right = added + len(got), wanted + len(want), right + len(got & want)
        assert {x for x in r.secrets.split(",") if x} == set(secrets[r.doc_id]), texts[r.doc_id]
        assert r.n_found == len(base) + len(got) + len(secrets[r.doc_id])
    assert wanted > 150 and right / wanted >= 0.95 and right / added >= 0.95, (added, wanted, right)


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"u{i}@mail.example.com" for i in range(24_000))
    docs = documents(spark, [text, "x"]).selectExpr("cast(null as bigint) as doc_id", "text", "'a' as base", "'b' as kind", "'c' as spans")
    docs = docs.unionByName(docs)
    began = time.time()
    rows = sorted(personal_data(docs).collect(), key=lambda r: -r.n_email)
    assert [r.n_email for r in rows] == [24_000, 24_000, 0, 0] and rows[0] == rows[1]
    assert rows[0].base_sha256 == hashlib.sha256(",".join(":".join(map(str, x)) for x in brute(text)).encode()).hexdigest()
    assert time.time() - began < 60


def test_redaction_against_brute_force(spark):
    rows = spans(documents(spark, TEXTS + planted(40)[0]), carry=("text",))
    for r in rows.select("text", "accepted", "secrets", redacted("concat(accepted, secrets)").alias("out")).collect():
        out, at = "", 0
        for start, end, kind in sorted((x.start, x.end, x.kind) for x in r.accepted + r.secrets):
            if start >= at:
                out += r.text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert r.out == (None if r.text is None else out + r.text[at:])
