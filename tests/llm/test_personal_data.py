import hashlib
import random
import re

from cinderloom.llm.personal_data import find, redact, report

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    found = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        found += [(m.start(), no, kind, m.end()) for m in re.finditer(p, text or "") if good(kind, m[0])]
    found.sort()
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


def test_base_spans_are_those_of_the_patterns(spark, sf):
    rnd = random.Random(5)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4785380592391139", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7.8", "a@b.co", "x_@d.com", "+1 (555) 123-4567", "+49 30 12345678", " ", "  ", "-", ".", "é", "\n", "7", "12", "@", "+", "%", "b", "😀", "--", "0000000000000"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "1" * 20000, "1 " * 9000, "a" * 20000 + "@", "a@b" + ".c" * 5000, "+1" * 4000, "1." * 6000, "4111 1111 1111 1111 " * 50]
    texts += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in report(find(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        base = ",".join(x for x in got[i].spans.split(",") if x and x.split(":")[0] in PATTERNS)
        assert base == want, repr(t)[:200]
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == sum(x.startswith(kind + ":") for x in want.split(","))


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


OWN = {
    "email": "mail|contact|kontakt|write to|correo",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobil|fax|dial|whatsapp",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|sozial|seguro|sécu",
}


def scored(text):
    """All spans with their scores, by a plain loop."""
    found = [(m.start(), no, m.end(), kind) for no, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0])]
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", text):
        found += [(m.start(), 4, m.end(), "iban")] if mod97(m[0]) else []
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        found += [(m.start(), 5, m.end(), "ssn")] if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000" else []
    out = []
    for start, no, end, kind in sorted(found):
        before = text[max(0, start - 40) : start]
        score = {"phone": 4, "ssn": 4}.get(kind, 6) + 3 * bool(re.search(OWN[kind], before, re.I)) - 3 * bool(re.search(r"\b(serial|part|order|item|invoice|version|build|sku|isbn|article|ticket|hash)\b", before, re.I))
        if no < 4 or score >= 5:
            out.append((f"{kind}:{start}:{end}", str(score)))
    return out


def test_scores_and_added_kinds_by_a_plain_loop(spark):
    rnd = random.Random(8)
    parts = ["GB82WEST12345698765432", "GB82WEST12345698765433", "DE89370400440532013000", "123-45-6789", "000-12-3456", "900-11-2222", "account", "Konto:", "serial number", "part", "SSN", "social security", "order no.", "a@b.co", "mail me", "4111 1111 1111 1111", "visa", "+1 (555) 123-4567", "call", "1.2.3.4", "version", "server", "x" * 45, "and", "é", "\n"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(1200)]
    got = {r.doc_id: r for r in report(find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        want = scored(t)
        assert got[i].spans == ",".join(x for x, _ in want), t
        assert got[i].scores == ",".join(x for _, x in want), t


def test_context_decides(spark):
    rows = [
        (1, "IBAN GB82WEST12345698765432 here"),
        (2, "GB82WEST12345698765433"),
        (3, "his SSN is 123-45-6789."),
        (4, "part 123-45-6789"),
        (5, "account DE89370400440532013000"),
        (6, "serial DE89370400440532013000"),
        (7, "serial of the account DE89370400440532013000"),
        (8, "DE89370400440532013000"),
    ]
    got = {r.doc_id: r for r in report(find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert [got[i].n_iban for i in range(1, 9)] == [1, 0, 0, 0, 1, 0, 1, 1]
    assert [got[i].n_ssn for i in range(1, 6)] == [0, 0, 1, 0, 0]
    assert got[1].spans == "iban:5:27" and [got[i].scores for i in (5, 7, 8)] == ["9", "6", "6"]


def test_redaction_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4", "x"), (2, None, "y")], "doc_id long, text string, _digit string")
    assert find(df).columns == ["doc_id", "text", "_digit", "pii"]
    got = {r.doc_id: r.text for r in redact(find(df)).collect()}
    assert got == {1: "mail <email> or <ip>", 2: None}
    assert report(find(df.limit(0))).count() == 0
