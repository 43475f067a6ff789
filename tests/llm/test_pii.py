"""Personal data: fixed forms against plain regular expressions, and what the bootstrap finds."""

import hashlib
import random
import re

from framekit.llm import pii
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_fixed_forms_equal_plain_expressions():
    rng = random.Random(2)
    pieces = ["a@b.c", "@", ".", "x.y+z@", "a-b.com", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111-1111-1111-1112",
              " ", "-", "0", "é", "12", "٣", "\n", "..", "%", "+49", "5500000000000004"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "a" * 400_000 + "@", "1" * 400_000, "+1" + " " * 400_000, "1." * 200_000, "@" * 200_000):
        pii.base_spans(text)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")


def test_bootstrap_finds_identifiers_in_learned_contexts(spark):
    rng = random.Random(3)
    filler = [" ".join(rng.choice("alpha beta gamma delta one two".split()) for _ in range(30)) for _ in range(60)]
    texts = [f"{f} please write to user{i}@mail.example.com today {f}" for i, f in enumerate(filler[:20])]
    texts += [f"{f} please write to agent{i}(at)host99 today" for i, f in enumerate(filler[20:30])]
    texts += [f"{f} room 1234567 two and alpha 99-8877-x" for f in filler[30:]] + [None, "", "write to"]
    got = {r.doc_id: r for r in pii.find(rows(spark, texts)).collect()}
    for i in range(20):
        assert [s.kind for s in got[i].base] == ["email"] and got[i].spans == got[i].base
    for i in range(20, 30):
        (span,) = got[i].spans
        assert span.kind == "email" and texts[i][span.start : span.end] == f"agent{i - 20}(at)host99" and not got[i].base
    assert all(not got[i].spans for i in range(30, len(texts)))


def longest(text, at):
    """The longest form from the word ``at`` on, if ``may_begin`` lets it through."""
    where = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    found = [text[a:b] for a, b in pii.forms(text, where, at)]
    assert not found or pii.may_begin(text.split(), at), text
    return found[0] if found else None


def test_forms_in_groups_and_in_words():
    for text, want in {
        "(826) 555-4081, 12 people": "(826) 555-4081", "DE89 3704 0044 0532 0130 00 is": "DE89 3704 0044 0532 0130 00", "12345 678 items": "12345 678",
        "AB 12 34 56 USA": "AB 12 34 56", "12345 3 days": "12345", "12345\n678": "12345", "12345. 678": "12345", "826 555 4081)": "826 555 4081",
        "jane at mail dot com now": "jane at mail dot com", "jane dot doe (at) mail.example [dot] com.": "jane dot doe (at) mail.example [dot] com",
        "jane(at)mail.com": "jane(at)mail.com", "a1b2c3(at)host": "a1b2c3(at)host", "us at home": None, "jane at\nmail dot com": None, "12 34": "12 34", "12 3": None, "IBM 36": None,
        "GB and 12345": None, "9" * 40 + " 12": "9" * 40, "12 " + "9" * 40: None, "()": None, "(12 (34": "12 (34",
    }.items():
        assert longest(text, 0) == want, text


def test_forms_are_let_through_and_take_linear_time():
    rng = random.Random(5)
    pieces = ["(826)", "555-4081", "DE89", "3704", "at", "dot", "(at)", "jane", "mail.com", "12,", "A", "x(dot)y", "+1", "\n", "7", ")", "\"9", "GB", "a@b"]
    for _ in range(3000):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        for at in range(len(text.split())):
            longest(text, at)
    for text in ("1 " * 200_000, "a dot " * 100_000, "12 " * 150_000, "a at " * 100_000, "a" + " " * 400_000 + "at b"):
        where = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for at in range(0, len(where), 50):
            list(pii.forms(text, where, at))


def test_identifiers_in_groups_and_in_words_are_redacted(spark):
    texts = [f"call the phone: +1 (555) 010-{1000 + i} now" for i in range(12)] + [f"please write to user{i}@mail.example.com today" for i in range(12)]
    texts += ["call the phone: (826) 555-4081 now", "the phone: DE89 3704 0044 0532, and so on", "please write to jane at mail dot com today"]
    # a number among the groups stays a base span, and the groups before it are taken alone
    texts += ["the phone: AB12 345 +1 555 010 9999 now", "the phone: rings", "12345 678 elsewhere"]
    got = [r.text for r in pii.redact(rows(spark, texts)).orderBy("doc_id").collect()]
    assert got[24:] == ["call the phone: <PHONE> now", "the phone: <PHONE>, and so on", "please write to <EMAIL> today", "the phone: <PHONE> <PHONE> now", "the phone: rings", "12345 678 elsewhere"]


def test_joined_patterns_give_the_same(spark, monkeypatch):
    texts = [f"mail me: u{i}@a.example.com now" for i in range(5)] + ["mail me: joe#4711 now", "me: joe#4711"]
    few = sorted((r.doc_id, str(r.spans)) for r in pii.find(rows(spark, texts)).collect())
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, str(r.spans)) for r in pii.find(rows(spark, texts)).collect()) == few


def test_redaction_keeps_rows_and_columns(spark):
    df = rows(spark, ["to a@b.example.org or +1 555 010 9999!", None, "clean", "clean"]).drop("spans")
    df = df.unionByName(df)
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["to <EMAIL> or <PHONE>!", "None", "clean", "clean"] * 2)
    assert pii.redact(df.limit(0)).count() == 0


def test_query_on_all_documents(spark):
    for r, text in zip(QUERIES["op2_personal_data"](spark, SF).orderBy("doc_id").collect(), spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        want = plain(text.text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.doc_id, r.base_sha256) == (text.doc_id, hashlib.sha256(listed.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))
