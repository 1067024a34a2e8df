import hashlib
import random
import re

import pytest
from oracle import DATA

from vecspark.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("letters", ["a.@b-_%+1 ", "0123456789. -+()", "1.2@a"])
def test_base_spans_against_patterns(letters):
    draw = random.Random(2)
    for _ in range(5000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 30)))
        assert pii.base_spans(text) == brute(text)


def test_query_against_patterns(spark):
    sf = f"{DATA}/sf0.001"
    got = {r.doc_id: r for r in queries.op5_pii(spark, sf).collect()}
    for d in queries.table(spark, sf, "documents").collect():
        base, row = brute(d.text), got[d.doc_id]
        assert row.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert row.spans == pii.joined(base) and row.n_added == 0


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write jane at mail dot example dot org today", "email", "jane at mail dot example dot org"),
        ("to аlice@exаmple.com", "email", "аlice@exаmple.com"),
        ("bob(at)site.co.uk x", "email", "bob(at)site.co.uk"),
        ("call plus four nine one five one two three four five six seven please", "phone", "plus four nine one five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot one two", "ip", "one nine two dot one six eight dot one dot one two"),
        ("card ４１１１ １１１１ １１１１ １１１１!", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("zeros 41​11 1111 1111 1111 end", "card", "41​11 1111 1111 1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, found)] and base == []
    assert pii.redact(text, added) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["a look at example.com is fine", "we met at noon. Dot said so", "see un deux trois quatre", "at the dot", "one or two at most", ""])
def test_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_edits_compose():
    r = pii.Rewritten("abcdef")
    r.apply([(1, 3, "X"), (4, 4, "YY")])
    assert r.text == "aXdYYef" and r.source(0, 2) == (0, 3, True) and r.source(2, 3) == (3, 4, False) and r.source(5, 7) == (4, 6, False)
    r.apply([(0, 1, "")])
    assert r.text == "XdYYef" and r.source(0, 1) == (1, 3, True) and r.source(4, 6) == (4, 6, False)


def test_long_texts_take_linear_time():
    import time

    for text in ("1" * 200_000, "a" * 200_000, "at " * 60_000, "one " * 50_000, "+1 " * 60_000, "a." * 90_000 + "@", "a dot " * 40_000, "1." * 90_000):
        begun = time.time()
        pii.find(text)
        assert time.time() - begun < 5


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = pii.find_in_documents(odd).collect()
    assert len(rows) == len(odd_rows)
    mail = next(r for r in rows if r.doc_id == 10)
    assert (mail.n_email, mail.n_ip, mail.n_phone) == (1, 1, 1) and mail.redacted == "mail [EMAIL] or [IP], [PHONE]"
    assert pii.find_in_documents(nothing).collect() == []
    out = pii.redacted_documents(odd)
    assert out.columns == odd.columns
    row = next(r for r in out.collect() if r.doc_id == 10)
    assert row.text == mail.redacted and row.n_chars == len(row.text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john @ example.com now", "email", "john @ example.com"),
        ("mail john@ example.com now", "email", "john@ example.com"),
        ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
        ("host 192 [dot] 168 (dot) one [dot] one is up", "ip", "192 [dot] 168 (dot) one [dot] one"),
        ("card 4111 1111 1111 111 one now", "card", "4111 1111 1111 111 one"),
        ("call +44 20 794 four six now", "phone", "+44 20 794 four six"),
        ("call plus 1 212 555 0101 now", "phone", "plus 1 212 555 0101"),
    ],
)
def test_few_marks_of_disguise_are_undone(text, kind, found):
    start = text.index(found)
    assert pii.find(text) == ([], [(kind, start, start + len(found))])


@pytest.mark.parametrize("text", ["call +1 212 555 0101 one time", "host 10.0.0.1 one time", "in 2001, 2002, 2003, two", "page 3 point 5 of 12, or 1 dot 2", "mail one 5 [at] home"])
def test_numbers_in_prose_add_nothing(text):
    assert pii.find(text)[1] == []


HINTS = ("the point ", "a dot ", "x [dot] ", "me [at] ", "me at ", "a@b", "a @ b", "one ", "plus ", "１ ", "")
RUNS = (".", "a.", "1.", "a", "1", "0", " ", "- ", "[ ", "(", "@", "@a.b ", " at a", " dot a", "a dot ", " [at] a [dot] b", "one ", "1 ", "+1(", "1, ", "é", "\u200b")


@pytest.mark.parametrize("run", RUNS)
def test_any_hint_beside_any_long_run_takes_linear_time(run):
    import time

    for hint in HINTS:
        begun = time.time()
        pii.find(hint + run * (100_000 // len(run)))
        assert time.time() - begun < 5, hint


def test_numbers_of_any_length():
    for text in ("0" * 5000 + ".1.2.3", "1" * 5000 + ".1.2.3", "1.2.3." + "0" * 6000):
        assert pii.base_spans(text) == ([("ip", 0, len(text))] if text[0] != "1" or text[1] == "." else [])
    assert [pii.is_octet(x) for x in ("0", "255", "256", "0255", "1000", "99")] == [True, True, False, True, False, True]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("x a dot b dot c dot d dot e dot f at site dot org y", "x a dot b dot c dot d dot e dot f at site dot org"[2:]),
        ("a.b.c.d.e.f [at] one.two [dot] three.", "a.b.c.d.e.f [at] one.two [dot] three"),
        ("to me@x.org and you [at] y.org", "you [at] y.org"),
    ],
)
def test_names_and_hosts_of_any_number_of_parts(text, found):
    assert [text[a:b] for _, a, b in pii.find(text)[1]] == [found]
