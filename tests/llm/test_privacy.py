import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from stallwise.llm import privacy as P
from tests.llm.helpers import DOCS, awkward, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for place, digit in enumerate(reversed(number)):
        d = int(digit) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The patterns as they are written, matched one after another."""
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    ]


def joined(spans):
    return ",".join(f"{kind}:{s}:{e}" for kind, of_kind in zip(P.KINDS, spans, strict=True) for s, e in of_kind)


@pytest.mark.parametrize("signs", ["ab@.@.-+1 123 45.(0)2é", "0123456789- ", "+12 ().-9é", "1.25.0", "a.b@c-d@e.f%"])
def test_base_spans_equal_the_patterns(signs):
    dice = random.Random(signs)
    for _ in range(3000):
        text = "".join(dice.choices(signs, k=dice.randint(0, 80)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 10**6, "a" * 10**6 + "@", " @x.y" * 200_000, "1.2." * 200_000, "+1(" * 300_000, "1 " * 300_000):
        P.base_spans(text)


FILLER = [f"filler{i}" for i in range(400)]


def corpus(seed=1, pages=700):
    """Fillers everywhere; one person's name beside their address in different sentences; a footer on most pages."""
    dice = random.Random(seed)
    texts = [" ".join(dice.choices(FILLER, k=30)) for _ in range(pages)]
    for i in range(0, 80, 10):
        texts[i] += f". Ask Zebulon Quartz at zq@site{i % 3}.example.org or zq@home.example.org, {' '.join(dice.choices(FILLER, k=9))}"
    for i in range(300, 600):
        texts[i] += " footerword info@footer.example.org"
    for i in range(200, 220):  # copies of one text prove nothing
        texts[i] = "copied obscureword one two three cop@copy.example.org four five six"
    texts[650] = "Zebulon Quartz alone, without any address"
    return texts


def plain_terms(texts, window=P.WINDOW, support=P.SUPPORT):
    """Disclosure of each term and entity, counted over all pairs."""
    docs_of, around, together, of_entity = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        spans = plain(text)
        every = [s for of_kind in spans for s in of_kind]
        terms = [(m.start(), m[0].lower()) for m in P.TERM.finditer(text)]
        for _, term in terms:
            docs_of[term].add(i)
        free = [(m.start(), m[0].lower()) for m in P.TERM.finditer(text) if not any(s < m.end() and m.start() < e for s, e in every)]
        for kind, of_kind in enumerate(spans):
            for start, end in of_kind:
                name = P._value(kind, text[start:end])
                of_entity[name].add(i)
                near = [t for s, t in free if s < start][-window:] + [t for s, t in free if s >= start][:window]
                for term in near:
                    around[name, term].add(tuple(near))
                    together[name, term].add(i)
    shares = defaultdict(lambda: -math.inf)
    for (name, term), windows in around.items():
        bits = math.log2(len(texts) / len(of_entity[name]))
        if len(windows) >= support and bits >= P.LEAST_BITS:
            shares[term] = max(shares[term], 1 + math.log2(len(together[name, term]) / len(docs_of[term])) / bits)
    return {t: "removed" if s >= P.REMOVE else "general" for t, s in shares.items() if s >= P.GENERALISE}


def test_disclosing_terms_equal_brute_force(spark):
    texts = corpus()
    found = {r.term: r.action for r in P.disclosing(docs(spark, *texts)).collect()}
    assert found == plain_terms(texts)
    assert {"zebulon", "quartz"} <= found.keys() and not found.keys() & {"footerword", "obscureword", *FILLER}


def test_spans_and_masked_texts(spark):
    texts = corpus()
    given = docs(spark, *texts)
    rows = {r.doc_id: r for r in P.report(given).collect()}
    terms = plain_terms(texts)
    for i, text in enumerate(texts):
        base = plain(text)
        every = [s for of_kind in base for s in of_kind]
        own = sorted((terms[m[0].lower()], m.start(), m.end()) for m in P.TERM.finditer(text)
                     if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, e in every))
        want = ",".join(x for x in (joined(base), ",".join(f"{a}:{s}:{e}" for a, s, e in own)) if x)
        assert rows[i].spans == want
        assert rows[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(map(len, base))
    clean = {r.doc_id: r.text for r in P.sanitised(given).collect()}
    assert "Zebulon" not in clean[650] and "without any address" in clean[650]
    assert "zq@" not in clean[0] and "[email]" in clean[0]
    assert clean[100] == texts[100]


def test_masked():
    text = "Call Zoe7 or Ann on 10.0.0.1 now"
    spans = [("ip", 20, 28), ("general", 5, 9), ("removed", 13, 16)]
    assert P.masked(text, spans) == "Call [name] or  on [ip] now"
    assert P.masked("12 abc a1c", [("general", 0, 2), ("general", 3, 6), ("general", 7, 10)]) == "[number] [word] [code]"
    assert P.masked(text, [("email", 0, 10), ("phone", 5, 12)]) == "[email] Ann on 10.0.0.1 now"[0:7] + text[12:]


def test_awkward_rows(spark):
    """Null and empty texts have no spans, each repeated row gives a row."""
    given = awkward(spark)
    found = P.report(given).collect()
    assert len(found) == given.count()
    assert {r.spans for r in found} == {""} and {r.base_sha256 for r in found} == {hashlib.sha256(b"").hexdigest()}
    assert sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 7 for r in found) == 3


def test_empty_table_and_clashing_columns(spark):
    assert P.report(spark.createDataFrame([], DOCS)).collect() == []
    clash = docs(spark, "me@a.example, 1.2.3.4").withColumnsRenamed({"lang": "base", "source": "place", "n_chars": "spans"})
    row = P.report(clash).first()
    assert (row.n_email, row.n_ip, row.spans) == (1, 1, "email:0:12,ip:14:21")
