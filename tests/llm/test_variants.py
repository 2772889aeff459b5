import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from stallwise.llm import variants as V
from tests.llm.helpers import DOCS, awkward, docs

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(V.UPPER, V.LOWER)


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    """Every two words compared."""
    n = vocabulary(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def misspelt(seed, count=60):
    """Texts of few words and many variants of them, with chains of forms."""
    dice = random.Random(seed)
    bases = ["".join(dice.choices("abcdeé", k=dice.randint(7, 10))) for _ in range(8)]
    texts = []
    for i in range(count):
        line = []
        for _ in range(60):
            word = dice.choice(bases)
            if dice.random() < 0.15:
                at = dice.randrange(len(word))
                word = dice.choice([word[:at] + word[at + 1 :], word[:at] + dice.choice("abx") + word[at + 1 :], word[:at] + "z" + word[at:]])
            line.append(word.upper() if dice.random() < 0.1 else word)
        texts.append(" ".join(line))
    return texts


@pytest.mark.parametrize("seed, tile", [(1, V.TILE), (2, 3), (3, 16)])
def test_equals_brute_force(spark, seed, tile):
    texts = misspelt(seed)
    found = V.variants(docs(spark, *texts), tile=tile)
    want = plain(enumerate(texts))
    assert got(found) == want and len(want) > 50
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_end_at_the_last_form(spark):
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000}
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    pairs = list(zip(counts, list(counts)[1:], strict=False))
    forms = spark.createDataFrame(pairs, "word string, form string")
    roots = {r.word: r.root for r in V.followed(forms, 4).collect()}
    assert roots == dict.fromkeys([*counts][:-1], "abcdezyx") and words.count() == 4


def test_awkward_rows(spark):
    """Null texts have no words, null ids hash as empty text, repeated rows count again, ties go to the first word."""
    long = "q" * 2_000
    extra = [(None, "Abcdefgh abcdefgh ÀBCDEFGH Àbcdefgh", None, None, None)] * 2 + [(9, f"{long} {long}x {long} {long}x", "en", "a", 1)]
    texts = ["tieword1 tiewordA tiewordA tiewordB tiewordB tiewordAB", "×××××××× ÷×÷×÷×÷×", None, "", "short wor ds"]
    given = docs(spark, *texts, extra=extra)
    assert got(V.report(given)) == plain([(r.doc_id, r.text) for r in given.collect()])
    both = awkward(spark)
    counts = vocabulary([(r.doc_id, r.text) for r in both.collect()])
    assert {r.word: r.n for r in V.report(both).collect()} == counts and len(counts) > 1000


def test_empty_tables_and_clashing_columns(spark):
    assert V.report(spark.createDataFrame([], DOCS)).collect() == []
    assert V.report(docs(spark, "no long run", None)).collect() == []
    clash = docs(spark, *misspelt(4, 10)).withColumnsRenamed({"lang": "word", "source": "n", "n_chars": "key"})
    assert got(V.report(clash)) == plain(enumerate(misspelt(4, 10)))


def test_edits_are_verified_exactly():
    dice = random.Random(5)
    words = list({"".join(dice.choices("ab", k=dice.randint(1, 6))) for _ in range(80)})
    found = V.Words(pa.array(words))
    import numpy as np

    x, y = (np.repeat(np.arange(len(words)), len(words)), np.tile(np.arange(len(words)), len(words)))
    assert found.one_edit(x, y).tolist() == [one_edit(words[i], words[j]) for i, j in zip(x, y, strict=True)]


def test_one_letter_words_of_any_block_meet_once(spark):
    """Pairs that share several blocks come once in each direction."""
    texts = misspelt(6, 20)
    pairs = [(r.word, r.near) for r in V.near_words(V.words(docs(spark, *texts))).collect()]
    n = vocabulary(enumerate(texts))
    want = defaultdict(int)
    for w in n:
        for v in n:
            if one_edit(w, v):
                want[w, v] += 1
    assert Counter(pairs) == want
