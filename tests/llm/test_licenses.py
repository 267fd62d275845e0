import random

from palimpsest.llm import licenses
from palimpsest.llm.templates import TEMPLATES
from tests.llm import helpers


def test_matches_are_all_maximal_common_runs():
    rng = random.Random(7)
    for _ in range(150):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(0, 14))] for _ in range(3)]
        text = [rng.randrange(3) for _ in range(rng.randrange(0, 25))]
        want = set()
        for k, s in enumerate(seqs):
            for i in range(len(text)):
                for j in range(len(s)):
                    if (i and j and text[i - 1] == s[j - 1]) or text[i] != s[j]:
                        continue
                    n = 0
                    while i + n < len(text) and j + n < len(s) and text[i + n] == s[j + n]:
                        n += 1
                    if n >= licenses.LEAST:
                        want.add((i, k, j, n))
        assert set(licenses.Automaton(seqs).matches(text)) == want


def test_every_template_is_found_in_a_text(spark):
    rows = [(k, f"Some words before it.\n{TEMPLATES[n]}\nand some words after it.") for k, n in enumerate(sorted(TEMPLATES))]
    found = {(r["doc_id"], r["license"]): r["share"] for r in licenses.scan_licenses(helpers.texts(spark, rows)).collect()}
    for k, n in enumerate(sorted(TEMPLATES)):
        assert found.get((k, n), 0) > 0.99, n


def test_changed_words_and_line_breaks_are_bridged(spark):
    words = TEMPLATES["MIT"].split()
    changed = " ".join(w if i % 25 else "CHANGED" for i, w in enumerate(words)).replace(" of ", "\n *  of ")
    rows = [(1, changed), (2, "nothing of the kind is said in this text about any license at all"), (3, f"{TEMPLATES['MIT']} middle words {TEMPLATES['MIT']}")]
    got = [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(helpers.texts(spark, rows)).collect()]
    assert sorted(got) == [(1, "MIT"), (3, "MIT"), (3, "MIT")]


def test_edges(spark):
    rows = [*helpers.EDGES, (None, TEMPLATES["MIT"], None, None, None, None, None, None)]
    got = [(r["doc_id"], r["license"]) for r in licenses.scan_licenses(helpers.docs(spark, rows)).collect()]
    assert got == [(None, "MIT")]
    assert licenses.scan_licenses(helpers.docs(spark, [])).count() == 0
    assert licenses.scan_licenses(helpers.docs(spark), {}).count() == 0
    assert licenses.scan_licenses(helpers.docs(spark), {"empty": ""}).count() == 0
