"""Held-out accuracy of the field, its decoding, and the operators on a small table."""

import itertools
import random
import re

import pyarrow as pa

from lumenfold.llm import personal as P
from lumenfold.llm import training
from lumenfold.llm.training import examples
from tests.llm.held_out import FRESH, GIVEN, LINES, PLAIN, held_out

TEXT = (
    "\\author{Chiara Norvaker \\and Søren B. Ulvemark-Pelliwicz\\orcid{0007-7543-8279-462X}}\r\n"
    "The Norvaker--Ulvemark bound holds. Runs 710-13-6802b use the same grid.\n"
    "Contact: Dalmrathel, Leila, 215 Quarry Lane\\\\\n14395 Port Ellory, +1\\,617\\,555\\,0128, {leila,bdalm}@mail.test.\n"
    "write to jrgen dot marv at ostra dot edu dot example, or SSN 974 32 9598, or (617) 555 0137 ext. 636.\n"
    "K. Bjövülsen, Ann. Velden Acad. 76 (2018) 245. Samples go to P.O. Box 967, Fenmark 46752.\n"
)
FOUND = {
    ("name", "Chiara Norvaker"), ("name", "Søren B. Ulvemark-Pelliwicz"), ("id_number", "0007-7543-8279-462X"), ("name", "Dalmrathel, Leila"),
    ("address", "215 Quarry Lane\\\\\n14395 Port Ellory"), ("phone", "+1\\,617\\,555\\,0128"), ("email", "{leila,bdalm}@mail.test"),
    ("email", "jrgen dot marv at ostra dot edu dot example"), ("id_number", "974 32 9598"), ("phone", "(617) 555 0137 ext. 636"),
    ("address", "P.O. Box 967, Fenmark 46752"),
}


def test_held_out_accuracy():
    weights = dict(P.trained_weights())
    hit = wrong = missed = 0
    for text, gold in examples(per_template=8, seed=4711):
        got = set(P.best_segments(text, weights))
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.98


def test_decoding_is_the_best_of_all_segmentations():
    weights = dict(P.trained_weights())
    for text, _ in examples(per_template=1, seed=5):
        arcs = [(a, b, k, sum(weights.get(f, 0.0) for f in P.features(text, a, b, k))) for a, b, k in P.candidates(text)][:9]
        best = 0.0
        for n in range(len(arcs) + 1):
            for some in itertools.combinations(arcs, n):
                ordered = sorted(some)
                if all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:])):
                    best = max(best, sum(s[3] for s in some))
        if len(P.candidates(text)) <= 9:
            got = P.best_segments(text, weights)
            score = {a[:3]: a[3] for a in arcs}
            assert abs(sum(score[g] for g in got) - best) < 1e-9


def test_table(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "  \n"), (5, TEXT + "\n" + "x " * 200_000 + TEXT), (6, "plain text, nobody in it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in P.find_items(df, "doc_id", "text").collect():
        assert (r.kind, r.found) not in got.setdefault(r.doc_id, set())
        got[r.doc_id].add((r.kind, r.found))
    assert got == {1: FOUND, 5: FOUND}
    assert P.find_items(df.limit(0), "doc_id", "text").count() == 0


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in P.redact(df, "doc_id", "text").collect()}
    want = TEXT
    for kind, found in sorted(FOUND, key=lambda x: -len(x[1])):
        want = want.replace(found, f"[{kind.upper()}]")
    assert out == {1: want, 2: None, 3: ""}


def regions(text):
    return [r for _, r, _ in P._regions(pa.array([text]), P.anchor_patterns())]


def accuracy(lines):
    weights, hit, wrong, missed = dict(P.trained_weights()), 0, 0, 0
    for text, gold in lines:
        got = {(a, b, k) for r in regions(text) for a, b, k in P.best_segments(r, weights)}
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    return hit / (hit + missed), hit / (hit + wrong)


def test_names_of_unknown_people_in_unknown_lines():
    # no given name, family name or line of these is trained on
    known = {g.casefold() for g in P.GIVEN} | {g.casefold() for g in training.UNLISTED}
    assert not {g.casefold() for g in GIVEN} & known
    assert not {w for t in (*LINES, *PLAIN, *FRESH) for w in re.split("<name>", t) if len(w) > 12} & {w for t in training.TEMPLATES for w in re.split(r"<\w+>", t)}
    for lines in (None, FRESH):
        recall, precision = accuracy(held_out(lines=lines))
        assert recall > 0.9 and precision > 0.9, (recall, precision)


def test_an_item_may_be_long():
    weights = dict(P.trained_weights())
    group = "{" + ",".join(f"author{i}" for i in range(60)) + "}@lab.example"
    street = "12, rue " + " ".join(["du Pont"] * 12) + ", 75012 Belmont"
    for text, kind in ((group, "email"), (street, "address")):
        line = f"Contact: {text}.\n"
        assert [(line[a:b], k) for a, b, k in P.best_segments(line, weights)] == [(text, kind)]


MISSED = ["passport no. 123456789", "social security no. 123456789", "Phone 555-1234", "call 1234567", "tel 12345 67890", "call 030\\,1234567",
          "jd (AT) lab (DOT) edu", "jd@bücher.example", "Uferstraße~12, 10115 Berlin"]
PIECES = [*MISSED, " ", " ", " ", "\n", "\n", "\r\n", "\r", "\n\n \n", "~", ",", ", ", "\\\\", ".", "-", "12", "٣٤٥", "Łucja", "Xiaoming", "Zhang", "J.", "É.", "van ", "O'Neil", "word",
          "at ", " AT ", "@", "[at]", "(dot)", "dot ", "lab.edu", "{a,b}", "3 Old Main Street", "7, rue du Pont", "P.O. Box 7", "Gartenweg 3", "Via Roma 12",
          "Apt 4", "Room~B", "Oxford", "OX1 2ZZ", "10115 Berlin", "555", "1234567", "QK1234567", "+49", "(030)", "ext. 5", "\u2003", "\x0b", "\u3000", "中文", "ǆ"]


def test_anchor_leaves_out_no_candidate():
    for text in MISSED:
        assert P.candidates(text) and regions(text) == [text], text
    for text in ("12 Main Street\n\n \n10115 Berlin", "12 Main Street\n\\\\\nOxford", "12 Main Street\n,\nApt 4\n,\nOxford", "Xiaoming\nJ.\nZhang", "Zhang,\nXiaoming"):
        assert any(b - a > len(text) - 2 for a, b, _ in P.candidates(text)) and regions("x\n" + text + "\nx")
        assert any(text in r for r in regions("x\n\n" + text + "\nx"))
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(2, 25))) for _ in range(4000)]
    spans = [[] for _ in texts]
    for i, r, kinds in P._regions(pa.array(texts), P.anchor_patterns()):
        at = texts[i].index(r, spans[i][-1][1] if spans[i] else 0)
        spans[i].append((at, at + len(r), kinds))
    found = [(i, c) for i, text in enumerate(texts) for c in P.candidates(text)]
    assert len(found) > 4000
    for i, (a, b, kind) in found:
        assert any(x <= a and b <= y and kind in kinds for x, y, kinds in spans[i]), (kind, texts[i][a:b], texts[i])
