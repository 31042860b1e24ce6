"""Personal information inside free text (problem 8): a semi-Markov conditional random field.

Each line that may hold an item is found by finite automata over all lines of an Arrow batch.
In such a line (with its neighbours) broad grammars propose candidate segments of five types, with
alternatives of boundary and type that overlap. Whole-span features score each segment, and
bounded-entity dynamic programming picks the best set of segments that do not overlap: boundaries
and types jointly. The weights are learned on the driver by conditional likelihood (forward and
backward sums over the same lattice) from labelled lines made by the rules in ``training``.

Defined results: null, empty and blank texts hold nothing; an item found twice in a document is
listed once; texts of any length are read whole, line by line.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenfold.llm.tokens import VOCABULARY, parts, read_vocabulary

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names of several languages.
GIVEN = """
Aaron Adam Aditi Agnes Ahmed Aiko Aisha Akira Alan Albert Alejandro Alex Alexander Alice Alina Amara Amina Amir Ana
Andrea Andreas Andrew Anita Anna Anne Anton Antonio Arthur Arturo Astrid Aurélie Barbara Bastian Beatriz Ben Bjorn Bruno
Camille Carla Carlos Carmen Catherine Cecilia Charles Chiara Chloé Christian Clara Claire Daniel David Deepa Diego
Dmitri Edward Elena Elif Elodie Emil Emily Emma Eric Erik Esther Eva Fatima Farida Felix Finn Francesca Frank
Gabriel George Giulia Greta Hana Hanna Hanneke Hans Hassan Helen Henrik Hiroshi Hugo Ibrahim Idris Ines Ingrid Irina Isabel Ivan
Jack Jakob James Jan Jane Jean Jens Joana Johan John Jonas José Juan Julia Juno Jürgen Karl Karin Kenji Klara Kofi Kwame
Lars Laura Leila Lena Leo Leon Linda Lise Louis Lucas Lucia Łucja Lukas Magnus Marc Marcel Maria Marie Marit Mark Marta Martin
Mateo Matthew Max Mei Michael Miguel Mireille Mohamed Nadia Natalia Nils Nina Noah Noemi Odile Olav Olga Oliver Omar Oscar
Pablo Paul Pavel Pedro Peter Petra Philip Priya Rafael Rania Ravi Rebecca Renata Richard Robert Rosa Ruth Samuel Sanna Sara
Sarah Sergei Sofia Solveig Sophie Søren Stefan Susan Takumi Tamsin Tariq Thomas Tomas Ulrike Ursula Vera Victor Viktor Wei
William Yara Yuki Yusuf Zeynep Zoë
""".split()
# What follows a family name in the name of a thing, and words that begin no name.
THINGS = """theorem lemma transform bound index inequality conjecture method equation law effect array observatory street
avenue ave road lane square institute university fund foundation hall park society acad lett proc prize test model
algorithm distribution process space group code number constant line collaboration bridge river mills port""".split()
OPENERS = """the a an this that following in of and we if however here it its our for from by with to as table section figure
lemma theorem university institute department dr prof professor mr mrs ms contact corresponding author contributor record
requests errata correspondence unpublished patient sampling samples samplings samples runs package tel phone fax old port saint new das die der den dem ein eine mit für bei""".split()
STREETS = "Street|St\\.|Avenue|Ave\\.?|Lane|Road|Rd\\.|Drive|Boulevard|Blvd|Way|Court|Square|Terrace|Close|Crescent|Hill|Row"
GERMAN = "stra(?:ß|ss)e|str\\.|gasse|weg|platz|allee|ring|damm|ufer"
ROMANCE = "Calle|Avenida|Plaza|Paseo|Rua|Via|Viale|Piazza|Largo"
FRENCH = "rue|avenue|boulevard|place|chemin|quai|allée|impasse"
UNITS = "Apt|Suite|Unit|Flat|Room|Rm|App|Bldg"
# Words of German prose, in which every noun has a capital.
_GERMAN_WORDS = frozenset("""der die das den dem und ist sind wird ein eine für mit von bei durch nicht auf zu zur im als wie aus nach sich
werden wurde""".split())
_LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]+(?![^\W_])")

_WORD = r"[^\W\d_]"
_FAMILY = rf"(?:(?:van|von|de|der|den|da|di|del)[ ~])*(?:O'|Mc|Mac)?[^\W\d_a-zß-öø-ÿ]{_WORD}+(?:-(?:O')?[^\W\d_a-zß-öø-ÿ]{_WORD}+)*"
_FIRST = rf"[^\W\d_a-zß-öø-ÿ]{_WORD}+(?:-{_WORD}{_WORD}+)?"
_GAP = r"(?:[ ~]|[ ]?\r?\n[ ]?)"
_SEP = r"(?:\s*,\s*|\s*\\\\\s*|\s*\r?\n\s*)"
_TOWN = rf"[^\W\d_a-z]{_WORD}+(?:[- ~][^\W\d_a-z]{_WORD}+){{0,2}}"
_ZIP = r"(?:[A-Z]{1,2}-?)?\d{4,6}"
_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
_HOUSE = (
    rf"(?:\d{{1,4}}[a-z]?,?[ ~](?:[^\W\d_a-z][\w.'-]*[ ~]){{1,3}}(?:{STREETS})(?!\w)"
    rf"|\d{{1,4}}[a-z]?,?[ ~](?:{FRENCH})[ ~][\w'-]+(?:[ ~]+[\w'-]+)*?"
    rf"|P\.? ?O\.? ?Box[ ~]\d{{1,6}}"
    rf"|{_WORD}*(?:{GERMAN})[ ~]\d{{1,4}}[a-z]?"
    rf"|(?:{ROMANCE})[ ~][\w']+(?:[ ~]+[\w']+)*?[ ~]\d{{1,4}}[a-z]?)"
)
_UNIT = rf"(?:\s*,\s*(?:{UNITS})\.?[ ~]?\w{{1,6}})?"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
_AT = r"(?:\\?@| ?\[at\] ?| ?\(at\) ?| at )"
_LOCAL = rf"(?:\\?\{{[\w.+, -]+\\?\}}|\w(?:[\w.+-]|\\_)*(?: dot \w+)*)"

GRAMMARS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(rf"{_LOCAL}{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)),
    ("phone", re.compile(
        r"(?<![\w.,/+-])(?:\+\d{1,3}(?:[ ~-]|\\,)?(?:\(\d{1,4}\)(?:[ ~-]|\\,)?)?|00\d{1,3}[ ~-]|\(\d{2,5}\)[ ~-]?)?\d(?:(?:[ ~./-]|\\,)?\d){5,14}"
        r"(?:,?[ ~]?(?:ext\.?|x|extension)[ ~]?\d{1,6})?(?![\w-]|[.,]\d)", re.I)),
    ("id_number", re.compile(
        r"(?<![\w/-])(?:\d{3}[- ~]\d{2}[- ~]\d{4}|\d{4}-\d{4}-\d{4}-\d{3}[\dX]|[A-Z]{1,2}\d{6,9}|\d{6}[-+]\d{4}|\d{9,11})(?![\w-])")),
    ("address", re.compile(rf"(?<!\w){_HOUSE}{_UNIT}{_SEP}(?:{_ZIP}[ ~]{_TOWN}|{_TOWN}(?:,?[ ~](?:{_ZIP}|{_UK})|,[ ~]?{_UK})?)(?!\w)")),
    ("name", re.compile(rf"(?<![\w-])(?=({_FIRST}{_GAP}(?:[^\W\d_a-z]\.{_GAP}?)*{_FAMILY})(?![\w]))")),
    ("name", re.compile(rf"(?<![\w-])(?=({_FAMILY},{_GAP}{_FIRST}(?:{_GAP}[^\W\d_a-z]\.)*)(?![\w]))")),
)

#: What every email holds: the grammar itself is slow where there is none.
_MAIL = re.compile(rf"{_AT}[\w-]+{_DOT}[\w-]", re.I)
_given = frozenset(g.casefold() for g in GIVEN)
_things, _openers = frozenset(THINGS), frozenset(OPENERS)
# Words that lead to an item, and how many words before it they may stand.
CUES = (
    ("phone", 5, frozenset("tel telephone phone fax ring mobile call called taken".split())),
    ("id", 4, frozenset("ssn social sec passport pass orcid national identity identifier personal id researcher travel document tax".split())),
    ("thing", 3, frozenset("grant version run runs report issn doi accession nr ref pp eq fig commit".split())),
    ("person", 1, frozenset("thank thanks author by with dr prof mail call form contact record said and danken sowie frau herr herrn".split())),
)


# The same in RE2, whose own classes are ASCII: a capital, a letter, an initial.
_CAPITAL, _LETTER = r"(?:[^\P{L}a-zß-öø-ÿ]|\p{Nl}|\p{No})", r"[\p{L}\p{Nl}\p{No}]"
_INITIAL = r"(?:[^\P{L}a-z]|\p{Nl}|\p{No})\."
_FAMILY_HEAD = rf"(?:(?:van|von|de|der|den|da|di|del)[ ~])*(?:O'|Mc|Mac)?{_CAPITAL}{_LETTER}"
#: Lines whose end and next line's beginning may be the parts of one name.
NAME_ENDS, NAME_GOES_ON = rf"(?:{_CAPITAL}{_LETTER}+,?|{_INITIAL}) ?\r?\n\z", rf"\A ?(?:{_INITIAL}|{_FAMILY_HEAD})"


def address_pattern() -> str:
    """The part of ``anchor_patterns`` for lines with a house or unit, after which an address may go on."""
    digit = r"\p{Nd}"
    house = (
        rf"{digit}[a-z]?,?[ ~](?:(?:[^\P{{L}}a-z]|\p{{Nl}}|\p{{No}})[\p{{L}}\p{{N}}_.'-]*[ ~]){{1,3}}(?:{STREETS})|{digit}[a-z]?,?[ ~](?:{FRENCH})[ ~]"
        rf"|P\.? ?O\.? ?Box[ ~]{digit}|(?:{GERMAN})[ ~]{digit}|(?:{ROMANCE})[ ~]"
    )
    return rf"{house}|\A[\s\p{{Z}},]*(?:{UNITS})\.?[ ~]?[\p{{L}}\p{{N}}_]"


def anchor_patterns() -> tuple[str, ...]:
    """RE2 patterns of lines that may hold an item; they decide only where the field looks.

    Each part is what every match of a grammar holds in its first line, so that no candidate is
    left out. One automaton for all would have too many states. Names need no list: any pair of capitalised words is looked at.
    """
    digit = r"\p{Nd}"
    names = rf"{_CAPITAL}{_LETTER}+(?:-{_LETTER}{_LETTER}+)?[ ~](?:{_INITIAL}[ ~]?)*{_FAMILY_HEAD}|{_CAPITAL}{_LETTER}+,[ ~]{_CAPITAL}{_LETTER}"
    mail = rf"(?i:{_AT}[\p{{L}}\p{{N}}_-]+{_DOT}[\p{{L}}\p{{N}}_-])"
    # phones and the numbers of persons: six digits, between them one separator at most
    numbers = rf"{digit}(?:(?:[ ~./-]|\\,)?{digit}){{5}}"
    return names, mail, numbers, address_pattern()


#: Lines that may stand between the parts of an address.
BETWEEN = r"\A[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85},\\]*\z"


_PARTS, _NEXT, _LED = re.compile(r",|" + _GAP), re.compile(r"[ ~]([A-Za-z]+)"), re.compile(r"([^\W\d_]+)[ ~]$")
_INITIAL_BEFORE = re.compile(r"[^\W\d_]\.[ ~]?$")


def candidates(text: str, kinds: frozenset[str] = frozenset(KINDS)) -> list[tuple[int, int, str]]:
    """Segments (begin, end, kind) of some kinds the grammars propose, with shorter and longer alternatives."""
    out: set[tuple[int, int, str]] = set()
    for kind, grammar in GRAMMARS:
        if kind not in kinds:
            continue
        if kind == "email" and not _MAIL.search(text):
            continue
        for m in grammar.finditer(text):
            a, b = m.span(1) if grammar.groups else m.span()
            if kind in ("phone", "id_number") and not text[a:b].isascii() and len({ord(c) - int(c) for c in text[a:b] if c.isdecimal()}) > 1:
                continue  # digits of several scripts are no number
            out.add((a, b, kind))
            if kind == "address":  # without a last word of the town
                cut = max(text.rfind(" ", a, b), text.rfind("~", a, b))
                if cut > a:
                    out.add((a, cut, kind))
            elif kind == "name" and "," not in text[a:b] and "-" in text[a:b]:
                cut = text.rfind("-", a, b)
                if any(c in " ~\n" for c in text[a:cut]):
                    out.add((a, cut, kind))
    return sorted(out)


@lru_cache(2)
def vocabulary_words(path: str = VOCABULARY) -> tuple[frozenset[str], frozenset[str]]:
    """(common, proper): whole words of a public vocabulary that stand there in lower case, and those
    (in lower case here) that stand there only with a capital."""
    words = {t[1:].decode() for t in read_vocabulary(path) if t[:1] == b" " and t[1:].isalpha()}
    lower = frozenset(w for w in words if w.islower())
    return lower, frozenset(w.lower() for w in words if w.istitle()) - lower


_classes: dict[str, str] = {}
_lexicon: tuple[frozenset[str], frozenset[str]] | None = None


def use_lexicon(lexicon: tuple[frozenset[str], frozenset[str]]) -> None:
    """The words of the vocabulary in this process; workers get them from the driver, not from a file."""
    global _lexicon
    if lexicon != _lexicon:
        _lexicon = lexicon
        _classes.clear()


def word_class(word: str) -> str:
    """``g`` a listed given name, ``c`` a common word, ``p`` a word known only with a capital, ``r`` a rare one."""
    found = _classes.get(word)
    if found is None:
        low, (common, proper) = word.casefold(), _lexicon or vocabulary_words()
        found = "g" if low in _given else "c" if low in common else "p" if low in proper else "r"
        if len(_classes) > 1_000_000:
            _classes.clear()
        _classes[word] = found
    return found


_TOKEN, _LETTERS, _LAST_STOP = re.compile(r"\w+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?"), re.compile(r"[.;:]\s*$")


@lru_cache(4096)
def _lead(before: str) -> tuple[str, tuple[str, ...]]:
    """The word before a segment, none after a stop, and the cues that lead to it."""
    words = _TOKEN.findall(before.lower())
    last = words[-1] if words and not _LAST_STOP.search(before) else ""
    return last, tuple(c for c, n, cue in CUES if not cue.isdisjoint(words[-n:]))


class _Surroundings:
    """Of a text: where its lower-case words, those of them the vocabulary does not have, and German ones end."""

    def __init__(self, text: str):
        self.words, self.strange, self.german = [], [], []
        for m in _LOWER.finditer(text):
            word = m.group()
            if word in _GERMAN_WORDS:
                self.german.append(m.end())
            if len(word) > 2:
                self.words.append(m.end())
                if word_class(word) == "r":
                    self.strange.append(m.end())

    @staticmethod
    def _between(ends: list[int], a: int, b: int) -> int:
        return bisect_right(ends, b) - bisect_right(ends, a)

    def near(self, a: int, b: int) -> tuple[int, int]:
        """(German words within 80 characters of a segment, quarters of strange words within 120)."""
        around = lambda ends, r: self._between(ends, a - r, a) + self._between(ends, b, b + r)
        words = around(self.words, 120)
        return around(self.german, 80), (8 * around(self.strange, 120) + words + 1) // (2 * words + 2)


def features(text: str, a: int, b: int, kind: str, around: _Surroundings | None = None) -> list[str]:
    """Whole-span features of a segment and its surroundings."""
    span = text[a:b]
    before = text[max(0, a - 40) : a]
    last, cues = _lead(before)
    out = [kind, f"{kind}|before {before[-1:]}", f"{kind}|after {text[b : b + 1]}", f"{kind}|word {last}"]
    out += [f"{kind}|cue {c}" for c in cues] or [f"{kind}|no cue"]
    if kind == "email":
        end = re.split(r"[^\w]+", span)[-1]
        out += ["email|word domain" if end.isalpha() else "email|number domain"]
        out += ["email|sign" if "@" in span else "email|disguised" if re.search(r"(?i)dot|\(at|\[at", span) else "email|plain at"]
        out += ["email|one dot"] if not re.search(r"@|dot|[(\[]at", span) else []
    elif kind in ("phone", "id_number"):
        bare = re.sub(r",?[ ~]?(?i:ext\.?|x)[ ~]?\d+$", "", span)
        groups = [len(g) for g in re.findall(r"\d+", bare)]
        digits = sum(groups)
        seps = "".join(sorted(set(re.sub(r"[\w]", "", bare))))
        letters = "L" if re.match(r"[A-Z]", span) else ""
        out += [f"{kind}|groups {letters}{'-'.join(map(str, groups))}", f"{kind}|digits {digits}", f"{kind}|seps {seps}"]
        out += [f"{kind}|plus"] if span[0] == "+" else [f"{kind}|zero"] if span[0] == "0" else []
        out += [f"{kind}|ext"] if bare != span else []
        out += [f"{kind}|n {len(groups)}", f"{kind}|known {'-'.join(map(str, groups)) in ('3-2-4', '4-4-4-4', '4-4-4-3', '6-4')}"]
    elif kind == "address":
        whole = re.search(rf"(?:{_ZIP}[ ~]{_TOWN}|(?:{_ZIP}|{_UK}))$", span)
        house = re.match(_HOUSE, span)
        style = "box" if "Box" in span else "street" if re.search(rf"{STREETS}", span) else "other"
        following = text[b : b + 12]
        more = re.match(rf"(?:,?[ ~](?:{_ZIP}|{_UK}))|(?:[- ~][A-Z][a-z])", following)
        out += [f"address|style {style}", f"address|ends {'zip' if whole else 'town'}", f"address|cut {bool(more)}", f"address|house {bool(house)}"]
    else:
        swapped = "," in span
        bits = _LETTERS.findall(span)
        full = [w for w in bits if len(w) > 1]
        given = full[-1] if swapped else full[0]
        family = full[0] if swapped else full[-1]
        parts_ = _PARTS.split(span)
        head = parts_[0].split("-")[0].strip()
        if swapped:
            tail = [p for p in parts_[1:] if len(p.rstrip(".")) > 1]
            head = tail[0].split("-")[0] if tail else given
        c1, c2 = word_class(head), "t" if family.lower() in _things else word_class(family)
        known, person = c1 == "g", "person" in cues
        order = "swapped" if swapped else "plain"
        two = f"{c1}{c2}"
        out += [f"name|{order} {two}", f"name|{order}", f"name|{two} cue {person}"]
        next_, led = _NEXT.match(text, b), _LED.search(before)
        thing = next_ is not None and next_[1].lower() in _things
        out += [f"name|thing {thing}", f"name|led {two} {led is not None and led[1][0].isupper()}", f"name|goes on {next_ is not None and next_[1][0].isupper()} {two}"]
        out += [f"name|led by {word_class(led[1]) if led else ''} {two}"]
        german, foreign = (around or _Surroundings(text)).near(a, b)
        out += [f"name|foreign {foreign} {two}", f"name|foreign {foreign} given {known} cue {person}", f"name|foreign {foreign} given {known} starts {before[-1:] in ('', chr(10), '{')}"]
        out += [f"name|german {min(german, 3)} {two}", f"name|german {german > 0} given {known} cue {person}"]
        out += [f"name|particle {p} given {known} cue {person}" for p in bits if p in ("der", "von", "den")]
        follows = "".join("a" if c.islower() else "A" if c.isalpha() else c for c in text[b : b + 2])
        out += [f"name|given {known} follows {follows}", f"name|german {german > 0} given {known} follows {follows}"]
        out += [f"name|capital {span[0].isupper()}", f"name|{two} starts {before[-1:] in ('', chr(10))}"]
        out += [f"name|opener {head.lower() in _openers}", f"name|capitals {span.upper() == span} {family.isupper()}", f"name|n {len(full)}"]
        out += [f"name|cut {text[b : b + 1] == '-' and text[b + 1 : b + 2].isalpha()}", f"name|double {text[b : b + 2] == '--'}"]
        out += [f"name|{order} given {known} after initial"] if _INITIAL_BEFORE.search(before) else []
        out += [f"name|{order} before point"] if text[b : b + 1] == "." and text[b + 1 : b + 3].strip().isalpha() else []
        out += ["name|line break"] if "\n" in span else []
    return out


def _lattice(text: str) -> list[tuple[int, int, str, list[str]]]:
    around = _Surroundings(text)
    return [(a, b, k, features(text, a, b, k, around)) for a, b, k in sorted(candidates(text), key=lambda s: (s[1], s[0], s[2]))]


def best_segments(text: str, weights: dict[str, float], kinds: frozenset[str] = frozenset(KINDS)) -> list[tuple[int, int, str]]:
    """The highest-scoring set of segments that do not overlap (Viterbi over segment ends)."""
    found, around, weight = candidates(text, kinds), None, weights.get
    if any(k == "name" for _, _, k in found):
        around = _Surroundings(text)
    segments = [(a, b, k, sum([weight(f, 0.0) for f in features(text, a, b, k, around)])) for a, b, k in found]
    segments = sorted((s for s in segments if s[3] > 0), key=lambda s: s[1])
    ends = [s[1] for s in segments]
    best, back = [0.0], [None]
    for i, (a, b, k, score) in enumerate(segments):
        j = i
        while j > 0 and ends[j - 1] > a:
            j -= 1
        if best[j] + score > best[i]:
            best.append(best[j] + score)
            back.append(j)
        else:
            best.append(best[i])
            back.append(None)
    out, i = [], len(segments)
    while i > 0:
        if back[i] is None:
            i -= 1
        else:
            out.append(segments[i - 1][:3])
            i = back[i]
    return out[::-1]


def _log_add(x: float, y: float) -> float:
    m = max(x, y)
    return m + math.log1p(math.exp(min(x, y) - m))


def train(examples: list[tuple[str, set[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> dict[str, float]:
    """Weights by stochastic gradient ascent (Adagrad) on the conditional log-likelihood.

    Any text outside chosen segments scores 0. Sums over all segmentations run over the sorted
    ends of the candidates, forward and, by mirroring, backward.
    """
    data = []
    for text, gold in examples:
        lattice = _lattice(text)
        if lattice:
            data.append((lattice, [(a, b, k) in gold for a, b, k, _ in lattice]))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for lattice, gold in data:
            points = sorted({p for a, b, _, _ in lattice for p in (a, b)})
            place = {p: i for i, p in enumerate(points)}
            arcs = [(place[a], place[b], sum(weights.get(f, 0.0) for f in fs)) for a, b, _, fs in lattice]
            forward, backward = [0.0] * len(points), [0.0] * len(points)
            into: list[list] = [[] for _ in points]
            out: list[list] = [[] for _ in points]
            for i, j, s in arcs:
                into[j].append((i, s))
                out[i].append((j, s))
            for j in range(1, len(points)):
                forward[j] = forward[j - 1]
                for i, s in into[j]:
                    forward[j] = _log_add(forward[j], forward[i] + s)
            for i in range(len(points) - 2, -1, -1):
                backward[i] = backward[i + 1]
                for j, s in out[i]:
                    backward[i] = _log_add(backward[i], backward[j] + s)
            total = forward[-1]
            for (i, j, s), truth, (_, _, _, fs) in zip(arcs, gold, lattice):
                gradient = truth - math.exp(min(0.0, forward[i] + s + backward[j] - total))
                if abs(gradient) < 1e-3:
                    continue
                for f in fs:
                    g = gradient - decay * weights.get(f, 0.0)
                    squares[f] = squares.get(f, 1e-2) + g * g
                    weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return weights


@lru_cache(2)
def trained_weights(vocabulary: str = VOCABULARY) -> tuple[tuple[str, float], ...]:
    from lumenfold.llm.training import examples

    use_lexicon(vocabulary_words(vocabulary))
    return tuple(sorted(train(examples()).items()))


#: The kinds of items of which each of ``anchor_patterns`` finds the lines.
ANCHORED = (("name",), ("email",), ("phone", "id_number"), ("address",))


def _regions(texts: pa.Array, patterns: tuple[str, ...]) -> Iterator[tuple[int, str, frozenset[str]]]:
    """(index of text, lines, kinds) of the lines that may hold an item of these kinds, with one line on each side.

    After a house or unit, lines that are blank or hold but commas and line commands do not count as
    that line: the address may go on after them.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return
    raw = np.frombuffer(data, np.uint8)
    cuts = np.union1d(np.flatnonzero((raw == 10) | ((raw == 13) & (np.append(raw[1:], 0) != 10))) + 1, ends)
    cuts = cuts[(cuts > 0) & (cuts <= len(data))]
    cuts = np.append(0, cuts).astype(np.int32)
    lines = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    match = lambda p: pc.match_substring_regex(lines, p).to_numpy(zero_copy_only=False)
    each = np.array([match(p) for p in patterns])
    each[0] |= match(NAME_ENDS) & np.append(match(NAME_GOES_ON)[1:], False)
    hits = np.flatnonzero(each.any(0))
    if not len(hits):
        return
    owner = np.searchsorted(ends, cuts[:-1], side="right") - 1
    full = np.append(np.flatnonzero(~match(BETWEEN)), len(owner))
    after = np.where(match(address_pattern())[hits], full[np.searchsorted(full, hits, side="right").clip(max=len(full) - 1)], hits + 1)
    begin, stop = -1, -1
    spans = []
    for h, b in zip(hits.tolist(), after.tolist()):
        a = h - 1 if h and owner[h - 1] == owner[h] else h
        b = b if b < len(owner) and owner[b] == owner[h] else h + 1 if h + 1 < len(owner) and owner[h + 1] == owner[h] else h
        if begin >= 0 and a <= stop and owner[a] == owner[begin]:
            stop = max(stop, b)
        else:
            if begin >= 0:
                spans.append((begin, stop))
            begin, stop = a, b
    spans.append((begin, stop))
    kinds = [frozenset(k for j, own in enumerate(ANCHORED) if bits >> j & 1 for k in own) for bits in range(1 << len(ANCHORED))]
    for a, b in spans:
        bits = sum(1 << j for j, some in enumerate(each[:, a : b + 1].any(1)) if some)
        yield int(owner[a]), str(data[cuts[a] : cuts[b + 1]], "utf-8"), kinds[bits]


def _finder(weights: dict[str, float], lexicon: tuple[frozenset[str], frozenset[str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_lexicon(lexicon)
        patterns = anchor_patterns()
        for batch in batches:
            for part in parts(batch, "text"):
                seen: dict[tuple[int, str, str], None] = {}
                for i, region, kinds in _regions(part.column("text"), patterns):
                    for a, b, kind in best_segments(region, weights, kinds):
                        seen[i, kind, region[a:b]] = None
                rows = np.array([k[0] for k in seen], np.int64)
                others = [part.column(j).take(pa.array(rows)) for j, n in enumerate(part.schema.names) if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                found = [pa.array([k[1] for k in seen], pa.string()), pa.array([k[2] for k in seen], pa.string())]
                yield pa.RecordBatch.from_arrays([*others, *found], names=[*names, "kind", "found"])

    return run


def find_items(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, kind, found): each distinct item of each row's text. The driver reads the vocabulary."""
    lexicon = vocabulary_words(vocabulary)
    use_lexicon(lexicon)
    weights = dict(trained_weights(vocabulary))
    inner = df.select(df[f"`{key}`"].alias("id"), df[f"`{text}`"].alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(_finder(weights, lexicon), f"id {kind}, kind string, found string").withColumnRenamed("id", key)


def _redactor(weights: dict[str, float], placeholders: dict[str, str], lexicon: tuple[frozenset[str], frozenset[str]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_lexicon(lexicon)
        patterns = anchor_patterns()
        for batch in batches:
            for part in parts(batch, "text"):
                column = part.column("text")
                texts = column.to_pylist()
                items: dict[int, list[tuple[str, str]]] = {}
                for i, region, kinds in _regions(column, patterns):
                    items.setdefault(i, []).append((region, "".join(_replaced(region, weights, placeholders, kinds))))
                for i, changes in items.items():
                    out, at = [], 0
                    for old, new in changes:  # regions come in order and do not overlap
                        j = texts[i].index(old, at)
                        out += [texts[i][at:j], new]
                        at = j + len(old)
                    texts[i] = "".join([*out, texts[i][at:]])
                names = part.schema.names
                columns = [pa.array(texts, pa.string()) if n == "text" else part.column(j) for j, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _replaced(region: str, weights: dict[str, float], placeholders: dict[str, str], kinds: frozenset[str]) -> Iterator[str]:
    at = 0
    for a, b, kind in best_segments(region, weights, kinds):
        yield region[at:a]
        yield placeholders[kind]
        at = b
    yield region[at:]


def redact(df: DataFrame, key: str, text: str, placeholders: dict[str, str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) with items replaced by ``[EMAIL]`` and so on; null texts stay null."""
    lexicon = vocabulary_words(vocabulary)
    use_lexicon(lexicon)
    placeholders = placeholders or {k: f"[{k.upper()}]" for k in KINDS}
    inner = df.select(df[f"`{key}`"].alias("id"), df[f"`{text}`"].alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    done = inner.mapInArrow(_redactor(dict(trained_weights(vocabulary)), placeholders, lexicon), f"id {kind}, text string")
    return done.toDF(key, text)
