"""Labelled lines for the field of ``personal``, made by rules from a fixed seed.

``PER_TEMPLATE`` bounds the sample: so many lines from each template. A template's ``<kind>``
slots become items of that kind; ``<family>``, ``<town>`` and the like become ordinary text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from lumenfold.llm import personal
from lumenfold.llm.personal import GIVEN, THINGS

PER_TEMPLATE = 24

# Given names that are not in the list of ``personal``, so that the field learns names from
# their surroundings; the tests hold out others.
UNLISTED = """Xavier Nkechi Thandiwe Yevgeny Bartłomiej Siobhan Raúl Minh Phuong Ngozi Oluwaseun Tadashi Haruki Jiho Seojun
Milica Dragan Zdeněk Radka Ilse Wolfgang Aino Väinö Gökhan Merve Farhad Shirin Rakesh Lakshmi Anil Suresh Mihai Ioana
Csaba Zsófia Kwabena Abena Tunde Lwazi Étienne Jin""".split()
UNLISTED_SHARE = 0.4
_HEADS = "Bar Dor Fal Hol Jan Mor Pet Quin Ros Sten Tor Wal Zan Brö Mül Hers Lund Ek Abr Dub Gal Vas Yam Okon Chat Szab Iva Kow".split()
_TAILS = "berg son ova ini mann etti quist sen wood ric ski ell ander ley dahl ström feld inen aard ovsky amoto eira adze yan escu".split()
_TOWNS = ["Ashford", "Neustadt", "Port Hallow", "Saint-Brieux", "Lunden-Ost", "Grünau", "Mill Valley", "Orsova", "Westhaven", "Belmont"]
_STREETS = ["Granite", "Harbour", "St. Anne", "Old Church", "Maple", "King", "Willow", "North Gate"]

# Slots in angle brackets: items of the five kinds; <w> a word of the public vocabulary and <W> one with a
# capital; the others are listed in ``_FILL``. Words around items are random, so that no phrase decides.
TEMPLATES = """
\\<command>{<name>}
\\<command>{<name> \\and <name>}
\\<command>{<name> \\and <name> \\and <name>}
\\<command>{<name>\\orcid{<id_number>}}
\\<command>{<name>\\<command>{<W> <w>, <town>}}
\\<command>{<initial> <family> \\and <initial> <family>}
\\<command>{<name>; <w>: <email>}
\\<command>{<W> <w>: <name>, \\texttt{<email>}.}
\\<command>{<email>}
\\<command>{<phone>}
\\<command>{<W> <w> <w>, <address>}
\\<command>{<address>}
\\<command>{<label> <id_number>}
\\<command>{<label> <id_number>}
\\<command>{<W> <name>}
\\<command>{<name> <w> <w> <w> <w>.}
\\<command>{<W> <w> <w> <name>: <w> <w>.}
<W> <w> <w> <name> <w> <w>.
<W> <w> <w> <name> <w> <w>.
<W> <w> <w> <name> <w> <w>.
<W> <w>, <name> <w> <w> <w>.
<W> <w> <name>, <w> <w> <w>.
<name> <w> <w> <w> <w>.
<name> <w> <w> <w> <w>.
<W> <w>, <name>, <w> <w>.
<W> <w> <w> <name>.
<W> <w> <w> <name>.
<W> <w> <name> and <name> <w> <w> <w>.
<W> <w> <name>, <name> and <name> <w> <w>.
<W> <w> <name> <w> <w> <name> <w>.
<W> <w> <name> <w>; <name> <w> <w> <w>.
<W> <person> <name> <w> <w>.
<W> <w> <person> <name> <w> <person> <name>.
<w> <w>. <W> <w> <name> <w> <w>
<w> <w>. <name> <w> <w> <w>
<W>: <name>
<W> <w> <w>: <name>, <w> <w>
<W> <w> <name> (<w> <phone>).
<W> <w> <w> <name> <<email>>.
<W> <w> <w> <name> (<email>).
<W> <w> <w> <w> <email>.
<W>: <email>
<w> <w> <email> <w> <w>
% <w> <email> <w> <w>
% <w> <w> <name> <w> <w> <w>, <call> <phone>
% <name> / <address> / <phone> / <email>
% <w> <w> <name>, <w> <w>
% <name> <w> <w> <w>
%% <name> -- <phone> -- <w> <w>
% <w> <w> <three>: <label> <id_number>
% <call> <phone>
% <w> <w>: <name>, <label> <id_number>
% <name>: <w> <w> <w>? <w> <given>
% <name>: <w> <w> <w>? <w> <name>
<W> <w> <w> <label> <id_number> <w> <w> <w>.
<W> <w> <label> <id_number>, <w> <w>.
<W> <w>: <name>; <label> <id_number>.
<name> (<label> <id_number>) <w> <w> <w>.
<W> <w> <w> <w>: <name>, <address>, <phone>, <email>.
<address> / <phone> / <email>
<name>\\\\
<W> <phone>\\\\
<call> <phone>\\\\
<W> <w> <w> <address>, <w> <w> <w>.
<W> <w> <w> <w> <address>.
<W> <w> <w> <w> <w> <phone>.
<W> <w> <w> <w> <call> <phone> <w> <w> <w>.
<W> <w> <w> <w> <w> <call> <phone> <w> <w> Dr.~<name>.
``<W> <w> <w> <w>,'' <w> <name>. <W> <w> <w> <name>.
<dank> <name> und <dank> <name>: <noun> <noun>.
<german> <dank> <name> <small> <noun>.
<noun> <small> <name>: <email>.
Wir <dank> <name> für die <noun> der <noun>, <name> sowie <name> für das <noun>.
The <family>--<family> <w> <w> <w>.
<W> <family> et al.~\\cite{key2001}, <w> <w> <w> <w>.
<W> <family> et al.~\\cite{key2001} <w> <w>.
% <W> <family> et al.~\\cite{key2001} <w> <w>.
<W> <family> <w> <w> <w> <w>.
<w> <w>. <W> <family> <w> <w> <w>.
<w> <w>). <W> <family> et al. <w> <w> <w>.
<W> <acronym>-<other> <w> <w> <w>.
<Odd> <acronym>-<other> <w> <w> <w>.
<w> <w>. <Odd> <acronym>-<other>-<acronym> <w> <w> <w>.
\\<section>{<Odd> <W>}
\\<section>{<Odd> <Odd> and <W> <Odd>}
The <Odd> <W> of <W> <Odd> <w> <w> <w>.
<W> <acronym> <w> <w> the <acronym> <w>.
<W> <w> <w> <family> and <family> <w>.
<W> <w> <w> <w> <w> <w> the <family> <Thing>.
The <family> <Thing> of Fig.~2 <w> <w>.
The <family> <Thing> and the <town> <Thing> <w> <w> <w>.
<W> <w> <w> <two>\\,GHz @ <digit>\\,V <w> the <town> <w>.
Library \\verb|grid@<digit>.<digit>| <w> <w> <w> (commit <hex>).
<W> <digit>.<two>.<three>.<four> <w> the <w> <w>.
<W> <other> <w> doi:<other> <w> <w> <w> <w>.
<W> <other> <w> <w> <w>.
<W> <w> <W> <other> <w> <w>.
<W> <w> <w>-<other> <w> ISSN <four>-<four>.
<W> <w> <w> <w> <w> <w> no.\\ <three>-<three>-<two> <w> the <town> Fund.
Nr. <two>, <five> <w>, <w> <digit> <w> <two>.
<initial> <family>, <initial> <W>. <W>. <W>. <two> (<four>) <three>.
<initial> <family>, <initial> <family> (<four>) <W> <w>. <W>. <town> <W>. \\textbf{<two>}:<three>
<initial> <family>, \\textit{<W> <w>}, <W>. <W>. <W>. <two>, <three> (<four>).
<W>, the <w> <w> not <w> by the <w> <w> (see vol.~<two>, pp.~<three>--<four>).
<w> & <three> & <two>.<two> \\\\
Panel~\\ref{<w>:<w>} <w> the <w> <w>, <w> at <three>\\,K with <two> <w>.
<family> and <family> <w> with <family>, <w> <w> by <family>.
\\bibitem{key<four>} <initial> <family>, <initial> <family>, <W>. <town> <W>. <two> (<four>) <three>.
\\bibitem{key<four>} <initial> <family>, <initial> <family>, <initial> <family>, <W>. <family>. <W>. <two> (<four>) <three>.
\\bibitem{key<four>} <initial> <family>, <W>. <family>. <two> (<four>) <three>.
\\bibitem{key<four>} <initial> <family>, <W>. <W>. <W>. <two>, <three> (<four>).
\\bibitem{key<four>} <initial> <family>, \\textit{<W> <w>}, <W>. <W>. <two>, <three> (<four>).
The <w> <w> <three> <three> <two> <w> <w> <w>.
The <w> <w> <three> 555 <two> <w> <w> <w> and <two> <three> <three> <w>.
<W> <w> <w> <w> <hex> on 12 May <four>.
\\begin{<w>}\\label{<w>:<three>-<two>}
12345678901234567890
The <town> <W> and the <town> <Thing> <w> <w> <town> <w> 12 May <four>.
<given> <w> <w> the <w>, and so did <given>.
\\title{<W> <W> <w> <W> <W>}
\\<section>{<W> <W> and <W>}
\\<section>{<W> <W>}
\\<section>{<W> <w> <W> <W> and <W> <W>}
The <W> <W> of the <town> <w>. <W> <W> <W>, <W> <W> and <W> <W>.
<W> the <W> <W> <W> <w> the <w> <w>.
The <W> of <W> <town> and the <W> <W> of <town> <w> <w>.
<W> <w> in <W> <town> and <W> <known> <w> <w> <w>.
The <known> <W> and the <known> <W> <w> <w>.
<W> <known> <w> <w> the <W> <known> <W> <w>.
<noun> <noun> wird sehr <small>. Die <noun> <noun> zeigt der <noun> eine <noun> <noun>.
<noun> der <noun> mit <noun> <noun> für <noun>. Das <noun> <noun> bei <noun> von <noun> <noun>
Mit <noun> und <noun> <noun> ist die <noun>, <noun> und <noun> <noun>, gleich. Für <noun> <noun> schwach.
Langsam <noun> <noun> nicht <noun> durch <noun> <noun> deutlich <noun> <noun> <noun>.
<script> <script> <script> <script>
<script> <script> <script> und <script> <script>
See <W> <W>, <W>, <W> <W> and <W>, <W>.
<german>
<german>
<german>
<german>
<german>
<german>
<german>
\\section{<noun>} <german>
$x = 1$ <german>
<german> \\cite{key2001} <german>
<german> $y$, <german>
\\(h \\le <digit>\\). <german> \\(k\\) <german>
$\\beta_{<digit>}$. <german>
<german> $\\theta_{<digit>}$.
<german>\\\\ <german> \\(h = <two>\\)
% <german>
<noun> <small> <noun> <noun> $\\theta \\ge <digit>$
""".strip().splitlines()

_NOUNS = """Zeitung Leistung Rechnung Wohnung Freiheit Höhe Länge Druck Strom Feld Wert Probe Kraft Stärke Fläche Spannung
Dichte Wirkung Bewegung Geschwindigkeit Teilchen Ordnung Menge Reihe Zahl Änderung Öffnung Beispiel Verfahren Wärme""".split()
_SMALL = """wird eine der die das von für mit bei nicht durch und ist langsam genau schnell gleich immer oft gering folgt ergibt
besteht sehr auch nur nach aus als""".split()
_SCRIPTS = "русский Русский язык עברית עם العربية لغة ไทย ภาษา Ελληνική γλώσσα 中文 漢字 かな हिन्दी Հայերեն ქართული".split()


def _digits(rng: random.Random, shape: str) -> str:
    return re.sub("9", lambda _: str(rng.randrange(10)), shape)


def _family(rng: random.Random) -> str:
    if rng.random() < 0.2:
        return rng.choice(_words()[1]).capitalize()
    return rng.choice(["", "", "", "", "", "O'"]) + rng.choice(_HEADS) + rng.choice(_TAILS)


def _given(rng: random.Random) -> str:
    if rng.random() < 0.06:
        return rng.choice(["Anne-Lise", "Jean-Paul", "Karl-Heinz", "Ana-Maria"])
    return rng.choice(GIVEN)


def _first(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.07:
        return rng.choice(_words()[kind < 0.06]).capitalize()
    return rng.choice(UNLISTED) if rng.random() < UNLISTED_SHARE else _given(rng)


def _name(rng: random.Random) -> str:
    family = _family(rng) + ("-" + _family(rng) if rng.random() < 0.12 else "")
    family = rng.choice(["van der ", "von ", "de ", "van "]) + family if rng.random() < 0.06 else family
    initial = rng.choice("ABDEKLRST") + "." if rng.random() < 0.12 else ""
    if rng.random() < 0.15:
        return f"{family}, {_first(rng)}"
    gap = rng.choice([" ", " ", " ", " ", "~", "\n"])
    out = gap.join(x for x in (_first(rng), initial, family) if x)
    return out.upper() if rng.random() < 0.08 else out


def _german(rng: random.Random) -> str:
    """Words of German prose without sense, in which only nouns and beginnings have capitals."""
    out = ""
    for _ in range(rng.randrange(1, 4)):
        words = [rng.choice(rng.choice((_NOUNS, _SMALL))) for _ in range(rng.randrange(5, 13))]
        # a few nouns that the vocabulary knows
        words = [rng.choice(_words()[rng.random() < 0.7]).capitalize() if w[0].isupper() and rng.random() < 0.15 else w for w in words]
        if rng.random() < 0.4:
            words[1:1] = [rng.choice(["der", "von", "der", "den"]), rng.choice(_NOUNS)]
        out += words[0].capitalize() + " " + " ".join(words[1:]) + ". "
    return out.strip()


def _email(rng: random.Random) -> str:
    a, b = _given(rng).lower().split("-")[0], _family(rng).lower().replace("'", "")
    plain = lambda s: re.sub(r"[^a-z]", "", s) or "ab"
    a, b = plain(a), plain(b)
    host = rng.choice(["lab.west.example", "mail.test", "uni-nord.example", "post.orsova.invalid", "geo.edu.example"])
    form = rng.randrange(9)
    if form == 0:
        return f"{a} dot {b} at " + host.replace(".", " dot ")
    if form == 1:
        return f"{b} (at) " + host.replace(".", " (dot) ")
    if form == 2:
        return f"{a}.{b} [at] {host}"
    if form == 3:
        return f"{{{a},{b}}}@{host}"
    if form == 4:
        return f"{a}.{b}\\@{host}"
    if form == 5:
        return f"{a}\\_{b}@{host}"
    if form == 6:
        return f"{a}.{b}@{host}".upper()
    return rng.choice([f"{a}.{b}+lab@{host}", f"{b}{rng.randrange(99)}@{host}", f"{a}-{b}@{host}"])


def _phone(rng: random.Random) -> str:
    shape = rng.choice([
        "+49 30 99999 999", "(999) 555 9999 ext. 999", "+44 (0)20 9999 9999", "020~9999~9999", "01.99.00.99.99", "030/99999-999",
        "0044 1632 999999", "+1\\,999\\,555\\,9999", "19995559999", "+1-999-555-9999", "+1 (999) 555-9999", "999.555.9999",
        "+33 1 99 00 99 99", "+61 2 5550 9999", "(999) 555-9999", "0999 99 99 99", "999-555-9999", "+44 20 9999 9999", "+39 06 9999 9999",
    ])
    return _digits(rng, shape)


def _id_number(rng: random.Random) -> str:
    shape = rng.choice(["999-99-9999", "999 99 9999", "0007-9999-9999-9999", "0007-9999-9999-999X", "QK9999999", "XR9999999", "999999-9999"])
    return _digits(rng, shape)


def _address(rng: random.Random) -> str:
    town, zip_ = rng.choice(_TOWNS), _digits(rng, "99999")
    street = f"{rng.randrange(1, 300)} {rng.choice(_STREETS)} {rng.choice(['Street', 'Lane', 'Ave', 'Avenue', 'Road'])}"
    return rng.choice([
        f"{street}, {town} {zip_}", f"{street}\\\\\n{zip_} {town}", f"{street}, Apt.~{rng.randrange(40)}, {town}, OX{rng.randrange(9)} {rng.randrange(9)}ZZ",
        f"{rng.randrange(99)}, rue {rng.choice(['Sainte-Claire', 'du Pont', 'des Lilas'])}, {zip_} {town}",
        f"{rng.choice(['Haupt', 'Garten', 'Ufer'])}{rng.choice(['straße', 'gasse', 'weg', 'str.'])} {rng.randrange(180)}{rng.choice(['', '', 'b'])}, {zip_} {town}",
        f"{rng.choice(['Calle', 'Avenida', 'Plaza', 'Via', 'Rua'])} {rng.choice(['del Sol', 'Puerta Nueva', 'del Puente', 'Grande', 'de la Luna'])} {rng.randrange(140)}, {zip_} {town}", f"P.O. Box {rng.randrange(9999)}, {town} {zip_}",
    ])


_LABELS = ("ORCID", "ORCID iD:", "SSN", "social security number", "passport", "passport no.", "national identity no.", "personal ID",
           "tax and social no.", "researcher iD", "author identifier", "travel document", "Pass-Nr.", "Soc.\\ Sec.\\ no.")
_COMMANDS = "author thanks footnote dedicatory contributor address affiliation email note person editor".split()
_SECTIONS = "section subsection paragraph chapter title caption emph textbf".split()
_PERSON = "by with to from of thank and for mail said dr".split()
_CALLS = ["tel", "Tel.:", "phone", "fax", "mobile", "ring", "call", "taken at", "Phone", "Fax"]


def _words() -> tuple[list[str], list[str]]:
    """The words that ``personal`` goes by, in a fixed order."""
    return _sorted(personal._lexicon or personal.vocabulary_words())


@lru_cache(2)
def _sorted(lexicon: tuple[frozenset[str], frozenset[str]]) -> tuple[list[str], list[str]]:
    """(lower-case words, words known only with a capital)."""
    common, proper = lexicon
    given = {g.casefold() for g in GIVEN}
    return sorted(w for w in common if len(w) > 1), sorted(w for w in proper if len(w) > 3 and w not in given)


def _other(rng: random.Random) -> str:
    """Numbers that are no person's."""
    return _digits(rng, rng.choice(["999-99-9999b", "999-9-99", "XYZ-999-99-9999-B", "AB-9999", "9999-9999", "10.9999/9999.9999", "99.9999", "9999/99", "TR-9999999", "9.99.999", "999-99-9999-B"]))


_ITEMS = {"name": _name, "email": _email, "phone": _phone, "id_number": _id_number, "address": _address}
_FILL = {
    "family": _family, "given": _given, "town": lambda r: r.choice(_TOWNS), "initial": lambda r: r.choice("ABCDEHJKLMNPRST") + ".",
    "label": lambda r: r.choice(_LABELS), "digit": lambda r: str(r.randrange(10)), "two": lambda r: _digits(r, "99"),
    "three": lambda r: _digits(r, "999"), "four": lambda r: _digits(r, r.choice(["1999", "2099", "9999"])), "five": lambda r: _digits(r, "99999"),
    "german": _german, "noun": lambda r: r.choice(_NOUNS), "script": lambda r: r.choice(_SCRIPTS), "small": lambda r: r.choice(_SMALL),
    "hex": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(7)) if r.random() < 0.7 else _digits(r, "9999999"),
    "w": lambda r: r.choice(_words()[0]), "W": lambda r: r.choice(_words()[0]).capitalize(), "known": lambda r: r.choice(_words()[1]).capitalize(),
    "dank": lambda r: r.choice("danken sowie Herrn Herr Frau Dr. Prof. an".split()), "Thing": lambda r: r.choice(THINGS).capitalize(), "command": lambda r: r.choice(_COMMANDS), "section": lambda r: r.choice(_SECTIONS),
    "Odd": lambda r: (r.choice(_words()[0]) + r.choice("ssion ity ment ness graphy ology ance ism".split())).capitalize(), "acronym": lambda r: "".join(r.choice("ABCDEGHKLMNPRSTX") for _ in range(3)), "person": lambda r: r.choice(_PERSON), "call": lambda r: r.choice(_CALLS), "other": _other,
}


def examples(per_template: int = PER_TEMPLATE, seed: int = 11) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """(text, {(begin, end, kind)}) of labelled lines."""
    rng = random.Random(seed)
    out = []
    for template in TEMPLATES:
        for _ in range(per_template):
            text, gold = "", set()
            for piece in re.split(r"(<\w+>)", template):
                slot = piece[1:-1] if piece[:1] == "<" and piece[-1:] == ">" and len(piece) > 2 else ""
                if slot in _ITEMS:
                    item = _ITEMS[slot](rng)
                    gold.add((len(text), len(text) + len(item), slot))
                    text += item
                else:
                    text += _FILL[slot](rng) if slot in _FILL else piece
            out.append((text + "\n", gold))
    return out
