"""Labelled lines for measuring names alone: templates, given and family names that training never saw."""

import random
import re

GIVEN = """Xiaoming Wojciech Oleksandr Thabo Sunita Gergely Katarzyna Hyunwoo Ayodele Rosalind Tiago Parisa Eero Nikolaos
Blessing Duarte Freya Gintaras Hye-jin Imogen Jadwiga Khadija Lorcan Maarten Nozomi Olumide Pilar Qiang Rasmus Saoirse
Tamar Umut Vasile Winnie Ximena Yaroslav Zahra Ognjen Iker Bronwen Cian Dilnoza Ewa Fumiko Gulnara""".split()
FAMILY = """Abernathy Bakare Chatterjee Dlamini Eriksen Ferreira Grabowski Hashimoto Ivanenko Jankowski Kowalczuk Lindgren
Mwangi Nakagawa Okonkwo Papadakis Quispe Rasmussen Szabo Tanaka Uribe Vasquez Whitfield Yilmaz Zielinski Achterberg
Castellanos Dubrovsky Fitzgerald Hallgrimsson Macleod Ollivier Pettersson Rourke Sandoval Thackeray""".split()

#: Every ``<name>`` is a case; nothing else is.
LINES = """
The talk by <name> was well attended.
In his review, <name> doubts the second step.
I owe this argument to <name>.
Section 3 follows a suggestion by <name>.
Samples were kindly provided by <name>.
<name> read an early version and found two gaps.
Both authors thank <name>, <name> and <name> for their patience.
As <name> pointed out to us, the sum need not converge.
The referee, <name>, asked for a longer proof.
With the help of <name> we repaired the detector.
This note is dedicated to <name> on the occasion of a birthday.
Part of the work was done while <name> visited the group.
\\author{<name>}
\\author{<name> \\and <name>}
\\dedicatory{For <name>}
\\thanks{<name> was supported by the council.}
\\footnote{Present address of <name>: see below.}
% <name> wants this shortened
% ask <name> whether the units are right
% reviewed by <name>, second pass
After the meeting <name> sent us the raw counts.
According to <name>, the sensor was moved twice.
We are indebted to <name> for the lower bound.
The second reader was <name>.
Interview with <name>, recorded in spring.
The software was written by <name> and later changed by <name>.
Signed: <name>
Please contact <name> for access.
The draft was edited by <name>.
Figure 4 was drawn by <name>.
""".strip().splitlines()
#: No case in any of these.
PLAIN = """
\\section{Linear Growth and Random Walks}
\\subsection{Numerical Results}
The National Science Council paid for the beam time.
See the Annals of Applied Physics, Vol. 12.
The North Sea and the Black Forest are compared in Table 2.
We use the Kalman Filter and the Fourier Transform in turn.
The University of Western Ontario hosted the meeting.
\\title{A Short Course on Sparse Grids}
Proceedings of the Winter School, Springer Verlag, Berlin.
Die Messung der Temperatur zeigt eine Abweichung im Norden.
The Monte Carlo estimate has a lower variance than the Quasi Newton step.
Data from the Hubble Telescope and the Green Bank Observatory were merged.
In New Mexico and South Africa the same effect is seen.
The Hamiltonian Mechanics course treats the Poisson Bracket first.
Every Tuesday Morning the Magnet Laboratory is closed.
Main Theorem. Under Condition A the Banach Space is reflexive.
\\bibitem{x1} R. Lindgren, P. Szabo, Phys. Rev. Lett. 12 (1999) 345.
The Nobel Prize and the Fields Medal are not given for this.
Figure Caption: Upper Panel, Lower Panel and Inset.
World Health Organization figures differ from those of the European Union.
""".strip().splitlines()


#: Written after the rules and features were chosen on the lines above; nothing was changed for them since,
#: though they were measured again after later changes (cues by words, German cues, more training lines).
FRESH = """
Nobody understood the device as well as <name> did.
These tables go back to <name>.
Thanks also go to <name> (who built the stand) and to <name>.
\\thanks{Written with <name> during a leave.}
In the words of <name>, nothing was lost.
\\author{<name> \\and <name> \\and <name>}
% TODO: let <name> decide
Measured by <name> in the old building.
<name>, who kept the log, left in June.
Later, <name> and <name> found a shorter way.
Questions? Write to <name>.
We remember <name>, our friend and teacher.
The Atlantic Ocean and the Baltic Sea differ in salt.
\\section{Open Questions and Future Plans}
The Royal Society printed the Collected Papers in Oxford.
A Markov Chain and a Wiener Process are compared.
Great Britain and the Soviet Union signed first.
The Upper Bound, the Lower Bound and the Error Term are plotted.
""".strip().splitlines()


def held_out(per_template: int = 12, seed: int = 77, lines: list[str] | None = None) -> list[tuple[str, set[tuple[int, int, str]]]]:
    rng = random.Random(seed)
    out = []
    for template in lines or [*LINES, *PLAIN]:
        for _ in range(per_template):
            text, gold = "", set()
            for piece in re.split("(<name>)", template):
                if piece == "<name>":
                    initial = rng.choice(["", "", "", "", "", rng.choice("ABDGHKMP") + ". "])
                    piece = f"{rng.choice(GIVEN)} {initial}{rng.choice(FAMILY)}"
                    gold.add((len(text), len(text) + len(piece), "name"))
                text += piece
            out.append((text + "\n", gold))
    return out
