"""Texts shared by the tests of this folder."""

import random


def words(seed: int, n: int, syllables: str = "ka lo mi ru te sa no vi du pe") -> str:
    """n invented words."""
    r = random.Random(seed)
    s = syllables.split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(2, 4))) for _ in range(n))


#: texts that every operator must stand: null, empty, white space, one word, very long, repeated
ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "word"), (9005, words(5, 60_000)), (9006, words(6, 40)),
       (9006, words(6, 40)), (None, words(7, 30)), (9007, "\U0001f600 \x00 ßİ " + "x" * 5000)]
