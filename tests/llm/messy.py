"""A small documents table with every awkward case, and its rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, c0 int, block string, TEXT string"


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "li", "mo", "nu", "Re", "si", "to", "é", "ü."]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (700, 300, 60, 40, 12, 300)]
    line = [words(rng, 8) for _ in range(12)]
    out = [
        (1, base[0]), (2, base[0]), (3, base[0].replace("ba", "BA", 1)), (4, base[0] + " one more tail"),
        (5, base[1]), (6, base[1].replace(" ", "\n", 40)), (7, " ".join(base[1].split()[:-30])), (8, words(rng, 300) + " " + base[1]),
        (9, None), (10, ""), (11, "  \n\t "), (12, "one two"), (13, "one two"), (14, "three"), (15, "123 456 !!"),
        (16, "\n".join(line[:6])), (17, "\n".join([*line[3:9], "tail"])), (18, "\n".join([line[0], line[1], line[2], line[0], line[1], line[2]])),
        (19, "\n".join([line[9]] * 6)), (20, "\n\n\n\n"), (21, "aaaa " * 400), (22, "aaaa " * 400 + "b"), (23, base[2]), (23, base[2]), (23, base[3]),
        (None, base[5]), (None, base[5]), (None, None), (-4, base[4]), (30, words(rng, 20000)), (31, "x" * 5000), (32, "日本語の文章 и русский текст"),
        (33, base[5][:900] + " " + words(rng, 40) + " " + base[5][900:]), (2**40, "Zeta\x00\x1c eta\x0btheta\x85iota <|endoftext|> 😀"),
    ]
    return [(i, t, ["en", "fr", None, "de"][k % 4], [None, "s1", "s2", "s1"][k % 4], len(t) if t is not None else None, "x", k, "b", "T") for k, (i, t) in enumerate(out)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
