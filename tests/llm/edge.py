"""Rows that every operator has to take: nulls, blanks, long texts, ties, repeats, clashing columns."""
import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, id string, n long, label string, node string, word string, a long, b long, block string, size double, host string"


def texts(seed=3, n=40):
    r = random.Random(seed)
    words = ["the", "of", "river", "Stone", "über", "ñandú", "tree", "sky", "42", "end."] + [f"w{i}" for i in range(200)]
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]


def rows(seed=3):
    t = texts(seed)
    base = t[0]
    t += [None, "", "   \n\t ", "one", "two words", base, base, base.upper(), base + " extra", "x " * 3000, "a b c d e " * 400, "line\nline\nline\n\nother", "tab\x0bvt\x0cff\x1csep nbsp", "é" * 300, "<|endoftext|> 'll don't", "|" * 50, "\U0001f600 smile"]
    out = [(i, x, "en", f"src{i % 3}", len(x or ""), "k", "r", "i", 1, "l", "n", "w", 1, 2, "b", 0.5, "h") for i, x in enumerate(t)]
    out += [out[3], (None, "no id here at all", None, None, 3, *out[0][5:])]
    return out


def table(spark, seed=3):
    return spark.createDataFrame(rows(seed), KIND)


def empty(spark):
    return table(spark).limit(0)
