"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 characters of keys and identifiers, split
at '=', or what is assigned to a secret's name, of any length and characters.
What is assigned is masked in its place if it is short, runs wherever they
occur.  Features: its length, character transitions (changes of
character class, of letter kind, repeated characters), coverage by a
dictionary, the path and the neighbouring words.  The forest is trained on
labelled findings, which a generator with a fixed seed makes from public key
formats and from their common look-alikes (LABELLED rows); it becomes a
column expression, so the scan is one pass over the table without Python.

Edge cases: null and empty texts have no candidates; a null path is an empty
one; a candidate that occurs twice is found twice; other columns are kept by
``redact``; an empty table gives an empty result.
"""
from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table
from .forest import probability, train

#: Labelled findings that the forest is trained on.
LABELLED = 3000
THRESHOLD = 0.5
MASK = "[SECRET]"

SPACE = r"[\x20\x09-\x0D]+"
#: A JSON web token, whose parts may be padded, or a run.
RUN = r"eyJ[A-Za-z0-9_=\-]+\.[A-Za-z0-9_=.+/\-]+|[A-Za-z0-9_+/.\-]{16,}"
LEAST = 16
#: Words that key names, code and prose are made of.
DICTIONARY = (
    "access account admin alpha api application archive article auth background base beta build cache change class client cloud code commit config content copy count create data database date debug default delete demo design dev digest document download edit element email error event example export false field file filter final first folder format frame function group handler hash header hello home host html http image import index info input item json key label language last layout level library line link list local login main manager master member message method model module month name network new node null number object office open option order output page panel param parent password path photo place policy post preview private process product profile project public query read record release remote render report request resource response result return root sample search second secret section select server service session setting simple source staging start state static status store string style submit support system table target task template test text that the this time title token tool true type update upload user value version video view widget window with word world write year"
).split()
#: Names that stand before secrets, and before what only looks like one.
SECRET_WORDS = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "private", "credential", "auth", "bearer", "signing", "key")
OTHER_WORDS = ("commit", "sha1", "sha256", "md5", "digest", "checksum", "hash", "uuid", "guid", "revision", "rev", "version", "build", "example", "sample", "dummy", "placeholder", "fake", "etag", "integrity", "isbn", "order", "invoice", "trace", "session-id", "request")
KNOWN_FORMS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_+/=-]*|glpat-[A-Za-z0-9_-]{20,})$"

#: A secret's name, the sign of an assignment, and a value.
NAMED = "(?i:" + "|".join(w.replace("-", "[-]") for w in SECRET_WORDS) + r")[A-Za-z0-9_.\-]*[\"'`]?"
ASSIGN = r"(?:=>|:=|==?|:)"
VALUE = r"[^\x20\x09-\x0D\"'`,;<>(){}\[\]&|=:][^\x20\x09-\x0D\"'`,;<>(){}\[\]&|]*"

NAMES = ["length", "class_changes", "vowel_changes", "repeats", "distinct", "digits", "uppers", "hexadecimal", "uuid", "known", "coverage", "separators", "path", "secret_near", "other_near", "assigned", "other_after"]


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(" + "|".join(w.replace("-", "[-]") for w in words) + ")")


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """Numbers, in the order of NAMES, of a candidate, the lower-case text before it (words and a part of its own word), the word after it and its path."""
    n = F.length(candidate).cast("double")

    def share(pattern: str) -> Column:
        return (n - F.length(F.regexp_replace(candidate, pattern, ""))) / n

    def runs(text: Column) -> Column:
        return F.length(F.regexp_replace(text, r"(.)\1+", "$1")) / n

    classes = F.translate(F.translate(F.translate(candidate, "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25), "123456789", "0" * 9)
    kinds = F.translate(F.translate(F.lower(candidate), "eiou", "aaaa"), "cdfghjklmnpqrstvwxyz", "b" * 20)
    covered = F.regexp_replace(F.lower(candidate), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")
    flag = lambda c: c.cast("double")
    return [
        n, runs(classes), runs(kinds), 1 - runs(candidate), F.size(F.array_distinct(F.split(candidate, ""))) / n, share("[0-9]"), share("[A-Z]"),
        flag(candidate.rlike("^[0-9a-fA-F]+$")), flag(candidate.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")), flag(candidate.rlike(KNOWN_FORMS)),
        (n - F.length(covered)) / n, share(r"[_./=+\-]"), flag(path.rlike("(?i)(test|example|sample|fixture|doc|readme|lock)")), flag(_any(before, SECRET_WORDS)), flag(_any(before, OTHER_WORDS)), flag(before.rlike("[=:][\"' ]*$")),
        flag(_any(F.lower(after), OTHER_WORDS)),
    ]


def labelled_findings(n: int = LABELLED, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before it, word after it, path, 1 for a secret) from a generator with a fixed seed."""
    r = random.Random(seed + 1)
    prose = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def after(label: int) -> str:
        """Prose, nothing, or, oftener after what only looks like a secret, a word that says what it is."""
        chance = r.random()
        return "" if chance < 0.15 else r.choice(OTHER_WORDS) + r.choice(["", ",", "."]) if chance < (0.18 if label else 0.35) else prose() + r.choice(["", "", "."])

    return [(c, before, after(label), path, label) for c, before, path, label in _findings(n, seed)]


def _findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    r = random.Random(seed)
    hexa, word62, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    draw = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    syllables = [c + v for c in "bcdfghlmnprstv" for v in "aeiou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 5)))
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(2))
    paths = ["src", "app/main.py", "config/settings.env", "web/crawl", "notes", "tests/test_api.py", "docs/readme.md", "package-lock.json", "", "src7"]
    out = []
    for i in range(n):
        path, kind = r.choice(paths[:5] + paths[8:] * 2 if r.random() < 0.8 else paths), r.random()
        if i % 2:
            name = r.choice(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "bearer"])
            join = r.choice([" = \"", " = ", "=", "=\"", ": ", ": \"", " "])
            before = f"{prose()} {name}{join}" if r.random() < 0.93 else prose() + " "
            if kind < 0.15:
                c = r.choice([draw(word62, r.randint(6, 15)), draw(word62 + "!@#$%^*?_+-", r.randint(8, 24)), word() + str(r.randint(1, 9999)), word().title() + str(r.randint(1, 9999)) + r.choice("!?#$"), word() + word()])
                before = f"{prose()} {name}{r.choice([' = ', '=', ': ', ':', '=' + chr(34), ': ' + chr(34), ' = ' + chr(34)])}"
            elif kind < 0.45:
                c = draw(hexa, r.choice([32, 40, 40, 40, 48, 64]))
            elif kind < 0.7:
                c = draw(word62 + "_-" * (r.random() < 0.5), r.randint(20, 48))
            elif kind < 0.8:
                c = draw(word62 + "+/", r.randint(24, 60)) + "=" * r.randint(0, 2)
            else:
                c = r.choice(["AKIA" + draw(upper, 16), "ghp_" + draw(word62, 36), "sk_live_" + draw(word62, 24), "AIza" + draw(word62, 35), "xoxb-" + draw("0123456789", 12) + "-" + draw(word62, 24), "eyJ" + draw(word62, 30) + "." + draw(word62, 60), "glpat-" + draw(word62, 20)])
                before = before if r.random() < 0.6 else prose() + " "
            out.append((c, before.lower(), path, 1))
            continue
        name = r.choice(["commit", "sha256", "md5", "digest", "checksum", "uuid", "revision", "version", "build", "etag", "trace", "integrity", "order", "request"])
        before = r.choice([f"{prose()} {name} ", f"{prose()} {name}: ", f"{prose()} {name}=", f"{prose()} "])
        if r.random() < 0.35:
            # Without digits, or short: prose, names and paths, also where a secret's name stands before them.
            near = r.choice(["token", "secret", "api_key", "password", "key", "auth", "private"]) + r.choice([" = ", "=", ": ", "=\"", " "])
            before = f"{prose()} {near}" if r.random() < 0.4 else before
            pick = r.random()
            if pick < 0.35:
                c = "".join(r.choice(syllables) for _ in range(r.randint(8, 12))) + r.choice(["", "n", "s", "ng", "tion"])
                c, before = r.choice([c, c, c.title(), c.upper()]), f"{prose()} "
            elif pick < 0.6:
                c = r.choice(["_", "-", ".", "/", "/"]).join(r.choice(DICTIONARY) for _ in range(r.randint(3, 6)))
                c = c.upper() if r.random() < 0.2 else c
            elif pick < 0.75:
                c = "".join(w.title() for w in r.sample(DICTIONARY, 4))
                c = c[0].lower() + c[1:] if r.random() < 0.5 else c
            else:
                c = r.choice([r.choice(DICTIONARY), r.choice(DICTIONARY) + r.choice("_-.") + r.choice(DICTIONARY), r.choice(DICTIONARY) + r.choice(DICTIONARY).title(), "true", "false", "null", "None", "xxxx", "****", "...", str(r.randint(0, 99))])
                out.append((c, f"{prose()} {near if near[-1] != ' ' or '=' in near or ':' in near else near[:-1] + '='}".lower(), path, 0))
                continue
            out.append((c if len(c) >= LEAST else c + "".join(r.choice(DICTIONARY) for _ in range(6)), before.lower(), path, 0))
            continue
        if kind < 0.25:
            c = draw(hexa, r.choice([32, 40, 64, 40]))
            before = f"{prose()} {name}{r.choice([' ', ': ', '=', ' = '])}"
        elif kind < 0.4:
            c = "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))
        elif kind < 0.55:
            c = r.choice(["_", "-", ".", "/"]).join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + str(r.randint(0, 999))
        elif kind < 0.7:
            c = "/".join(r.choice(DICTIONARY) for _ in range(3)) + f"/{r.choice(DICTIONARY)}{r.randint(1, 99)}.{r.choice(['html', 'png', 'js', 'csv'])}"
        elif kind < 0.8:
            c = draw("0123456789", r.randint(16, 24))
        elif kind < 0.9:
            c = r.choice(["x", "0", "a", "1"]) * r.randint(14, 30) + "1234"
            before = f"{prose()} {r.choice(['token', 'api_key', 'password', 'example'])}{r.choice([' = ', '=', ': '])}"
        else:
            c = "".join(w.title() for w in r.sample(DICTIONARY, 4)) + str(r.randint(1, 99))
        out.append((c if len(c) >= 16 else c + "0" * 16, before.lower(), path, 0))
    return out


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None) -> list:
    """The forest, from the features that SQL computes for the labelled findings (a bounded number of rows)."""
    findings = findings if findings is not None else labelled_findings()
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quote(c)}, {quote(b)}, {quote(a)}, {quote(p)}, {y})" for c, b, a, p, y in findings)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(candidate, before, after, path, label)")
    got = table.select(F.array(*features(*map(F.col, ("candidate", "before", "after", "path")))).alias("x"), "label").collect()
    return train(np.array([r.x for r in got], float), np.array([r.label for r in got]))


def candidates(text: Column, path: Column) -> Column:
    """Array of structs: word (its number), candidate, before, after, path."""
    words = F.split(F.coalesce(text, F.lit("")), SPACE)

    def near(w: Column, i: Column) -> Column:
        return F.when((i >= 0) & (i < F.size(w)), F.element_at(w, (i + 1).cast("int"))).otherwise(F.lit(""))

    def at(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        held = F.filter(numbered, lambda s: (F.length(s["x"]) >= LEAST) & s["x"].rlike(RUN) | s["x"].rlike("[=:]") | near(w, s["i"] - 1).rlike("[=:]"))

        def of_word(s: Column) -> Column:
            x, before = s["x"], F.concat_ws(" ", near(w, s["i"] - 2), near(w, s["i"] - 1))
            long = F.transform(F.regexp_extract_all(x, F.lit(f"({RUN})"), F.lit(1)), lambda c: F.regexp_replace(c, r"[.=]+$", ""))
            runs = F.filter(long, lambda c: F.length(c) >= LEAST)
            first = F.when(before.rlike(NAMED + " ?" + ASSIGN + r" ?[\"'`]?$"), F.regexp_extract(x, rf"^[\"'`]*({VALUE})", 1)).when(before.rlike(NAMED + "$"), F.regexp_extract(x, rf"^{ASSIGN}[\"'`]*({VALUE})", 1)).otherwise(F.lit(""))
            values = F.transform(F.concat(F.array(first), F.regexp_extract_all(x, F.lit(rf"{NAMED}{ASSIGN}[\"'`]*({VALUE})"), F.lit(1))), lambda c: F.regexp_replace(c, "[.]+$", ""))
            other = F.filter(F.array_distinct(values), lambda c: (c != "") & ~F.exists(runs, lambda r: r == F.regexp_replace(c, r"[.=]+$", "")))
            return F.transform(F.concat(other, runs), lambda c: F.struct(
                s["i"].alias("word"), c.alias("candidate"),
                F.concat(F.lower(before), F.lit(" "), F.lower(F.call_function("substring_index", x, c, F.lit(1)))).alias("before"), near(w, s["i"] + 1).alias("after"), F.coalesce(path, F.lit("")).alias("path"),
            ))

        return F.flatten(F.transform(held, of_word))

    found = F.transform(F.array(words), at)[0]
    empty = F.expr("CAST(array() AS array<struct<word: int, candidate: string, before: string, after: string, path: string>>)")
    return F.when(text.rlike(RUN) | text.rlike(rf"{NAMED}[\x20\x09-\x0D]*{ASSIGN}"), found).otherwise(empty)


def _masked(text: Column, c: Column) -> Column:
    """text without the secret c: a short one goes only where it is assigned to a secret's name."""
    quoted = F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9_])"))
    place = F.concat(F.lit(rf"({NAMED}[\x20\x09-\x0D]*{ASSIGN}[\x20\x09-\x0D]*[\"'`]*)"), quoted)
    return F.when(F.length(c) >= LEAST, F.replace(text, c, F.lit(MASK))).otherwise(F.regexp_replace(text, place, F.lit("$1" + MASK)))


def scan(docs: DataFrame, forest: list, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: doc_id, word, candidate, before, after, path, features, probability, is_secret."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(candidates(F.col("text").cast("string"), F.col(path).cast("string"))).alias("c")).select("doc_id", "c.*")
    names = [F.col(f"x.{n}") for n in NAMES]
    scored = found.withColumn("x", F.struct(*(f.alias(n) for f, n in zip(features(*map(F.col, ("candidate", "before", "after", "path"))), NAMES))))
    return scored.withColumn("probability", probability(forest, names)).withColumn("is_secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, forest: list, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text replaced by MASK; texts stay in their rows, so nothing is shuffled."""
    # Features are an array of their own before the forest reads them: as expressions, each of its nodes would compute them again.
    of = lambda c: F.struct(c["candidate"].alias("candidate"), F.array(*features(c["candidate"], c["before"], c["after"], c["path"])).alias("x"))
    scored = F.transform(candidates(F.col("text"), F.col(path).cast("string")), of)
    secrets = F.transform(F.filter(scored, lambda s: probability(forest, [s["x"][i] for i in range(len(NAMES))]) >= threshold), lambda s: s["candidate"])
    # Longer ones first: a secret may hold another.
    ordered = F.array_sort(F.array_distinct(secrets), lambda a, b: F.length(b) - F.length(a))
    hidden = F.aggregate(ordered, F.col("text"), _masked)
    return docs.withColumn("text", hidden)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), train_forest(spark))
    return found.select("doc_id", "word", "candidate", "before", "after", "path", F.round("probability", 6).alias("probability"), "is_secret")
