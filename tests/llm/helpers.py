"""A small table with every awkward case, and brute-force answers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed=3, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    base, passage = say(150), say(70)
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            t = base.split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            t = " ".join(t)
        elif kind == 1:
            t = say(40) + "\n" + passage + "\n" + say(30)
        elif kind == 2:
            t = out[-2][1] if out else base
        elif kind == 3:
            t = "wörter *** ### " + say(20).upper() + "\n" + "same line\n" * rng.randint(1, 6)
        else:
            t = say(rng.choice([1, 3, 5, 12, 60, 200]))
        out.append((i, t, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"]), len(t)))
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "a", 0),
        (n + 2, " \t\n ", "en", None, 4),
        (n + 3, "one", "en", "b", 3),
        (n + 4, "one", "en", "b", 3),
        (n + 5, "x" * 5000 + " " + say(9000), "en", "a", None),
        (n + 6, "und " * 300, "de", "b", 1200),
        (n + 7, "don't <|endoftext|> stop  \n\n the 123 ’s 漢字 naïve x ", "en", "c", 40),
        (n + 8, "0123456789 " * 30, "en", "c", 330),
        (n + 9, "a | b | c\n" * 12, "en", "c", 120),
        (None, base, "en", "a", None),
        (3, out[3][1], "de", "b", 9),
    ]
    return out


def table(spark, found=None):
    """The rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if found is None else found, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("id", "key", "n", "kept", "size", "part", "a", "b", "page", "weight", "c1", "copies")})


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near(found, percent=75):
    sets = []
    for doc, text, *_ in found:
        w = words(lowered(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = {r[0]: r[0] for r in found if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(found)):
        for j in range(i):
            if found[i][0] is None or found[j][0] is None or not sets[i]:
                continue
            k = len(sets[i] & sets[j])
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                x, y = root(found[i][0]), root(found[j][0])
                up[max(x, y)] = min(x, y)
    return [(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(found, sets)]


def without_repeats(found, width=35):
    places = {}
    for d, r in enumerate(found):
        w = words(r[1])
        for i in range(len(w) - width + 1):
            places.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in found]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + width))
    return [(r[0], len(words(r[1])), len(g), " ".join(x for i, x in enumerate(words(r[1])) if i not in g)) for r, g in zip(found, gone)]


def by_repr(x):
    return sorted(map(tuple, x), key=repr)
