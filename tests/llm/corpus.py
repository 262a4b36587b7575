"""Small corpora with the awkward cases, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, h1 string, kind int, bucket int, size int, target string, node int, hub int, part int, label int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def awkward(seed=1, docs=60):
    """(doc_id, text) with copies, near copies, shared lines, odd white space, empties and one very long text."""
    rng = random.Random(seed)
    shared = [sentence(rng, rng.randint(9, 16)) for _ in range(6)]
    out = []
    for i in range(docs):
        lines = [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice([str, str.upper, lambda x: f" \t{x}\r", lambda x: x + "!"])(rng.choice(shared)))
        out.append((i * 3, "\n".join(lines)))
    base = out[4][1]
    words = base.split(" ")
    words[len(words) // 2] = "changed"
    out += [(1000, base), (1001, base), (1001, base), (1002, " ".join(words)), (2, None), (5, ""), (8, "   "), (11, "\n\n"), (None, out[0][1]), (None, "short"), (1003, "é" * 60 + "\n" + "日本 語" * 30), (1004, "a" * 500), (1005, sentence(rng, 30_000)), (7, out[1][1] + "\n" + out[3][1])]
    return out


def frame(spark, rows, sources=("s0", "s1", None, "s2")):
    return spark.createDataFrame([(i, t, "en", sources[k % len(sources)], len(t or ""), 1, "x", 2, 3, 4, "t", 5, 6, 7, None) for k, (i, t) in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
