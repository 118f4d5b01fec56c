"""Small documents with every edge the operators define: nulls, empty and long texts, repeats, clashing names."""

import random

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key long, h long, fp long, spans string, size long, `group` string, node long, component long, m long, score double, item string, __text string, e string, p double"
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñt") for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(3, 160)) for _ in range(24)]
    passage = words(rng, 70)
    out = [*base]
    out += [base[0], base[1].upper(), base[2] + " tail", passage, words(rng, 30) + " " + passage + " " + words(rng, 9)]
    out += [words(rng, 5) + "\n" + passage, passage[:-3] + "zzz", " ".join(["same"] * 400), " ".join(["ab cd"] * 200)]
    out += [None, "", " \n\t", "x", "word " * 3, "ẞtraße  İ ＷＩＤＥ 漢字 😀 <|endoftext|> a<|endoftext|>b", "a" * 5000, words(rng, 6000)]
    return out


def rows(seed=1):
    out = []
    for i, t in enumerate(texts(seed)):
        out.append((i, t, "en", None if i % 7 == 6 else f"s{i % 4}", None if t is None else len(t)))
    out.append(out[3])  # a repeated row
    out.append((None, out[4][1], None, None, None))
    out.append((None, None, None, None, None))
    return out


def frame(spark, data=None):
    """The rows with further columns whose names the operators use inside."""
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, 1, 2, 3, "s", 4, "g", 5, 6, 7, 0.5, "i", "t", "e", 0.1) for r in data], COLUMNS).repartition(3)


def empty(spark):
    return frame(spark).limit(0)
