"""Small tables with the awkward cases every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part long"

WORDS = "the of and stone river light ninety über été señor don't it's 42 7 :-) 　 ß".split(" ")


def texts(seed: int = 3, count: int = 40) -> list:
    rng = random.Random(seed)
    out = [None, "", " ", "\n\t", "a", "Hello, World!", "don't can't it's", "x" * 3000, "日本語 テキスト 😀", "tab\tline\nend  "]
    while len(out) < count:
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 8, 40, 200]))))
    base = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(120)]
    for k in range(8):  # near copies, and exact ones
        words = list(base)
        words[10 * k] = "changed"
        out += [" ".join(words)] * (1 + k % 2)
    return out


def documents(spark, seed: int = 3):
    """Further columns bear the names that operators use themselves; one doc_id is null, one row is repeated."""
    rows = [(k, t, "en", "s", 0, 0.5, 7) for k, t in enumerate(texts(seed))]
    rows += [(None, "a null id with some words", "en", "s", 0, 0.5, 7), rows[20]]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)
