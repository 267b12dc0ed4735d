"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

WORDS = "ein river stone amber la nube cat zwölf über corriente paper light moon garden été mañana".split()
CLASH = "k1 long, k2 long, fp long, h long, score double, spans string, block long, tokens string, who_ string, w string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_texts() -> list:
    base = prose(1, 120)
    long = prose(2, 30_000)
    return [base, base, None, "", " \n\t ", base + " tail", "x" + base, long, long[:150_000] + "!", "é" * 500, "a" * 900,
            "one", prose(3, 60), prose(4, 400) + "\n" + base, prose(5, 80), "\u00a0", "ab " * 700, prose(6, 300) + " " + prose(3, 60)]


def odd_docs(spark, texts=None):
    texts = odd_texts() if texts is None else texts
    rows = [(i if i != 4 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t),
             *([None] * 10)) for i, t in enumerate(texts)]
    rows += rows[:1]  # a wholly repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, " + CLASH)
