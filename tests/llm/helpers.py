"""Small corpora and brute-force words."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text, low=True):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text) if low else text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def documents(spark, texts, extra=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(seed, n=60, vocabulary=400, most=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñü.") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, most))) for _ in range(n)]
    for _ in range(n // 3):  # copies of stretches, of whole texts, and near copies
        a, b = r.randrange(n), r.randrange(n)
        own = texts[a].split(" ")
        s = r.randrange(len(own))
        texts[b] = texts[b] + "\n" + " ".join(own[s : s + r.randint(5, 150)])
        if r.random() < 0.4:
            texts.append(texts[a])
        if r.random() < 0.5:
            k = r.randrange(len(own))
            texts.append(" ".join(own[:k] + ["neu"] + own[k + 1 :]))
    return texts + [None, "", " \n\t ", "Ein", "hot " * 700, "a b c " * 120, "a b c " * 121]
