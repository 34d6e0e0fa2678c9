"""Small corpora for the tests, and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, `set` string, h int, n int, size int, score int, _doc string, _row string, lang_pred int, words int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rng: random.Random, words: int) -> str:
    syllables = "an the re on in ti er ha ou at is und sch ung ñas ción é".split()
    made = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(made).capitalize() + rng.choice([".", "!", "?\n", ".\n"])


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng, rng.randint(3, 14)) for _ in range(sentences))


def documents(seed: int = 5, count: int = 60) -> list[tuple]:
    """Prose, near and exact copies, shared passages, and every odd case: null and empty texts, blanks, marks only, very
    short and very long texts, null and repeated doc_ids, whole rows twice, null languages and sources."""
    rng = random.Random(seed)
    passage, line = prose(rng, 9), sentence(rng, 7)
    rows = []
    for i in range(count):
        text = prose(rng, rng.randint(1, 25))
        if i % 6 == 1:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 6 == 3:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 6 == 5:
            text = prose(rng, 2) + " " + passage + " " + prose(rng, 2) + "\n" + line
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])))
    long = prose(rng, 900)
    rows += [
        (1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "  \n\t ", None, None), (1003, "... !!", "en", "b"), (1004, "Re.", "en", "b"),
        (1005, "The the THE the", "en", "b"), (1006, "the The the the", "de", "b"), (1007, long, "en", "c"), (1008, long[:4000] + long[4100:], "en", "c"),
        (None, rows[0][1], "en", "a"), (None, prose(rng, 6), "en", "a"), (None, None, None, None), (1009, "x" * 30000, "en", "c"),
        (1010, "and And " * 500, "en", "c"), (7, prose(rng, 8), "de", "b"), (1011, "日本語 текст ñandú", "en", "c"), (1012, "   ", "en", "c"),
        (1013, "1 2 3 4", "en", "a"), (-5, rows[2][1], "en", "a"), rows[4], rows[4],
    ]
    return rows


def frame(spark, rows, partitions: int = 3):
    """The rows with further columns of names that the operators use inside."""
    wide = [(*r, len(r[1] or ""), 1, "s", 2, 3, 4, 5, "d", "r", 6, 7) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(partitions)


def fold(doc_id, parts: int) -> int:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % parts


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def order(doc_id) -> tuple:
    return (doc_id is None, doc_id or 0)
