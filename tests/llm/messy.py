"""Documents with everything that real tables hold: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, spans string, print string, d long, node long"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 45)
    out = []
    for i in range(n):
        text = prose(rng, rng.randint(5, 160))
        if i % 5 == 0:
            text += "\n" + shared + "\n" + prose(rng, 30)
        if i % 7 == 0:
            text += f" call +1 (017) 555-77{i % 100:02d} or x{i}.y@mail.example.com from 10.{i}.3.4 with 4111 1111 1111 1111"
        out.append((i, text, rng.choice(["en", "fr", None]), f"src{i % 4}", len(text)))
    base = prose(rng, 120).split()
    for k in range(12):  # near copies
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = "changed"
        out.append((100 + k, " ".join(copy), "en", "src0", 1))
    out += [(200, out[3][1], "en", "src1", 2), (201, out[3][1].upper(), "en", None, None)]  # copies, one in capitals
    out += [(300, None, "en", "src1", 0), (301, "", "en", "src1", 0), (302, " \t\n ", None, None, 3), (303, "one", "en", "src2", 3), (304, "É", "fr", "src2", 1), (305, "1234 5678", "en", "src2", 9)]
    out += [(306, "a b c d e f g h i j", "en", "src3", 19), (307, "so it goes " * 3000, "en", "src3", 1), (308, prose(rng, 6000), "en", "src3", 1), (309, "x" * 30000, "en", "src3", 1)]
    out += [(310, "nbsp stays next line \u0085end zero​width", "fr", "src0", 1), (311, "emoji 🎉🎉 <|endoftext|> and <|endoftext|>\n\n  tail  ", "en", "src0", 1)]
    out += [out[10], (None, prose(rng, 50), "en", "src0", 1), (None, None, None, None, None), (11, "the same id with another text " + prose(rng, 40), "en", "src0", 1)]
    return out


def documents(spark, seed=1, n=60):
    extra = (7, False, "mine", "p", 5, 6)
    return spark.createDataFrame([(*r, *extra) for r in rows(seed, n)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    """Rows of distinct, non-null ids as a dict."""
    out, twice = {}, set()
    for r in frame.collect():
        if r.doc_id in out:
            twice.add(r.doc_id)
        out[r.doc_id] = r
    return {k: v for k, v in out.items() if k is not None and k not in twice}
