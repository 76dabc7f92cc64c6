"""Small hard inputs shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, rank string, h string, part string, salt string"


def hard_docs(spark, texts=None):
    """Documents with nulls, empty and long texts, repeated rows, copies and extra columns that clash with inner names."""
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "de", "Über", "naïve", "日本", "x1", "end.", "A", "token", "secret:"]
    texts = texts or []
    rows = [(i, t) for i, t in enumerate(texts)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(25)]
    for t in base:
        rows.append((len(rows), t))
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, base[0]), (104, base[0]), (105, base[1] + "\nnew line"), (106, "x" * 9000), (107, "word " * 5000)]
    rows += [(None, base[2]), (103, base[0]), (110, "\n".join(base[:4])), (111, "\n".join(base[2:6])), (112, "\r\n".join(base[:2]))]
    out = [(i, t, None if k % 7 == 0 else ("en", "de")[k % 2], None if k % 11 == 0 else f"src{k % 3}", None, 1, "s", "r", "h", "p", "q") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x if x is not None else 0) if not isinstance(x, bool) else (True, x) for x in r))
