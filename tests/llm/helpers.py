"""Small tables with the awkward cases, and plain Python forms of what the operators do."""

import random
import re

LONG = "word " * 30_000 + "x" * 5000 + " tail.\n" + "ünï " * 3000
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_tokens STRING, score STRING"


def texts():
    rng = random.Random(1)
    words = "the quick brown fox jumps over lazy dog don't it's 123 naïve Straße ÉCOLE ,. !! $$ <|endoftext|> 你好 é".split()
    own = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    own += own[:10] + [own[3] + " extra", "", None, " ", "\n\n", "a", "a b", "two words", LONG, LONG, "x" * 200_000, "\x1c\x85\xa0", "é ≠.", "İ. Σς"]
    return own


def docs(spark, rows=None):
    """Rows of documents with nulls, repeated rows, a null id, and columns whose names clash with results."""
    if rows is None:
        t = texts()
        rows = [(k, x, "en" if k % 3 else None, None if k % 11 == 0 else f"s{k % 4}", "clash", "clash") for k, x in enumerate(t)]
        rows += [rows[2], rows[2], (None, "the null id", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(x):
    return tuple((v is None, "" if v is None else str(v)) for v in x)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def least_ids(ids, groups):
    best = {}
    for k, i in enumerate(ids):
        r = groups.find(k)
        if i is not None and (best.get(r) is None or i < best[r]):
            best[r] = i
    return [best.get(groups.find(k)) for k in range(len(ids))]
