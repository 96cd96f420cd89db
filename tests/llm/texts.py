"""Small hand-made documents with the odd cases, and brute-force models."""

import random
import re

WORD = re.compile("[^ \t-\r]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _id bigint, key string, digest string, hits int, `odd.name` int"


def sentence(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def odd_texts():
    base = sentence(1, 120)
    near = base.split()
    near[60] = "other"
    long = sentence(2, 30_000, 5000)
    return [base, base, base.replace(" ", "\n\t "), " ".join(near), base.upper(), None, "", "   \n", "one", "one two three", "ONE two three", "a b c d e",
            sentence(3, 40) + " " + base[:400] + " " + sentence(4, 40), sentence(5, 50), long, "é" * 50 + " ñandú \U0001F600 ok", "x " * 200, sentence(6, 34), sentence(6, 35), sentence(6, 35) + "."]


def documents(spark, texts=None):
    """Ids as given by position, one row repeated, one null id, and columns whose names an operator might use itself."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en", "host" if i % 3 else None, None if t is None else len(t), "r", 5, "k", "d", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def with_oddities(spark):
    docs = documents(spark)
    repeated = docs.filter("doc_id = 13")
    nameless = docs.filter("doc_id = 0").selectExpr("cast(null as bigint) as doc_id", *[f"`{c}`" for c in docs.columns[1:]])
    return docs.unionByName(repeated).unionByName(nameless)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def components(sets, percent):
    """Smallest id reachable over links, by comparing all pairs."""
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in sets}


def window_coverage(items, width):
    """For each sequence, which items lie in a window that also starts elsewhere."""
    from collections import Counter
    count = Counter(tuple(x[i:i + width]) for x in items for i in range(len(x) - width + 1))
    out = []
    for x in items:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if count[tuple(x[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append(gone)
    return out
