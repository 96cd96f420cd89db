"""Exact and near dedup, decontamination, passage dedup and encoding against brute force, with the odd cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import anchors, bpe, decontamination, exact_dedup, queries, rolling, setsketch, suffix_dedup
from texts import WORD, components, documents, odd_texts, shingles, window_coverage, with_oddities


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return with_oddities(spark).cache()


def test_exact_groups(docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    given = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    size = Counter(t for _, t in given)
    keep = {t: min(i for i, u in given if u == t and i is not None) for t in size}
    want = sorted((str(i), keep[t], size[t], i == keep[t], sha(t)) for i, t in given)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want


def test_exact_stage_keeps_columns(docs):
    kept = exact_dedup.without_exact_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    # the null id goes with its text; the repeated row stays twice
    assert "None" not in ids and ids.count("13") == 2 and "1" not in ids and "0" in ids and "6" not in ids


@pytest.mark.parametrize("percent", [85, 60])
def test_near_components(docs, percent):
    rows = setsketch.near_duplicates(docs, percent).collect()
    sets = {i: shingles(t) for i, t in enumerate(odd_texts())}
    want = components(sets, percent)
    assert len(rows) == len(odd_texts()) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id == 0 and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_rows_that_share_an_id(spark):
    """Texts under one id are judged each by itself; a row gives a row and unrelated texts stay apart."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (1, a), (5, c), (5, a + " y"), (6, c + " z"), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, node int")
    got = setsketch.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == sorted([
        (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 5, True), (5, 1, False), (6, 5, False), (7, 7, True), (7, 7, True)])
    # 5 with the text of c stays, though 5 with a copy of 1 goes
    assert sorted(r.node for r in setsketch.without_near_copies(docs).collect()) == [0, 1, 4, 5, 8, 9]


def test_near_many_variants(spark, monkeypatch):
    """A group of near copies of one text that are not all near each other, in blocks of a few."""
    import random
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "GROUP", 5)
    r = random.Random(9)
    base = [f"v{r.randrange(500)}" for _ in range(150)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, 85)
    got = by_id(setsketch.near_duplicates(documents(spark, texts), 85))
    assert {i: g.component_id for i, g in got.items()} == want
    assert len(set(want.values())) < 60


def test_sketch_properties():
    import numpy as np
    rng = np.random.default_rng(1)
    for jaccard in (0.3, 0.7, 0.9):
        n, m = 600, 180
        both = round(2 * n * jaccard / (1 + jaccard))
        x = [np.unique(rng.integers(0, 2 ** 63, 2 * n - both).astype(np.uint64)) for _ in range(60)]
        a, b = [v[:n] for v in x], [v[n - both:] for v in x]
        ra, rb = setsketch.registers(a, m), setsketch.registers(b, m)
        assert abs((ra == rb).mean() - jaccard) < 0.03
        merged = setsketch.registers([np.unique(np.concatenate(p)) for p in zip(a, b)], m)
        assert (merged == np.maximum(ra, rb)).all()
        sizes = np.full(60, n)
        assert setsketch.may_reach(ra, rb, sizes, sizes, 0.85).mean() == {0.3: 0, 0.9: 1}.get(jaccard, pytest.approx(0.3, abs=0.3))
    rows, bands = setsketch.plan(0.85)
    assert (1 - 0.85 ** rows) ** bands <= setsketch.MISSED


def test_contained_items(spark, docs):
    texts = odd_texts()
    items = [(0, texts[0][:200]), (1, "Ñandú"), (2, None), (3, ""), (4, "One, two; THREE!"), (5, "not there at all it is not"), (6, texts[13] + " and one more word"), (7, texts[13])]
    items = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, hash string")
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w, n: {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for d in docs.collect():
        for i in items.collect():
            n = min(5, len(words(i.text)))
            a, b = (cut(words(i.text), n), cut(words(d.text), n)) if n else (set(), set())
            if a and len(a & b) >= 0.8 * len(a):
                want.add((d.doc_id, i.item_id, len(a), len(a & b)))
    got = decontamination.contained_items(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in got} == want and len(got) == len(want)
    left = decontamination.without_benchmark(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in {w[0] for w in want})


def test_items_of_few_words_in_longer_documents(spark):
    docs = documents(spark, ["so the secret, answer is here in the middle of it", "the secret of an answer", "the secret answer", "secret", "an answer: the", None, "x the\nSECRET\tanswer"])
    items = spark.createDataFrame([(0, "The secret answer"), (1, "secret"), (2, "of an answer the"), (3, " .. "), (4, "answer is here in the middle")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, items).collect()}
    assert got == {(0, 0), (2, 0), (6, 0), (0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (0, 4)}


def test_index_can_be_shuffled(spark, docs, monkeypatch):
    items = spark.createDataFrame([(0, odd_texts()[0][:200])], "item_id bigint, text string")
    want = sorted(map(str, decontamination.contained_items(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontamination.contained_items(docs, items).collect())) == want


@pytest.mark.parametrize("window", [35, 6])
def test_repeated_words(spark, window):
    docs = documents(spark)
    words = [WORD.findall(t or "") for t in odd_texts()]
    gone = window_coverage(words, window)
    got = by_id(anchors.without_repeats(docs, window, with_text=True))
    for i, (w, g) in enumerate(zip(words, gone)):
        kept = " ".join(x for x, y in zip(w, g) if not y)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept_text) == (len(w), sum(g), sha(kept), kept), i


def test_repeated_words_of_repeated_rows(docs):
    rows = anchors.without_repeats(docs).collect()
    assert len(rows) == len(odd_texts()) + 2
    assert all(r.n_removed == r.n_words for r in rows if r.doc_id == 13 or r.doc_id is None)


@pytest.mark.parametrize("options", [{}, {"together": 2}, {"shard": 300, "together": 1}])
def test_repeated_bytes(spark, options):
    docs = documents(spark)
    raw = [(t or "").encode() for t in odd_texts()]
    gone = window_coverage(raw, 60)
    got = by_id(suffix_dedup.without_repeats(docs, 60, 24, with_bytes=True, **options))
    for i, (b, g) in enumerate(zip(raw, gone)):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for k, y in enumerate(g) if y and (k == 0 or not g[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(b), sum(g), spans, sha(kept), kept), i


@pytest.mark.parametrize("n", [16, 200])
def test_anchors_are_dealt_evenly(n):
    rng = np.random.default_rng(7)
    texts = pa.array([bytes(rng.integers(97, 123, 40_000, dtype=np.uint8)).decode() for _ in range(30)], pa.string())
    hashes = np.unique(suffix_dedup.Runs(texts, 400, 160).hash)
    sizes = np.bincount(anchors._bucket(hashes, n).astype(np.int64), minlength=n)
    mean = len(hashes) / n
    assert mean > 40 and sizes.min() > mean - 6 * mean ** 0.5 and sizes.max() < mean + 6 * mean ** 0.5
    # the 32 bits that are compared within a bucket are spread, too
    assert len(np.unique(hashes & suffix_dedup.LOW)) > 0.999 * len(hashes)


def test_suffix_arrays():
    import random
    r = random.Random(5)
    for _ in range(100):
        window, base = r.choice([9, 16, 20, 40]), "".join(r.choice("abé") for _ in range(200)).encode()
        regions = []
        for _ in range(r.randint(1, 12)):
            a = r.randint(0, len(base) - window)
            x = bytearray(base[a:min(len(base), a + window + r.randint(0, 30))])
            if r.random() < 0.5:
                x[r.randint(0, len(x) - 1)] = 120
            regions.append(bytes(x))
        count = Counter(x[i:i + window] for x in regions for i in range(len(x) - window + 1))
        for x, flags in zip(regions, suffix_dedup.repeated_in(regions, window)):
            assert [count[x[i:i + window]] > 1 for i in range(len(x) - window + 1)] == flags.tolist()


def test_tokens_like_the_library(docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = bpe.encoded(docs, queries.tokenizer_path()).collect()
    texts = {i: t or "" for i, t in enumerate(odd_texts())} | {None: odd_texts()[0]}
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), sha(texts[r.doc_id]))


def test_speculation_equals_merging():
    import random
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_path())
    own = bpe.vocabulary(bpe._file(queries.tokenizer_path()))
    r = random.Random(1)
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "\x1c\x1d a\x85b", "a" * 3000, "ab" * 2000, "日本語テキスト", "👍🏽", "it's we'll I'D 's", "\t\t\n x  y   "]
    texts += ["".join(r.choice("ab thein\n'sé<|endoftext|>0 9.,!日") for _ in range(r.randint(0, 60))) for _ in range(800)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetful_encoder(monkeypatch):
    """A full table of remembered words changes nothing."""
    own = bpe.vocabulary(bpe._file(queries.tokenizer_path()))
    text = odd_texts()[14][:20_000]
    want = own.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 5)
    own.known.clear()
    assert own.encode(text) == want


def test_hashes_do_not_depend_on_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa
    data, offsets = rolling.text_bytes(pa.array(odd_texts()))
    starts, ends, _ = rolling.word_bounds(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [w.encode() for t in odd_texts() for w in WORD.findall(t or "")]
    want = rolling.range_hashes(data, starts, ends)
    monkeypatch.setattr(rolling, "SLICE", 64)
    monkeypatch.setattr(rolling, "_POWERS", {})
    assert (rolling.range_hashes(data, starts, ends) == want).all()
    assert len(np.unique(want)) == len({w for t in odd_texts() for w in WORD.findall(t or "")})


@pytest.mark.parametrize("operator", [exact_dedup.exact_duplicates, setsketch.near_duplicates, anchors.without_repeats, suffix_dedup.without_repeats,
                                      lambda d: bpe.token_digests(d, queries.tokenizer_path()), lambda d: decontamination.contained_items(d, d.selectExpr("doc_id as item_id", "text"))])
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_slices_keep_all_rows():
    import pyarrow as pa

    from caseloom.llm.common import slices
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "text": ["a" * 4, None, "", "é" * 30, "b" * 5, "c" * 5, "d" * 9, None]}, schema=pa.schema([("i", pa.int64()), ("text", pa.string())]))
    parts = list(slices(iter([batch, batch.slice(3, 2), batch.slice(0, 0)]), size=10))
    assert sum((p.to_pylist() for p in parts), []) == batch.to_pylist() + batch.slice(3, 2).to_pylist()
    assert len(parts) > 4 and all(sum(len((t or "").encode()) for t in p.column("text").to_pylist()[1:]) <= 70 for p in parts)
