"""Resampling, clustering and packing against brute force, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pytest

from caseloom.llm import clustering, importance, packing, queries
from caseloom.llm.common import in_order
from texts import documents, lowered, odd_texts, with_oddities

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return with_oddities(spark).cache()


# --- importance resampling -------------------------------------------------------------------------------------------

def runs(text, n):
    w = WORDS.findall(lowered(text))
    return [" ".join(w[i:i + size]) for size in range(1, n + 1) for i in range(len(w) - size + 1)], len(w)


def resampled(rows, target, percent, min_words, n, buckets, seed):
    """By the definition: every run as a text of its own."""
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = (Counter(bucket(r) for x in texts for r in runs(x, n)[0]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found, words = runs(text, n)
        weight = sum(gain[bucket(r)] for r in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = percent * len(eligible) // 100
    ranked = [(*x, k + 1 if k < drawn else None) for k, x in enumerate(eligible)] + [(*x, None) for x in out if x[1] < min_words]
    return sorted(map(str, ranked))


@pytest.mark.parametrize("percent, min_words, n, buckets, seed", [(10, 20, 1, 10_000, 2024), (50, 2, 3, 97, 7), (100, 0, 2, 1000, 1), (0, 20, 1, 10, 2)])
def test_resampling(docs, percent, min_words, n, buckets, seed):
    texts = odd_texts()
    target = docs.filter("doc_id in (3, 12, 5)").selectExpr("doc_id as item_id", "text", "key")
    given = [(i, t) for i, t in enumerate(texts)] + [(13, texts[13]), (None, texts[0])]
    rows = importance.resample(docs, target, percent, min_words, n, buckets, seed).collect()
    assert sorted(str(tuple(r)) for r in rows) == resampled(given, [texts[3], texts[12], None], percent, min_words, n, buckets, seed)


def test_resampling_byte_table():
    """Characters whose bytes look like separators or letters, and every ASCII character."""
    text = "".join(map(chr, range(128))) + " Éa B cİ ÀZ\U0001F600z0\x7f9{x}"
    want, _ = runs(text, 3)
    assert sorted(importance.features(text.encode(), 3)[1]) == sorted(zlib.crc32(r.encode()) for r in want)


def test_selected_documents(docs):
    target = docs.filter("doc_id = 14").select("text")
    kept = importance.selected(docs, target, percent=50)
    assert kept.columns == docs.columns
    drawn = {r.doc_id for r in importance.resample(docs, target, percent=50).collect() if r.rank}
    assert {r.doc_id for r in kept.collect()} == drawn


@pytest.mark.parametrize("empty_docs, empty_target", [(True, False), (False, True), (True, True)])
def test_resampling_empty(docs, empty_docs, empty_target):
    rows = importance.resample(docs.limit(0) if empty_docs else docs, docs.limit(0) if empty_target else docs).collect()
    assert len(rows) == (0 if empty_docs else len(odd_texts()) + 2)


def test_order_numbers_are_whole(spark):
    """Many equal keys over several tasks get different numbers, in order."""
    rows = spark.range(5000, numPartitions=7).selectExpr("id", "cast(if(id % 3 = 0, 1, id % 50) as int) as k").checkpoint()
    placed, total = in_order(rows, "place", rows["k"].desc())
    found = sorted((r.place, r.k) for r in placed.collect())
    assert total == 5000 and [p for p, _ in found] == list(range(5000))
    assert [k for _, k in found] == sorted((k for _, k in found), reverse=True)


# --- centroid clustering ---------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster int, components string"


def odd_vectors():
    r = random.Random(3)
    rows = [(i, [r.choice([-1.5, -0.3, 0.0, 0.26, 0.7, 2.0]) for _ in range(8)]) for i in range(120)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, rows[5][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 9), (304, [None, *[1.0] * 7]), (305, [float("nan"), *[1.0] * 7]),
             (306, [float("inf"), *[1.0] * 7]), (307, [-1e9, *[1.0] * 7]), (308, [-1e-9, 1e-9, 0.0156, -0.0157, 5.0, 5.0, 5.0, 5.0])]
    return rows


def clustered(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(np.float64(np.float32(x)) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) <= clustering.LARGEST for x in v)]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(of[n]) for x in zip(*of[n])] if of[n] else c for n, c in enumerate(centres)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    own = Counter()
    for _, n, d in out:
        own[n] += d
    sha = lambda n: hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()
    return sorted(str((i, n, d, own[n], sum(own.values()), sha(n))) for i, n, d in out)


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 1), (1, 2), (1000, 2), (7, 0)])
def test_clusters(spark, k, rounds):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], VECTORS).repartition(5)
    got = clustering.cluster_digests(frame, centroids=k, rounds=rounds, dimensions=8).collect()
    assert sorted(str(tuple(r)) for r in got) == clustered(rows, k, rounds, 8, 64, 1)


def test_walk_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    for dims, k in ((1, 40), (2, 64), (3, 200), (64, 16)):
        centroids = rng.integers(-50, 50, (k, dims))
        vectors = np.concatenate([rng.integers(-60, 60, (300, dims)), centroids[:5]])
        number, best = clustering.Lists(centroids).nearest(vectors)
        all_of = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (best == all_of.min(axis=1)).all() and (number == all_of.argmin(axis=1)).all()


def test_walk_leaves_far_centroids_alone(monkeypatch):
    """In few dimensions the bound is passed long before every centroid has come up."""
    counted = []
    plain = np.einsum
    monkeypatch.setattr(clustering.np, "einsum", lambda how, a, b: (counted.append(len(a)), plain(how, a, b))[1])
    centroids = np.arange(0, 100_000, 100)[:, None]
    number, best = clustering.Lists(centroids).nearest(np.arange(5, 100_000, 1000)[:, None])
    assert (best == 25).all() and sum(counted) < 100 * 8


@pytest.mark.parametrize("rows", [[], [(1, [float("nan")] * 8)], [(1, [0.5] * 8)], [(1, [0.5] * 8)] * 3])
def test_few_vectors(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 9, "x") for i, v in rows], VECTORS)
    got = clustering.cluster_digests(frame, dimensions=8).collect()
    assert sorted(str(tuple(r)) for r in got) == clustered(rows, 16, 3, 8, 64, 1)


# --- packing ---------------------------------------------------------------------------------------------------------

def histogram(lengths, capacity):
    out = Counter()
    for x in lengths:
        if x // capacity:
            out[capacity] += x // capacity
        if x % capacity:
            out[x % capacity] += 1
    return dict(out)


def check_plan(counts, capacity, **parameters):
    classes = packing.planned(counts, capacity, **parameters)
    held = Counter()
    for n, content in classes:
        assert n > 0 and 0 < sum(x * k for x, k in content) <= capacity
        for x, k in content:
            held[x] += n * k
    assert held == counts
    return sum(n for n, _ in classes)


def falling_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= x]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("low, high, n", [(1, 100, 400), (26, 60, 500), (34, 50, 300), (51, 99, 80), (1, 20, 300), (30, 36, 500)])
def test_plan_is_no_worse_than_best_fit(low, high, n):
    r = random.Random(low)
    lengths = [r.randint(low, high) for _ in range(n)]
    assert check_plan(histogram(lengths, 100), 100) <= falling_best_fit(lengths, 100)


def test_plan_finds_what_best_fit_misses():
    """Halves, thirds and sixths that greedy filling pairs wrongly: the configurations reach the optimum."""
    counts = {51: 60, 27: 60, 26: 60, 23: 120}
    optimum = 60 * 51 + 60 * 27 + 60 * 26 + 120 * 23
    greedy = packing._number(packing.best_fit([], counts, 100))
    found = check_plan(counts, 100)
    assert -(-optimum // 100) <= found < greedy


def test_plan_of_few_pieces_against_all_partitions():
    def best(lengths):
        lengths = sorted(lengths, reverse=True)
        least = len(lengths)

        def place(i, rooms):
            nonlocal least
            if len(rooms) >= least:
                return
            if i == len(lengths):
                least = len(rooms)
                return
            for k in {room: k for k, room in enumerate(rooms) if room >= lengths[i]}.values():
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1:]])
            place(i + 1, [*rooms, 30 - lengths[i]])

        place(0, [])
        return least

    r, over = random.Random(2), 0
    for _ in range(60):
        lengths = [r.randint(1, 25) for _ in range(r.randint(1, 11))]
        found, least = check_plan(histogram(lengths, 30), 30), best(lengths)
        assert least <= found <= least + 1
        over += found - least
    assert over <= 6


def test_plan_size_does_not_depend_on_the_number_of_pieces():
    r = random.Random(4)
    counts = histogram([min(int(r.lognormvariate(6, 1)), 40_000) + 1 for _ in range(3000)], 2048)
    many = {x: n * 10 ** 7 for x, n in counts.items()}
    plan = packing.planned(many)
    rows = packing.intervals(plan, many)
    assert len(rows) < 8 * 2048
    assert sum(n for n, _ in plan) <= 1.002 * sum(x * n for x, n in many.items()) / 2048 + 1


def test_configurations_against_all_of_them():
    """The fractional optimum is not above any integral one."""
    sizes, demand, capacity = [45, 38, 29, 26], [10, 14, 9, 20], 100
    used = packing.configurations(sizes, demand, capacity)
    for x, c in used:
        assert x >= 0 and int(c @ np.array(sizes)) <= capacity
    assert np.allclose(sum(x * c for x, c in used), demand)
    possible = [c for k in range(1, 4) for c in combinations_with_replacement(range(4), k) if sum(sizes[i] for i in c) <= capacity]
    price = np.linalg.solve(np.array([c for _, c in used], float), np.ones(4))
    assert all(sum(price[i] for i in c) <= 1 + 1e-6 for c in possible)


def brute_pieces(texts, capacity):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.tokenizer_path(queries.PACKED_TOKENIZER))
    library.no_truncation()
    library.no_padding()
    out = []
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    return out


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_packed_documents(docs, capacity):
    path = queries.tokenizer_path(queries.PACKED_TOKENIZER)
    source = docs if capacity > 1 else docs.filter("doc_id is null or doc_id <> 14")
    texts = [(i, t) for i, t in enumerate(odd_texts()) if capacity > 1 or i != 14] + [(13, odd_texts()[13]), (None, odd_texts()[0])]
    rows = packing.packed(source, path, capacity).collect()
    want = brute_pieces(texts, capacity)
    assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(str(x[:5]) for x in want)
    inside = defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(inside) <= falling_best_fit([x[3] for x in want], capacity)


def test_sequences_hold_the_documents(docs):
    path = queries.tokenizer_path(queries.PACKED_TOKENIZER)
    texts = [(i, t) for i, t in enumerate(odd_texts())] + [(13, odd_texts()[13]), (None, odd_texts()[0])]
    want = brute_pieces(texts, 512)
    rows = packing.sequences(docs, path, capacity=512).collect()
    assert sum(len(r.ids) for r in rows) == sum(x[3] for x in want) and max(len(r.ids) for r in rows) <= 512
    known = Counter((x[0], tuple(x[5])) for x in want)
    for r in rows:
        # the end id is the token of "!", so pieces are told by taking known ones off the front
        left = list(r.ids)
        for i in r.doc_ids:
            part = next(p for (owner, p), n in known.items() if n and owner == i and tuple(left[:len(p)]) == p and (len(p) == 512 or len(left) >= len(p)))
            known[i, part] -= 1
            left = left[len(part):]
        assert not left
    assert not any(known.values())


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer
    path = queries.tokenizer_path(queries.PACKED_TOKENIZER)
    library = Tokenizer.from_file(path)
    own = packing.Encoder(open(path, "rb").read())
    r = random.Random(1)
    texts = ["<|endoftext|>", "A<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "\x1c\x1d A\x85B c d", "H̱ é ́x", "ΑΣ ΣΑΣ", "İSTANBUL", "It's WE'LL I'D 'S", "a" * 5000,
             "日本語 テキスト", "\t\t\n x  y \x0b z \x0c"]
    texts += ["".join(r.choice("ab TheIn\n'sÉé<|endoftext|>0 9.,!日́\x1c") for _ in range(r.randint(0, 60))) for _ in range(800)]
    for text in texts:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgetful_chunks(monkeypatch):
    path = queries.tokenizer_path(queries.PACKED_TOKENIZER)
    own = packing.Encoder(open(path, "rb").read())
    text = odd_texts()[14][:20_000].encode()
    want = own.encode(text)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 4)
    own.known.clear()
    own.known_words.clear()
    assert own.encode(text) == want


def test_no_documents(docs):
    path = queries.tokenizer_path(queries.PACKED_TOKENIZER)
    assert packing.packed(docs.limit(0), path).count() == 0
    assert packing.sequences(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_packed_table(spark, scale):
    """The registered query over its whole table against the library, at most one sequence above what the tokens fill."""
    folder = f"/root/testdata/{scale}"
    rows = queries.op13_best_fit_packing(spark, folder).collect()
    texts = duckdb.connect().execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    want = brute_pieces(texts, 2048)
    assert sorted(tuple(r)[:5] for r in rows) == sorted(x[:5] for x in want)
    used, lengths = len({r.sequence_id for r in rows}), [x[3] for x in want]
    assert used <= min(falling_best_fit(lengths, 2048), -(-sum(lengths) // 2048) + 1)
