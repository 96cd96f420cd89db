"""Archives, chat formatting, language model, language identification and the pipeline."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from caseloom.llm import chat, language_id, pitman_yor, queries, setsketch, warc
from texts import WORD, components, lowered, odd_texts, shingles, with_oddities

PAGES = [(1, "http://a.example.com/x y", "<html>é</html>"), (2, "http://b.example.org", "same"), (3, None, "same"), (4, "http://c", None), (5, "u", ""), (None, "n", "same"), (7, "l\nf", "long " * 50_000), (7, "l\nf", "other"), (2, "http://b.example.org", "same")]


@pytest.mark.parametrize("shard_bytes, file_bytes, least", [(1 << 31, 1 << 30, 0), (600, 300, 0), (1 << 20, 1 << 20, 5)])
def test_archives(spark, tmp_path, shard_bytes, file_bytes, least):
    pages = spark.createDataFrame([(*p, "k", 3) for p in PAGES], "page_id bigint, url string, html string, kind string, shard int")
    manifest = warc.write_archives(pages, str(tmp_path / "out"), file_bytes, shard_bytes, least)
    rows = warc.read_archives(manifest, str(tmp_path / "out")).collect()
    want = []
    for page_id, url, body in PAGES:
        raw = (body or "").encode()
        first = min((i for i, _, b in PAGES if (b or "").encode() == raw and i is not None), default=None)
        revisit = len(raw) >= least and first is not None and page_id != first
        want.append((str(page_id), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw, True))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.sound) for r in rows))) == sorted(map(str, want))
    found = manifest.collect()
    assert sum(r.records for r in found) == len(PAGES)
    for r in found:
        data = open(r.path, "rb").read()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256 and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert not list((tmp_path / "out" / "_temporary").iterdir())
    again = warc.write_archives(pages.repartition(3), str(tmp_path / "again"), file_bytes, shard_bytes, least).collect()
    assert sorted((r.shard, r.file, r.sha256) for r in again) == sorted((r.shard, r.file, r.sha256) for r in found)
    # renaming twice changes nothing
    assert warc.commit(spark, str(tmp_path / "out")).count() == len(found)


def test_no_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages, str(tmp_path / "none"))
    assert manifest.count() == 0 and warc.read_archives(manifest, str(tmp_path / "none")).count() == 0


def test_shard_bounds(spark):
    sized = spark.createDataFrame([(i * 1000 if i < 50 else 10 ** 12 + i, 10) for i in range(100)], "page_id bigint, _size bigint")
    bounds = warc.shard_bounds(sized, "_size", 100)
    ids = [r.page_id for r in sized.collect()]
    count = Counter(sum(b <= i for b in bounds) for i in ids)
    assert max(count.values()) <= 10 and len(count) >= 10
    # one id over the size, ids without rows between them, a null id, and any partitioning: the same bounds
    uneven = spark.createDataFrame([(None, 500), (-5, 950), (2, 10), (2, 45), (3, 30), (1 << 60, 1)], "page_id bigint, _size bigint")
    assert warc.shard_bounds(uneven, "_size", 100) == [2, 3] and warc.shard_bounds(uneven.repartition(5), "_size", 100) == [2, 3]
    assert warc.shard_bounds(uneven.filter("false"), "_size", 100) == []


CONVERSATIONS = [(1, 0, "system", "be\nkind"), (1, 1, "user", "hi [INST] </s>"), (1, 2, "assistant", "yo <\\s> [\\\\INST]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
                 (2, 0, "user", "only"), (3, 0, "assistant", "first"), (None, 0, "ro\\le\n[INST]", "x"), (None, None, None, "y"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*c, 1, "f") for c in CONVERSATIONS], "conv_id bigint, turn bigint, role string, text string, example int, formatted string")
    made = chat.examples(rows)
    by = defaultdict(list)
    for r in made.collect():
        by[r.conv_id].append(r)
    turns = defaultdict(list)
    for c in sorted(CONVERSATIONS, key=lambda c: (str(c[0]), -1 if c[1] is None else c[1], c[2] or "", c[3] or "")):
        turns[c[0]].append((c[2] or "", c[3] or ""))
    for conv_id, own in turns.items():
        replies = [k for k, t in enumerate(own) if t[0] == "assistant"]
        ends = replies + ([len(own) - 1] if not replies or replies[-1] < len(own) - 1 else [])
        assert [chat.parse(r.formatted) for r in by[conv_id]] == [own[:k + 1] for k in ends]
        targets = [chat.unescape(r.formatted[r.target_start:r.target_end]) for r in by[conv_id]]
        assert targets == [own[k][1] if k in replies else "" for k in ends]
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv_id, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert (back[conv_id].n_turns, back[conv_id].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest())
        assert (back[conv_id].loss_chars, back[conv_id].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.examples(rows.limit(0))).count() == 0


def test_escapes_are_reversible():
    import random
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["<", "s>", "</s>", "[INST]", "[/INST]", "[", "INST]", "\\", "a", "/", "\n", " "]) for _ in range(r.randrange(12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not re.search(r"</?s>|\[/?INST\]", out)


@pytest.fixture(scope="module")
def docs(spark):
    return with_oddities(spark).cache()


def test_model_scores(docs):
    rows = pitman_yor.score(docs).collect()
    given = [(r.doc_id, WORD.findall(lowered(r.text)) + [None]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in given if not held(i) for w in t)
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 6)) for i, t in given)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    assert pitman_yor.score(docs.limit(0)).count() == 0


def test_model_without_training(spark):
    only = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3], "doc_id bigint, text string")
    rows = pitman_yor.score(only).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in rows)


def test_model_is_proper():
    """The predictive probabilities of all known words and the unknown one add up to 1 in every context."""
    rng = np.random.default_rng(4)
    word = pitman_yor.rolling.mixed(rng.zipf(1.5, 5000).clip(max=300).astype(np.uint64))
    kinds, counts = np.unique(word, return_counts=True)
    known = pitman_yor.Frequent(len(word), len(kinds), kinds[:0], counts[:0], np.zeros(pitman_yor.SHARED, np.int64))
    context = known.context(np.roll(word, 1))
    known.context_size = np.bincount(context, minlength=pitman_yor.CONTEXTS)
    seat = lambda: pitman_yor.Seating(1, word, context, np.ones(len(word), np.int64), known)
    samples = []
    for tables, customers, own in seat().samples():
        seating = seat()
        samples.append({"context_tables": np.bincount(seating.context, tables, pitman_yor.CONTEXTS), "customers": np.zeros(pitman_yor.FREQUENT), "tables": np.zeros(pitman_yor.FREQUENT), "all_customers": customers.sum(), "all_tables": own.sum()})
        assert (tables >= 1).all() and (tables <= seating.count).all() and (own <= customers).all()
    every = np.append(kinds, np.uint64(12345))
    for c in np.unique(context)[:5].tolist() + [3]:
        p, n = pitman_yor.probabilities(seat(), samples, list(seat().samples()), every, np.full(len(every), c))
        assert p.min() > 0 and p.sum() == pytest.approx(1) and n[:-1].tolist() == counts.tolist() and n[-1] == 0


def test_model_beats_counts_on_held_out(spark):
    rows = pitman_yor.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > 1.05 * sum(r.base_score for r in rows)


def test_rare_contexts_have_their_own_restaurants(spark):
    """What follows a rare word is learnt apart from what follows other rare words."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    triples = [f"c{i} t{i} often" for i in range(25_000)]
    train, test = [i for i in range(400) if not held(i)][:75], [i for i in range(400) if held(i)][:2]
    # three times each, in 25 texts
    texts = [(i, " ".join(triples[k % 25::25])) for k, i in enumerate(train)]
    mixed = [f"c{i} t{i + 1} often" for i in range(100)]
    texts += [(test[0], " ".join(triples[:100])), (test[1], " ".join(mixed))]
    rows = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(texts, "doc_id bigint, text string")).filter("held_out").collect()}
    assert 3 * pitman_yor.FREQUENT < rows[test[0]].train_tokens
    # three customers at a table of a restaurant with three: over half; a rare word after the common one: over 2 of its 75,000;
    # the first word and the end: over 1e-8
    low = 100 * (2 * math.log10(0.5) + math.log10(2 / 75_076)) - 16
    assert low < rows[test[0]].score < 0
    # a word that never followed takes no part of the seated customers
    assert rows[test[1]].score < rows[test[0]].score - 100 * 3


def test_languages(spark):
    data = "/root/testdata/sf0.001/"
    documents, pages = spark.read.parquet(data + "documents.parquet"), spark.read.parquet(data + "pages.parquet")
    rows = language_id.identify(documents, pages).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    own = [r for r in rows if r.doc_id >= 0]
    assert len(rows) == documents.count() + pages.count() and len(own) == len(truth)
    assert sum(r.lang == truth[r.doc_id] for r in own) >= 0.98 * len(own) and all(r.accepted for r in own)
    assert sum(r.lang == r.declared for r in rows if r.declared) >= 0.95 * sum(r.declared is not None for r in rows)


def test_language_evidence(spark):
    """Declaration, suffix and host decide where the text says little."""
    data = "/root/testdata/sf0.001/"
    documents = spark.read.parquet(data + "documents.parquet")
    model = language_id.fit_text_model(documents)
    by = defaultdict(list)
    for r in documents.collect():
        by[r.lang].append(r.text)
    page = lambda i, host, lang, text: (i, f"http://{host}/p", f'<html lang="{lang}"><body>{text}</body></html>' if lang else text)
    pages = [page(i, f"{lang}{i % 3}.site.{lang}x", lang, t) for lang in ("de", "fr") for i, t in enumerate(by[lang])]
    short = [page(9001, "de0.site.dex", None, "xx"), page(9002, "fr0.site.frx", "fr-FR", "xx"), page(9003, "new.dex", None, "xx"), (9004, None, None), (9005, "not a url", "<html lang=''>12 34</html>")]
    rows = {r.doc_id: r for r in language_id.identify(documents.limit(0), spark.createDataFrame(pages + short, "page_id bigint, url string, html string"), model).collect()}
    assert rows[-9002].lang == "de"
    assert rows[-9003].lang == "fr" and rows[-9003].declared == "fr"
    assert rows[-9004].lang == "de" and rows[-9004].host == "new.dex"
    assert not rows[-9005].accepted and not rows[-9006].accepted


def test_language_odd_rows(docs):
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if not r.accepted} == {5, 6, 7}
    kept = language_id.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", docs["lang"].substr(10, 1)).replace("", None, ["lang"]))
    assert all(r.accepted and r.lang is None for r in unlabelled.collect())


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    base64.b64encode(np.random.default_rng(5).bytes(300)).decode(),
    " ".join("".join(map(chr, w)) for w in np.random.default_rng(6).integers(97, 123, (60, 6)))]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_foreign_texts_are_not_accepted(spark, size):
    """None of the labelled languages: not accepted as a document, a page or in the pipeline. Short own texts are."""
    documents = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language_id.fit_text_model(documents)
    own = ["the and of", "der die das", "hello"]
    odd = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(FOREIGN + own)], documents.schema)
    pages = spark.createDataFrame([(i, "http://a.example.de/", f"<html lang='de'><body>{t}</body></html>") for i, t in enumerate(FOREIGN)], "page_id bigint, url string, html string")
    accepted = {r.doc_id: r.accepted for r in language_id.identify(odd, pages, model).collect()}
    assert accepted == {**{i: i >= len(FOREIGN) for i in range(len(FOREIGN + own))}, **{-1 - i: False for i in range(len(FOREIGN))}}
    assert all(r.accepted for r in language_id.identify(documents, None, model).collect())
    shifted = odd.selectExpr("-10 - doc_id AS doc_id", "text", "lang", "source")
    kept = language_id.in_known_language(documents.unionByName(shifted))
    assert {r.doc_id for r in kept.filter("doc_id < 0").collect()} == {-10 - i for i in range(len(FOREIGN), len(FOREIGN + own))}


def test_pipeline(spark):
    from tokenizers import Tokenizer
    data = "/root/testdata/sf0.001"
    documents, benchmark = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    kept = documents.collect()
    step = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, data).collect(), documents.schema)
        assert step.columns == documents.columns
        ids = {r.doc_id for r in step.collect()}
        if name == "language_id":
            want = {r.doc_id for r in kept if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "exact_dedup":
            seen = {}
            for r in sorted(kept, key=lambda r: r.doc_id):
                seen.setdefault(re.sub("[ \t-\r]+", " ", r.text or ""), r.doc_id)
            want = set(seen.values())
        elif name == "near_dedup":
            label = components({r.doc_id: shingles(r.text) for r in kept}, 80)
            want = {i for i, c in label.items() if i == c}
        else:
            words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
            cut = lambda t: {tuple(w[i:i + 5]) for w in [words(t)] for i in range(len(w) - 4)} or {tuple(words(t))} - {()}
            items = [cut(r.text) for r in benchmark.collect()]
            want = {r.doc_id for r in kept if not any(len(i & s) >= 0.8 * len(i) for s in [cut(r.text)] for i in items)}
        assert ids == want, name
        kept = [r for r in kept if r.doc_id in ids]
    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, data).collect()}
    assert rows.keys() == {r.doc_id for r in kept}
    for r in kept:
        assert rows[r.doc_id].ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def seated_one_by_one(customers, weight, discount):
    """Probabilities of each number of tables when every customer is seated alone."""
    at = np.zeros(customers + 1)
    at[1] = 1
    for seated in range(1, customers):
        tables = np.arange(customers + 1)
        new = np.where(at > 0, weight / np.maximum(weight + seated - discount * tables, 1e-9), 0)
        at = at * (1 - new) + np.concatenate([[0], (at * new)[:-1]])
    return at


@pytest.mark.parametrize("customers, weight, discount", [(40, 6.0, 0.75), (200, 0.75, 0.75), (30, 200.0, 0.5), (2, 1.0, 0.0)])
def test_tables_are_those_of_single_seating(customers, weight, discount):
    n = 60_000
    tables = pitman_yor.tables_of(np.full(n, customers), np.full(n, weight), discount, np.random.default_rng(7))
    want = seated_one_by_one(customers, weight, discount)
    got = np.bincount(tables, minlength=customers + 1) / n
    assert len(got) == customers + 1 and 0.5 * np.abs(got - want).sum() < 0.012
    assert pitman_yor.tables_of(np.array([0, 1]), np.ones(2), discount, np.random.default_rng(1)).tolist() == [0, 1]
