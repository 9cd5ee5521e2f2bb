"""Operators against brute force on small fixtures, with nulls, empty texts, repeated rows, ties and extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from seriesloom.llm import bpe, chat, decontaminate, fingerprint, jaccard, licenses, quality, repeats, tokencount, urlfilter

FOLDER = "/root/testdata/sf0.001"
RANKS = path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, bucket string, key long, n int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, rows):
    """Rows of id and text with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# --- byte-level BPE ---------------------------------------------------------------------------------------------------


def test_codes_equal_the_library(spark, coder):
    rng = random.Random(1)
    signs = ["'", " ", "  ", "\n", "s", "t", "re", "ll", "Bc", "é", "日本", "1", "²", "!", "...", "\u00a0", "\x1c", "\x85", "😀", "'s", "'ll"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))) for i in range(2000)]
    rows += [(-1, None), (-2, ""), (-3, "a" * 5000), (-4, "ab" * 1500), (None, "null id"), (5, rows[5][1]), (-6, "!" * 4000 + "x" + " " * 3000)]
    got = {(r.doc_id, tuple(r.token_ids)) for r in bpe.encode_documents(frame(spark, rows), RANKS).collect()}
    assert got == {(i, tuple(coder.encode_ordinary(t or ""))) for i, t in rows}
    coded = bpe.encode_documents(frame(spark, rows), RANKS)
    back = Counter((r.doc_id, bytes(r.text).decode()) for r in bpe.decode_documents(coded, RANKS).collect())
    assert back == Counter((i, t or "") for i, t in rows)
    digests = {r.doc_id: r for r in bpe.encoded_digests(frame(spark, rows), RANKS).collect()}
    ids = coder.encode_ordinary(rows[7][1])
    assert digests[7].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digests[7].decoded_sha256 == hashlib.sha256(rows[7][1].encode()).hexdigest()


def test_unknown_ids_and_empty_table(spark):
    assert bpe.encode_documents(frame(spark, []), RANKS).count() == 0
    bad = spark.createDataFrame([(1, [999_999])], "doc_id long, token_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_documents(bad, RANKS).collect()


# --- repeated strings -------------------------------------------------------------------------------------------------


def removed_by_force(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [40, 41])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(3)
    shared = [sentence(rng, rng.randint(5, 25), "abcdé") for _ in range(10)]
    rows = [(i, "".join(rng.choice([sentence(rng, rng.randint(0, 8)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 60)]]) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 300), (1004, rows[5][1]), (1005, shared[0] * 2), (None, shared[1]), (7, rows[7][1])]
    got = sorted((tuple(r)[:5] for r in repeats.removal_report(frame(spark, rows).repartition(3), length=length).collect()), key=repr)
    assert got == removed_by_force(rows, length)


def test_cut_texts_keep_their_columns(spark):
    shared = "déjà vu " * 9
    docs = frame(spark, [(1, "one " + shared), (2, "two " + shared), (3, None), (4, "clean")])
    out = {r.doc_id: r for r in repeats.without_repeats(docs, length=40).collect()}
    assert repeats.without_repeats(docs, length=40).columns == docs.columns
    assert out[3].text is None and out[4].text == "clean" and out[1].text == "one" and out[2].text == "two"
    assert repeats.without_repeats(frame(spark, []), length=40).count() == 0


# --- Jaccard join -----------------------------------------------------------------------------------------------------


def components_by_force(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for base in range(60):
        words = sentence(rng, rng.choice([3, 5, 8, 9, 12, 20, 40, 90])).split()
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = sentence(rng, 1)
            rows.append((len(rows) + 10 * (base % 3), (" ".join(copy)).title() if rng.random() < 0.3 else "\t".join(copy)))
    rows = list({i: (i, t) for i, t in rows}.values())
    passage = sentence(rng, 40)
    rows += [(5000 + k, passage + " " + sentence(rng, 30)) for k in range(40)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE")]
    got = sorted(tuple(r) for r in jaccard.similar_documents(frame(spark, rows)).collect())
    assert got == components_by_force(rows)


def test_long_chain_is_one_component(spark):
    words = sentence(random.Random(9), 60).split()
    rows = []
    for k in range(30):
        words[2 * k % 60] = f"new{k}"
        rows.append((k, " ".join(words)))
    assert sorted(tuple(r) for r in jaccard.similar_documents(frame(spark, rows)).collect()) == components_by_force(rows)


def test_one_document_of_each_group_stays(spark):
    text = sentence(random.Random(2), 30)
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (4, None), (5, ""), (None, "lonely words here"), (None, "lonely words here")]
    kept = jaccard.one_of_each_group(frame(spark, rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("1", text), ("None", "lonely words here")]
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, None}
    assert jaccard.one_of_each_group(frame(spark, [])).count() == 0


def test_rows_are_dropped_by_id_and_text(spark):
    a, b, c = (sentence(random.Random(k), 30) for k in (21, 22, 23))
    rows = [(5, a), (5, b), (3, b), (None, b + " more"), (None, c), (None, "lonely words here")]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.one_of_each_group(frame(spark, rows)).collect())
    assert kept == sorted([("5", a), ("3", b), ("None", c), ("None", "lonely words here")])


# --- decontamination --------------------------------------------------------------------------------------------------

ITEM = "We know that Anna walked 12 km to the market and bought 3 apples for Anna today."


def test_other_numbers_names_and_units_are_caught(spark):
    docs = frame(spark, [
        (1, "Hello there. " + ITEM), (2, ITEM.replace("Anna", "Peter").replace("12 km", "15 miles").replace("3", "4")), (3, ITEM.replace("for Anna", "for Paul")),
        (4, None), (5, ""), (6, "Nothing of it at all, only a few other words that nobody asked for."), (None, ITEM), (1, "Hello there. " + ITEM),
    ])
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "two words"), (10, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.kind) for r in decontaminate.contaminations(docs, bench).collect())
    assert got == [("1", 7, "exact"), ("2", 7, "reparameterised"), ("None", 7, "exact")]
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminations(docs, bench.where("false")).count() == 0


def verdicts(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.kind, r.n_covered) for r in decontaminate.contaminations(frame(spark, rows), bench).collect()}


def test_copies_rich_in_numbers_are_caught(spark):
    item = "Find the next number in the sequence: " + ", ".join(str(k) for k in range(2, 37, 2)) + "."
    other = "Find the next number in the sequence: " + ", ".join(str(k) for k in range(3, 38, 2)) + "."
    got = verdicts(spark, [(1, "So. " + item), (2, other), (3, "2, 4, 6, 8, 10, 12, 14, 16, 18, 20 and nothing else")], [(7, item)])
    assert got == {(1, 7): ("exact", 25)}


def test_one_changed_value_does_not_hide_a_long_copy(spark):
    words = sentence(random.Random(4), 120).split()
    item = " ".join(["so", *words[:40], "for Anna", *words[40:80], "with 12 km", *words[80:], "and Anna left"])
    got = verdicts(spark, [(1, item.replace("and Anna", "and Paul")), (2, item.replace("12 km", "12 kilometers")), (3, item.replace("Anna", "Paul"))], [(7, item)])
    assert {k: v[0] for k, v in got.items()} == {(1, 7): "exact", (2, 7): "reparameterised", (3, 7): "reparameterised"}
    assert all(n >= 120 for _, n in got.values())


def test_names_that_open_sentences_line_breaks_and_case(spark):
    pets = "Anna has 3 cats. Ben has 4 dogs. Carl has 5 birds. How many pets are there?"
    named = "Yesterday Anna met Ben, Carl and Dora in Paris, then Emil, Fritz and Gerda went to Rome with Hans and Ida, said Jon."
    rows = [
        (1, "Emma has 7 cats. Noah has 9 dogs. Otto has 2 birds. How many pets are there?"), (2, "Emma has 7 cats. Noah sees nothing at all. Otto had birds. How many are there now?"),
        (3, named.replace(" ", "\n")), (4, named.lower()), (5, named.replace(" ", "\u00a0 \r\n")),
    ]
    got = verdicts(spark, rows, [(7, pets), (8, named)])
    assert {k: v[0] for k, v in got.items()} == {(1, 7): "reparameterised", (3, 8): "exact", (4, 8): "exact", (5, 8): "exact"}
    assert got[1, 7][1] == 17 and got[4, 8][1] == 23


def test_contained_items_are_found(spark, documents):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(d.doc_id, i) for d in documents.collect() for i, t in items if t in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(documents, bench).collect()}
    assert want and want <= got and len(got - want) <= 1


# --- chat -------------------------------------------------------------------------------------------------------------


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "a\\<[b"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", None), (2, None, None, "é<<TEXT>>"), (None, 0, "assistant", "x"), (3, 0, "a<<TEXT>>\n", "\\\\<\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    segments = chat.format_turns(turns)
    assert sorted(chat.read_back(r.segment.encode()) for r in segments.collect()) == sorted(((r or "").encode(), (t or "").encode()) for _, _, r, t in rows)
    got = {r.conv_id: r for r in chat.conversation_digests(segments).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 21 and got[None].loss_chars == 1
    assert got[1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256("\né<<TEXT>>\n".encode()).hexdigest()
    assert chat.conversation_digests(chat.format_turns(turns.where("false"))).count() == 0


# --- urls -------------------------------------------------------------------------------------------------------------


def test_cascade_is_exact(spark):
    universe = spark.range(5000).selectExpr("cast(id as string) as key")
    listed = universe.where("cast(key as int) % 7 = 0")
    cascade = urlfilter.build_cascade(universe, listed)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.listed(F.col("key")) != F.expr("cast(key as int) % 7 = 0")).count() == 0


def test_rules_and_odd_urls(spark, monkeypatch):
    rules = (urlfilter.Rule("net", "/", "block"), urlfilter.Rule("example.net", "/en/", "allow"))
    pages = spark.createDataFrame([(1, "http://A.Example.net/en/x?q"), (2, "http://a.net"), (3, "http://b.net/#x"), (4, None), (5, "no scheme"), (6, "x://Bad.org/p"), (6, "x://Bad.org/p"), (None, "x://good.org?u")], "page_id long, url string")
    listed = spark.createDataFrame([("bad.org",), ("elsewhere",), (None,)], "host string")
    want = [("1", "a.example.net", "/en/x", "example.net/en/", "allow"), ("2", "a.net", "", None, "allow"), ("3", "b.net", "/", "net/", "block"), ("4", "", "", None, "allow"), ("5", "", "", None, "allow"), ("6", "bad.org", "/p", None, "block"), ("6", "bad.org", "/p", None, "block"), ("None", "good.org", "", None, "allow")]
    for bits in (urlfilter.MOST_BITS, 0):  # the second: the list is too long for a filter
        monkeypatch.setattr(urlfilter, "MOST_BITS", bits)
        got = urlfilter.judged_urls(pages, rules, listed).drop("listed").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


# --- token files ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [2, 64, 4 << 20])
def test_token_counts_over_blocks(spark, coder, block_bytes):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 50), (4, "word " * 50), (None, "x")]
    got = tokencount.document_tokens(frame(spark, rows).coalesce(1), RANKS, PATTERN, 50256, block_bytes).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(coder.encode_ordinary(t or ""))) for i, t in rows)
    assert tokencount.document_tokens(frame(spark, []), RANKS, PATTERN, 50256).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_edit_distances():
    rng = random.Random(4)
    a, b = ([bytes(rng.choice(b"ABC/") for _ in range(rng.randint(0, 64))) for _ in range(200)] for _ in range(2))
    assert fingerprint.edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_next_document_over_ranges(spark):
    rng = random.Random(6)
    rows = [(k * 3, sentence(rng, rng.randint(0, 80), "abcé日")) for k in range(120)] + [(None, "null id"), (9, None), (1000, "")]
    rng.shuffle(rows)
    got = fingerprint.against_next(frame(spark, rows).repartition(5)).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter((i, len(t), hashlib.sha256(fingerprint.edited_text(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    alone = Counter((r.doc_id, r.fingerprint) for r in fingerprint.fingerprint_documents(frame(spark, rows)).collect())
    assert alone == Counter((r.doc_id, r.fingerprint) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.against_next(frame(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in fingerprint.against_next(frame(spark, [(1, "only")])).collect()] == [(1, 4)]


def test_likeness_follows_the_shared_part(documents):
    texts = [r.text for r in documents.collect() if len(r.text) > 2000][:40]
    own = fingerprint.fingerprints([t.encode() for t in texts])
    edited = fingerprint.fingerprints([fingerprint.edited_text(t, u).encode() for t, u in zip(texts, texts[1:] + texts[:1], strict=True)])
    near = fingerprint.likeness(own, edited)
    far = fingerprint.likeness(own, fingerprint.fingerprints([t.encode() for t in texts[1:] + texts[:1]]))
    assert (near > far).mean() > 0.9 and (fingerprint.likeness(own, own) == 1).all()


# --- licenses ---------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES[-1][1]
    rows = [(1, "Text. Released under the MIT License.\nmore"), (2, "x " * 500 + mit.replace("free of charge", "at no charge") + " y" * 500), (3, None), (4, ""), (5, "a license to kill under the bridge"), (None, "Licensed under CC BY-NC 4.0. " * 3), (7, "Released under the MIT License. " * 40)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, None: "CC-BY-NC-4.0", 7: "MIT"}
    assert rows[0][1][got[1].start : got[1].end] == "Released under the MIT License"
    assert 0.8 <= got[2].coverage < 1 and got[1].coverage == 1
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_patience_pairs_are_increasing_matches():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


# --- quality ----------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    field = quality.train(documents, labels.where(~quality.held_out()))
    scored = quality.score_documents(documents, field).join(labels, "doc_id").where(quality.held_out()).collect()
    right = sum((r.score >= quality.ACCEPTED) == (r.quality == 1) for r in scored)
    assert right >= 0.9 * len(scored)
    odd = frame(spark, [(1, None), (2, ""), (3, "\n\n"), (None, "word"), (1, None)])
    assert all(0 <= r.score <= 1 for r in quality.score_documents(odd, field).collect())
    assert quality.accepted_documents(odd, field).columns == odd.columns
    assert quality.train(documents, labels.where("false")) is None
    assert {r.score for r in quality.score_documents(odd, None).collect()} == {quality.UNFITTED}


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    unary, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    weight = {s: np.exp(sum(u for u, x in zip(unary, s, strict=True) if x) + sum(moves[a, b] for a, b in zip(s, s[1:], strict=False))) for s in itertools.product((0, 1), repeat=4)}
    total = sum(weight.values())
    good, pair = quality.chain(unary, moves, np.array([0, 4]))
    assert np.allclose(good, [sum(w for s, w in weight.items() if s[k]) / total for k in range(4)])
    assert np.isclose(pair[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(s, s[1:], strict=False)) for s, w in weight.items()) / total)
