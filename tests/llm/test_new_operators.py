"""SimHash near copies, tokenizer alignment and the Merkle manifest against brute force, with nulls, ties and long texts."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import accumulate

import pytest
import xxhash
from public_tokenizers import path
from pyspark.sql import functions as F

from seriesloom.llm import alignment, merkle, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- SimHash ----------------------------------------------------------------------------------------------------------


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def classes(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, []).append(i)
    return sorted(groups.values())


@pytest.mark.parametrize("length", simhash.LENGTHS)
def test_every_chain_finds_all_components(spark, monkeypatch, length):
    rng = random.Random(length)
    prints = {0, 2**64 - 1, 1, 2**63}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            prints.add(base)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5, 6])):
                base ^= 1 << b
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "chain_plan", lambda n: simhash.chain(length))
    monkeypatch.setattr(simhash, "BLOCK", 3)
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in simhash.links(frame, len(prints)).collect():
        a, b = u % 2**64, v % 2**64
        assert (a ^ b).bit_count() <= 4
        root[find(place[a])] = find(place[b])
    assert classes([find(i) for i in range(len(prints))]) == classes(components(prints))


def test_chain_plans_grow_with_the_fingerprints():
    lengths = [simhash.chain_plan(n).length for n in (0, 10**3, 10**6, 10**9, 10**11)]
    assert lengths == sorted(lengths) and lengths[0] == 3 and lengths[-1] == 11


def test_forest_rows_are_linear_in_a_large_group(spark):
    # 2000 fingerprints within a few bits of each other share most keys, in many components or one.
    rng = random.Random(5)
    prints = sorted({sum(1 << b for b in rng.sample(range(40, 64), 9)) for _ in range(2000)})
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    plan = simhash.chain_plan(len(prints))
    edges = simhash.links(frame, len(prints))
    assert edges.count() <= len(plan.slots) * len(prints)
    found = {}
    for u, v in edges.collect():
        found.setdefault(u % 2**64, set()).add(v % 2**64)
        found.setdefault(v % 2**64, set()).add(u % 2**64)
    seen, sizes = set(), []
    for p in prints:
        if p not in seen:
            queue, size = [p], 0
            seen.add(p)
            while queue:
                q = queue.pop()
                size += 1
                new = found.get(q, set()) - seen
                seen |= new
                queue += new
            sizes.append(size)
    assert sorted(sizes) == sorted(map(len, classes(components(prints))))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "x", "42", "naïve", "delta"]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 40, 300]))]
        rows.append((i, "\t ".join(text)))
        if rng.random() < 0.5 and text:
            text[rng.randrange(len(text))] = "other"
            rows.append((100 + i, " ".join(text) + " \x0b\n"))
    rows += [(500, None), (501, ""), (502, " \n"), (None, "one two three four five"), (503, "one two three four five"), (3, rows[3][1]), (None, None)]
    frame = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, print string, least long")
    got = Counter(tuple(r) for r in simhash.near_copies(frame).collect())
    prints = [print_of(t) for _, t in rows]
    roots = components(prints)
    least = {}
    for (i, _), x in zip(rows, roots, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    assert got == Counter((i, f"{p:016x}", least.get(x)) for (i, _), p, x in zip(rows, prints, roots, strict=True))
    assert simhash.near_copies(frame.limit(0)).count() == 0


def test_long_texts_are_read_in_slices(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["Ab", "c", " ", "\n", "  ", "é"]) for _ in range(5000)).encode()
    whole = b"".join(simhash.shingle_hashes(text))
    for size in (1, 7, 100, 4000):
        monkeypatch.setattr(simhash, "SLICE_BYTES", size)
        assert b"".join(simhash.shingle_hashes(text)) == whole


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = [print_of(r.text) for r in docs]
    least = {}
    for r, x in zip(docs, roots := components(prints), strict=True):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    got = {tuple(r) for r in queries.op11_simhash(spark, FOLDER).collect()}
    assert got == {(r.doc_id, f"{p:016x}", least[x]) for r, p, x in zip(docs, prints, roots, strict=True)}


# --- alignment --------------------------------------------------------------------------------------------------------


def measures_by_force(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in plain}
    sign |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    names = {i: s for s, i in json.load(open(path("byte_bpe_50k.json")))["model"]["vocab"].items()}

    def b_bytes(i):
        piece = b_coder.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    out, links, counts = [], [], Counter()
    for doc_id, text in rows:
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        a_raw, b_raw = [bytes(sign[c] for c in names[i]) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            out.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = (list(accumulate(map(len, raw))) for raw in (a_raw, b_raw))
        at_b = {end: y for y, end in enumerate(ends_b)}
        groups, i, j, own = [], 0, 0, []
        for x, end in enumerate(ends_a):
            if end in at_b:
                y = at_b[end]
                groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
                own.append((a[x], b[y]))
                i, j = x + 1, y + 1
        links.append(own)
        counts.update(own)
        out.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return Counter((d, a, b, g, len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), h) for (d, a, b, g, h), own in zip(out, links, strict=True))


def odd_texts():
    rng = random.Random(4)
    signs = ["the", " quick", "brown ", "  ", "\n", "été", "日本語", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "😀", "1234", "'s", "\x00", "ﬁ", " ", "."]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(900, None), (901, ""), (None, "the quick brown"), (902, "the quick brown"), (5, rows[5][1]), (903, "word " * 3000), (904, "a" * 3000)]
    return rows


def test_alignment_equals_brute_force(spark):
    rows = odd_texts()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, copies long, pairs long")
    got = alignment.align_documents(frame, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert Counter(tuple(r) for r in got.collect()) == measures_by_force(rows)
    assert got.limit(0).count() == 0
    assert alignment.align_documents(frame.limit(0), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")).count() == 0


def test_remembered_pieces_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(alignment, "PIECES", 50)
    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    encode = alignment.remembering(coder)
    rng = random.Random(3)
    signs = [chr(c) for c in range(256)] + ["  ", "\n\n", "'s", "'ll", "'ve ", " the", " été", "<|endoftext|>", "x" * 60, "²½", "\x1c", "\x85", "\xa0", "€", "ω"]
    for _ in range(40):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        assert encode(texts) == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_rare_pairs_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 20)
    rows = odd_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align_documents(frame, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert Counter(tuple(r) for r in got.collect()) == measures_by_force(rows)


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_tokenizer_alignment(spark, FOLDER)
    assert Counter(tuple(r) for r in got.collect()) == measures_by_force(rows)


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_force(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree_by_force(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_by_force(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def manifest_by_force(rows):
    if not rows:
        return []
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted(((r, leaf_by_force(r, r["text"])) for r in rows if r["lang"] == x), key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1])) for x in langs}
    trees = {x: tree_by_force([leaf for _, leaf in groups[x]]) for x in langs}
    top = tree_by_force([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for k, x in enumerate(langs):
        for i, (r, leaf) in enumerate(groups[x]):
            steps = path_by_force(trees[x], i) + path_by_force(top, k)
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf_by_force(r, lowered(r["text"]) if r["text"] is not None else None) if touched else leaf
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((r["doc_id"], leaf, trees[x][-1][0], root, h(*[s for before, after in steps for s in before + after]), node, node == root))
    return out


def manifest(spark, rows):
    kind = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g int"
    frame = spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], 1, 2) for r in rows], kind).repartition(3)
    tree = merkle.document_manifest(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return [tuple(r) for r in merkle.proofs(tree).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_manifest_equals_brute_force(spark):
    rng = random.Random(6)
    row = lambda i, lang: {"doc_id": i, "source": rng.choice(["a", None, "é"]), "lang": lang, "n_chars": rng.choice([None, 3, -12]), "text": rng.choice([None, "", "Some Text", "other ÉTÉ Text " * 20])}
    rows = [row(i * rng.choice([1, 1, 1000]), "en") for i in range(5000)]
    rows += [row(rng.choice([-(2**62), -1, 2**63 - 1, -(2**63), 5]) + 0, "fr") for _ in range(30)]
    rows += [row(None, "de") for _ in range(300)] + [row(7, "de") for _ in range(100)] + [row(i, "de") for i in range(20)]
    rows += [row(1, None), row(None, None), row(1, ""), *[row(k, f"l{k}") for k in range(70)], *[row(k, "nine") for k in range(9)]]
    rows += [dict(rows[i]) for i in (0, 0, 0, 5100, 5200)]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(manifest(spark, rows), key=key) == sorted(manifest_by_force(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 512, 513])
def test_manifest_sizes(spark, n):
    rows = [{"doc_id": i, "source": "s", "lang": "en", "n_chars": 1, "text": f"T{i}"} for i in range(n)]
    assert sorted(manifest(spark, rows)) == sorted(manifest_by_force(rows))


def test_paths_lead_to_the_root(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for r in merkle.proofs(merkle.document_manifest(docs), with_path=True).limit(20).collect():
        node = r.leaf
        for k in range(0, len(r.path), 2):
            node = h(r.path[k], node, r.path[k + 1])
        assert node == r.root and r.verified
