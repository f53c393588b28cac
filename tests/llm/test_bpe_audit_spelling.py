"""Byte-level BPE, the filter audit and spelling variants against plain statements of their rules."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, filter_audit, spelling

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, part string, word string"


def table(spark, rows, parts=3):
    """documents with further columns whose names are those of the operators' own."""
    return spark.createDataFrame([(d, t, "en", s, 0, "clash", "clash", "clash") for d, t, s in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(spark, library):
    rng = random.Random(3)
    alphabet = "abcdeetinos  \n\t'’.,-0123éÀß漢字🙂̀​\x00\x1c\xa0ﬁ"
    texts = [None, "", " ", "  \n ", "<|endoftext|> it's we'LL", "a" * 30_000, "xq" * 4_000, "é" * 999, " " * 5_000 + "x", "zyx1" * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    texts += ["".join(map(chr, (rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)]) for _ in range(40)))) for _ in range(60)]
    rows = [(None if i == 20 else i // 2 if i > 140 else i, t, None) for i, t in enumerate(texts)] + [(7, texts[7], None)]
    got = byte_bpe.digest(table(spark, rows), VOCABULARY, public_tokenizers.PATTERN)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t, _ in rows)
    assert Counter(map(tuple, got.collect())) == want


def test_segment_tree_merges_as_the_plain_loop():
    ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate([b"ab", b"bc", b"aa", b"abc", b"aaa", b"cab", b"bca", b"aab"])}

    def plain(piece):
        if piece in ranks:
            return (ranks[piece],)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
            if not found:
                return tuple(ranks[p] for p in parts)
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for n in range(9):
        for letters in itertools.product(b"abc", repeat=n):
            assert byte_bpe.merged(bytes(letters), ranks) == plain(bytes(letters)), letters


def test_short_pieces_are_scanned_and_equal_the_tree(monkeypatch, library):
    ranks = library._mergeable_ranks
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"abcdet in") if rng.random() < 0.9 else rng.randrange(256) for _ in range(n)) for n in range(1, 140) for _ in range(6)]
    trees = [byte_bpe.by_tree(piece, ranks) for piece in pieces]
    assert trees == [byte_bpe.by_scan(piece, ranks) for piece in pieces] == [tuple(library._encode_single_piece(piece)) for piece in pieces]
    monkeypatch.setattr(byte_bpe, "put", None)  # no leaf of a tree can be changed
    short = [piece for piece in pieces if len(piece) <= byte_bpe.SCANNED]
    assert [byte_bpe.merged(piece, ranks) for piece in short] == [tuple(library._encode_single_piece(piece)) for piece in short]


def test_decode_of_unknown_ids_and_bad_vocabularies(spark, tmp_path, library):
    ranks = spark.sparkContext.broadcast(byte_bpe.Vocabulary(byte_bpe.read_ranks(spark, VOCABULARY)))
    rows = [(1, [library.encode_ordinary("hi")[0]]), (2, [10**6]), (3, [-1]), (4, [1, None]), (5, None), (6, [])]
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), ranks).collect()}
    assert got == {1: bytearray(b"hi"), 2: None, 3: None, 4: None, 5: bytearray(b""), 6: bytearray(b"")}
    assert byte_bpe.read_ranks(spark, f"file://{VOCABULARY}") == ranks.value.ranks
    bad = tmp_path / "bad.tiktoken"
    bad.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no rank for bytes"):
        byte_bpe.read_ranks(spark, str(bad))


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 10)
    pieces = byte_bpe.Pieces({bytes([b]): b for b in range(256)})
    for i in range(95):
        assert pieces[f"w{i}"] == tuple(f"w{i}".encode())
    assert len(pieces) <= 10 and pieces["z" * 100] == (ord("z"),) * 100 and "z" * 100 not in pieces


def audited(rows, labels):
    """The audit by applying the filters in each order to the rows themselves."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    least: dict = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    failing = []
    for d, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and least[t] < d]
        failing.append((d, s or "", {f for f, x in zip("ABCDE", tests, strict=True) if x}))
    out, removed_in = {}, Counter()
    for part in {s for _, s, _ in failing}:
        own = [(d, f) for d, s, f in failing if s == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [(d, x) for d, x in left if f in x]
                kept = [(d, x) for d, x in left if f not in x]
                removed_in[part, f] += len(gone)
                out[part, order, k + 1] = [len(kept), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                left = kept
    return {(p, o, k, *v, removed_in[p, o[k - 1]]) for (p, o, k), v in out.items()}


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    texts = [None, "", "", "A", "  \t", "a|b", " ".join(word() for _ in range(220)), " ".join(["same"] * 250), " ".join(word().upper() for _ in range(300))]
    long = " ".join(word() for _ in range(4000))
    texts += [long, long, long[:-1] + "!", "x" + long[1:], long[:9000] + "#" + long[9001:], long[:1000] + "?" + long[1001:]]
    texts += [" ".join(word() for _ in range(rng.choice([150, 199, 200, 201, 260]))) + rng.choice(["", " %", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for _ in range(30)]
    texts += rng.choices(texts, k=60)
    rows = [(i * 7 % 101, t, rng.choice(["hot", "hot", "b", "", None])) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[3], (None, long, "hot"), (None, "", "b"), (5, "other text of an id that repeats", "b")]


@pytest.mark.parametrize("weak", [False, True])
def test_filter_audit(spark, audit_rows, monkeypatch, weak):
    if weak:  # hashes that meet for different texts: full texts must tell them apart
        monkeypatch.setattr(filter_audit, "block_hashes", lambda text: F.array(F.length(text) % 2).cast("array<bigint>"))
    labels = [(d, d % 2, int(d % 5 == 0)) for d in range(0, 101, 3)] + [(3, 1, None), (6, None, 1), (None, 1, 1)]
    got = filter_audit.audit(table(spark, audit_rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = got.collect()
    assert len(found) == 600 * len({s or "" for _, _, s in audit_rows})
    assert {tuple(r) for r in found} == audited(audit_rows, labels)


def test_filter_audit_of_nothing(spark):
    assert filter_audit.audit(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_refinement_drops_single_rows(spark, audit_rows):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, audit_rows).select(F.length(text).alias("size"), filter_audit.block_hashes(text).alias("hashes"))
    copies = [t for t, n in Counter(t or "" for _, t, _ in audit_rows).items() if n > 1]
    assert filter_audit.refined(rows).count() == len(copies)
    assert [a for a, _ in filter_audit.blocks()][:3] == [1, 257, 257 + 2048] and sum(n for _, n in filter_audit.blocks()) >= 2**31 - 2


def words_by_hand(rows):
    """Words and counts as the contract states them."""
    n = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n):
    """All pairs of words compared."""
    form, out = {}, []
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


@pytest.mark.parametrize("hot", [2, 40, 10_000])
def test_spelling_variants_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(hot)
    n = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "b" * 300: 9, "b" * 299 + "a": 50, "b" * 301: 6, "zzzzzz×": 7, "zzzzzz÷": 40}
    for _ in range(120):  # stems with all sorts of one-letter changes, among them runs of one letter
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 9)))
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("abéz")
            w = rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :] if len(w) > 6 else w])
            n[w] = rng.choice([5, 6, 25, 26, 125, 700, 4000])
    got = spelling.variants(spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == variants_by_hand(n)


def test_spelling_of_texts(spark):
    rng = random.Random(2)
    stems = ["wordsmith", "Überall", "naïveté", "Sentence", "sentance", "paragraph", "mañana", "ÉCOLES"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", "", "s", ",", "-x", "1"]) for _ in range(400)), None) for i in range(40)]
    rows += [(None, None, "s"), (50, "", None), (51, "漢字 12 !", None), (None, "paragraph " * 7, None), (3, "paragraph", None), (3, "paragraph", None), (52, "g" * 5000 + " ", None)] + [(60 + i, "g" * 5000, None) for i in range(6)]
    n = words_by_hand(rows)
    assert any(w not in {s.lower() for s in stems} and c >= 5 for w, c in n.items())
    assert {r["word"]: r["n"] for r in spelling.words_of(table(spark, rows)).collect()} == n
    assert Counter(map(tuple, spelling.grouped(table(spark, rows)).collect())) == variants_by_hand(n)
    assert spelling.grouped(table(spark, [])).count() == 0


def test_each_pair_is_met_once(spark):
    """The moves are the light edges, few a word, and no pair is counted twice."""
    words = [("".join(x), 5) for x in itertools.product("abc", repeat=4)] + [("".join(x), 5) for x in itertools.product("abc", repeat=5)]
    df = spark.createDataFrame(words, "word string, n long")
    found = {r["word"]: r["n_near"] for r in spelling.near(df).collect()}
    assert found == {w: sum(one_edit(w, v) for v, _ in words) for w, _ in words}
    light = spelling.light_edges(df).groupBy("word").count().agg(F.max("count")).first()[0]
    assert light <= len(words).bit_length()
