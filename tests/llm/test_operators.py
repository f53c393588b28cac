"""Each operator against a plain statement of its rule, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_wrapper, jaccard_join, language_id, license_scan, mixing, paragraph_dedup, suffix_dedup, top_k, warc
from tidemark.llm.shared import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def words(rng, n, letters="abcdefgh"):
    return [rng.choice(letters) + rng.choice("aeiou") + rng.choice(letters) + rng.choice(["", "n", "st"]) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Null, empty, blank and very long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    base = [" ".join(words(rng, rng.randint(3, 200))) for _ in range(25)]
    texts = [None, "", " \n\t", "x", "Two words", "ÀÉ über naïve 漢字 text", " ".join(words(rng, 20000))]
    texts += base + base[:4]
    for t in base[4:14]:  # near copies: a word or two of many differ
        w = t.split()
        for _ in range(1 + len(w) // 80):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for t in base[14:18]:
        texts.append(f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}\n{' '.join(words(rng, 30))}")
    rows = [(i * 3 % 101, t, rng.choice(["en", "de", None]), "s0" if i % 3 else None, 0, "clash") for i, t in enumerate(texts)]
    return rows + [rows[20]]


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}).encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, none, corpus, k, num):
    for chunk_tokens in (400_000, 300):  # one chunk to a block, and many
        links = {r["doc_id"]: r["n_links"] for r in jaccard_join.components(docs, k=k, num=num, chunk_tokens=chunk_tokens, count_links=True).collect()}
        all_sets = [(r[0], shingles(r[1], k)) for r in corpus]
        similar = [[bool(a and b) and 100 * len(a & b) >= num * len(a | b) for _, b in all_sets] for _, a in all_sets]
        assert links == {all_sets[i][0]: max(0, sum(x) - 1) for i, x in enumerate(similar)}
    got = {r["doc_id"]: r for r in jaccard_join.components(docs, k=k, num=num).collect()}
    sets = [(r[0], shingles(r[1], k)) for r in corpus]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = 0
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
                linked += 1
    assert linked > 5
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), top(i)) for i, s in sets}
    assert jaccard_join.components(none, k=k, num=num).count() == 0


def test_jaccard_chunks_agree(docs):
    """Many small chunks and the rounds between them give what one chunk gives."""
    one = sorted(map(tuple, jaccard_join.components(docs, k=3, num=70).select("doc_id", "component_id").collect()))
    many = sorted(map(tuple, jaccard_join.components(docs, k=3, num=70, chunk_tokens=50).select("doc_id", "component_id").collect()))
    assert one == many


def test_jaccard_many_mutual_links(spark):
    """Every link of a group of mutually similar texts is counted, though its component needs but a few of them."""
    rng = random.Random(8)
    base = words(rng, 120)
    rows = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (None, rows[3][1]), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.components(docs, k=3, num=90, chunk_tokens=2_000, count_links=True).collect()
    sets = [(r[0], shingles(r[1], 3)) for r in rows]
    want = sorted((str(i), sum(1 for _, b in sets if a and b and 100 * len(a & b) >= 90 * len(a | b)) - bool(a)) for i, a in sets)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == want
    assert {r["component_id"] for r in got if r["n_shingles"]} == {0}


def test_jaccard_frequent_tokens(spark, monkeypatch):
    """Tokens that very many nodes have are counted apart and their nodes meet in parts; rows without an id are linked too."""
    monkeypatch.setattr("tidemark.llm.jaccard_join.PART_NODES", 4)
    rng = random.Random(12)
    base = words(rng, 100)
    rows = [(i, " ".join([*base[: 10 + i % 7], f"e{i}", *base[10 + i % 7 :]])) for i in range(60)]
    rows += [(100 + i, " ".join(words(rng, 80))) for i in range(20)]
    alone = words(rng, 90)
    rows += [(None, " ".join(alone)), (None, " ".join([*alone, "tail"])), (200, " ".join([*alone, "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("clash")).repartition(5)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.components(docs, k=3, num=90).collect())
    want = [(str(i), "0") for i in range(60)] + [(str(i), str(i)) for i in range(100, 120)] + [("None", "200"), ("None", "200"), ("200", "200")]
    assert got == sorted(want)


def test_drop_near_duplicates(docs, corpus):
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r[0] for r in corpus if not (r[1] or "").strip()} <= ids
    assert len(ids) < len({r[0] for r in corpus})


def test_drop_near_duplicates_by_row(spark):
    """Repeated ids are rows of their own: what resembles nothing stays, and one row of each group does."""
    rng = random.Random(11)
    a, b, c, d = (" ".join(words(rng, 40)) for _ in range(4))
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (7, c, 0), (7, c, 0), (None, a, 0), (None, d, 1), (None, d, 2), (9, c + " tail", 0), (9, "", 0), (9, None, 0), (3, "", 0), (8, d + "  ", 0), (8, d, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumn("keeps", F.lit("clash")).repartition(4)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "mark", "keeps"]
    got = sorted(((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (9, ""), (9, ""), (3, ""), (8, d)], key=str)
    nulls = spark.createDataFrame([(None, d, 1), (None, d, 2), (None, a, 3)], "doc_id long, text string, mark int")
    assert sorted(r["text"] for r in jaccard_join.drop_near_duplicates(nulls).collect()) == sorted([a, d])
    assert jaccard_join.drop_near_duplicates(docs.limit(0)).count() == 0


def removed_bytes(rows, length):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.get(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], i)
        out[i] = gone
    return out


@pytest.mark.parametrize("slice_bytes", [2_000_000, 500])
def test_suffix_dedup(docs, none, corpus, slice_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup.removed_parts, "__defaults__", (50, slice_bytes))
    got = {r["doc_id"]: r for r in suffix_dedup.digest(docs).collect()}
    gone = removed_bytes({(r[0], r[1]) for r in corpus}, 50)
    for i, text in {(r[0], r[1]) for r in corpus}:
        b, g = (text or "").encode(), gone[i]
        kept = bytes(c for c, x in zip(b, g, strict=True) if not x)
        spans = sum(1 for j in range(len(g)) if g[j] and (not j or not g[j - 1]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(g), spans, hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 500
    assert suffix_dedup.digest(none).count() == 0


def test_suffix_dedup_periodic(spark):
    """Runs of one phrase, where a window has many equal grams, come out alike however the rows lie in their tasks."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["a", "to ", "xyz"]) * rng.randint(1, 40) + rng.choice(["", "q", "end of it "]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:15])]
    gone = removed_bytes(rows, 50)
    for parts in (1, 7):
        got = {r["doc_id"]: r for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        for i, text in rows:
            kept = bytes(c for c, x in zip(text.encode(), gone[i], strict=True) if not x)
            assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(gone[i]), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_text(spark):
    shared = "é" * 40 + "shared passage that is long enough to go"
    docs = spark.createDataFrame([(1, "first " + shared, "a"), (2, "xé " + shared + " end", "b"), (3, shared, "c"), (4, None, "d")], "doc_id long, text string, ranges string")
    got = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(docs).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1]["text"] == "first " + shared and got[2]["ranges"] == "b" and got[4]["text"] is None
    assert got[2]["text"].replace("é", "") == "x end"


def test_equal_windows_match_sorting():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[::150] = 255
    order, group = suffix_dedup.equal_windows(np.append(data, np.uint8(255)), 12)
    text = bytes(np.append(data, np.uint8(255)))
    by = {}
    for place, c in zip(order.tolist(), group.tolist(), strict=True):
        if b"\xff" not in text[place : place + 12] and place + 12 <= len(text):
            by.setdefault(text[place : place + 12], set()).add(c)
    assert all(len(c) == 1 for c in by.values())
    assert len({next(iter(c)) for c in by.values()}) == len(by)


def test_paragraphs(spark, docs, none, corpus):
    got = {r["doc_id"]: r for r in paragraph_dedup.digest(docs).collect()}
    texts = {r[0]: r[1] for r in corpus}
    by_text = {}
    for i in sorted(texts):
        by_text.setdefault(texts[i], []).append(i)
    for text, ids in by_text.items():  # exact copies lose all but the first
        if text and len(text) >= 120 and len(ids) > 1:
            assert all(got[i]["n_removed"] == len(text.encode()) for i in ids[1:])
    holders = sorted(i for i, t in texts.items() if t and "\n" in t and len(t) > 300)[1:]
    assert all(got[i]["n_removed"] >= 100 for i in holders)  # a passage pasted into other lines
    rng = random.Random(9)
    clean = spark.createDataFrame([(i, " ".join(words(rng, 150, "jklmnpqr")), "x") for i in range(30)], "doc_id long, text string, first string")
    assert paragraph_dedup.digest(clean).agg(F.sum("n_removed")).first()[0] == 0
    assert paragraph_dedup.digest(none).count() == 0


def test_paragraphs_near(spark):
    """Lines that differ in a few words fall into one component."""
    rng = random.Random(2)
    line = words(rng, 120)
    rows = [(0, " ".join(line))]
    for i in range(1, 6):
        w = list(line)
        w[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(words(rng, 40)) + "\n" + " ".join(w)))
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] >= len(" ".join(line)) * 0.9 for i in range(1, 6))


def test_paragraph_recall(spark):
    """Line pairs of similarity 0.8 or more meet in one component (recall 0.95 at least); no others do. Passages of 51 words go."""
    rng = random.Random(31)
    lines = []
    for _ in range(60):
        line = words(rng, rng.randint(50, 90))
        lines.append(" ".join(line))
        for _ in range(2):
            w = list(line)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = "new"
            lines.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets = [shingles(t, 5) for t in lines]
    similar = [(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    gone = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digest(docs).collect()}
    late = {j for _, j in similar}
    assert len(late) > 30 and sum(gone[j] == len(lines[j].encode()) for j in late) >= 0.95 * len(late)
    assert all(gone[i] < len(lines[i].encode()) for i in range(len(lines)) if i not in late)
    passage = " ".join(words(rng, 51))
    rows = [(i, f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 40))}") for i in range(20)]
    rows += [(None, rows[0][1]), (50, rows[0][1]), (50, "other text of the same id"), (60, "short line\n" + rows[1][1])]
    short = [(70 + i, "short line") for i in range(3)]
    got = paragraph_dedup.digest(spark.createDataFrame([*rows, *short], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["n_removed"] for r in got if r["doc_id"] not in (None, 50)}
    assert by[0] == 0 and all(by[i] >= 0.5 * len(passage) for i in range(1, 20)) and by[71] == 0
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 50) == [0, len(rows[0][1].encode())]
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    every = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.digest(spark.createDataFrame(short, "doc_id long, text string"), least_bytes=1).collect()}
    assert every == {70: 0, 71: 10, 72: 10}


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/1", "same " * 40), (3, "http://a/2", "same " * 40), (9, None, "same " * 40), (4, "u", None), (6, "u", ""), (7, "u\r\nX: y", "short"), (8, "u", "short"), (None, "u", "same " * 40), (1, "u", "é" * 60_000), (3, "again", "same " * 40), (2, "u", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=1000)
    back = warc.read_archives(manifest, payloads=True).collect()
    assert len(back) == len(rows)
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in back if r["page_id"] in (3, 5, 9))
    assert kinds == [(3, "response", None), (3, "response", None), (5, "revisit", 3), (9, "revisit", 3)]
    by = {r[0]: r[2] or "" for r in rows}
    for r in back:
        html = by[r["page_id"]].encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        assert r["record_type"] == "revisit" or bytes(r["html"]) == html
    one = warc.fetch(manifest, spark.createDataFrame([(1,), (5,)], "page_id long")).collect()
    assert {r["page_id"]: (r["refers_to"], len(r["html"] or b"")) for r in one} == {1: (None, 120_000), 5: (3, 0)}
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "e"))).count() == 0
    clash = pages.selectExpr("*", "'x' AS digest", "1 AS n", "2 AS refers_to", "3 AS copies", "'y' AS archive")
    assert warc.read_archives(warc.write_archives(clash, str(tmp_path / "c"))).count() == len(rows)


def test_warc_headers(spark, tmp_path):
    """Mandatory fields, a warcinfo at the head of each archive, and revisits that name their response's record."""
    rows = [(5, "http://a/1", "same " * 40), (3, "http://a/2", "same " * 40), (7, "u", "twice " * 40), (6, "u", "twice " * 40), (6, "u", "twice " * 40), (8, "u", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), frame_bytes=1000, date="2024-05-06T07:08:09Z")
    records = []
    for file in (tmp_path / "w").glob("part-*.warc.zst"):
        with file.open("rb") as source:
            data = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
        own = [dict(x.split(": ", 1) for x in head.split("\r\n")) for head in data.decode().split("WARC/1.1\r\n")[1:] for head in [head.split("\r\n\r\n")[0]]]
        assert own[0]["WARC-Type"] == "warcinfo" and own[0]["WARC-Filename"] == file.name
        records += own
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(r) and r["WARC-Date"] == "2024-05-06T07:08:09Z" for r in records)
    assert len({r["WARC-Record-ID"] for r in records}) == len(records)
    by = {r["X-Page-ID"]: r for r in records if "X-Page-ID" in r}
    assert by["5"]["WARC-Refers-To"] == by["3"]["WARC-Record-ID"] and by["5"]["X-Refers-To-Page-ID"] == "3"
    assert by["7"]["X-Refers-To-Page-ID"] == "6" and "WARC-Refers-To" not in by["7"]  # the page 6 has two records


def test_language_id(spark):
    rng = random.Random(1)
    stock = {"aa": words(rng, 60, "bdg"), "bb": words(rng, 60, "ptk"), "cc": words(rng, 60, "mnl")}
    rows = []
    for i in range(240):
        lang = rng.choice(list(stock))
        rows.append((i, " ".join(rng.choice(stock[lang]) + rng.choice(stock[lang]) if rng.random() < 0.5 else rng.choice(stock[lang]) for _ in range(12)), lang if i % 9 else None))
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "123 --- 4", "bb"), (503, "漢字", "cc")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in language_id.train_and_predict(docs).collect()}
    assert len(got) == len(rows)
    truth = {i: next(k for k, v in stock.items() if t.split()[0][:3] in {x[:3] for x in v}) for i, t, _ in rows[:240]}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [got[i]["held_out"] for i in range(240)] == [i in held for i in range(240)]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.train_and_predict(docs.where("lang = 'zz'")).count() == 0
    unlabelled = language_id.train_and_predict(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    kept = language_id.keep_known(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and {500, 501, 502}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_language_unspaced(spark):
    rng = random.Random(9)
    stock = {"aa": "漢字仮名交文書", "bb": "한글문장단어로"}

    def run(lang, n):
        return "".join(rng.choice(stock[lang]) for _ in range(n))

    train = spark.createDataFrame([(run(k, 300), k) for k in stock for _ in range(5)], "text string, lang string")
    model = language_id.fit(train)
    assert model["langs"] == ["aa", "bb"]  # unspaced text is learned from
    text = run("aa", 450) + run("bb", 4000)
    assert language_id.judge(model, text)[0] == "bb"  # what lies beyond the first 400 letters counts
    long = run("bb", 1200)
    assert language_id.judge(model, long + " " + " ".join(run("aa", 4) for _ in range(6)))[0] == "bb"  # and a run weighs by its length
    many = {"".join(w) for w in zip(*[rng.choices("abcdefghij", k=30_000) for _ in range(7)])}
    both = language_id.fit(spark.createDataFrame([(" ".join(many) + " " + " ".join(many), "cc")], "text string, lang string"))
    assert language_id.is_known(both, sorted(many)).all() and len(both["words"][0]) == len(many) > 20_000  # no cap on rank


def slow_language(train, text, longest=5, full_weight=20):
    """Score and back-off stated word by word. train: (text, lang) of different texts."""
    counts = {}
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            own = counts.setdefault(lang, {})
            if len(w) <= 40:
                own["", w] = own.get(("", w), 0) + 1
            b = f"^{w}$"
            for n in range(1, longest + 1):
                for i in range(len(b) - n + 1):
                    own[n, b[i : i + n]] = own.get((n, b[i : i + n]), 0) + 1
    langs = sorted(counts)
    kept = [{k: n for k, n in counts[x].items() if n >= (1 if k[0] == 1 else 2)} for x in langs]
    all_keys = {k for x in kept for k in x}
    sums = {kind: [sum(n for k, n in x.items() if k[0] == kind) for x in kept] for kind in ["", *range(1, longest + 1)]}
    sizes = {kind: max(1, sum(k[0] == kind for k in all_keys)) for kind in sums}

    def logs(key):
        return [math.log((x.get(key, 0) + 0.5) / (sums[key[0]][i] + 0.5 * sizes[key[0]])) for i, x in enumerate(kept)]

    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not found or not langs:
        return "und", 0.0
    total, weight = [0.0] * len(langs), 0
    for w in found:
        units = max(1, -(-len(w) // 40))
        weight += units
        if ("", w) in all_keys:
            own = logs(("", w))
        else:
            b, i, parts, own = f"^{w}$", 0, 0, [0.0] * len(langs)
            while i < len(b):
                n = next((n for n in range(min(longest, len(b) - i), 0, -1) if (n, b[i : i + n]) in all_keys), 0)
                if n:
                    own = [x + y + math.log(0.4) * (longest - n) for x, y in zip(own, logs((n, b[i : i + n])), strict=True)]
                    parts += 1
                i += n or 1
            own = [x * min(1.0, 2.0 * units / max(parts, 1)) for x in own]
        total = [x + y for x, y in zip(total, own, strict=True)]
    best = total.index(max(total))
    return langs[best], 1 / sum(math.exp((x - total[best]) * min(1.0, full_weight / weight)) for x in total)


def test_language_against_slow_statement(spark):
    """Scores, back-off, ties, very long texts and repeated rows against the plain statement."""
    rng = random.Random(12)
    stock = {"aa": words(rng, 40, "bdgm"), "bb": words(rng, 40, "ptkm")}
    train = list({" ".join(rng.choices(stock[k], k=rng.randint(1, 30))): k for k in stock for _ in range(20)}.items())
    texts = [" ".join(rng.choices(stock["aa"] + stock["bb"], k=9)) for _ in range(20)] + ["İstanbul ẞ ΣΑΣ", "zzz qqq", "bim1dam_tok-pat", "漢字" * 30, "", None, "12 --", " ".join(rng.choices(stock["bb"], k=60_000)), "x" * 500]
    texts += ["".join(rng.choices("bdgptkaeiou", k=rng.randint(1, 130))) for _ in range(30)] + [texts[0]]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        lang, score = slow_language(train, text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4, text
    tie = language_id.fit(spark.createDataFrame([("same words", "zz"), ("same words", "aa")], "text string, lang string"))
    assert language_id.judge(tie, "same words") == ("aa", 0.5)
    repeated = language_id.predict(docs.union(docs).withColumn("lang_pred", F.lit("clash")), model)
    assert repeated.count() == 2 * len(texts)
    assert language_id.predict(spark.createDataFrame([(None, "same")], "doc_id long, text string"), tie).first()["doc_id"] is None


def test_license_scan(spark, none):
    text = "Intro. Released under the MIT License.\nMore text; All rights reserved. GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "mit license", 0), (4, "GNU GENERAL PUBLIC LICENSE\nAll rights reserved.\nVersion 3, 29 June 2007", 0)], "doc_id long, text string, licenses int")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert got[1]["licenses"] == "GPL-3.0,LicenseRef-all-rights-reserved,MIT" and got[1]["n_sentences"] == 4
    assert (got[2]["n_sentences"], got[2]["licenses"]) == (0, "") and got[3]["licenses"] == ""
    assert got[4]["licenses"] == "LicenseRef-all-rights-reserved"  # the rule's sentences do not follow one another
    assert license_scan.scan(none).count() == 0
    for name in license_scan.SENTENCES.values():
        assert license_scan.plain(name)


def test_license_scan_whole_sentences(spark):
    grant = license_scan.SENTENCES["mit-grant"].split()
    wrapped = "\n * ".join(" ".join(grant[i : i + 9]) for i in range(0, len(grant), 9))
    texts = {
        1: "# SPDX-License-Identifier: MIT\nimport x",
        2: "// SPDX-License-Identifier: Apache-2.0",
        3: "SPDX-License-Identifier:\nGPL-3.0-only\n",
        4: "SPDX-License-Identifier: BSD-3-Clause",
        5: "MIT License\n\n * " + wrapped + "\n *\n * More.",
        6: "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy",
        7: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
        8: "Licensed under the Apache License,\n\nVersion 2.0.",
        9: 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in\ncompliance with the License.',
        10: "SPDX-License-Identifier: MIT OR GPL-3.0-only",
    }
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0", 4: "BSD-3-Clause", 5: "MIT", 6: "MPL-2.0", 7: "", 8: "", 9: "Apache-2.0", 10: ""}
    s = license_scan.SENTENCES
    bsd2 = f"{s['bsd-grant']}\n1. {s['bsd-source']}\n2. {s['bsd-binary']}"
    more = {
        1: f"{bsd2}\n\n3. {s['bsd-names']}",
        2: bsd2,
        3: f"{bsd2}\n3. {s['bsd-names']}\n---\n{bsd2}",
        4: "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
        5: "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",
        6: "word " * 200_000 + "\nMIT License\n\n" + s["mit-grant"],
        7: "SPDX-License-Identifier: LGPL-2.1-or-later",
    }
    more |= {100 + i: f"// {s[f'spdx-{x.lower()}']}" for i, x in enumerate(license_scan.SPDX)}
    rows = [*more.items(), (2, bsd2)]
    got = [(r["doc_id"], r["licenses"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(1))).collect()]
    want = {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: "BSD-2-Clause,BSD-3-Clause", 4: "LGPL-3.0", 5: "GPL-2.0", 6: "MIT", 7: "LGPL-2.1"}
    want |= {100 + i: x.replace("-only", "").replace("-or-later", "") for i, x in enumerate(license_scan.SPDX)}
    assert sorted(got) == sorted([*want.items(), (2, "BSD-2-Clause")])
    with pytest.raises(ValueError):
        license_scan.forms({"a": "MIT License", "b": "mit license."})


def plain_hits(text, items, window):
    w = decontaminate.words(text)
    hit, names = set(), set()
    for name, t in items:
        x = decontaminate.words(t)
        n = min(window, len(x))
        grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("most_chars", [10_000_000, 200])
def test_decontaminate(spark, docs, none, corpus, most_chars):
    texts = [r[1] for r in corpus if r[1] and len(r[1].split()) > 40]
    items = [(1, " ".join(texts[2].split()[5:25])), (2, "Two WORDS!"), (3, None), (4, "..."), (10, texts[5]), (11, texts[5]), (5, "über naïve")]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.digest(decontaminate.hits(docs, bench, most_chars=most_chars)).collect()
    by = {r[0]: r[1] for r in corpus}
    assert len(got) == len(corpus)
    for r in got:
        n, hit, names = plain_hits(by[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    assert sum(r["contaminated"] for r in got) >= 4
    clean = decontaminate.remove_documents(docs, bench, most_chars=most_chars)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in got if not r["contaminated"])
    assert decontaminate.hits(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.hits(docs, bench.limit(0))).collect())


def test_decontaminate_item_without_id(spark):
    docs = spark.createDataFrame([(1, "so one two three it is"), (2, "four five"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two three"), (7, "four five"), (None, "four five")], "item_id long, text string")
    for most_chars in (10_000_000, 10):
        got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.hits(docs, bench, most_chars=most_chars)).collect()}
        assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(3, 0, True), (2, 1, True), (0, 0, False)]
        assert [r["doc_id"] for r in decontaminate.remove_documents(docs, bench, most_chars=most_chars).collect()] == [3]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)) * 0.3, np.repeat(rng.normal(size=(1, 8)), 60, axis=0)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [float("nan")] * 8, 0), (1100, [None] * 8, 0), (None, x[0].tolist(), 0), (7, x[7].tolist(), 0), (1150, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    vectors = top_k.integers(table)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    q = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, 360, 50):
        scores = sorted(((-int(q[i] @ q[j]), j) for j in range(360) if j != i))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    for shard in (32_768, 40):
        got = top_k.search(vectors, queries, shard_rows=shard, query_rows=3 if shard == 40 else 4096, page=8).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    assert top_k.search(vectors.limit(0), queries.limit(0)).count() == 0
    few = top_k.search(vectors.where("vec_id < 3"), queries.where("query_id = 0")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_top_k_of_large_numbers(spark):
    x = [[2.0**19, -(2.0**19)], [2.0**20, 3.0], [-1.0, 2.0**20]]
    vectors = top_k.integers(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"))
    got = top_k.search(vectors, vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "v")).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 2**16 * (2**39 - 3 * 2**19)), (2, 2**16 * (-(2**19) - 2**39))]
    with pytest.raises(Exception, match="too large for exact scores in vec_id 17"):
        top_k.integers(spark.createDataFrame([(17, [1e17, 0.0])], "vec_id long, embedding array<double>")).collect()


def test_top_k_prunes(monkeypatch):
    """Where vectors lie in clusters, a search opens few of the tree's nodes and is still exact."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 3000
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    tree = top_k.Tree(np.arange(len(x)), x, 5, 16)

    def nodes(node):
        return 1 + sum(map(nodes, node.children or []))

    opened, pop = [], top_k.heapq.heappop
    monkeypatch.setattr(top_k.heapq, "heappop", lambda heap: opened.append(1) or pop(heap))
    for i in range(0, 4000, 400):
        scores = sorted((-int(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5]
        assert tree.search(i, x[i]) == [(-s, j) for s, j in scores]
    assert len(opened) < 0.5 * 10 * nodes(tree.root)


def test_mixing(spark, docs, none):
    rows = [(i, "w " * 10, "big", 0) for i in range(300)] + [(1000 + i, "w " * 10, "small", 0) for i in range(20)] + [(2000, None, None, 0), (2001, "one two", None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, weight int")
    got = mixing.mix(table, most_repeats=3.0, block_tokens=100).collect()
    times = {}
    for r in got:
        times.setdefault(r["source"], {}).setdefault(r["doc_id"], []).append(r["epoch"])
    assert {len(v) for v in times["big"].values()} == {1} and len(times["big"]) == 300  # nothing is lost
    assert set(times[None]) == {2000, 2001}
    assert max(len(v) for v in times[None].values()) <= 4  # three passes, the last document begun
    tokens = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
    weights = {r["source"]: r["weight"] for r in got}
    assert math.isclose(tokens["small"] / tokens["big"], weights["small"] / weights["big"], rel_tol=0.06)
    for s in ("big", "small"):  # places are running sums, so they never overlap
        own = sorted((r["place"], r["n_tokens"]) for r in got if r["source"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(mixing.mix(table.repartition(7), most_repeats=3.0, block_tokens=100).collect())]
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    totals = spark.createDataFrame([(k, int(v * 1000)) for k, v in shares.items()], "source string, tokens long")
    alpha = mixing.exponent(totals, 1.0, None).first()["alpha"]
    p = np.array([v**alpha for v in shares.values()])
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() - 1.0) < 1e-9
    assert mixing.exponent(totals, 2.0, None).first()["alpha"] == 0.0  # out of reach: as even as can be
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("limit", [{"most_repeats": 2.5}, {"most_repeats": None, "target_entropy": 1.2}, {"most_repeats": 4.0, "budget_tokens": 700}])
def test_mixing_against_plain_statement(spark, limit, monkeypatch):
    """Exponent, budgets and places in plain Python; null ids and texts, very long texts, a hot source, several groups of blocks."""
    monkeypatch.setattr(mixing, "GROUP", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(1, 9))), "hot" if i % 3 else f"s{i % 4}") for i in range(240)]
    rows += [(None, "no id", "hot"), (900, None, "s0"), (901, "", "none"), (902, "w " * 5_000, "s1"), (903, "x", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=60, **limit).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def kept(a):
        raised = {s: p**a for s, p in share.items()}
        norm = sum(raised.values())
        if limit.get("target_entropy"):
            return -sum(r / norm * math.log(r / norm) for r in raised.values()) >= limit["target_entropy"]
        ratio = [raised[s] / share[s] for s in share]
        return max(ratio) <= limit["most_repeats"] * min(ratio)

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) == bool(limit.get("target_entropy")) else (lo, mid)
    alpha = lo if limit.get("target_entropy") else hi
    raised = {s: p**alpha for s, p in share.items()}
    weight = {s: r / sum(raised.values()) for s, r in raised.items()}
    least = min(raised[s] / share[s] for s in share)
    for s in tokens:
        own = [r for r in got if r["source"] == s]
        if s not in share:
            assert len(own) == sum(x[2] == s for x in rows)
            continue
        budget = limit["budget_tokens"] * weight[s] if "budget_tokens" in limit else total * raised[s] / least
        budget = math.ceil(budget - 1e-6)
        assert all(math.isclose(r["weight"], weight[s], rel_tol=1e-9) for r in own)
        at = 0
        for r in sorted(own, key=lambda r: (r["place"], r["n_tokens"])):  # places are running sums without gaps
            assert r["place"] == at
            at += r["n_tokens"]
        assert at >= min(budget, max(budget, tokens[s]) if budget >= tokens[s] else budget)
        for e in range(max(r["epoch"] for r in own)):  # all but the last pass hold every document once
            assert sorted(str(r["doc_id"]) for r in own if r["epoch"] == e) == sorted(str(x[0]) for x in rows if x[2] == s)
        blocks = [[r["block"] for r in sorted(own, key=lambda r: (r["place"], r["n_tokens"])) if r["epoch"] == 0 and r["n_tokens"]]]
        for b in blocks:  # a block's documents stand together
            assert sum(x != y for x, y in zip(b, b[1:])) == len(set(b)) - 1


PAGE = """<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies {n}</div>
{open}<h1>Title {n} &amp; more</h1><p>First <b>para</b>&nbsp;{n}
  graph.<p>Second {n}<br>line{extra}<ul><li>one<li>two {n}</ul><aside>see also {n}</aside><form>mail <input></form>{close}
<section id="comments"><p>reader {n}</p></section><footer>&copy; site {n}</footer></body></html>"""


@pytest.mark.parametrize(("opened", "close"), [("<article>", "</article>"), ('<div class="text">', "</div>"), ('<div role="main">', "</div>")])
def test_html(spark, opened, close):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=f"nr{i}", open=opened, close=close, extra="<blockquote>cited</blockquote>" if i % 3 == 0 else "")) for i in range(12)]
    rows += [(50, None, None), (51, "http://h0.example/", ""), (52, "http://h1.example/", "no markup, 3 < 4 &lt; 5"), (53, "x", rows[0][2][: rows[0][2].index("Second")]), rows[3]]
    got = {r["page_id"]: r for r in html_wrapper.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, wrapper int").repartition(3)).collect()}
    for i in range(12):
        cited = "\ncited" if i % 3 == 0 else ""
        assert got[i]["text"] == f"Title nr{i} & more\nFirst para nr{i} graph.\nSecond nr{i} line{cited}\none\ntwo nr{i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[50]["text"], got[50]["n_chars"], got[51]["text"]) == ("", 0, "")
    assert got[52]["text"] == "no markup, 3 < 4 < 5"
    assert got[53]["text"].startswith("Title nr0 & more\nFirst para")


def test_html_wrapper_shape():
    pages = ["<article><h1>A</h1><p>x</p><p>y</p></article>", "<article><h1>B</h1><h3>sub</h3><p>z</p></article>"]
    w = html_wrapper.merged(*[html_wrapper.stream(html_wrapper.parse(p)) for p in pages])
    shape = [(n[html_wrapper.NAME], html_wrapper.optional(w, x), html_wrapper.repeated(w, x)) for x, n in w.items() if n[html_wrapper.LEVEL] == 2]
    assert shape == [("h1", False, False), ("h3", True, False), ("p", False, True)]
    rows = html_wrapper.stream(html_wrapper.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert [(n[html_wrapper.NAME], html_wrapper.repeated(rows, x)) for x, n in rows.items() if n[html_wrapper.LEVEL] == 2] == [("dt", True), ("dd", True)]
    same = html_wrapper.merged(*[html_wrapper.stream(html_wrapper.parse(f"<p>alike</p><b>{i}</b>")) for i in range(2)])
    assert [n[html_wrapper.CONSTANT] is None for n in same.values()] == [False, False, True]


def texts_of_pages(spark, htmls, host="http://one.example/"):
    rows = [(i, f"{host}{i}", h) for i, h in enumerate(htmls)]
    return {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_wrapper_decides(spark):
    """Without article or main elements the host's pages together name the content; one page alone would not."""
    rng = random.Random(6)

    def page(n, box):
        body = "".join(f"<p>{' '.join(words(rng, 12))}</p>" for _ in range(n))
        return f"<body><div class=col-a><h1>T</h1>{body}</div><div class=col-b><p>{' '.join(words(rng, box))}</p></div><div class='social-x'><p>Follow us here</p></div></body>"

    htmls = [page(20, 4) for _ in range(6)] + [page(1, 40)]
    got = texts_of_pages(spark, htmls)
    assert got[6].count("\n") == 1 and got[6].startswith("T\n")  # its side box is longer than its text
    alone = texts_of_pages(spark, htmls[6:])[0]
    assert alone != got[6]
    assert all(x.startswith("T\n") and x.count("\n") == 20 and "Follow" not in x for i, x in got.items() if i < 6)


def test_html_class_words(spark):
    """A word in a class or id removes nothing of an article by itself."""
    body = "<h1>H</h1><p>first</p><div class='social-history'><p>of weavers {n}</p></div><div id=notice-board>kept {n}</div><div class='share-buttons'>Share</div><section id=comments><p>me too {n}</p></section>"
    opened = ["<article class='post comments-open promotion'>", "<main class='content has-sidebar'>", "<div role=main class=no-sidebar>", "<article class=ad>"]
    for i, o in enumerate(opened):
        tag = re.match("<([a-z]+)", o)[1]
        htmls = [f"<body><nav>N</nav>{o}{body.format(n=n)}</{tag}><footer>F</footer></body>" for n in range(4)]
        got = texts_of_pages(spark, htmls, f"http://h{i}.example/")
        assert got == {n: f"H\nfirst\nof weavers {n}\nkept {n}" for n in range(4)}
    weak = [f"<article><p>text {n}</p><div class='ad-zone'>Buy now at our shop</div></article>" for n in range(4)]
    assert texts_of_pages(spark, weak) == {n: f"text {n}" for n in range(4)}  # constant on all pages, so of the template


def test_html_deep_long_and_odd(spark):
    deep = "<article>" + "<div>" * 3_000 + "inside" + "</div>" * 3_000 + "<p>after</p></article>"
    asides = "<article><p>kept</p></article>" + "<aside>" * 1_200 + "x"
    long = "<article>" + "".join(f"<p>p{i} &lt;</p>" for i in range(20_000)) + "</article>"
    hashed = [f"<body><div class='sc{i}x9'><p>{'text ' * 30}{i}</p></div></body>" for i in range(30)]
    got = texts_of_pages(spark, [deep, asides, long, "</p></div>", "<p>aaaa<table><tr><td>b<td>c</table>"])
    assert got[0] == "inside\nafter" and got[1] == "kept"
    assert got[2] == "\n".join(f"p{i} <" for i in range(20_000))
    assert (got[3], got[4]) == ("", "aaaa\nb\nc")
    assert texts_of_pages(spark, hashed, "http://hash.example/") == {i: "text " * 30 + str(i) for i in range(30)}
    merged = html_wrapper.stream(html_wrapper.parse(hashed[0]))
    for h in hashed[1:]:
        merged = html_wrapper.merged(merged, html_wrapper.stream(html_wrapper.parse(h)))
    assert len(merged) == 4  # names made for each build do not grow the wrapper
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_wrapper.extract(empty).count() == 0


@pytest.mark.parametrize("part_edges", [400_000, 25])
def test_components(spark, part_edges, monkeypatch):
    monkeypatch.setattr("tidemark.llm.shared.PART_EDGES", part_edges)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        x, y = sorted((up.setdefault(a, a), up.setdefault(b, b)))
        for k, v in list(up.items()):
            if v == y:
                up[k] = x
    assert got == up
