"""The whole pipeline against plain statements of its stages, on a small corpus with awkward rows."""

import random
import re

from corpus_pipeline import STAGES, run

from .test_operators import plain_hits, removed_bytes, shingles, words


def plain_pipeline(rows, items):
    """Ids and texts that the first four stages keep. rows: (doc_id, text), clean in language but for texts without letters."""
    kept = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    sets = {i: shingles(t, 5) for i, t in kept}
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if label[i] < label[j] and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[j] = label[i]
    kept = [(i, t) for i, t in kept if label[i] == i]
    gone = removed_bytes(kept, 150)
    left = []
    for i, t in kept:
        data = t.encode()
        text = bytes(c for c, x in zip(data, gone[i], strict=True) if not x).decode()
        if "".join(text.split()) or not any(gone[i]):
            left.append((i, text))
    return {i: t for i, t in left if not plain_hits(t, items, 10)[1]}


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    item = " ".join(words(rng, 14))
    passage = " ".join(words(rng, 60))
    rows = [(i, " ".join(words(rng, rng.randint(20, 120)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    for i in range(5, 10):  # near copies
        w = rows[i][1].split()
        rows.append((100 + i, " ".join([*w, "tail"])))
    rows += [(200 + i, f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}") for i in range(4)]
    rows += [(300 + i, f"{' '.join(words(rng, 20))} {item} {' '.join(words(rng, 20))}") for i in range(3)]
    rows += [(400, None), (401, ""), (402, "12 - 3"), (403, " ".join(words(rng, 8_000))), (404, "é" * 90)]
    table = [(i, t, "xx", "hot" if i % 3 else f"s{i % 2}", len(t or "")) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, kinds).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, [(1, item), (2, None)])
    assert {r["doc_id"] for r in got} == set(want)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.split()) for i, t in want.items()}
    assert max(r["epoch"] for r in got) < 5 and [name for name, _ in STAGES][-1] == "mixture"
    empty = tmp_path / "empty"
    spark.createDataFrame([], kinds).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    assert run(spark, str(empty)).count() == 0
