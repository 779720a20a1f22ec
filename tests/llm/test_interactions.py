"""The filter audit against a direct simulation of every order."""
import re
from collections import defaultdict
from itertools import permutations

import pytest

from weekloom.llm.interactions import interactions, mask_cells
from weekloom.llm.queries import QUERIES

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(docs, labels):
    """(part, failing letters, good, toxic) of each document."""
    out = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in docs),
        }
        own = [(q, x) for k, q, x in labels if k == i and i is not None]
        out.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    return out


def brute(docs, labels):
    found, shapley = {}, defaultdict(int)
    all_masks = masks(docs, labels)
    for part in {m[0] for m in all_masks}:
        own = [m for m in all_masks if m[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = sum(letter in m[1] for m in own)
                shapley[part, letter] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(m[1] == {letter} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def rows_of(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in FIELDS) for r in rows}
    assert len(found) == len(rows)
    return found


LONG = " ".join(f"word{k}" for k in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "en"), (3, LONG, None), (4, "", ""), (5, None, "en"), (None, "", "en"), (None, None, "en"),
    (6, "A B C # d", "en"), (7, "same " * 150, "en"), (8, LONG + " $ %", "de"), (9, LONG.upper(), "en"), (9, LONG.upper(), "en"), (None, "lone", None), (None, "lone", None),
    (10, "\t\n ", "en"), (11, LONG + "　x", "zh"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]


def test_ties_nulls_copies_and_labels(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame([(*x, 5) for x in LABELS], "doc_id long, quality int, toxic int, n int")
    assert rows_of(interactions(mask_cells(docs, labels))) == brute(DOCS, LABELS)
    assert interactions(mask_cells(docs.limit(0), labels.limit(0))).collect() == []
    assert rows_of(interactions(mask_cells(docs, labels.limit(0)))) == brute(DOCS, [])


def test_query_equals_simulation(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert rows_of(QUERIES["op11_interactions"](spark, sf)) == brute(docs, labels)


def test_many_parts_and_other_letters(spark):
    cells = spark.range(4000).selectExpr("cast(id as string) AS part", "cast(id % 4 as int) AS mask", "id + 1 AS n", "1L AS good", "0L AS toxic")
    out = interactions(cells, "xy")
    assert out.count() == 4000 * 2 * 2
    r = out.filter("part = '3' AND filter_order = 'yx' AND step = 2").first()
    assert tuple(r[f] for f in FIELDS) == (0, 0, 4, 0, 0, 0, 4)
    assert interactions(cells.filter("id < 0") if "id" in cells.columns else cells.limit(0), "xy").collect() == []
    with pytest.raises(ValueError):
        interactions(cells, "xx")
