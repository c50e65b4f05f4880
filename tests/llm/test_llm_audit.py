"""The filter audit against a plain count of every order."""

import itertools
import re

import pytest

from gridloom.llm import audit

TEXTS = [
    "word " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " 5 % off", "A B C d", "", None, " \t\n",
    "Ä" * 300 + " ABCDEFG", "ABC" + "x" * 147, "ABC" + "x" * 146, "a#b " * 200, " ".join("ab" for _ in range(300)), "a  a", "X " * 120_000,
]


def plain(rows, labels):
    """part, order, step -> the seven counts, by going through the documents one by one."""
    said = {}
    for doc_id, quality, toxic in labels:
        if doc_id is None:  # it labels no document
            continue
        old = said.get(doc_id, (False, False))
        said[doc_id] = (old[0] or quality == 1, old[1] or toxic == 1)
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = {}
    judged = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id,
        }
        judged.append((source or "", {k for k, bad in fails.items() if bad}, said.get(doc_id, (False, False))))
    shapley = {}
    for part in {p for p, *_ in judged}:
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                got = [0] * 6
                for p, bad, (good, toxic) in judged:
                    if p != part:
                        continue
                    gone, fails = bool(bad & set(order[: step - 1])), letter in bad
                    got[0] += not gone and not fails
                    got[1] += not gone and fails
                    got[2] += gone and fails
                    got[3] += bad == {letter}
                    got[4] += not gone and fails and good
                    got[5] += not gone and fails and toxic
                out[part, "".join(order), step] = got
                shapley[part, letter] = shapley.get((part, letter), 0) + got[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_a_plain_count(spark):
    rows = [(i, t, ("s1", "s2", None, "")[i % 4]) for i, t in enumerate(TEXTS * 3)]
    rows += [(4, "", "s1"), (4, "", "s1"), (None, "", "s2"), (None, None, "s2"), (None, "new", "s3"), (-1, "A B C d", "s3")]
    labels = [(i, i % 3 % 2, i % 2) for i in range(0, 45, 2)] + [(6, 1, None), (6, None, 1), (None, 1, 1), (900, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, part string")
    got = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert found == plain(rows, labels)
    assert len(found) == 600 * 4


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_audit_of_small_tables(spark, labels):
    schema, said = "doc_id long, text string, source string", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit.audit_filters(spark.createDataFrame([], schema), said).count() == 0
    rows = [(1, "A", None), (1, "A", None), (2, "A", None)]
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit_filters(spark.createDataFrame(rows, schema), said).collect()}
    assert found == plain(rows, labels)
