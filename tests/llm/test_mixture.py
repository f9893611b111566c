"""Budgets against water-filling by hand, and the documents taken against a walk through each leaf."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from railbird.llm import mixture, queries
from railbird.operators.groups import shared_dir
from tests.llm import cases

TOKENS = r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0))"


def fill(budget, rooms, weights):
    """Deal to all that are not full by weight, until nothing is left to deal."""
    given = dict.fromkeys(rooms, 0.0)
    open_ = {k for k in rooms if rooms[k] > 0 and weights[k] > 0}
    budget = min(budget, sum(rooms[k] for k in open_))
    while open_ and budget > 1e-9:
        level = budget / sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] - given[k] <= level * weights[k] + 1e-12}
        step = full or open_
        for k in step:
            take = rooms[k] - given[k] if full else level * weights[k]
            given[k] += take
            budget -= take
        open_ -= step
    return given


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[2] or "(none)", r[3] or "(none)"].append((r[0], len((r[1] or "").split())))
    sizes = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda *path: weights.get("/".join(path), 1.0)
    langs = defaultdict(float)
    for (lang, source), n in sizes.items():
        langs[lang] += n * epochs if weight(lang, source) > 0 else 0
    top = fill(share * sum(sizes.values()), langs, {k: weight(k) for k in langs})
    out = []
    for lang in langs:
        rooms = {k: sizes[k] * epochs for k in sizes if k[0] == lang}
        budgets = fill(top[lang], rooms, {k: weight(*k) for k in rooms})
        for leaf, given in budgets.items():
            budget = math.floor(given + 1e-6)
            full = budget // sizes[leaf] if sizes[leaf] else 0
            left = budget - full * sizes[leaf]
            key = lambda i: hashlib.md5(f"{seed}/{full}/{'(none)' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
            upto, cut = 0, None
            for i, n in sorted(leaves[leaf], key=lambda d: key(d[0])):
                upto += n
                if upto > left and cut is None:
                    cut = key(i)
            for i, n in leaves[leaf]:
                more = budget > full * sizes[leaf] and (cut is None or key(i) < cut)
                out.append((i, n, budget, full + more))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    ("weights", "share"),
    [({}, 1.0), ({"en": 0.1, "fr": 5, "fr/src2": 9}, 0.6), ({"de": 100}, 1.5), ({"en": 0, "es/src4": -1, "(none)": 3}, 0.9), ({}, 9.0)],
)
def test_same_as_by_hand(spark, weights, share):
    rows = [r for r in cases.ROWS if r[0] != 12]
    got = mixture.mix(cases.documents(spark, rows), ("lang", "source"), TOKENS, weights, share, 2, 5)
    found = sorted(((r["doc_id"], r["n_tokens"], r["leaf_budget"], r["copies"]) for r in got.collect()), key=repr)
    assert found == brute(rows, weights, share, 2, 5)


def test_shortage_goes_to_siblings_first(spark):
    rows = [cases.row(i, "w " * 10, lang, source) for i, (lang, source) in enumerate(
        [("a", "s")] + [("a", "t")] * 50 + [("b", "s")] * 50 + [("b", "t")] * 50
    )]
    got = mixture.mix(cases.documents(spark, rows), ("lang", "source"), TOKENS, {"a/s": 9.0}, 0.5, 1, 0)
    budget = {(r["lang"], r["source"]): r["leaf_budget"] for r in got.collect()}
    # a's half stays within a, although its heavy leaf has 10 tokens only
    assert budget[("a", "s")] == 10 and budget[("a", "s")] + budget[("a", "t")] == 377
    assert budget[("b", "s")] == budget[("b", "t")] == 188


def test_empty_table_and_columns(spark):
    docs = cases.documents(spark)
    got = mixture.mix(docs.where("doc_id < 0"), ("lang", "source"), TOKENS, {}, 1.0)
    assert got.count() == 0 and set(docs.columns) <= set(got.columns)


def test_no_python_in_the_plan(spark):
    plan = mixture.mix(cases.documents(spark), ("lang", "source"), TOKENS, {})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sources_without_a_number_within_int(spark):
    sources = ["src1", "src6", "src2147483647", "9" * 40 + "6", "src007", "web", "", "7up", None]
    folder = f"{shared_dir(spark)}/odd-sources"
    docs = cases.documents(spark, [cases.row(i, "w " * 10, "en", x) for i, x in enumerate(sources * 3)])
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    number = {"src1": 1, "src6": 2, "src2147483647": 3, "9" * 40 + "6": 0, "src007": 3}
    expected = {x: f"d{number.get(x, zlib.crc32(x.encode()) % 4)}" for x in sources if x is not None} | {None: None}
    got = queries.QUERIES["op8_source_mixture"](spark, folder).collect()
    assert len(got) == len(sources) * 3 and {r["source"]: r["domain"] for r in got} == expected
    assert corpus_pipeline.mixed(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() == sum(r["copies"] for r in got)
