"""Scores against a model with dictionaries, and that all probabilities after a context sum to 1."""

import math
import re
from collections import Counter, defaultdict

import pytest

from railbird.llm import katz
from railbird.operators.groups import shared_dir
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def split(text):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return WORD.findall((text or "").translate(str.maketrans(upper, lower))) + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(set)
        self.contexts = Counter()
        for text in texts:
            before = "<s>"
            for word in split(text):
                self.words[word] += 1
                self.pairs[before, word] += 1
                self.contexts[before] += 1
                self.after[before].add(word)
                before = word
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.word_kept = self.kept(self.words)
        self.pair_kept = self.kept(self.pairs)

    def kept(self, counts):
        seen = Counter(counts.values())
        return katz.discounts([seen[r] for r in range(1, katz.K + 2)])

    def part(self, kept, count):
        return count * (kept[count] if count <= katz.K else 1.0)

    def word(self, w):
        if w in self.words:
            return self.part(self.word_kept, self.words[w]) / (self.n + 1)
        return 1 - sum(self.part(self.word_kept, c) for c in self.words.values()) / (self.n + 1)

    def pair(self, h, w):
        if h not in self.contexts:
            return self.word(w)
        if (h, w) in self.pairs:
            return self.part(self.pair_kept, self.pairs[h, w]) / (self.contexts[h] + 1)
        seen = sum(self.part(self.pair_kept, self.pairs[h, x]) for x in self.after[h]) / (self.contexts[h] + 1)
        return (1 - seen) / (1 - sum(self.word(x) for x in self.after[h])) * self.word(w)

    def score(self, text):
        words = split(text)
        return sum(math.log10(self.pair(h, w)) for h, w in zip(["<s>", *words], words))

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in split(text))


def chunked(spark, rows, name, size):
    path = f"{shared_dir(spark)}/katz-{name}"
    cases.documents(spark, rows, 2).write.mode("overwrite").parquet(path)
    return katz.read_chunks(spark, path, size).withColumn("held_out", (katz.F.coalesce("doc_id", katz.F.lit(0)) % 3) == 1)


@pytest.mark.parametrize(("size", "part_bytes"), [(4096, 1 << 24), (5, 20_000)])
def test_same_as_dictionaries(spark, monkeypatch, size, part_bytes):
    monkeypatch.setattr(katz, "PART_BYTES", part_bytes)
    plain = Plain([r[1] for r in cases.ROWS if (r[0] or 0) % 3 != 1])
    got = sorted(map(tuple, katz.score(chunked(spark, cases.ROWS, f"all{size}", size)).collect()), key=repr)
    assert len(got) == len(cases.ROWS)
    want = [
        (
            r[0],
            (r[0] or 0) % 3 == 1,
            len(split(r[1])),
            sum(w in plain.words for w in split(r[1])),
            plain.n,
            pytest.approx(plain.base(r[1]), rel=1e-9),
            pytest.approx(plain.score(r[1]), rel=1e-9),
        )
        for r in cases.ROWS
    ]
    for a, b in zip(got, sorted(want, key=lambda r: repr(r[:5])), strict=True):
        assert a == b


def test_probabilities_sum_to_one():
    plain = Plain([r[1] for r in cases.ROWS])
    for h in ["<s>", "one", "</s>", "never", *list(plain.words)[:40]]:
        total = sum(plain.pair(h, w) for w in plain.words) + plain.pair(h, "an unknown word")
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark):
    docs = chunked(spark, [cases.row(1, "a b"), cases.row(4, None)], "none", 10)
    got = sorted(map(tuple, katz.score(docs).collect()))
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (4, True, 1, 0, 0, 0.0, 0.0)]


def test_empty_table(spark):
    docs = chunked(spark, cases.ROWS, "empty", 10).where("doc_id < 0")
    assert katz.score(docs).count() == 0


def test_discounts_of_few_counts_are_proper():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 50, 20, 10, 5, 3], [1, 100, 1, 1, 1, 1]):
        kept = katz.discounts(n)
        assert kept[0] == 0 and all(0 < x < 1 for x in kept[1:])
