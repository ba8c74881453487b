"""Spans that the learned formats add over a whole table: planted credentials, and none of its addresses, dates and versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import automata, secrets

ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])")


@pytest.fixture(scope="module")
def planted(spark):
    """The table sf0.1 with 360 credentials of nine formats put into as many texts: (rows by id, planted tokens by id)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    rng = np.random.default_rng(17)
    tokens = [t for own in secrets.published(40, 4711).values() for t in own]
    at = rng.choice(len(docs), len(tokens), replace=False)
    texts, put = {r["doc_id"]: r["text"] or "" for r in docs}, {}
    for i, token in zip(at, tokens, strict=True):
        key = docs[i]["doc_id"]
        words = texts[key].split(" ")
        k = int(rng.integers(0, len(words) + 1))
        texts[key], put[key] = " ".join([*words[:k], token, *words[k:]]), token
    return texts, put


def test_precision_and_recall_over_a_whole_table(spark, planted):
    texts, put = planted
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    model = secrets.learn(df)
    rows = secrets.scan(df, model).select("doc_id", "text", "base", "spans").where(F.size("spans") > 0).collect()
    added = [(r["doc_id"], r["text"][s["start"] : s["end"]]) for r in rows for s in r["spans"] if s["kind"] == "format"]
    found = {r["doc_id"] for r in rows for s in r["spans"] if put.get(r["doc_id"], "\0") in r["text"][s["start"] : s["end"]]}
    true = sum(put.get(i) == token for i, token in added)
    assert len(found) >= 0.97 * len(put)
    assert true >= 0.95 * len(added) and len(added) > 200
    assert sum(len(ADDRESS.findall(t)) for t in texts.values()) > 100 and not any(ADDRESS.fullmatch(token) for _, token in added)


def test_figures_are_no_credentials(spark, planted):
    texts, _ = planted
    df = spark.createDataFrame(list(texts.items())[:3000], "doc_id long, text string")
    model = secrets.learn(df)
    plain = ["97.51.17.173", "129.38.82.176:", "2024-01-05T12:30:59", "host=10.0.12.255", "backup-2024-01-05.tar.gz", "release-2.10.3-rc.1", "v12.31.4-beta.22", "+49-170-555-01234", "20240105T123059Z", "1234567890123456", "3.14159265358979"]
    tokens = [t for x in plain for t in secrets.TOKEN.findall(x)]
    assert not model.is_credential(tokens).any()
    assert not secrets.TOKEN.findall("97.51.17.173 2024-01-05/06 1234567890123456 ============ 10.0.0.1/255.0.0.0")
    fresh = secrets.numbers(50, 99)
    assert model.is_credential([t for x in fresh for t in secrets.TOKEN.findall(x)]).mean() < 0.02


def plain_merge(examples, alpha=0.05):
    """States of the automaton by merging whole sets of suffixes, each pair tested over all continuations; the same order of states."""
    bound = np.sqrt(0.5 * np.log(2 / alpha))
    sets = {(): [()]}  # red state's name: the suffixes of examples that pass it

    def tree(suffixes):
        out = {}
        for s in suffixes:
            for k in range(len(s) + 1):
                n, f, nxt = out.setdefault(s[:k], (0, 0, {}))
                nxt = dict(nxt)
                if k < len(s):
                    nxt[s[k]] = nxt.get(s[k], 0) + 1
                out[s[:k]] = (n + 1, f + (k == len(s)), nxt)
        return out

    def differ(f1, n1, f2, n2):
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > bound * (1 / np.sqrt(n1) + 1 / np.sqrt(n2))

    def alike(a, b):
        for w in a.keys() & b.keys():
            (n1, f1, x1), (n2, f2, x2) = a[w], b[w]
            if differ(f1, n1, f2, n2) or any(differ(x1.get(c, 0), n1, x2.get(c, 0), n2) for c in x1.keys() | x2.keys()):
                return False
        return True

    return sets, tree, alike


def test_states_merge_only_where_all_continuations_agree():
    """After each merge's test: two states of a prefix tree are alike by the automaton where a plain comparison of all suffixes says so."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        examples = ["".join(rng.choice(list("ab1"), int(rng.integers(1, 5)))) for _ in range(int(rng.integers(2, 60)))]
        auto = automata.Automaton.__new__(automata.Automaton)
        build = automata.Automaton._merge
        try:
            automata.Automaton._merge = lambda self: setattr(self, "states", list(range(len(self.count))))
            auto.__init__(examples)
        finally:
            automata.Automaton._merge = build
        of = automata.CLASS_OF
        coded = [tuple(of[np.frombuffer(e.encode(), np.uint8)].tolist()) for e in examples]
        _, tree, alike = plain_merge(examples)
        names = {0: ()}
        for q in range(len(auto.count)):
            for s, child in auto.next[q].items():
                names[child] = (*names[q], s)
        for a in names:
            for b in names:
                below = lambda p: tree([e[len(p) :] for e in coded if e[: len(p)] == p])
                assert auto._alike(a, b) == alike(below(names[a]), below(names[b]))
