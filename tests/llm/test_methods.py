"""Operators against plain versions of their whole method, and rows at the edges with fitted models."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kelpline.llm import automata, decontaminate, fingerprint, langid, licenses, neardup, packing, pii, secrets, store, toxicity, warc
from tests.llm.test_operators import DOC, WORD, bench, edge, empty, low, prose, with_folder  # noqa: F401


def words_of(text):
    return WORD.findall(low(text or ""))


def labelled_corpus(rng, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        rows.append((i, prose(rng, 40, 200) + (" vile nasty rotten" if bad else " kind mild"), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_scores_equal_a_dense_version(spark):
    rng = np.random.default_rng(11)
    rows, labels = labelled_corpus(rng)
    docs, marked = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    picked, index = toxicity.learn(marked, docs)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (picked, index)).collect()}
    texts, y = {r[0]: words_of(r[1]) for r in rows}, dict(labels)
    examples = sorted(y)
    held = Counter(w for i in examples for w in set(texts[i]))
    terms = sorted(w for w, c in held.items() if c >= 2)
    df = Counter(w for t in texts.values() for w in set(t))
    n, n1 = len(examples), sum(y.values())
    weight = {}
    for w in terms:
        a = sum(y[i] for i in examples if w in texts[i])
        b = held[w] - a
        c, d = n1 - a, (n - n1) - b
        chi = n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
        weight[w] = (math.log((1 + len(rows)) / (1 + df[w])) + 1) * min(max(chi / 30, 0.2), 1)

    def vector(words):
        c = Counter(w for w in words if w in weight)
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    own = {i: vector(texts[i]) for i in examples}
    share = n1 / n
    for i in list(texts)[:60]:
        v = vector(texts[i])
        sims = sorted(((sum(x * own[e].get(w, 0) for w, x in v.items()), e) for e in examples), reverse=True)
        least = sims[24][0]
        votes = [(1 / (1.05 - min(s, 1)), y[e]) for s, e in sims if s >= least - 1e-6 and s > 0]
        prior = 0.5 / 1.05
        raw = (sum(w * t for w, t in votes) + prior * share) / (sum(w for w, _ in votes) + prior)
        assert got[i] == pytest.approx(index.calibrated(raw), abs=2e-3), i
    assert all(index.norm > 0)


def test_toxicity_at_edges(spark, edge, empty):  # noqa: F811
    rng = np.random.default_rng(12)
    rows, labels = labelled_corpus(rng, 120)
    docs = edge.unionByName(spark.createDataFrame([(r[0] + 1000, *r[1:]) for r in rows], DOC))
    marked = spark.createDataFrame([(i + 1000, t) for i, t in labels] + [(1000, 0), (None, 1), (4, 0)], "doc_id long, toxic int")  # an id with both labels, an id of two rows
    model = toxicity.learn(marked, docs)
    odd = docs.withColumns({c: F.lit("x") for c in ("score", "evidence", "id", "y")})
    out = toxicity.score(odd, model)
    assert out.count() == docs.count() and set(odd.columns) <= set(out.columns)
    same = {r["score"] for r in out.where("doc_id IN (4, 5)").collect()}
    assert len(same) == 1 and toxicity.score(empty, model).count() == 0
    assert toxicity.learn(marked, empty) == 0.0


def test_secret_formats_are_found_and_words_are_not(spark):
    rng = np.random.default_rng(13)
    token = lambda p, letters, n: p + "".join(rng.choice(list(letters), n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["ber", "lich", "keit", "tion", "oua", "eau", "the", "ing", "ost", "ra"]
    word = lambda: "".join(rng.choice(syllables, 5))
    rows = [(i, " ".join(word() for _ in range(60)) + (f' password = "{token("", letters, 24)}"' if i % 5 == 0 else ""), "en", "s", 1) for i in range(300)]
    planted = [(1000 + i, f"{word()} see {t} there {word().capitalize()}", "en", "s", 1) for i, t in enumerate([token(p, letters, n) for p, n in (("ghp_", 36), ("sk_live_", 24), ("AIza", 35), ("glpat-", 20), ("", 40)) for _ in range(20)])]
    docs = spark.createDataFrame(rows + planted, DOC)
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "format"] for r in secrets.scan(docs, secrets.learn(docs)).collect()}
    hits = sum(len(found[r[0]]) == 1 and r[1][slice(*found[r[0]][0])] == r[1].split(" see ")[1].split(" there")[0] for r in planted)
    wrong = sum(len(found[r[0]]) for r in rows)
    assert hits >= 0.95 * len(planted) and wrong <= 0.05 * len(planted)


def test_a_format_that_reaches_beyond_a_base_span_stays(spark):
    model = secrets.Formats(secrets.published(60, 1), ["berlichkeittion", "ouaeautheing", "ostraberlich", "keittionouaeau"])
    hidden = "0af3" * 5 + "Zx9Qw7Lm2Kp4Vt8Rj3Ys6Hd1Bn5"
    out = secrets.scan(spark.createDataFrame([(1, f"see {hidden} there")], "doc_id long, text string"), model).first()
    assert [(x["kind"], x["start"], x["end"]) for x in out["spans"]] == [("hex", 4, 24), ("format", 4, 4 + len(hidden))]


def test_the_share_of_credentials_sets_the_threshold():
    f = secrets.Formats(secrets.published(20, 1), ["berlichkeittion", "ouaeautheing"])
    h = np.zeros(f.HIGH - f.LOW + 1)
    h[-30 - f.LOW], h[60 - f.LOW] = 99_000, 1_000
    f.calibrate(h)
    assert f.threshold == pytest.approx(max(math.log(99 * 99), f.LEAST), abs=0.1)
    h[60 - f.LOW] = 0
    f.calibrate(h)
    assert f.threshold > math.log(99 * 90_000)


def plain_automaton(automaton, text):
    state, total = 0, 0.0
    for c in text:
        s = automaton.of[ord(c)]
        total += automaton.log_p[state, s]
        state = automaton.step[state, s]
    return total + automaton.log_end[state]


def test_automata_score_like_a_walk():
    examples = {"a": ["ab12cd34", "ef56ab78", "cd90ef12"], "b": ["XY-12", "ZZ-34", "QQ-5678"]}
    own = [automata.Automaton(x, of=automata.CHARACTER_OF) for x in examples.values()]
    texts = ["ab12", "XY-1", "zz", "x" * 300]
    order, codes, lengths = automata.padded(texts, automata.CHARACTER_OF)
    got = automata.log_likelihoods(own, codes, lengths)
    assert got == pytest.approx([max(plain_automaton(a, texts[k]) for a in own) for k in order])
    assert automata.Automaton(["ab" * 100] * 3, of=automata.CHARACTER_OF).count[0] >= 3  # whole strings


def test_telling_terms_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    texts = [prose(rng, 30, 80) for _ in range(80)]
    for i in range(0, 60, 2):
        texts[i] = f"{texts[i]} {rng.choice(['zor', 'blax', 'quin'])} {'q' * (i % 5 == 0)}{i}z a{i % 14}@ex.org {rng.choice(['mip', 'w3x'])} {prose(rng, 5, 80)}"
    n, window, theta = len(texts), 8, 0.7
    df = Counter(w for t in texts for w in set(words_of(t)))
    near, holders = Counter(), Counter()
    for t in texts:
        spans = pii.base_spans(t)
        pairs = set()
        for kind, a, b in spans:
            left = [m for m in WORD.finditer(low(t)) if m.end() <= a][-window:]
            right = [m for m in WORD.finditer(low(t)) if m.start() >= b][:window]
            pairs |= {(t[a:b].lower(), m.group()) for m in left + right if not any(x < m.end() and m.start() < y for _, x, y in spans)}
        near.update(pairs)
        holders.update({t[a:b].lower() for _, a, b in spans})
    telling = set()
    for (entity, term), co in near.items():
        share = holders[entity] / n
        if share < 1 and math.log((co + share) / (df[term] + 1) / share) / -math.log(share) >= theta:
            telling.add(term)
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), theta=theta).collect()
    for r in out:
        t = texts[r["doc_id"]]
        spans = pii.base_spans(t)
        want = {(m.start(), m.end()) for m in WORD.finditer(low(t)) if m.group() in telling and not any(x < m.end() and m.start() < y for _, x, y in spans)}
        assert {(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "term"} == want
    assert telling


def test_plan_equals_filling_bin_after_bin():
    """Each bin: the longest pieces that fit; then its smallest gives way to the two that fill its gap most tightly."""
    rng = np.random.default_rng(15)
    for _ in range(20):
        capacity = int(rng.integers(10, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 80))).tolist()
        left, bins = Counter(lengths), []
        while left.total():
            gap, own = capacity, []
            while fit := [x for x in left if x <= gap and left[x] > 0]:
                x = max(fit)
                own.append(x)
                left[x] -= 1
                gap -= x
            room = gap + own[-1]
            pairs = [(x + y, x) for x in left if left[x] > 0 for y in left if y <= x and left[y] > (x == y) and x + y <= room] if gap else []
            if pairs and max(pairs)[0] > own[-1]:
                total = max(pairs)[0]
                left[own.pop()] += 1
                x = min(min(a, total - a) for t, a in pairs if t == total)
                for piece in (total - x, x):
                    own.append(piece)
                    left[piece] -= 1
            bins.append(own)
        _, n = packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert abs(n - len(bins)) <= 1, (capacity, sorted(lengths))


def test_archive_files_are_valid_on_disk(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>same</p>" if i % 3 else None) for i in range(40)] + [(3, "u", "other"), (None, "n", "<p>same</p>"), (5, "again", "<p>same</p>")], "page_id long, url string, html string")
    odd = pages.withColumns({c: F.lit("x") for c in ("id", "sha", "payload", "salt", "first")})
    files = warc.write_archives(odd, limit=600)
    rows = warc.read_archives(files).collect()
    names = {r["archive"] for r in rows}
    assert len(rows) == pages.count() and len(names) > 1
    for name in names:
        with open(name.removeprefix("file:"), "rb") as f:
            content = f.read()
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_MAGIC
        assert [h["warc-type"] for h, _ in warc.records(content)][0] == "warcinfo"
    same = [r for r in rows if r["payload_bytes"] == 11]
    assert {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {1} and sum(r["record_type"] == "response" for r in same) == 1


def test_models_meet_clashing_names(spark, edge, bench):  # noqa: F811
    rng = np.random.default_rng(16)
    docs = edge.unionByName(spark.createDataFrame([(100 + i, prose(rng, 60), "en" if i % 2 else "fr", "s", 1) for i in range(40)], DOC))
    odd = docs.withColumns({c: F.lit("x") for c in ("score", "spans", "base", "id", "key", "node", "rejected", "items", "n_hit", "lang_pred", "__hits", "part", "place", "digest", "lines", "found")})
    n = docs.count()
    assert langid.identify(odd, langid.learn(odd)).count() == secrets.scan(odd, secrets.learn(odd)).count() == decontaminate.scan(odd, bench).count() == n
    assert licenses.scan(odd).count() == n and packing.pack(odd).select("doc_id", "piece").count() >= n and neardup.deduplicated(odd).columns == odd.columns


@pytest.mark.parametrize("part", ["documents", "benchmark"])
def test_pipeline_over_an_empty_table(spark, tmp_path, edge, empty, bench, part):  # noqa: F811
    tables = {"documents": edge, "benchmark": bench} | ({"documents": empty} if part == "documents" else {"benchmark": bench.limit(0)})
    out = corpus_pipeline.run(spark, with_folder(spark, tmp_path, **tables))
    assert (out.count() == 0) == (part == "documents")


def test_pipeline_keeps_extra_columns(spark, tmp_path, edge, bench):  # noqa: F811
    odd = edge.withColumns({c: F.lit("x") for c in ("__text", "__key", "__kept", "rejected", "spans")})
    at = with_folder(spark, tmp_path, documents=odd, benchmark=bench)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, at).columns == odd.columns


def test_scratch_drops_what_nobody_reads(spark):
    with store.scratch(spark) as keep:
        gone, stays = store.materialise(spark.range(3), "gone"), keep(store.materialise(spark.range(3), "stays"))
    assert stays.count() == 3
    with pytest.raises(Exception, match="(?i)not|exist"):
        gone.count()


def test_crc_decides_what_is_held_out(spark):
    rows = spark.range(50).select("id", langid.remainder("id", 5).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
    assert fingerprint.K > fingerprint.S
