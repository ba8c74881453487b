"""The ten operators and the pipeline: contracts against brute force, planted cases, and edge rows."""

import base64
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kelpline.llm import components, decontaminate, fingerprint, langid, licenses, neardup, packing, pii, registry, secrets, toxicity, warc
from tests import oracle

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(rng, n, vocabulary=600):
    return " ".join(f"w{int(i)}x" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    rng = np.random.default_rng(0)
    a = prose(rng, 80)
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "   \n", "en", "s", 4), (4, a, "en", "s", len(a)), (4, a, "en", "s", len(a)), (5, a, "en", "s", len(a)), (None, a + " more", None, "s", 1), (6, prose(rng, 30_000), "fr", "s", 9), (7, "!!! 123 \U0001f600", "fr", "s", 9), (8, "one", "en", "s", 3)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None), (3, "three word item")], "item_id long, text string")


def with_folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- 1


def test_toxicity_learns_and_leaves_clean_ones(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 60) + (" vile nasty rotten " if bad else " ") + prose(rng, 20), "en", "s", 1))
        if i < 500:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    at = with_folder(spark, tmp_path, documents=spark.createDataFrame(rows, DOC), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, at).collect()}
    assert len(out) == 602
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in range(500, 600)]) > 0.95
    assert 0 <= out[1000]["score"] < 0.5 and out[1000]["score"] == out[1001]["score"]


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(none, edge) == 0.0
    assert toxicity.score(edge, 0.0).count() == edge.count()


# --- 2


def brute_classes(texts, size=5, threshold=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if (texts[i] or "") == (texts[j] or "") or u and len(sets[i] & sets[j]) / u >= threshold:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [prose(rng, 120) for _ in range(60)]
    for i in range(40):  # near copies, far from the threshold on either side
        w = texts[i].split()
        for k in range(2 if i % 2 else 25):
            w[(k * 41 + 7) % len(w)] = f"new{i}_{k}"
        texts.append(" ".join(w))
    texts += texts[:10] + [None, "", "one two", "one two", "one three"]
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r["class_id"] for r in out.orderBy("doc_id").collect()]
    assert same_partition(got, brute_classes(texts))


def test_near_duplicates_of_an_absent_original(spark):
    rng = np.random.default_rng(22)
    texts = [prose(rng, 200) for _ in range(310)]
    first = prose(rng, 200).split()
    for i in range(300):  # a text is similar to the few that share two of its three places, and all hold together
        w = list(first)
        for k in rng.choice(40, 3, replace=False):
            w[k * 5] = f"new{i}_{k}"
        texts.append(" ".join(w))
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), floor=0.5)  # equal weights
    got = [r["class_id"] for r in out.orderBy("doc_id").collect()]
    want = brute_classes(texts)
    assert len(set(want)) < 340
    assert same_partition(got, want)


def test_a_group_of_a_third_of_the_rows_keeps_its_links(spark):
    rng = np.random.default_rng(24)
    texts = [prose(rng, 200) for _ in range(201)]
    for i in range(100):
        w = texts[0].split()
        for k in (3 + i % 90, 100 + (i * 7) % 90):
            w[k] = f"new{i}_{k}"
        texts.append(" ".join(w))
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r["class_id"] for r in out.orderBy("doc_id").collect()]
    assert same_partition(got, brute_classes(texts))


@pytest.mark.parametrize("block", [1, 3, 256])
def test_every_pair_of_different_classes_is_compared(spark, block):
    rng = np.random.default_rng(23)
    base = prose(rng, 60).split()
    texts = []
    for i in range(24):  # text i and i + 1 are similar
        base = base[:-3] + [f"n{i}a", f"n{i}b", f"n{i}c"] if i % 2 else [f"m{i}"] + base[1:]
        texts.append(" ".join(base) if i < 20 else prose(rng, 60))
    sk = neardup.Sketch(np.zeros(neardup.DEPTH * neardup.WIDTH, np.int64), 100, 0.01)
    have = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "node long, text string, length int")
    placed = spark.createDataFrame([(7, i, 0 if i % 3 == 0 else i) for i in range(24)], "band long, node long, comp long")
    links = [(r.u, r.v) for r in neardup.cross_class_links(placed, have, sk, 5, 0.8, block=block).collect()]
    classes = {r.node: r.comp for r in components.components(spark.createDataFrame(links + [(0, i) for i in range(3, 24, 3)], "u long, v long")).collect()}
    want = brute_classes(texts)
    for i in range(0, 24, 3):  # of one class from the start
        want = [want[0] if w == want[i] else w for w in want]
    assert same_partition([classes.get(i, i) for i in range(24)], want)


def test_near_duplicates_at_edges(spark, edge, empty):
    out = neardup.near_duplicates(edge)
    assert out.count() == edge.count()
    assert neardup.deduplicated(edge).columns == edge.columns
    kept = neardup.deduplicated(edge).collect()
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and not any(r["doc_id"] in (5, None) for r in kept)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[100 + i] for i in range(30)}) == 1 and got[0] != got[100]


# --- 3


def brute_hits(text, items):
    w = WORD.findall(low(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(low(t or ""))
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if v else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, tmp_path, edge, bench):
    items = [tuple(r) for r in bench.collect()]
    planted = "So: ALPHA, beta gamma delta epsilon zeta eta theta iota kappa LAMBDA mu three word item three-word item"
    docs = edge.unionByName(spark.createDataFrame([(20, planted, "en", "s", 1), (21, planted.replace("zeta", "zzz"), "en", "s", 1)], DOC))
    at = with_folder(spark, tmp_path, documents=docs, benchmark=bench)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((str(i), n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, t in texts for n, h, f in [brute_hits(t, items)])
    got = sorted((str(r["doc_id"]), *list(r)[1:6]) for r in decontaminate.op3_decontaminate(spark, at).collect())
    assert got == want
    found = decontaminate.scan(docs, bench).where("doc_id = 20").withColumn("clean", decontaminate.without_spans(F.col("text"), F.col("spans"))).first()
    assert found["clean"] == "So:  mu "


def test_a_benchmark_of_many_parts_is_united(spark, bench):
    rng = np.random.default_rng(31)
    items = [(i, prose(rng, int(n), 12)) for i, n in enumerate(rng.integers(0, 25, 30))]
    texts = [prose(rng, int(n), 12) for n in rng.integers(0, 200, 25)] + [" ".join(t for _, t in items), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("x"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for part_bytes in (1, 150, 1 << 20):
        out = decontaminate.scan(docs, benchmark, part_bytes=part_bytes)
        assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in out.collect()} == want


def test_decontamination_of_nothing(spark, empty, edge, bench):
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(edge, bench.limit(0)).where("n_hit > 0").count() == 0


# --- 4


def test_secrets(spark, tmp_path, edge):
    rng = np.random.default_rng(3)
    token = "ghp_" + "".join(rng.choice(list("abcdefABCDEFXYZ0123456789"), 36))
    long_words = " ".join("".join(rng.choice(list("aeiounrst"), 14)) for _ in range(60))
    docs = edge.unionByName(spark.createDataFrame([(30, f'password = "{token}" and {"0a" * 10}', "en", "s", 1), (31, f"see {token} there", "en", "s", 1), (32, long_words, "en", "s", 1)], DOC))
    at = with_folder(spark, tmp_path, documents=docs)
    out = {r["doc_id"]: r for r in secrets.op4_secrets(spark, at).collect()}
    assert (out[30]["n_assign"], out[30]["n_hex"], out[30]["n_access"]) == (1, 1, 0)
    assert out[31]["spans"] == f"format:4:{4 + len(token)}" and out[32]["spans"] == "" and out[1]["spans"] == ""
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_secrets_of_nothing(spark, empty):
    assert secrets.learn(empty) is None and secrets.scan(empty, None).count() == 0


# --- 5


def brute_anchors(text):
    """Closed syncmers of a text with its margins, one k-mer after the other: (place, hash)."""
    import xxhash

    k, s, out = fingerprint.K, fingerprint.S, []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = lambda x: signed(xxhash.xxh64(x.encode("utf-32-be"), seed=42).intdigest())
    t = "\uffff" * (k - 1) + text + "\uffff" * (k - 1) if text else ""
    for i in range(len(t) - k + 1):
        inner = [h(t[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(t[i : i + k]) & 0xFFFFFFFF))
    return out


def test_fingerprints_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    letters = lambda n, of="ab é世🎉\n": "".join(rng.choice(list(of), n))
    texts = ["", None, "a", "abc", "abcd", letters(9_000, "abcdefgh "), *[letters(int(n)) for n in rng.integers(0, 120, 30)], prose(rng, 150), "hé 世界 x"]
    texts.append(texts[5])
    docs = spark.createDataFrame([(3 * i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC).withColumns({c: F.lit("x") for c in ("own", "next", "changed", "head", "__key")})
    out = fingerprint.op5_fingerprints(spark, with_folder(spark, tmp_path, documents=docs)).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    shown = lambda t: "".join(f"{h:08X}" for _, h in brute_anchors(t))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(out) == len(texts)
    for i, (r, t) in enumerate(zip(out, plain, strict=True)):
        q, following = len(t) // 4, plain[(i + 1) % len(plain)]
        edited = t[: len(t) - q] + following[:q]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == shown(t) and r["edited_fingerprint"] == shown(edited), i
        sets = [{h for _, h in brute_anchors(x)} for x in (t, edited, following)]
        assert r["near_edited"] == pytest.approx(jaccard(sets[0], sets[1])) and r["near_next"] == pytest.approx(jaccard(sets[0], sets[2]))
    assert out[5]["fingerprint"] == out[-1]["fingerprint"]


def test_fingerprints_at_edges(spark, tmp_path, edge, empty):
    out = fingerprint.op5_fingerprints(spark, with_folder(spark, tmp_path, documents=edge)).collect()
    assert len(out) == edge.count() and len({r["fingerprint"] for r in out if r["doc_id"] in (4, 5)}) == 1
    assert fingerprint.op5_fingerprints(spark, with_folder(spark, tmp_path / "none", documents=empty)).count() == 0
    named = spark.createDataFrame([("b", "x" * 30), ("a", "y" * 30), ("c", "z" * 30)], "doc_id string, text string")  # ids that aren't numbers
    rows = fingerprint.with_next(named, ["doc_id"], id_col="doc_id", tie=F.md5("text"), enrich=lambda d: d).collect()
    assert {r["doc_id"]: r["next"]["doc_id"] for r in rows} == {"a": "b", "b": "c", "c": "a"}


def test_anchors_are_the_same_wherever_a_passage_stands(spark):
    rng = np.random.default_rng(44)
    passage = prose(rng, 40)
    rows = spark.createDataFrame([(1, passage), (2, prose(rng, 9) + passage)], "doc_id long, text string")
    found = {}
    for r in fingerprint.anchors(rows).collect():
        found.setdefault(r["doc_id"], {})[r["place"]] = r["hash"]
    shift = len(rows.where("doc_id = 2").first()["text"]) - len(passage)
    inside = {p: h for p, h in found[1].items() if 0 <= p <= len(passage) - fingerprint.K}
    assert inside and all(found[2][p + shift] == h for p, h in inside.items())


# --- 6


def test_personal_data_and_telling_terms(spark, tmp_path, edge):
    rng = np.random.default_rng(5)
    rows = [(100 + i, f"{prose(rng, 30)} zorblax owns jo@ex.org today {prose(rng, 30)}", "en", "s", 1) for i in range(4)]
    rows += [(200 + i, prose(rng, 60), "en", "s", 1) for i in range(40)]
    docs = edge.unionByName(spark.createDataFrame(rows, DOC))
    at = with_folder(spark, tmp_path, documents=docs)
    out = {r["doc_id"]: r for r in pii.op6_pii(spark, at).collect()}
    texts = dict((r[0], r[1]) for r in rows)
    for i in range(100, 104):
        assert out[i]["n_email"] == 1
        terms = {texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in out[i]["spans"].split(",") if s.startswith("term")}
        assert {"zorblax", "owns", "today"} <= terms
    assert all(out[i]["spans"] == "" for i in range(200, 240)) and out[1]["spans"] == ""
    clean = pii.find(docs).join(docs.select("doc_id", "text"), "doc_id").where("doc_id = 100").select(pii.sanitised(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert "jo@ex.org" not in clean and "zorblax" not in clean and "[PRIVATE]" in clean


def test_terms_of_an_entity_of_one_document(spark):
    rng = np.random.default_rng(55)
    texts = [prose(rng, 60) for _ in range(60)]
    texts += [f"\U0001f600 é {prose(rng, 20)} qz owns jo@ex.org with zorblax {prose(rng, 20)}", "owns with " + prose(rng, 20)] + [f"owns with {prose(rng, 9)}"] * 3
    # a co-occurrence in four documents, and the term once more where the entity isn't
    texts += [f"{prose(rng, 20)} grumbik al@ex.org {prose(rng, 20)}" for _ in range(4)] + [f"é {prose(rng, 20)} grumbik"]
    texts += texts[:60] * 20  # common words are common
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    terms = {r["doc_id"]: {texts[r["doc_id"]][x["start"] : x["end"]] for x in r["spans"] if x["kind"] == "term"} for r in out.collect()}
    assert {"qz", "zorblax"} <= terms[60] and not {"owns", "with", "jo", "ex", "org"} & terms[60]
    assert "grumbik" in terms[65] and terms[69] == {"grumbik"}
    assert not any(terms[i] for i in range(60))


def test_personal_data_of_nothing(spark, empty):
    assert pii.find(empty).count() == 0


# --- 7


def test_packing(spark, tmp_path, edge):
    from tokenizers import Tokenizer

    at = with_folder(spark, tmp_path, documents=edge)
    out = packing.op7_best_fit_packing(spark, at).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in edge.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(r["doc_id"]), k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at_ = 0
        for offset, length in sorted(own):
            assert offset == at_
            at_ += length
        assert at_ <= 2048
    whole = packing.sequences(packing.pack(edge, keep_ids=True)).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in out)


def test_packing_nothing(spark, empty):
    assert packing.pack(empty).count() == 0


# --- 8


def test_language(spark, tmp_path, edge):
    rng = np.random.default_rng(6)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(40))
    rows = [(1000 + i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", "s", 1) for i in range(120)]
    docs = edge.drop("lang").withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame(rows, DOC))
    at = with_folder(spark, tmp_path, documents=docs)
    out = {r["doc_id"]: r for r in langid.op8_language_id(spark, at).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in held]) == 1.0 and not any(out[r[0]]["rejected"] for r in held)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert out[held[0][0]]["held_out"]


def test_language_without_labels(spark, empty, edge):
    assert langid.learn(empty) is None
    assert {r["lang_pred"] for r in langid.identify(edge, None).collect()} == {"und"}


# --- 9


@pytest.mark.parametrize("name", ["op3_decontaminate", "op9_licenses", "op10_warc"])
def test_equals_sql(spark, sf_dir, name):
    oracle.check(spark, oracle.connect(sf_dir), sf_dir, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name,file", [("Apache-2.0", "Apache-2.0"), ("GPL-1.0", "GPL-1"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("Artistic-1.0-Perl", "Artistic"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("BSD-3-Clause", "BSD")])
def test_full_licenses(spark, name, file):
    at = Path("/usr/share/common-licenses", file)
    if not at.exists():
        pytest.skip(f"no {at}")
    text = at.read_text()
    texts = [text, text.upper(), text.replace("\n", "\n\n  "), text.split("END OF TERMS AND CONDITIONS")[0], text + "\nand more"]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = [name] * 4 + [None]
    assert [r["license_id"] for r in out] == want


def test_license_variants(spark, edge):
    mit = "MIT LICENSE\n\nCopyright (c) 2020 A. Person\n\n" + licenses._MIT.replace("sublicense", "sub-license").replace(" ", "  ")
    docs = spark.createDataFrame([(1, mit), (2, "text\n  released under the mit licence!\nmore"), (3, None), (4, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert out[1]["license_id"] == "MIT" and out[2]["license_id"] is None and out[2]["notice_ids"] == "MIT"
    assert out[3]["n_notices"] == 0 and out[3]["text_sha256"] == out[4]["text_sha256"]
    assert licenses.scan(edge).count() == edge.count()


# --- 10


def test_archives_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>é世</p>" * 50, None, "", "<p>a</p>", "x" * 100_000, "<p>a</p>"]
    pages = spark.createDataFrame([(10 - i, None if i == 1 else f"http://h/{i}", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.op10_warc(spark, with_folder(spark, tmp_path, pages=pages)).collect()}
    first = {}
    for r in sorted(pages.collect()):
        body = (r["html"] or "").encode()
        head = first.setdefault(body, r["page_id"])
        got = out[r["page_id"]]
        assert got["payload_bytes"] == len(body) and got["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got["record_type"], got["refers_to"]) == (("response", None) if head == r["page_id"] else ("revisit", head))
    assert len(out) == len(html)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# --- pipeline


def test_pipeline_stages_take_effect_and_keep_clean_documents(spark, tmp_path, edge, bench):
    rng = np.random.default_rng(7)
    clean = [(100 + i, prose(rng, 60), "en", "s", 1) for i in range(30)]
    planted = [(200, clean[0][1] + " tail", "en", "s", 1), (201, prose(rng, 30) + " alpha beta gamma delta epsilon zeta eta theta iota kappa lambda " + prose(rng, 30), "en", "s", 1), (202, prose(rng, 40) + " token = abcdef123456XYZ", "en", "s", 1)]
    docs = edge.unionByName(spark.createDataFrame(clean + planted, DOC))
    at = with_folder(spark, tmp_path, documents=docs, benchmark=bench)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    kept = stages["language_id"](spark, docs, at)
    assert {r["doc_id"] for r in kept.collect()} >= {r[0] for r in clean} and kept.where("doc_id IN (1, 2, 3, 7)").isEmpty()
    deduped = stages["near_dedup"](spark, kept, at)
    ids = {r["doc_id"] for r in deduped.collect()}
    assert 200 not in ids and ids >= {r[0] for r in clean}
    cut = stages["decontamination"](spark, deduped, at)
    row = cut.where("doc_id = 201").first()
    assert "alpha" not in row["text"] and row["n_chars"] == len(row["text"])
    safe = stages["secret_scan"](spark, cut, at)
    assert "abcdef123456XYZ" not in safe.where("doc_id = 202").first()["text"]
    for df in (kept, deduped, cut, safe):
        assert df.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, at).collect()} == ids


def test_extra_columns_with_clashing_names(spark, edge, bench):
    odd = edge.withColumns({c: F.lit("x") for c in ("score", "spans", "base", "id", "key", "node", "rejected", "items", "n_hit", "evidence")})
    assert langid.identify(odd, None).count() == decontaminate.scan(odd, bench).count() == secrets.scan(odd, None).count() == toxicity.score(odd, 0.5).count() == edge.count()
    assert neardup.near_duplicates(odd).count() == pii.find(odd).count() == edge.count()


def test_registry_names_one_query_an_operator():
    names = set(registry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)} and "pipeline" in names
