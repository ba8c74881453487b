"""Periodic runs, fill-in-middle and URL filters against brute force, and rows at the edges."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kelpline.llm import fim, periodic, urlfilter
from tests import oracle

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(s, exponent, least):
    """(start, length, period), each period tried at each place."""
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(exponent * q, least):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, e - a, q) for (a, e), q in found.items())


def repeated(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
    if s and rng.random() < 0.7:
        a, p = rng.randrange(len(s)), rng.randint(1, 8)
        s = s[:a] + [s[a + (i - a) % p] if a + (i - a) % p < len(s) else 0 for i in range(a, len(s) + 20)]
    return s * rng.choice([1, 1, 2, 3])


@pytest.mark.parametrize(("exponent", "least"), [(2, 2), (3, 5), (4, 6)])
def test_runs_equal_brute_force(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        s = repeated(rng)
        want = brute_runs(s, exponent, least)
        assert periodic.maximal_runs(s, exponent, least) == want
        assert periodic.runs_of([str(x) for x in s], exponent, least) == want


def test_runs_of_a_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.maximal_runs(b) == brute_runs(b, 2, 2)


def test_factors_are_longest_earlier_strings():
    rng = random.Random(3)
    for _ in range(100):
        s, at = repeated(rng), 0
        for b, f, source in periodic.factors(s):
            assert b == at
            at = f
            earlier = lambda n, b=b, s=s: any(s[i : i + n] == s[b : b + n] for i in range(b))
            if source < 0:
                assert f == b + 1 and s[b] not in s[:b]
            else:
                assert source < b and s[source : source + f - b] == s[b:f] and (f == len(s) or not earlier(f - b + 1))
        assert at == len(s)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_runs(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 4, 6)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "x " * 3000, "a\u00a0b " * 7, "é\x0bé\x0cé\ré é é", "  lead and trail  "]
    texts += [" ".join(rng.choice(["a", "b", "cc", "ü"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(60)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(4, "a a a a a a", "en", "s", 1)] * 2
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected_runs(i, t) for i, t, *_ in rows), key=str)


def test_periodic_query_over_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in periodic.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        if len(words_of(text)) < 800:
            assert got[i] == expected_runs(i, text)


def test_periodic_scan_at_the_edges(spark):
    rows = [(1, None, "r", 2), (1, "b b b b b b c", "r", None), (1, "b b b b b b c", "r", None)]
    df = spark.createDataFrame(rows, "id long, text string, Runs string, extra int")
    got = periodic.scan(df, exponent=2, least=4)
    assert got.columns == ["id", "text", "extra", "runs", "collapsed"]
    assert [(r["text"] and [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()] == [(None, ""), ([(0, 6, 1)], "b c"), ([(0, 6, 1)], "b c")]
    assert periodic.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        periodic.scan(df, exponent=1)


def expected_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100
    form = "plain" if plain else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if plain else len(p), None if plain else len(m), sha(out), sha(text))


def fim_rows():
    rng = random.Random(8)
    texts = [None, "", "\n", "\n\n\n", "no end", "a\nb", "<P>a\nb", "x<M>\ny", "<<S\n>\n<", "ä\n🐙🐙\n\r\nz", "line\n" * 4000, "<P\n>S>\n<M\n"]
    texts += ["".join(rng.choice(["a", "🐙", "\n", "<", ">", "P", "S"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc", None, None, None), (None, "d\ne", None, None, None), (5, "other\ntext\n", None, None, None)] + [(9, texts[9], "en", "s", 1)] * 3


def test_fill_in_middle_query_equals_brute_force(spark, tmp_path):
    rows = fim_rows()
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in fim.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected_fim(i, t) for i, t, *_ in rows), key=str)


def test_fill_in_middle_restores_and_keeps_columns(spark):
    df = spark.createDataFrame(fim_rows(), DOC).withColumnsRenamed({"n_chars": "N", "lang": "key_id", "source": "whole"})
    got = fim.transformed(df, rate=60, spm=30)
    assert got.columns == ["doc_id", "text", "key_id", "whole", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.select("text", "form", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(back) == df.count() and all((r["text"] or "") == r["back"] for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.transformed(df.limit(0)).count() == 0


def test_fill_in_middle_by_words(spark):
    df = spark.createDataFrame([(i, "one two  three four") for i in range(50)], "doc_id long, text string")
    got = fim.transformed(df, unit=r"\s*\S+").collect()
    assert {r["n"] for r in got} == {4} and {r["prefix_chars"] for r in got} <= {0, 3, 7, 14, 19}


RULES = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/x", "block"), ("B.a.net", "", "allow"), ("org", "/fr", "allow"), ("org", "/fr", "block"), ("x.org", "", "allow"), ("", "/e", "block"), ("long.org", "/f", "allow")]


def expected_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    top = max(fits, default=(0, 0, 0, None, default))
    return host, path, top[3], top[4]


def url_rows():
    rng = random.Random(2)
    urls = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/?q", "https://a.net?x/en/", "ftp://b.A.net/en/xyz#f", "http://ünet/", "http://.net/", "http://a.net./", "http://a.net:80/en/", "x://://net/", "http://deep.x.org/fr/"]
    part = lambda *xs: rng.choice(xs)
    for _ in range(400):
        host = ".".join(part("a", "b", "x", "net", "org", "long", "") for _ in range(rng.randint(1, 4)))
        urls.append(f"http://{host}" + part("", "/", "/en", "/en/", "/en/x", "/en/xy/z", "/fr", "/frank/", "/f", "/e", "//en/") + part("", "?a/b", "#/en/"))
    return urls + urls[:5]


@pytest.mark.parametrize("bound", [10, 0])
def test_verdicts_equal_brute_force(spark, bound):
    """By the broadcast trie and, with a bound that the entries exceed, by joins."""
    urls = url_rows()
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, Host string, salt int")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("a", "/", None)], "host string, path string, verdict string")
    got = urlfilter.judge(df, rules, broadcast_rows=bound)
    assert got.columns == ["page_id", "url", "salt", "host", "path", "rule", "verdict"]
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert rows == {i: expected_verdict(u, RULES) for i, u in enumerate(urls)}
    assert got.count() == len(urls)


@pytest.mark.parametrize("bound", [10, 0])
def test_verdicts_without_rules_or_urls(spark, bound):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r)[2:] for r in urlfilter.judge(df, rules, default="block", broadcast_rows=bound - 1).collect()] == [("a.net", "/x", None, "block")]
    assert urlfilter.judge(df.limit(0), urlfilter.fixed_rules(spark), broadcast_rows=bound).count() == 0


def test_url_query_equals_brute_force_and_sql(spark, tmp_path):
    spark.createDataFrame([(i, u, "") for i, u in enumerate(url_rows())], "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.op13_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: expected_verdict(u, urlfilter.RULES) for i, u in enumerate(url_rows())}


@pytest.mark.parametrize(("query", "sql"), [(fim.op12_fill_in_middle, fim.oracle()), (urlfilter.op13_url_filter, urlfilter.oracle())], ids=["fim", "urls"])
def test_queries_equal_sql(spark, sf_dir, query, sql):
    oracle.check(spark, oracle.connect(sf_dir), sf_dir, query, sql)


@pytest.mark.parametrize("name", [lambda k: f"doc-{k:010d}", lambda k: str(k), lambda k: "ä" * (k % 50) + str(k)])
def test_text_ids_spread_over_all_ranges_of_fingerprints(spark, name):
    """The row that follows by a text id, and ranges of like size however long the ids' common beginning."""
    from kelpline.llm import fingerprint

    n = 4000
    rows = [(name(k), f"text {k}") for k in range(n)] + [(None, "null"), ("", "empty")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    key = fingerprint._range_key(df, "doc_id")
    bounds = fingerprint._bounds(df, key, "doc_id", 16)
    sizes = [r["count"] for r in df.groupBy(fingerprint._bucket(key, bounds).alias("b")).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * n / 16
    got = {r["text"]: r["next"]["text"] for r in fingerprint.with_next(df, ["text"], id_col="doc_id", tie=F.md5("text"), enrich=lambda x: x).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_terms_that_give_entities_away_and_rare_ones_that_do_not(spark):
    """Of planted terms those that nearly always stand beside their entity are spans, whatever the entity's frequency; as rare ones
    that mostly stand elsewhere aren't."""
    from kelpline.llm import pii

    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    texts, telling, others = [prose(40) for _ in range(3000)], set(), set()
    for k in range(40):
        copies = rng.choice([2, 3, 5, 9])
        texts += [f"{prose(20)} given{k} user{k}@host{k}.org {prose(20)}" for _ in range(copies)]
        telling.add(f"given{k}")
        texts += [f"{prose(9)} rare{k} user{k}@host{k}.org"] + [f"{prose(20)} rare{k} {prose(9)}" for _ in range(5)]
        others.add(f"rare{k}")
    rng.shuffle(texts)
    out = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    terms = {texts[r["doc_id"]][x["start"] : x["end"]] for r in out for x in r["spans"] if x["kind"] == "term"}
    assert terms == telling


def test_archives_of_pages_with_text_ids(spark):
    from kelpline.llm import warc

    rows = [("b/ü 1", "http://x", "same"), ("a", "http://y", "same"), (None, None, "same"), ("", "http://z", "other"), ("None", "u", None), ("<7>", "u", "third")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages), text_ids=True).collect()}
    assert got == {("b/ü 1", 4, "revisit", "a"), ("a", 4, "response", None), (None, 4, "revisit", "a"), ("", 5, "response", None), ("None", 0, "response", None), ("<7>", 5, "response", None)}
