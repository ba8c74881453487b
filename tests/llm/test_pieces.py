"""Building blocks of the training-data operators against plain versions."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import automata, decontaminate, fm_index, langid, neardup, packing, pii, secrets, toxicity, warc, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = st.lists(st.text(alphabet="abAB é1 .\n_@世", max_size=40) | st.none(), max_size=8)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sliced(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_are_the_patterns(texts):
    want = [WORD.findall(low(t or "")) for t in texts]
    got = words.split_words(*sliced(texts))
    assert np.diff(got.first).tolist() == [len(w) for w in want]
    flat = [w.encode() for own in want for w in own]
    if flat:
        assert (words.hash_words(flat) == got.hash).all()
    for a, b, data, offsets in words.text_slices(pa.array(texts, pa.string()), 16):
        assert len(offsets) == b - a + 1 and offsets[-1] == len(data)
    rows, values = words.shingles(got, 3)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()} for w in want]
    assert [len(set(values[rows == i].tolist())) for i in range(len(texts))] == [len(s) for s in sets]


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=2), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_fm_index_finds_every_place(runs, phrases):
    text = np.array([x for r in runs for x in [*r, 0]], np.int32)
    index = fm_index.FMIndex(text, 4)
    lo, hi = index.search(np.array(phrases, np.int32))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - 1) if text[i : i + 2].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_short_items_and_nulls_in_benchmark():
    p = decontaminate.Phrases([(1, "one two"), (2, None), (3, ""), (None, "x y z")], 10)
    data, offsets = sliced(["zero one two three", None, "x y z"])
    w = words.split_words(data, offsets)
    start, which, length = decontaminate.occurrences(p, w)
    _, item = p.items_of(np.arange(len(start)), which)
    assert {(int(s), p.items[k], int(n)) for s, k, n in zip(start, item, length, strict=True)} == {(1, "1", 2), (4, "", 3)}


def test_weighted_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    value = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    a, b = slice(0, 800), slice(80, 880)
    weight = rng.uniform(0.5, 4, len(value))
    s = neardup.Sampler(1024, 7)
    (_, x), (_, y) = (s.draw(np.zeros(800, int), value[k], weight[k]) for k in (a, b))
    want = neardup.similarity((value[a], weight[a]), (value[b], weight[b]))
    assert abs(float((x == y).mean()) - want) < 0.06


def test_similarity_edges():
    none = (np.empty(0, np.uint64), np.empty(0))
    assert neardup.similarity(none, none) == 0.0
    v = (np.array([1, 5], np.uint64), np.array([1.0, 2.0]))
    assert neardup.similarity(v, v) == 1.0


def test_sketch_gives_shares():
    rng = np.random.default_rng(1)
    common, counters, n = np.uint64(12345678901), np.zeros((neardup.DEPTH, neardup.WIDTH), np.int64), 1000
    for i in range(n):
        value = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        value = np.append(value, common) if i % 2 else value
        for k, slot in enumerate(neardup._slots(value)):
            np.add.at(counters[k], slot, 1)
    idf = neardup.Sketch(counters.ravel(), n, 0.01).idf(np.array([common, 99], np.uint64))
    assert idf[0] == pytest.approx(np.log(2), abs=0.1) and idf[1] == pytest.approx(np.log(100), abs=0.3)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_without_gaps(lengths):
    counts = np.bincount(lengths, minlength=41)
    rows, n = packing.plan(counts, 40)
    seen = {}
    for size in np.flatnonzero(counts):
        own = rows[rows[:, 0] == size]
        for rank in range(counts[size]):
            _, first, seq, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            seen.setdefault(int(seq + rank - first), []).append((int(offset), int(size)))
    assert len(seen) == n and sum(map(len, seen.values())) == len(lengths)
    for pieces in seen.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= 40
    assert n <= 1.25 * sum(lengths) / 40 + 2


def test_two_replace_the_smallest():
    counts = np.zeros(101, int)
    for size in (60, 30, 25, 15):
        counts[size] += 1
    rows, _ = packing.plan(counts, 100)
    first = {int(r[0]) for r in rows if r[2] == 0}
    assert first == {60, 25, 15}  # 60 + 30 leaves 10; 25 + 15 fill the gap of 40


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, own = Tokenizer.from_file(path), packing.Encoder(path)
    small = packing.Encoder(path)
    small.KEPT = 4
    for t in ("a b c d e f", "a b g h", "a i j k l", "a b m A n o p"):  # forgets rare runs on the way
        assert [x.tolist() for x in small.encode_many([t, "a b"])] == [plain.encode(x, add_special_tokens=False).ids for x in (t, "a b")]
    assert "a" in small.known
    texts = ["", " ", "It's THE end.", "café CAFÉ İx ΣΣ", "a\x1cb <|endoftext|> c", "y" * 200 + " z", "世界 12,5", "̈a", "the end"]
    for some in (texts, texts[5:6], [], [""]):
        want = [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert [x.tolist() for x in packing.Encoder(path).encode_many(some)] == want
        assert [own.encode(t).tolist() for t in some] == want


def brute_kneser_ney(texts):
    """Interpolated Kneser-Ney of order five over lists of symbols, by dictionaries; a function (context, symbol) -> p for m = 1 ... 5."""
    from collections import Counter

    counts = [Counter() for _ in range(6)]
    for t in texts:
        s = [0] * 4 + t
        counts[5].update(tuple(s[i - 4 : i + 1]) for i in range(4, len(s)))
    for m in range(4, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    discount = [0.0] * 6
    for m in range(1, 6):
        ones, twos = (sum(c == k for c in counts[m].values()) for k in (1, 2))
        discount[m] = ones / (ones + 2 * twos) if ones and twos else 0.75

    def p(gram, vocabulary):
        if not gram:
            return 1 / (vocabulary + 1)
        own = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        below = p(gram[1:], vocabulary)
        if not own:
            return below
        total, d = sum(own.values()), discount[len(gram)]
        return max(own.get(gram, 0) - d, 0) / total + max(d * len(own) / total, 1e-6) * below

    return p


def symbols_of(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
        elif out and out[-1]:
            out.append(0)
    return out


def test_kneser_ney_equals_a_plain_version():
    texts = {"x": ["abcab cabba abc", "cab abc", "abba", "cccab a", "held"], "y": ["zzyx yxz zyx", "xyz", "zx", "yy zy", "xx"], "z": ["世界 人世", "界", "人人", "世世界", "人"]}
    m = langid.Models(texts)
    trained = {k: [symbols_of(t) for t in v if v.index(t) % 5 != 4] for k, v in texts.items()}
    vocabulary = len({c for own in trained.values() for t in own for c in t})
    probes = ["abc zy", "cabba", "zzz", "qq ab", "世人 abc"]
    ce, _, _ = m.cross_entropies(*sliced(probes))
    for k, lang in enumerate(m.languages):
        p = brute_kneser_ney(trained[lang])
        for i, t in enumerate(probes):
            s = [0] * 4 + symbols_of(t)
            want = -np.mean([np.log(p(tuple(s[j - 4 : j + 1]), vocabulary)) for j in range(4, len(s))])
            assert ce[i, k] == pytest.approx(want, rel=1e-4), (lang, t)
    lang, score, _, rejected = m.predict(*sliced(["abc abc", "zyx", "", "123"]))
    assert lang == ["x", "y", "und", "und"] and score[2] == 0 and rejected.tolist()[2:] == [True, True] and not rejected[0]


def test_foreign_and_random_texts_are_rejected():
    rng = np.random.default_rng(3)

    def prose(letters, n):
        words = ["".join(rng.choice(list(letters), 5)) for _ in range(40)]
        return [" ".join(rng.choice(words, 60)) for _ in range(n)]

    m = langid.Models({"x": prose("abcdefgh", 60), "y": prose("efghijkl", 60)})
    other = prose("가나다라마", 20) + prose("mnopqrst", 20)
    assert all(m.predict(*sliced(other))[3])
    rng = np.random.default_rng(3)
    assert not any(m.predict(*sliced(prose("abcdefgh", 60)))[3])


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")


@given(st.text(alphabet="ab@.-1 2+%", max_size=60))
@settings(max_examples=400, deadline=None)
def test_linear_patterns_equal_the_contracts(text):
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]
    assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in IP.finditer(text)]
    assert [m.span() for m in pii._CARD.finditer(text)] == [m.span() for m in CARD.finditer(text)]


def test_personal_spans():
    text = "x a.b@c.de 1.2.3.4 no 999.1.1.1 no 4111 1111 1111 1111 no +1 (826) 555-7388 no 4111111111111112"
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    assert pii.base_spans("") == []


def test_secret_spans():
    text = 'Api_Key = "abcdefghijkl" token: short AKIA' + "A" * 14 + " " + "0af" * 6 + " AKIAX"
    assert [k for k, _, _ in secrets.base_spans(text)] == ["assign", "access", "hex"]
    assert secrets.base_spans("") == []


def test_merged_states_accept_the_format():
    a = automata.Automaton(["0123456789abcdef" * 2, "fedcba9876543210", "00ff00ff00ff00ff00"])
    hexes, prose = automata.padded(["deadbeef01234567"]), automata.padded(["thequickbrownfox"])
    assert automata.log_likelihoods([a], *hexes[1:])[0] > automata.log_likelihoods([a], *prose[1:])[0]
    assert len(a.states) < 40


def brute_neighbours(index, w):
    dense = np.zeros((len(index.idf), index.n), np.float32)
    for term in range(len(index.idf)):
        for pair in range(index.first[term], index.first[term + 1]):
            for at in range(index.pair_at[pair], index.pair_at[pair + 1]):
                dense[term, index.example[at]] = index.value[at]
    s = w @ dense
    order = np.sort(s[s > 0])[::-1]
    least = order[min(index.k, len(order)) - 1] if len(order) else 1
    return {i for i in range(index.n) if s[i] > 0 and s[i] >= least - 1e-6}


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    n, t = 500, 40
    dense = rng.random((n, t)) < 0.08
    rows, terms = np.nonzero(dense)
    index = toxicity.Neighbours(rows, terms, rng.integers(1, 4, len(rows)), n, rng.uniform(1, 5, t), rng.integers(0, 2, n), list(range(n)), (1.0, 1.0), 10)
    for _ in range(30):
        q = np.flatnonzero(rng.random(t) < 0.1)
        if len(q):
            w = np.zeros(t, np.float32)
            w[q] = rng.random(len(q))
            w /= np.linalg.norm(w)
            assert set(index.search(q, w[q])[0].tolist()) == brute_neighbours(index, w)


def test_texts_are_searched_together_and_exactly(monkeypatch):
    rng = np.random.default_rng(6)
    n, t, calls = 700, 120, []
    dense = rng.random((n, t)) < rng.uniform(0.005, 0.4, t)  # frequent and rare terms
    dense[:300] = dense[0]  # ties
    rows, terms = np.nonzero(dense)
    ranges = toxicity.Neighbours._ranges
    monkeypatch.setattr(toxicity.Neighbours, "_ranges", staticmethod(lambda *a: calls.append(1) or ranges(*a)))
    index = toxicity.Neighbours(rows, terms, rng.integers(1, 4, len(rows)), n, rng.uniform(1, 5, t), rng.integers(0, 2, n), list(range(n)), (1.0, 1.0), 10)
    assert len(calls) < n / 4  # leave-one-out votes: a search a text called it twice a text or more
    texts = []
    for i in range(300):
        q = np.flatnonzero(dense[rng.integers(n)] if i % 2 else rng.random(t) < 0.1)
        w = rng.random(len(q)).astype(np.float32) + np.float32(0.1)
        texts.append((q, w / np.sqrt((w**2).sum())))
    calls.clear()
    cut, q, w = np.cumsum([0, *(len(x[0]) for x in texts)]), np.concatenate([x[0] for x in texts]), np.concatenate([x[1] for x in texts])
    together = list(index.search_all(cut, q, w))
    assert len(calls) < len(texts) / 4
    for (q, w), (at, sims) in zip(texts, together, strict=True):
        alone = index.search(q, w)
        assert np.array_equal(alone[0], at) and np.array_equal(alone[1], sims)  # whatever stands beside a text
        full = np.zeros(t, np.float32)
        full[q] = w
        assert set(at.tolist()) == brute_neighbours(index, full)
        if len(at):
            assert at[0] not in index.search(q, w, without=int(at[0]))[0]


def test_archives_reject_faults():
    d = warc.train_dictionary([b"<html>" + bytes([i]) * 50 for i in range(5)], 1024)
    w = warc.Writer(d, 3, 1 << 20)
    w.add(warc.page_record(1, "http://a/\r\nx", b"hello" * 30, None, "2024-01-01T00:00:00Z"))
    w.add(warc.page_record(2, None, b"", 1, "2024-01-01T00:00:00Z"))
    content = w.close()
    pages = [warc.page_of(h, b) for h, b in warc.records(content)]
    assert [p[0] for p in pages] == [1, 2] and pages[1][4] == 1 and pages[0][1] == 150
    with pytest.raises((warc.ArchiveError, zstandard.ZstdError)):
        list(warc.records(content[:-3]))
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(b"\x00" * 20))
    with pytest.raises(warc.ArchiveError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n")
    bad = warc.page_record(1, "u", b"abc", None, "d").replace(b"abc\r\n\r\n", b"abd\r\n\r\n")
    with pytest.raises(warc.ArchiveError):
        warc.page_of(*warc.parse(bad))


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 0], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\0\0\0\0")
