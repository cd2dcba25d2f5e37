"""Vector codes, license spans and source divergence against brute force, and on nulls, empty
and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, licences, orchard, transducer

# --- vector codes -------------------------------------------------------------


def brute_codes(rows, rounds=4):
    """(vec_id, code, error, label_error) of (vec_id, vector, label), and the codebooks' digest."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    parts = [[(v + [0] * (4 * width - len(v)))[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(v) for v in part[:256]] for part in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book)) for v in part]
                for part, book in zip(parts, books, strict=True)]

    for _ in range(rounds):
        for part, book, found in zip(parts, books, assign(), strict=True):
            for i in range(len(book)):
                own = [v for v, (_, at) in zip(part, found, strict=True) if at == i]
                if own:
                    book[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, totals = assign(), Counter()
    out = []
    for n, (i, _, label) in enumerate(kept):
        error = sum(found[p][n][0] for p in range(4))
        totals[label] += error
        out.append((i, "".join(f"{found[p][n][1]:02x}" for p in range(4)), error, label))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, totals[label]) for i, c, e, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def got_codes(df):
    rows = orchard.compress(df).collect()
    assert len({r.codebooks_sha256 for r in rows}) <= 1
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str), rows[0].codebooks_sha256 if rows else None


VECTORS = "vec_id long, embedding array<float>, label int, data string"  # ``data`` clashes with a name used inside


def test_codes_of_random_vectors_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice((rnd.gauss(0, 0.3), 0.25)) for _ in range(8)], rnd.choice((None, 1, 2))) for i in range(330)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)
    assert got_codes(df) == brute_codes(rows)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5, -0.25, 1.0, 0.0], 1), (3, [0.5, -0.25, 1.0, 0.0], 1), (3, [0.5, -0.25, 1.0, 0.0], 1), (3, [0.25, 0.0, -1.0, 2.0], None),
        (None, [0.0, 0.0, 0.0, 0.0], None), (1, None, 1), (2, [nan, 0.0, 0.0, 0.0], 2), (4, [0.0, inf, 0.0, 0.0], 2),
        (6, [0.0, None, 0.0, 0.0], 2), (7, [], 2), (8, [1.0, 2.0, 3.0, 4.0, 5.0], 2), (9, [-0.0001] * 4, 3),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    assert got_codes(df) == brute_codes(rows)
    assert got_codes(df.where("1 = 0")) == ([], None)


def test_too_large_components_stop_the_job(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        orchard.compress(spark.createDataFrame([(1, [1e30] * 4, 1, "x")], VECTORS)).collect()


def test_orchard_search_is_exact_with_ties_and_visits_less_than_all():
    rng = np.random.default_rng(5)
    for n, reach in ((256, 2), (7, 1), (1, 3), (256, 400)):
        entries, points = rng.integers(-reach, reach + 1, (n, 4)), rng.integers(-reach, reach + 1, (500, 4))
        at, distance = orchard.Orchard(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_codes_stand_for_near_vectors():
    books = np.arange(4 * 3 * 2).reshape(4, 3, 2) * 1024
    assert orchard.reconstruct("00010200", books).tolist()[:4] == pytest.approx([0, 1, 8, 9], abs=0.001)


# --- license spans ------------------------------------------------------------


def brute_scan(text, phrases=licences.PHRASES, templates=licences.TEMPLATES):
    """(n_words, n_base, first, last, base labels, labels, score) by comparing runs of words."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    places, base = [], set()
    for label, phrase in phrases:
        p = phrase.encode().split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    texts = [t.encode().split() for _, t in templates]
    grams = defaultdict(list)
    for n, t in enumerate([p.encode().split() for _, p in phrases] + texts):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                grams[tuple(t[i:j])].append((n - len(phrases), i))
    longest = []
    for i in range(len(words)):
        longest.append(max((k for k in range(1, i + 2) if tuple(words[i + 1 - k : i + 1]) in grams), default=0))
    matches = []
    for i, k in enumerate(longest):
        if k >= licences.LONG and (i + 1 == len(words) or longest[i + 1] <= k):
            matches += [(n, i + 1 - k, k, at) for n, at in grams[tuple(words[i + 1 - k : i + 1])] if n >= 0]
    labels, score = set(base), 1.0 if base else 0.0
    for n, t in enumerate(texts):
        own = sorted((f, k, at) for m, f, k, at in matches if m == n)
        best, reach, chains = [], -1, []
        for f, k, at in own:
            if f > reach + licences.GAP:
                chains = []
            before = max((c for c, end, place in chains if end < f and place <= at), default=0)
            chains.append((before + k, f + k - 1, at + k))
            reach = max(reach, f + k - 1)
            best.append(before + k)
        share = min(1.0, max(best, default=0) / len(t))
        if share >= licences.COVER:
            labels.add(templates[n][0])
            score = max(score, share)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def got_scan(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in licences.scan(df).collect()]


def test_license_spans_of_damaged_notices_equal_brute_force(spark):
    rnd, texts = random.Random(8), []
    pool = [t.split() for _, t in licences.TEMPLATES]
    for _ in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            piece = list(rnd.choice(pool))
            for _ in range(rnd.randint(0, 5)):
                at = rnd.randrange(len(piece))
                piece[at : at + rnd.randint(0, 2)] = rnd.choice(([], ["xx"], ["License", "été"], rnd.choice(pool)[:3]))
                piece = piece or ["the"]
            words += piece[rnd.choice((0, 0, 5)) :] + ["filler"] * rnd.choice((0, 1, 20))
        texts.append(rnd.choice((" ", "\n", ", ", "--")).join(w.title() if rnd.random() < 0.2 else w for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dict(got_scan(df)) == {i: brute_scan(t) for i, t in enumerate(texts)}


def test_license_spans_of_odd_rows(spark):
    notice = " ".join(licences.TEMPLATES[2][1].split())
    long = "w0 mit " * 40_000 + notice.upper() + " mit license" * 3
    texts = [None, "", " .,- ", "MIT License", "mit", "license mit\nLicense", "the mit-license, MIT LICENSE", notice, notice, long,
             "Licensed under CC BY-NC 4.0.", "mitlicense", "général public license gnu general public license", "mit", "license", "é mit license é"]
    rows = [(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert sorted(map(str, got_scan(df))) == sorted(str((r[0], brute_scan(r[1]) if r[1] != long else (80_000 + len(notice.split()) + 6, 3, 80_000 + len(notice.split()), 80_004 + len(notice.split()), "mit", "mit", 1.0))) for r in rows)
    assert got_scan(df.where("1 = 0")) == []


def test_spans_name_their_words(spark):
    notice = " ".join(licences.TEMPLATES[3][1].split())
    row = licences.scan(spark.createDataFrame([(1, "a b " + notice + " c")], "doc_id long, text string")).collect()[0]
    assert [(s.label, s.first_word, s.last_word, s.covered) for s in row.spans] == [("isc", 2, 1 + len(notice.split()), 1.0)]


def test_documents_without_notices_have_no_labels(spark):
    texts = ["use of this software for any purpose", "the license is in the software and the copyright notice is in the file", "free of charge to any person"]
    got = got_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert all(r[1][4:] == ("", "", 0.0) for r in got)


# --- source divergence --------------------------------------------------------


def test_transducer_numbers_terms_in_byte_order():
    rnd = random.Random(2)
    for _ in range(60):
        terms = sorted({bytes(rnd.choice(b"ab\xc3\xa9z") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 120))})
        made = transducer.Transducer(transducer.build(terms))
        assert made.terms() == terms and made.size == len(terms)
        asked = [*terms, b"", b"q", b"abz" * 400, *(t + b"a" for t in terms), *(t[:-1] for t in terms)]
        assert made.ordinals(pa.array(asked, pa.binary())).tolist() == [terms.index(a) if a in terms else -1 for a in asked]


def test_transducer_shares_equal_endings():
    made = transducer.Transducer(transducer.build([a + b for a in (b"co", b"lo", b"mo") for b in (b"", b"re", b"res")]))
    assert len(made.final) == 6  # the root, one for the three first letters, and one path


def brute_audit(rows):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    docs = [(lang, source, re.findall("[A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = {t for t, n in df.items() if n >= 3}
        counts = {s: Counter(t for _, source, ts in own if source == s for t in ts if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def p(c, t, v=len(kept)):
            return 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v)

        def f(a, b):
            return (a - b) ** 2 // b

        for s, c in counts.items():
            pairs = [(o, sum(f(p(c, t), p(other, t)) for t in kept)) for o, other in counts.items() if o != s]
            terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def got_audit(df, **sizes):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.audit(df, **sizes).collect())


AUDITED = "text string, lang string, source string, ordinal string"  # ``ordinal`` clashes with a name used inside


def test_divergence_over_several_shards_blocks_and_ranges(spark):
    rnd = random.Random(4)
    terms = ["".join(rnd.choice("abcé漢") for _ in range(rnd.randint(1, 4))) for _ in range(90)]
    rows = []
    for _ in range(240):
        words = [rnd.choice(terms[: rnd.choice((5, 40, 90))]) for _ in range(rnd.randint(0, 40))]
        text = rnd.choice((" ", "1", "\n")).join(w.upper() if rnd.random() < 0.3 else w for w in words)
        rows.append((text, rnd.choice(("en", "de", None)), rnd.choice(("s1", "s2", "s3", "s1", None))))
    df = spark.createDataFrame([(*r, "x") for r in rows], AUDITED).repartition(4)
    assert got_audit(df) == brute_audit(rows)
    assert got_audit(df, block=2000, shard=7, span=5) == brute_audit(rows)


def test_divergence_of_odd_rows(spark):
    long = "tail " + "x" * 200_000 + " tail"
    rows = [(None, None, None), ("", "en", "a"), ("a a b", "en", "a"), ("a b", "en", "a"), ("A b c", "en", "b"), ("É é é", "fr", "a"),
            ("é É", "fr", "b"), ("É", "fr", "b"), ("é", "fr", "b"), (long, "en", "c"), (long, "en", "c"), (long, "en", "c"), ("only here", "xx", "a"), ("1 2 3", "xx", "b"),
            ("a\x00b", "en", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], AUDITED)
    assert got_audit(df) == brute_audit(rows)
    assert got_audit(df.where("1 = 0")) == []


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 2**52, 200)
    count = (total * rng.random(200)).astype(np.int64)
    expect = [1 + 1_000_000_000 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
    assert divergence.share(count, total).tolist() == expect
