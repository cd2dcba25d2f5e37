"""Each operator against brute force, an exact round trip or held-out accuracy, and on
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import archive, automata, backtrack, cascade, components, crossent, curves, kernel, ledger, pivotal, prefixes
from tidemark.llm.catalog import vocabulary
from tidemark.llm.text import scratch

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = " ".join(f"b{i}" for i in range(60))
ODD = [
    (1, BASE, "a", 1), (2, BASE, "a", 2), (2, BASE, "a", 2), (3, None, None, 3), (4, "", "b", 4),
    (5, " \t\n", "b", 5), (6, "Two words", "b", 6), (7, "two WORDS", None, 7), (8, LONG, "a", 8),
    (9, BASE.replace("b30", "x"), "c", 9), (None, BASE + " tail", "c", 10), (11, "é 漢字 🙂 <|endoftext|> x" * 9, "c", 11),
]
SCHEMA = "doc_id long, text string, source string, node long"  # ``node`` clashes with a name used inside


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def empty(df):
    return df.where("1 = 0")


def words(text):
    return (text or "").encode().split()


# --- near duplicates --------------------------------------------------------


def brute_components(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return sorted(out, key=str)


def got_components(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in prefixes.near_duplicates(df).collect()), key=str)


def test_near_duplicates_of_odd_rows(odd):
    assert got_components(odd) == brute_components([(r[0], r[1]) for r in ODD])
    assert got_components(empty(odd)) == []


def test_near_duplicates_of_edited_copies_over_many_tasks(spark):
    rnd, rows = random.Random(5), []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(rnd.choice([40, 120, 300]))]
        for _ in range(rnd.choice([3, 30, 60])):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 25)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.random()}"
            rows.append(" ".join(copy))
    rows += rows[:20]  # the same set in several tasks
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got_components(df) == brute_components(rows)


def test_near_duplicates_of_appended_and_truncated_copies_in_one_task(spark):
    rnd, texts = random.Random(11), []
    for group, (size, more) in enumerate([(84, 20), (84, 20), (204, 40), (204, 51), (44, 9), (64, 16), (304, 75)] * 3):
        base = [f"g{group}w{i}" for i in range(size)]
        added = [f"g{group}a{i}" for i in range(more)]
        texts += [base, base + added if group % 2 else added + base, base[: -(more // 2)]]
        texts += [base[more // 3 :] + added[: more // 2]] * rnd.randint(0, 1)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == brute_components(rows)
    alone = [(0, " ".join(texts[0])), (1, " ".join(texts[1]))]  # no other document lends a token
    assert got_components(spark.createDataFrame(alone, "doc_id long, text string").coalesce(1)) == brute_components(alone)


def test_representatives_keep_columns_and_one_row_of_each_group(odd):
    kept = prefixes.representatives(odd).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 5, 6, 8, 11]
    assert {r.doc_id: r.node for r in kept}[8] == 8


def test_representatives_of_null_and_repeated_ids(spark):
    own = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (None, own[2] + " tail"), (7, own[2]), (7, own[3]), (7, own[3].upper()),
            (1, own[4]), (9, own[4] + " tail"), (9, own[5]), (3, None), (3, ""), (None, None), (None, " ")]
    kept = prefixes.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    once = [(None, own[0]), (None, own[1]), (7, own[2]), (7, own[3]), (1, own[4]), (9, own[5]), (3, None), (3, ""), (None, None), (None, " ")]
    lower = lambda x: str((x[0], x[1] and x[1].lower()))
    assert sorted(map(lower, kept)) == sorted(map(lower, once))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# --- substring dedup ----------------------------------------------------------


def brute_removed(rows):
    first = {}
    key = lambda doc: (1 << 63) - 1 if doc is None else doc
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, key(doc)), key(doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key(doc):
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_removed(df):
    rows = automata.remove(df, texts=False).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def test_substrings_of_odd_rows(odd):
    assert got_removed(odd) == brute_removed([(r[0], r[1]) for r in ODD])
    assert got_removed(empty(odd)) == []


def test_substrings_with_common_anchors_cut_into_windows(spark, monkeypatch):
    monkeypatch.setattr(automata, "COMMON", 3)
    rnd = random.Random(1)
    span = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(30):
        own = [f"d{i}x{j}" for j in range(30)]
        a, b = sorted(rnd.sample(range(41), 2))
        rows.append((i, " ".join(own[:10] + span[a:b] + own[10:] + ["z"] * rnd.randint(0, 30))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_removed(df) == brute_removed(rows)


def test_cut_texts_keep_the_white_space_of_the_rest(spark):
    df = spark.createDataFrame([(1, BASE), (2, "own\n start  " + BASE + "\n the end\n")], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in automata.remove(df).collect()}
    assert cut == {1: BASE, 2: "own\n start\n the end\n"}


# --- quality rules ------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_ledger_measures_and_ablation(spark, odd, documents):
    extra = spark.createDataFrame(
        [(20, "a b c " * 40, None, 0), (21, "x y z x y z q\nx y z x y z q\n\n \n# $5 <b>", None, 0), (22, "a a a a", None, 0)], SCHEMA
    )
    rows = odd.union(extra).unionByName(documents.select("doc_id", "text", "source", F.lit(0).cast("long").alias("node")))
    book = ledger.ledger(rows.withColumn("id", F.monotonically_increasing_id()).drop("id"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc_id), *(r[c] for c in columns)) for r in book.collect())
    assert got == sorted((str(r.doc_id), *brute_measures(r.text)) for r in rows.collect())
    policy = ledger.POLICIES["web-1"]
    failed = [r.failed & ledger.mask(policy) for r in book.collect()]
    for row in ledger.ablation(book, policy).collect():
        bit = ledger.mask([row.rule])
        assert (row.failing, row.alone) == (sum(f & bit != 0 for f in failed), sum(f == bit for f in failed))
        assert row.kept_without == sum(f & ~bit == 0 for f in failed)
        assert row.alone == book.where(ledger.only_rule(policy) == row.rule).count()
    assert book.where(ledger.passes(policy) & ledger.only_rule(policy).isNotNull()).count() == 0
    assert ledger.ledger(empty(odd)).count() == 0


# --- url verdicts ---------------------------------------------------------------


def test_urls(spark):
    allow, block = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]
    cases = [
        (1, "http://EXAMPLE.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"),
        (2, "https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"), (4, "http://x.net/fr", "x.net", "/fr", None, "allow"),
        (5, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (6, None, "", "", None, "allow"),
        (7, "example.com/en/", "", "", None, "allow"), (8, "http://a.com", "a.com", "", None, "allow"), (8, "", "", "", None, "allow"),
        (9, "x://É.COM/?a=://b.net/fr/", "É.com", "/", "com/", "allow"), (10, "http://a.com?x/en/", "a.com", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in cases], "page_id long, url string, rule string")
    got = sorted(map(str, map(tuple, cascade.judge(pages, allow, block).collect())))
    assert got == sorted(str((i, h, p, r, v)) for i, _, h, p, r, v in cases)
    assert cascade.judge(empty(pages), allow, block).count() == 0
    assert {r.verdict for r in cascade.judge(pages, [], []).collect()} == {"allow"}


def test_a_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like '%7'")
    levels = cascade.build(keys, listed)
    assert len(levels) > 1
    wrong = keys.where(cascade.member(levels, F.col("key")) != F.col("key").like("%7"))
    assert wrong.count() == 0
    assert sum(x.bits for x in levels) < 40 * 2000


# --- archive --------------------------------------------------------------------


def test_archive_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a/ b\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1"), (2, None, "<p>é</p>\r\n\r\nWARC/1.1"), (3, "u", None), (4, "u", ""),
        (5, "u", "z" * 300_000), (5, "u", "z" * 300_000), (None, "n", "alone"), (6, "u", "n" * 30), (7, "u", "n" * 30),
        (8, "http://a.com/ééé", "<html>" + "é" * 62), (9, "http://例え.jp/日本", "<html>漢字</html>"), (10, "http://例え.jp/" + "日本🙂/" * 40_000, "\r\n\r\n long"),
        (11, "http://例え.jp/日本", "<html>漢字</html>"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    folder = scratch(spark, "archive")
    archive.write(pages, folder)
    back = archive.parse(archive.records(spark, folder)).collect()
    assert sorted(str(r.page_id) for r in back) == sorted(str(r[0]) for r in rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in back:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.record_type == "revisit" or bytes(r.payload) == html[r.page_id]
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in back)
    assert ("2", "revisit", 1) in kinds and ("4", "revisit", 3) in kinds and kinds.count(("5", "response", None)) == 1
    assert ("5", "revisit", 5) in kinds and ("7", "revisit", 6) in kinds and ("11", "revisit", 9) in kinds
    for r in back:
        sha1 = hashlib.sha1(html[r.page_id]).digest()
        assert r.payload_digest == base64.b32encode(sha1).decode()
    assert {r.page_id: r.url for r in back}[9] == "http://例え.jp/日本"
    heads = [bytes(r.record).split(b"\r\n\r\n")[0].decode() for r in archive.records(spark, folder).collect()]
    names = re.findall("WARC-Record-ID: (.*)\r", "\n".join(heads))
    assert len(set(names)) == len(rows) and set(re.findall("WARC-Refers-To: (.*)\r", "\n".join(heads))) <= set(names)
    cut = archive.records(spark, folder).select(F.expr("substring(record, 1, octet_length(record) - 9)").alias("record"))
    with pytest.raises(Exception, match="no whole payload"):
        archive.parse(cut.where("contains(record, 'X-Page-Id: 8')")).collect()
    none = scratch(spark, "archive")
    archive.write(empty(pages), none)
    assert archive.records(spark, none).count() == 0
    big = scratch(spark, "archive")
    archive.write(pages, big, min_bytes=100)
    assert {r.page_id for r in archive.parse(archive.records(spark, big)).where("record_type = 'revisit'").collect()} == {5}
    archive.export(archive.records(spark, folder), str(tmp_path / "warc"))
    written = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert sorted(written) == sorted(b"".join(bytes(r.record) for r in archive.records(spark, folder).collect()))


# --- classifier -------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = kernel.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_classifier_against_ridge_and_isotonic_fit_of_all_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marks = {}
    for r in labels.where("quality is not null").collect():
        marks.setdefault(r.doc_id, []).append(r.quality)
    stats = {r.doc_id: np.array(r.stats) for r in kernel.statistics(docs).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in stats}
    learn = sorted(i for i in stats if i in marks and fold[i] in (1, 2, 3))
    back = sorted(i for i in stats if i in marks and fold[i] == 4)
    label = lambda ids: np.array([np.mean(marks[i]) for i in ids])
    x = np.stack([stats[i] for i in learn])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    rng = np.random.default_rng(7)
    turns = rng.normal(size=(x.shape[1], kernel.FEATURES)) / np.sqrt(x.shape[1] / 2)
    shift = rng.uniform(0, 2 * np.pi, kernel.FEATURES)

    def raw(ids):
        z = np.clip((np.stack([stats[i] for i in ids]) - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ turns + shift), np.ones((len(ids), 1))])

    z = raw(learn)
    beta = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(z.shape[1]), z.T @ label(learn))
    place = lambda ids: np.clip((raw(ids) @ beta + 0.25) / 1.5, 0, 1)
    model = kernel.learn(kernel.statistics(docs), labels)
    every = sorted(stats)
    assert np.abs(model.raw(np.stack([stats[i] for i in every])) - place(every)).max() < 2e-3  # features are rounded to 1 / 2048

    # the isotonic fit by its min-max form, over the bins of the held-back rows
    at = np.minimum((model.raw(np.stack([stats[i] for i in back])) * kernel.BINS).astype(int), kernel.BINS - 1)
    total, weight = np.bincount(at, label(back), kernel.BINS), np.bincount(at, minlength=kernel.BINS)
    full = np.flatnonzero(weight)
    t, w = np.cumsum([0, *total[full]]), np.cumsum([0, *weight[full]])
    level = [max(min((t[b] - t[a]) / (w[b] - w[a]) for b in range(i + 1, len(full) + 1)) for a in range(i + 1)) for i in range(len(full))]
    assert np.abs(model.levels[full] - level).max() < 1e-3
    assert (np.diff(model.levels) >= 0).all()
    scores = {r.doc_id: r for r in kernel.judge(docs, labels).collect()}
    expect = model.score(np.stack([stats[i] for i in every]))
    assert len(scores) == len(every) and max(abs(scores[i].score - e) for i, e in zip(every, expect)) < 1e-9
    assert all(scores[i].held_out == (fold[i] == 0) and scores[i].predicted == (scores[i].score >= 0.3) for i in every)


def test_classifier_on_odd_rows_and_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in kernel.judge(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 0, 0), (9, None, 0), (99, 1, 1)], none.schema)
    rows = kernel.judge(odd, some).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert kernel.judge(empty(odd), some).count() == 0
    assert kernel.keep(odd, none).count() == len(ODD)


def test_isotonic_levels_never_fall():
    levels = kernel.isotonic(np.array([0.0, 3, 0, 2, 0, 5]), np.array([0.0, 4, 0, 4, 2, 5]))
    assert (np.diff(levels) >= 0).all() and levels[0] == levels[1] and levels[-1] == 1


# --- tokens -------------------------------------------------------------------------


def test_encoding_equals_the_library(spark, odd, documents):
    from tokenizers import Tokenizer

    path = vocabulary()
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    noise = ["".join(rnd.choice("aabcdethinoERs  \n\t'0129.,!é漢🙂ñ-_") for _ in range(rnd.choice([3, 40, 400]))) for _ in range(300)]
    texts = [r[1] for r in ODD] + noise + ["a" * 3000, " " * 500 + "x"] + [r.text for r in documents.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in backtrack.decode(backtrack.encode(df, path), path).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert row.text == library.decode(ids, skip_special_tokens=False)
    assert backtrack.encode(empty(odd), path).count() == 0


# --- mixing ---------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pivotal.mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, pivotal.mix_sources(docs.repartition(5)).collect()))
    sources = {r.source for r in rows}
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1
    for source in sources:
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)


def brute_targets(sizes):
    """Exact shares of the sum by weight; a source over its cap stops there, the rest share again."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, free = total - sum(3 * sizes[n] for n in capped), [n for n in names if n not in capped]
        shares = {n: Fraction(rest * weight[n], sum(weight[m] for m in free)) for n in free}
        over = {n for n in free if shares[n] > 3 * sizes[n]}
        if not over:
            return {**shares, **{n: Fraction(3 * sizes[n]) for n in capped}}
        capped |= over


def test_mix_targets_against_exact_shares(spark):
    names = ["Z", "a", "B", "b", "é", "漢", "🙂", "", None]  # not the order of a locale, nor of UTF-16
    counts = [1, 40, 3, 700, 2, 90, 11, 1, 25]
    rows = [(i, "w " * (1 + i % 7), n, i) for n, c in zip(names, counts) for i in range(c)] + [(1, None, "none", 0), (2, "", "none", 0)]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for docs in (spark.createDataFrame(rows, SCHEMA).repartition(5), given):
        sizes = Counter()
        for r in docs.select("source", "text").collect():
            sizes[r.source] += len(words(r.text))
        expect = brute_targets(sizes)
        got = pivotal.mix_sources(docs).collect()
        assert {r.source for r in got} == set(expect)
        for r in got:
            assert r.source_size == sizes[r.source]
            assert abs(r.target - float(expect[r.source])) <= 1e-9 * sum(sizes.values()) + 1e-6


def test_mix_of_many_chunks_and_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(pivotal, "CHUNK", 8)
    many = spark.range(700).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90).cast("int")).alias("text"),
                                   F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    rows = pivotal.mix_sources(many).collect()
    assert len(rows) == 700
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 90
    taken = pivotal.mix_sources(odd)
    assert taken.count() == len(ODD) and {r.source for r in taken.collect()} == {"a", "b", "c", None}
    mixed = pivotal.apply(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == taken.agg(F.sum("copies")).first()[0]
    assert pivotal.mix_sources(empty(odd)).count() == 0


def test_mix_of_a_source_made_of_one_repeated_row(spark):
    rows = [(1, "five words in this text", "a", i) for i in range(301)] + [(2 + i, f"t{i} " * (i % 5 + 1), "ab"[i % 2], i) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    each = pivotal.mix_sources(docs).collect()
    for source in "ab":
        own = [r for r in each if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 5
    assert len(each) == len(rows)
    mixed = pivotal.apply(docs).collect()
    assert Counter(r.doc_id for r in mixed) == +Counter({d: sum(r.copies for r in each if r.doc_id == d) for d in {r.doc_id for r in each}})
    times = Counter(r.node for r in mixed if r.doc_id == 1)  # each of the equal rows in its turn
    assert max(times.values()) - min(times[i] for i in range(301)) <= 1


# --- neighbours ------------------------------------------------------------------------




def test_neighbours_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = curves.search(vectors, F.col("vec_id") % 20 == 0, k=20).collect()
    table = vectors.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in table], float), np.array([r.vec_id for r in table])
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        assert abs(r.score - x[ids == r.query_id][0] @ x[ids == r.vec_id][0]) < 1e-12
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        assert sorted(got[ids[q]]) == list(range(1, 21))
        hits += len(set(got[ids[q]].values()) & set(ids[np.argsort(-score, kind="stable")[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_among_vectors_of_uneven_length(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 128)
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(6000, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    one = np.where(np.arange(6000) == 77, 100.0, 1.0)
    for lengths in (one, np.exp(rng.normal(size=6000)), np.where(np.arange(6000) % 2000 == 0, 1e100, 1e-100)):
        x = unit * lengths[:, None]
        vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got, hits = {}, 0
        for r in curves.search(vectors, F.col("vec_id") % 100 == 5, k=20).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sorted(got) == list(range(5, 6000, 100))
        for q, found in got.items():
            score = x @ unit[q]
            score[q] = -np.inf
            hits += len(found & set(np.argsort(-score, kind="stable")[:20].tolist()))
        assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_vectors_without_structure(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 128)  # windows, not whole curves
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got, hits = {}, 0
    for r in curves.search(vectors, F.col("vec_id") % 50 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found & set(np.argsort(-score, kind="stable")[:20].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 20 * 200


def test_ties_at_the_edge_of_a_list_go_to_smaller_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, size=(700, 24)).astype(float)
    x[:, 0] = 1
    rows = [(0, g, int(i), v.tolist(), q) for q, ids in ((True, range(40)), (False, rng.permutation(700))) for g in (0, 1) for i, v in zip(ids, x[list(ids)])]
    dealt = spark.createDataFrame(rows, "block long, group int, uid long, embedding array<double>, query boolean").repartition(3)
    want = [(q, int(v), x[q] @ x[v]) for q in range(40) for v in np.lexsort((np.arange(700), -(x @ x[q])))[:21]]
    assert sorted(tuple(r) for r in curves._nearest(dealt, 21).collect()) == sorted(want * 2)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1),
            (6, [1.0, None], 1), (7, [2.0, 0.5], 1), (7, [2.0, 0.5], 1), (7, [1.5, 0.25], 1), (8, [1.0], 1), (40, [2.0], 1), (60, [1.0, 2.0, 3.0], 1),
            (9, [-1.0, 0.0], 1), (20, [0.0, 3.0], 1), (None, [5.0, 5.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in sorted(curves.search(vectors, F.col("vec_id") % 20 == 0, k=3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # one id with two vectors is two candidates; other numbers of components are other spaces
    assert got == {0: [(7, 2.0), (7, 1.5), (1, 1.0)], 20: [(7, 1.5), (7, 0.75), (0, 0.0)], 40: [(8, 2.0)]}
    assert curves.search(empty(vectors), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_steps_are_one_cell():
    points = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = curves.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


# --- language models ---------------------------------------------------------------------


def brute_losses(rows, wanted):
    texts = [(r[1] or "").encode().lower().split() for r in rows]
    known = {w for t in texts for w in t}
    models = []
    for inside in (lambda r: r[0] in wanted, lambda r: True):
        pairs = [(a, b) for r, t in zip(rows, texts, strict=True) if inside(r) for a, b in zip(["start", *t[:-1]], t, strict=False)]
        models.append((Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs), len(pairs)))
    scale = models[0][3] / models[1][3] if models[0][3] else 1.0
    out = []
    for r, t in zip(rows, texts, strict=True):
        means = []
        for (both, before, word, total), s in zip(models, (1.0, scale), strict=True):
            losses = [
                -np.log((both[a, b] * s + crossent.PRIOR * (word[b] * s + 1) / (total * s + len(known))) / (before[a] * s + crossent.PRIOR))
                for a, b in zip(["start", *t[:-1]], t, strict=False)
            ]
            means.append(np.mean(losses) if losses else None)
        out.append((str(r[0]), len(t), *means))
    return sorted(out, key=lambda x: tuple(map(str, x[:2])))


def got_losses(df, target, **sizes):
    rows = [(str(r.doc_id), r.n_tokens, r.loss_target, r.loss_background) for r in crossent.score(df, target, **sizes).collect()]
    return sorted(rows, key=lambda x: tuple(map(str, x[:2])))


def same_losses(got, want):
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:] == b[2:] or np.allclose(a[2:], b[2:], atol=1e-6), (a, b)


def test_losses_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1,), (1,), (6,), (None,), (99,)], "doc_id long")
    same_losses(got_losses(odd, target), brute_losses(ODD, {1, 6}))
    same_losses(got_losses(odd, empty(target)), brute_losses(ODD, set()))
    assert crossent.score(empty(odd), target).count() == 0
    nothing = odd.where("text is null or trim(text) = ''")
    assert [r[1:] for r in got_losses(nothing, target)] == [(0, None, None)] * nothing.count()


def test_losses_over_many_blocks_and_buckets(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    wanted = {doc for doc, _ in rows if doc % 3 == 0}
    target = spark.createDataFrame([(doc,) for doc in wanted], "doc_id long")
    same_losses(got_losses(documents.repartition(5), target, block=20_000, bucket=5_000), brute_losses(rows, wanted))


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_runs_and_keeps_columns(spark):
    import corpus_pipeline
    from tidemark.llm.text import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, SMALL), "stage")
        assert docs.count() <= 3 * before.count()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.count() == corpus_pipeline.run(spark, SMALL).count()
    nothing = spark.createDataFrame([], spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SMALL).count() == 0


# --- columns of any name --------------------------------------------------------------


def test_columns_with_inner_names_pass_through(spark):
    names = ["row", "_id", "_hash", "_key", "_doc", "marks", "starts", "doc", "key", "text_hash", "n_words", "_size", "_n_", "_time", "_copies", "root", "node", "a.b"]
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate([base, base + " more", " ".join(f"x{i}" for i in range(40)), None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    carried = lambda out: {tuple(r[n] for n in names) for r in out.collect()}
    every = carried(df)
    assert prefixes.representatives(df).columns == df.columns and carried(prefixes.representatives(df)) == {r for r in every if not r[0].endswith("1")}
    assert carried(pivotal.apply(df)) <= every and pivotal.apply(df).columns == df.columns
    cut = automata.removed(df).select("text", *[F.col(f"row.`{n}`") for n in names])
    assert carried(cut) == every
    assert automata.remove(df).columns == [c for c in df.columns if c not in ("text", "n_words")] + ["text", "n_words", "n_removed", "kept_sha256"]


def test_many_rows_without_id_keep_their_marks_apart(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(base[i % 20 : i % 20 + 15] + [f"u{i}"])) for i in range(300)] + [(1, " ".join(base)), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = automata.marked(df)
    assert marks.groupBy("doc", "text_hash").count().agg(F.max("count")).first()[0] == 1
    assert marks.agg(F.max(F.size("starts"))).first()[0] == 28
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in automata.remove(df).collect())
    assert got == {(None, 16, 15): 300, (1, 40, 0): 1, (None, 40, 40): 1}


def test_texts_of_many_rows_without_id_meet_only_their_own(spark):
    rows = [(None, " ".join(f"d{i}w{j}" for j in range(30)) + (" tail" if copy else "")) for i in range(60) for copy in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(prefixes.representatives(df).collect()) == 60
    named = prefixes.grouped(df)
    first = named.groupBy("node").agg(F.min("text_hash").alias("text_hash")).withColumn("doc_id", F.lit(None).cast("long"))
    assert prefixes.texts_of(df, first).count() == 120
