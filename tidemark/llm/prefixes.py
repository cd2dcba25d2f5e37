"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

Every document is the set of its 5-word shingles in one global order, frequent shingles
last. Two sets with overlap of at least t share at least k tokens among their first
n - t + k. With k = 1 that is the usual prefix; a longer prefix costs more postings but lets
fewer candidates through. Each document takes the k with the least estimated cost (postings
it meets, plus verification of the at most postings / k documents that share k of them). A
pair is verified if it shares as many prefix tokens as the smaller k of the two asks.

No group is expanded into all its pairs. Equal sets are one node. A first round verifies,
for each node, the neighbour in the posting lists that it meets most often, and joins the
links into components. The second round looks at candidate pairs across different
components only, and misses none of them; so a large group of copies, which is one component
by then, costs no more than its size.

The order uses frequencies counted over all documents: a task reports the shingles that it
meets in two documents or more, and the ``HOT`` most frequent become the common table of
all tasks (12 MB at most). The order only decides the cost, never the result.

Rows: a document with fewer words than a shingle has its whole sequence as the one
shingle; without words (null and empty texts too) the set is empty and linked with nothing;
repeated rows are equal sets; a null doc_id takes part, the smallest id ignores it; other
columns are not read; an empty table gives no rows. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.filters import build_filter
from tidemark.llm.text import Words, carried, free, mix, pieces, restored, shingles, stored

SIZE = 5
HOT = 1 << 20
LOCAL_HOT = 2
BITS = 512
WORD = r"[^\x20\x09-\x0D]"
VERIFY = 8.0  # cost of comparing one candidate, in postings


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of consecutive documents."""
    words = Words(data, offsets, lower=True)
    hashes = words.hashes()
    runs = shingles(hashes, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield shingles(hashes[a:b], b - a)
        else:
            yield np.empty(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    total = mix(tokens + mix(place)).sum(dtype=np.uint64) if len(tokens) else np.uint64(0)
    return int(mix(np.array([total ^ np.uint64(len(tokens))]))[0].astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def common(docs: DataFrame) -> DataFrame:
    """``token`` and ``n``: the most frequent shingles, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold() -> None:
            nonlocal tokens, counts, fresh, waiting
            every = np.concatenate([tokens, *fresh])
            weight = np.concatenate([counts, np.ones(waiting, np.int64)])
            tokens, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weight).astype(np.int64)
            fresh, waiting = [], 0

        def report(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal tokens, counts
            often = counts >= least
            if often.any():
                yield pa.RecordBatch.from_arrays([pa.array(tokens[often].astype(np.int64)), pa.array(counts[often])], names=["token", "n"])
            tokens, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        tokens, counts, fresh, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch):
                for tokens_of in sets_of(data, offsets):
                    fresh.append(tokens_of)
                    waiting += len(tokens_of)
                if waiting > 1 << 19:
                    fold()
                    if len(tokens) > 1 << 20:
                        yield from report(LOCAL_HOT)
        fold()
        yield from report(LOCAL_HOT)

    counted = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "token").limit(HOT)  # decides the cost only


class Order:
    """Global order of tokens: by power of two of the frequency, then by hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted tokens and their estimated frequencies."""
        n = np.ones(len(tokens), np.int64)
        if len(self.tokens):
            at = np.searchsorted(self.tokens, tokens).clip(0, len(self.tokens) - 1)
            n = np.where(self.tokens[at] == tokens, self.counts[at], 1)
        by = np.lexsort((tokens, np.log2(n).astype(np.int8)))
        return tokens[by], n[by]


def matches_asked(frequency: np.ndarray, percent: int) -> tuple[int, int]:
    """The k of least cost for a set in global order, and its prefix length."""
    n = len(frequency)
    least = least_overlap(n, percent)
    base = n - least
    met = np.cumsum(frequency - 1)
    asked = 1 << np.arange(max(1, int(np.log2(max(least, 1))) + 1))
    asked = asked[asked <= max(least, 1)]
    postings = met[base + asked - 1]
    cost = asked + VERIFY * postings / asked
    k = int(asked[np.argmin(cost)])
    return k, base + k


def documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``n`` (set size), ``node``, and, once per node and task, ``asked``,
    its ``prefix`` tokens and ``bits`` (parity of the tokens that fall on each of 512 bits)."""
    rows = common(docs).toArrow()
    table = docs.sparkSession.sparkContext.broadcast(
        (rows["token"].to_numpy().astype(np.uint64), rows["n"].to_numpy())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(*table.value), set()
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                size, node, asked, prefix, bits = [], [], [], [], []
                for tokens in sets_of(data, offsets):
                    name = node_of(tokens) if len(tokens) else None
                    size.append(len(tokens))
                    node.append(name)
                    if name is None or name in seen:
                        asked.append(None)
                        prefix.append(None)
                        bits.append(None)
                        continue
                    seen.add(name)
                    ordered, frequency = order(tokens)
                    k, length = matches_asked(frequency, percent)
                    asked.append(k)
                    prefix.append(ordered[:length].astype(np.int64))
                    odd = np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                        pa.array(asked, pa.int32()), pa.array(prefix, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "node", "asked", "prefix", "bits"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node long, asked int, prefix array<bigint>, bits array<bigint>")


def shared_postings(rows: DataFrame, percent: int) -> DataFrame:
    """Postings (token, node, n, asked) of tokens that two nodes or more hold, with the
    ``prev`` node of the list. Of two linked sets the smaller shares a token among its
    first few (``part`` 2) with the larger's usual prefix (``part`` 1 or 2)."""
    tokens = rows.where("prefix is not null").select(F.posexplode("prefix").alias("place", "token"), "node", F.col("n").cast("int"), "asked")
    fewest = lambda top, bottom: F.col("n") - F.ceil(F.col("n") * top / bottom - 1e-9)
    part = F.when(F.col("place") <= fewest(2 * percent, 100 + percent), 2).when(F.col("place") <= fewest(percent, 100), 1).otherwise(0)
    postings = tokens.select("token", "node", "n", "asked", part.cast("byte").alias("part"))
    lists = Window.partitionBy("token").orderBy("n", "node")
    whole = lists.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a node that several tasks report stands in a row; its first place counts
    return (
        postings.withColumn("prev", F.lag("node").over(lists))
        .withColumn("prev_n", F.lag("n").over(lists))
        .withColumn("several", F.first("node").over(whole) != F.last("node").over(whole))
        .where("several and (prev is null or prev != node)")
        .select("token", "node", "n", "asked", "part", "prev", "prev_n")
    )


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and one text for each of ``nodes`` (node, doc_id, text_hash). A bounded filter keeps
    most other texts out of the exact join, which goes by id and text: rows of one id, null too,
    meet only the node that their own text is."""
    key = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    wanted = stored(nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), key.alias("_key")), "wanted")
    known = docs.sparkSession.sparkContext.broadcast(build_filter(wanted.select("_key"), wanted.count()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column(2).to_numpy().astype(np.uint64)), pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                names = pa.array([node_of(t) if len(t) else None for t in sets_of(data, offsets)], pa.int64())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), names, part.column(1)], names=["node", "own", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.select("doc_id", "text", key.alias("key")).mapInArrow(pick, f"doc_id {kind}, text string, key long")
    found = near.join(wanted, (near["key"] == wanted["_key"]) & near["doc_id"].eqNullSafe(wanted["_id"]))
    # repeated rows once
    once = found.groupBy("key", "node", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"))
    return once.select("node", "text").mapInArrow(run, "node long, own long, text string").where("own = node").select("node", "text")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                both = [[s for _, _, d, o in pieces(part, c) for s in sets_of(d, o)] for c in ("ta", "tb")]
                good = []
                for x, y in zip(*both, strict=True):
                    common_n = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common_n >= percent * (len(x) + len(y) - common_n))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def likely(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) to start with: each node with the neighbour in posting lists, and with the
    list leader, that it meets most often. The leader of a list is the node whose lists
    are longest together; among copies with own changes that is the one nearest to their
    common source. Pairs must be of like size and meet in a twentieth of the tokens. Only a
    start, linear in the postings: ``across`` misses no pair."""
    lists = postings.groupBy("token").agg(F.count("*").alias("df"))
    weight = postings.join(lists, "token").groupBy("node").agg(F.sum("df").alias("weight"))
    ranked = postings.select("token", "node", "n").join(weight, "node")
    leader = ranked.groupBy("token").agg(F.max(F.struct("weight", "node", "n")).alias("lead"))
    led = postings.join(leader, "token").select("node", "n", F.col("lead.node").alias("other"), F.col("lead.n").alias("other_n"), F.lit(1).alias("kind"))
    near = postings.where("prev is not null").select("node", "n", F.col("prev").alias("other"), F.col("prev_n").alias("other_n"), F.lit(0).alias("kind"))
    close = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
    meetings = led.unionByName(near).where(close & (F.col("node") != F.col("other"))).groupBy("node", "other", "kind").agg(F.count("*").alias("met"), F.first("n").alias("n"))
    best = meetings.groupBy("node", "kind").agg(F.max(F.struct("met", "other")).alias("best"), F.first("n").alias("n"))
    pairs = best.where("best.met * 20 >= n").select("node", F.col("best.other").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def across(postings: DataFrame, roots: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes in different components that share enough prefix
    tokens: ``a`` the smaller, meeting ``b`` in one of its first tokens. A pair is given up when
    the parity ``bits`` alone differ in more places than the sets may differ in tokens."""
    # Of two sets, take the one whose prefix ends first in the global order. What both hold
    # of its prefix lies in the other's prefix too, so tokens that no other prefix holds are
    # not in the other set: the overlap is at most ``alive``. Nothing of the sort holds for the
    # other one, whose unmet tokens may stand behind the first one's prefix. So a pair is given
    # up only by the larger ``alive`` of the two, and no node alone.
    bound = F.ceil(F.col("size") * percent / 100 - 1e-9)
    alive = (
        postings.groupBy("node").agg(F.count("*").alias("shared"), F.first("n").alias("size"), F.first("asked").alias("asked"))
        .select("node", (bound - F.col("asked") + F.col("shared")).alias("alive"), (F.col("shared") >= F.col("asked")).alias("live"))
    )
    named = postings.where("part > 0").join(alive, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("token", "root", "node", "n", "part", "alive", "live"), "named")
    small, large = named.where("part = 2"), named
    # Components meet in a token by their sizes there, and only members of a size that some
    # member of the other one allows are taken out of them.
    roots_of = lambda rows, s: rows.groupBy("token", F.col("root").alias(f"root{s}")).agg(
        F.max("live").alias(f"live{s}"), F.min("n").alias(f"least{s}"), F.max("n").alias(f"most{s}"), F.count("*").alias(f"k{s}")
    )
    may = (F.col("mosta") * 100 >= F.col("leastb") * percent) & (F.col("leasta") <= F.col("mostb"))
    meets = roots_of(small, "a").join(roots_of(large, "b"), "token").where("roota != rootb and (livea or liveb)").where(may)
    meets = stored(meets.select("token", "roota", "rootb", "leasta", "mosta", "leastb", "mostb", "ka", "kb"), "meets")

    def side(rows: DataFrame, s: str) -> DataFrame:
        rows = rows.select("token", *[F.col(c).alias(c + s) for c in ("root", "node", "n", "alive")])
        there = rows.join(meets.select("token", f"root{s}").distinct(), ["token", f"root{s}"], "left_semi")
        return there.join(bits.select(F.col("node").alias(f"node{s}"), F.col("bits").alias(f"bits{s}")), f"node{s}")

    a, b = side(small, "a"), side(large, "b")
    fits_a = (F.col("na") * 100 >= F.col("leastb") * percent) & (F.col("na") <= F.col("mostb"))
    fits_b = (F.col("nb") >= F.col("leasta")) & (F.col("nb") * percent <= F.col("mosta") * 100)
    both = F.col("na") + F.col("nb")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("nodea") < F.col("nodeb")))
    enough = F.greatest("alivea", "aliveb") * (100 + percent) >= both * percent
    differ = F.aggregate(
        F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n
    )
    alike = differ <= both - 2 * F.ceil(both * percent / (100 + percent) - 1e-9)
    fits = ordered & enough & (F.col("na") * 100 >= F.col("nb") * percent) & alike
    # the component with fewer members there is taken apart first; the other one's members join
    # it under the conditions of a pair
    of_a = meets.where("ka <= kb").join(a, ["token", "roota"]).where(fits_a).join(b, ["token", "rootb"]).where(fits_b & fits)
    of_b = meets.where("ka > kb").join(b, ["token", "rootb"]).where(fits_b).join(a, ["token", "roota"]).where(fits_a & fits)
    pairs = of_a.select("nodea", "nodeb").unionByName(of_b.select("nodea", "nodeb")).distinct()
    # the whole prefixes, as far as others share them
    lists = postings.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.first("asked").alias("asked"))
    of = lambda s: lists.select(*[F.col(c).alias(c + s) for c in ("node", "tokens", "asked")])
    met = F.size(F.array_intersect("tokensa", "tokensb"))
    pairs = stored(pairs, "candidates")
    free(named, meets)
    several = (
        pairs.join(of("a"), "nodea").join(of("b"), "nodeb")
        .where(met >= F.least("askeda", "askedb"))
        .select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))
    )
    several = stored(several, "pairs")
    free(pairs)
    return several


def grouped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n`` (set size), ``node`` and ``root`` (the component; both null
    without words) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    full = documents(docs, percent)
    postings = stored(shared_postings(full, percent), "postings")
    rows = stored(full.select("doc_id", "text_hash", "n", "node", "bits"), "sets")
    bits = rows.where("bits is not null").groupBy("node").agg(F.first("bits").alias("bits"))
    first = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    first = first.select("node", "x.doc_id", "x.text_hash")

    def check(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = stored(texts_of(docs, first.join(wanted, "node")), "texts")
        links = stored(verified(pairs, texts, percent), "links")
        free(texts, pairs)
        return links

    links = check(stored(likely(postings, percent), "pairs"))
    roots = stored(components(links), "roots")
    more = check(across(postings, roots, bits, percent))
    free(postings)
    final = roots if more.isEmpty() else stored(components(links.unionByName(more)), "roots")

    return rows.select("doc_id", "text_hash", "n", "node").join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest doc_id reachable by links)
    of every row of ``docs`` (doc_id, text)."""
    named = grouped(docs, percent)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) without near duplicates: of each group one row with
    the smallest doc_id stays (a null one only where the group has no other), and every row
    without words. Rows are told apart by doc_id and text, so rows of one id, null too,
    stand for themselves."""
    named = grouped(docs, percent).where("root is not null")
    # a null doc_id comes last
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "text_hash")).alias("x"))
    kept = least.select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    held = docs.select(carried(docs), "text", "doc_id")
    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    once = held.where(worded).join(kept, same).dropDuplicates(["_id", "_hash"]).select(*restored(docs))
    return once.unionByName(docs.where(~worded))
