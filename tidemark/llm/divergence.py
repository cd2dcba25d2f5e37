"""Source divergence audit over a vocabulary of minimal acyclic transducers.

Terms are runs of letters (bytes of A-Z, a-z and from 0x80 on), A-Z lower-cased. Each language
keeps the terms of at least ``MIN_DOCUMENTS`` of its documents. With add-one smoothing in whole
parts of ``UNIT``, every (lang, source) group and every language gives each kept term a share p;
f(p, q) = floor((p - q)^2 / q) measures how far p is from q.

1. Blocks of documents count in how many documents of a language each term occurs; sums by
   (lang, term) give the kept terms.
2. Kept terms are range-partitioned and sorted; every run of up to ``SHARD`` terms of a language
   becomes one minimal transducer, which numbers its terms. Ordinals of a shard start where
   those of the one before end, so they follow the byte order of the language's terms.
3. Texts are read again for recounting. A vocabulary grows with the corpus, so it is not shipped
   whole: each block of documents deals its distinct words, with counts by source, to the
   shard whose range they fall into, and there they stream through the transducer. ``LANE`` map
   tasks share one copy of a shard, so a common word meets in one task only as often as that.
4. Languages are cut into ranges of ``RANGE`` ordinals. In each, shares of all sources stand side
   by side; sums over terms for pairs of sources, and the ``TOP`` terms of each source, leave it.
   Ties between terms go by ordinal; the transducers turn ordinals into terms again.

All arithmetic is on integers, so nothing depends on how rows are dealt. The driver sees one row
per shard (first term and size).

Rows: null text, lang and source count as ''; empty texts have no terms, but their group is there;
rows that repeat a doc_id are documents of their own; a language without kept terms has pairs of
value 0 and no terms; an empty table gives no rows; other columns go no further. Texts are taken
whole; blocks hold about ``BLOCK`` bytes, one text at least.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import transducer
from tidemark.llm.runs import Runs, byte_class
from tidemark.llm.text import pieces, stored

LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
MIN_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
BLOCK = 8 << 20
SHARD = 1 << 15
LANE = 32
RANGE = 1024
WIDE = 1 << 20  # shares held by one step over pairs of sources, about


class Block:
    """Terms of consecutive documents: sorted distinct ``terms``, and for every word its ``code``
    and ``doc``; ``langs`` and ``sources`` by document."""

    def __init__(self, held: list[tuple]):
        counts = np.concatenate([h[0] for h in held])
        coded = pa.chunked_array([h[1] for h in held]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary.cast(pa.large_binary())).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.terms = coded.dictionary.take(pa.array(order))
        self.code = place[coded.indices.to_numpy()]
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.langs, self.sources = (pa.chunked_array([h[i] for h in held]).combine_chunks().cast(pa.large_string()) for i in (2, 3))

    def count(self, groups: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of documents, term and how often the term occurs there (``once``: in how
        many documents), ordered by group and term."""
        width, doc, code = max(1, len(self.terms)), self.doc, self.code
        if once:
            doc, code = np.divmod(np.unique(doc * width + code), width)
        both, times = np.unique(groups[doc] * width + code, return_counts=True)
        return *np.divmod(both, width), times


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    held, waiting = [], 0
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch, "text"):
            found = Runs(data, offsets, LETTERS)
            held.append((found.counts, found.strings(), *(batch.column(c).slice(lo, hi - lo) for c in ("lang", "source"))))
            waiting += len(data) + 16 * (hi - lo)
            if waiting >= size:
                yield Block(held)
                held, waiting = [], 0
    if held:
        yield Block(held)


def document_counts(docs: DataFrame, block: int) -> DataFrame:
    """``lang``, ``term`` and number ``n`` of documents, once per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _blocks(batches, block):
            langs = found.langs.dictionary_encode()
            lang, term, n = found.count(langs.indices.to_numpy(), once=True)
            for i in range(0, len(n), 1 << 16):
                at = slice(i, i + (1 << 16))
                columns = [langs.dictionary.take(pa.array(lang[at])), found.terms.take(pa.array(term[at])), pa.array(n[at])]
                yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns[:2]] + columns[2:], names=["lang", "term", "n"])

    return docs.mapInArrow(run, "lang string, term string, n long")


def vocabulary(kept: DataFrame, shard: int) -> DataFrame:
    """Shards of the kept terms (lang, term): ``lang``, ``head`` (first term), ``n`` and ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            columns = [pa.array([lang]), pa.array([terms[0].decode()]), pa.array([len(terms)]), pa.array([transducer.build(terms)])]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "head", "n", "packed"])

        lang, terms = None, []
        for batch in batches:
            for at, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if terms and (at != lang or len(terms) == shard):
                    yield made()
                    terms = []
                lang = at
                terms.append(term.encode())
        if terms:
            yield made()

    ranged = kept.select("lang", "term").repartitionByRange(kept.count() // shard + 1, "lang", "term")
    return ranged.sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, head string, n long, packed binary")


def _pack(terms: pa.Array, at: np.ndarray, source: np.ndarray, n: np.ndarray, sources: pa.Array) -> bytes:
    """Counts of some terms of one block: ``terms`` are sorted, ``at`` numbers them."""
    sink = pa.BufferOutputStream()
    for table in (pa.table({"term": terms}), pa.table({"at": at.astype(np.int32), "source": source.astype(np.int32), "n": n}), pa.table({"source": sources})):
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def _unpack(packed: bytes) -> list[pa.Table]:
    reader = pa.BufferReader(zstandard.decompress(packed))
    return [pa.ipc.open_stream(reader).read_all().combine_chunks() for _ in range(3)]


def dealt(docs: DataFrame, heads: dict[str, list[tuple[bytes, int]]], block: int) -> DataFrame:
    """``slot``, ``lane`` and ``packed`` counts by source of the words of every block that fall
    into the range of a shard; ``heads`` has first term and slot of the shards of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() // LANE
        for found in _blocks(batches, block):
            langs, sources = found.langs.dictionary_encode(), found.sources.dictionary_encode()
            width = max(1, len(sources.dictionary))
            group, term, n = found.count(langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy(), once=False)
            lang, source = np.divmod(group, width)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                shards = heads.get(name)
                if not shards:
                    continue
                own = np.flatnonzero(lang == i)
                own = own[np.argsort(term[own], kind="stable")]
                codes = term[own]
                # where each shard begins among the sorted terms of the block
                cuts = [bisect.bisect_left(_Bytes(found.terms), head) for head, _ in shards] + [len(found.terms)]
                rows = np.searchsorted(codes, cuts)
                for (_, slot), a, b in zip(shards, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    used, at = np.unique(codes[a:b], return_inverse=True)
                    sites, site = np.unique(source[own[a:b]], return_inverse=True)
                    packed = _pack(found.terms.take(pa.array(used)), at, site, n[own[a:b]], sources.dictionary.take(pa.array(sites)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([slot]), pa.array([lane]), pa.array([packed], pa.binary())], names=["slot", "lane", "packed"]
                    )

    return docs.mapInArrow(run, "slot long, lane long, packed binary")


class _Bytes:
    """Sorted Arrow strings as a sequence of bytes, for bisection."""

    def __init__(self, terms: pa.Array):
        self.terms = terms

    def __len__(self) -> int:
        return len(self.terms)

    def __getitem__(self, i: int) -> bytes:
        return self.terms[i].as_py().encode()


def recounted(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """``slot``, ``place`` (ordinal inside the shard), ``source`` and count ``n``, from the rows of
    ``dealt`` and the ``shards`` (slot, packed); once per lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, shard, names, keys, counts, waiting = None, None, {}, [], [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, at, np.concatenate(counts))
            return every, total

        def rows() -> Iterator[pa.RecordBatch]:
            key, n = merge()
            sources = pa.array(list(names), pa.string())
            for i in range(0, len(n), 1 << 16):
                part = key[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), unit[0])), pa.array(part & (1 << 32) - 1), sources.take(pa.array(part >> 32)), pa.array(n[i : i + len(part)])],
                    names=["slot", "place", "source", "n"],
                )

        for batch in batches:
            for slot, lane, kind, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (slot, lane) != unit:
                    if keys:
                        yield from rows()
                    unit, names, keys, counts, waiting = (slot, lane), {}, [], [], 0
                if kind == 0:  # the shard comes first
                    shard = transducer.Transducer(packed)
                    continue
                terms, found, sites = _unpack(packed)
                place = shard.ordinals(terms["term"].combine_chunks() if terms.num_rows else pa.array([], pa.large_string()))
                here = place[found["at"].to_numpy()]
                site = np.array([names.setdefault(s, len(names)) for s in sites["source"].to_pylist()])[found["source"].to_numpy()]
                term = here >= 0
                keys.append(site[term] << 32 | here[term])
                counts.append(found["n"].to_numpy()[term])
                waiting += len(keys[-1])
                if waiting > 1 << 21 and len(keys) > 1:
                    key, n = merge()
                    keys, counts, waiting = [key], [n], 0
        if keys:
            yield from rows()

    units = blocks.select("slot", "lane").distinct().join(shards, "slot").select("slot", "lane", F.lit(0).alias("kind"), "packed")
    both = units.unionByName(blocks.select("slot", "lane", F.lit(1).alias("kind"), "packed"))
    return both.repartition("slot", "lane").sortWithinPartitions("slot", "lane", "kind").mapInArrow(
        run, "slot long, place long, source string, n long"
    )


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), by long division in three steps (count <= total < 2^53)."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def away(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _compare(table: pa.Table, span: int, top: int) -> pa.Table:
    """Sums of f for the pairs of sources over one range of ordinals, and the top terms of each.
    Rows of ``kind`` 0 name all sources of the language with their totals, those of kind 1 count."""
    kind = table["kind"].to_numpy()
    sites = table.filter(pa.array(kind == 0))
    sources, lang, terms = sites["source"].combine_chunks(), sites["lang"][0], sites["terms"][0].as_py()
    base = sites["range"][0].as_py() * span
    size, width = min(span, terms - base), len(sources)
    told = table.filter(pa.array(kind == 1))
    counts = np.zeros((max(0, size), width), np.int64)
    at = pc.index_in(told["source"].combine_chunks(), sources).to_numpy(zero_copy_only=False)
    np.add.at(counts, (told["ordinal"].to_numpy() - base, at.astype(np.int64)), told["n"].to_numpy())
    totals = sites["total"].to_numpy()
    sums = np.zeros((width, width), np.int64)
    tops: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if size > 0:
        p = share(counts + 1, totals + terms)
        q = share(counts.sum(axis=1) + 1, np.int64(totals.sum() + terms))
        step = max(1, WIDE // max(1, size))
        for i in range(width):
            for j in range(0, width, step):
                sums[i, j : j + step] = away(p[:, i : i + 1], p[:, j : j + step]).sum(axis=0)
            more = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            value = away(p[more, i], q[more])
            best = np.lexsort((more, -value))[:top]
            tops.append((np.full(len(best), i), more[best] + base, value[best]))
    one, other = np.nonzero(~np.eye(width, dtype=bool))
    found = [np.concatenate([t[c] for t in tops]) if tops else np.empty(0, np.int64) for c in range(3)]
    n = len(one) + len(found[0])
    return pa.table({
        "lang": pa.array([lang.as_py()] * n, pa.string()),
        "source": sources.take(pa.array(np.concatenate([one, found[0]]))),
        "other": pa.concat_arrays([sources.take(pa.array(other)), pa.nulls(len(found[0]), pa.string())]),
        "ordinal": pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(found[1].astype(np.int64))]),
        "value": np.concatenate([sums[one, other], found[2].astype(np.int64)]),
    })


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, block: int = BLOCK, shard: int = SHARD, span: int = RANGE
) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank`` of the groups of
    ``docs`` (text, lang, source). ``block`` (bytes of text), ``shard`` and ``span`` (terms) size the
    pieces of the work and change no result."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = document_counts(docs, block).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_documents)
    shards = stored(vocabulary(stored(kept.select("lang", "term"), "terms"), shard), "shards")

    # one row per shard
    listed = sorted((r["lang"], r["head"].encode(), r["n"]) for r in shards.select("lang", "head", "n").collect())
    heads: dict[str, list[tuple[bytes, int]]] = {}
    terms: dict[str, int] = {}
    slots = []
    for slot, (lang, head, n) in enumerate(listed):
        heads.setdefault(lang, []).append((head, slot))
        slots.append((slot, lang, head.decode(), terms.get(lang, 0)))
        terms[lang] = terms.get(lang, 0) + n
    numbered = spark.createDataFrame(slots, "slot long, lang string, head string, base long")
    shards = shards.join(F.broadcast(numbered), ["lang", "head"])

    blocks = stored(dealt(docs, heads, block), "blocks")
    places = recounted(blocks, shards.select("slot", "packed")).join(F.broadcast(numbered.select("slot", "lang", "base")), "slot")
    counts = stored(places.select("lang", (F.col("base") + F.col("place")).alias("ordinal"), "source", "n"), "counts")

    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = spark.createDataFrame(list(terms.items()), "lang string, terms long")
    groups = (
        docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(F.broadcast(sizes), "lang", "left").na.fill(0)
    )
    ranges = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("terms") / span) - 1, F.lit(0))).cast("array<long>")
    sites = groups.select("lang", F.explode(ranges).alias("range"), F.lit(0).alias("kind"), "source", "total", "terms")
    told = counts.select("lang", F.floor(F.col("ordinal") / span).alias("range"), F.lit(1).alias("kind"), "source", "ordinal", "n")
    compared = stored(
        sites.unionByName(told, allowMissingColumns=True).groupBy("lang", "range")
        .applyInArrow(lambda table: _compare(table, span, top), "lang string, source string, other string, ordinal long, value long"),
        "compared",
    )

    pairs = compared.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    best = compared.where("ordinal is not null").withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    named = shards.mapInArrow(_terms, "lang string, ordinal long, item string")
    items = best.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(items)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of shards with their ordinals."""
    for batch in batches:
        for row in batch.to_pylist():
            terms = transducer.Transducer(row["packed"]).terms()
            columns = [pa.array([row["lang"]] * len(terms)), pa.array(np.arange(len(terms)) + row["base"]), pa.array([t.decode() for t in terms])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "ordinal", "item"])
