"""Personal data: base patterns, and terms that reveal them by co-occurrence.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers,
leftmost and non-overlapping for each kind; a match that fails its test (parts
above 255, Luhn, digit counts) is dropped and not tried again from within.

The information-theoretic part protects each entity (a distinct value of a base
kind).  Terms are words of at least three letters or digits, A-Z lower-cased.
With c(t) the documents that hold term t, c(e) those that hold entity e, c(t, e)
those where t stands within a few words of e, and N all documents,

    disclosure(t, e) = PMI(t, e) / IC(e) = 1 - log(c(t) / c(t, e)) / log(N / c(e))

is the share of the entity's information that seeing t gives away; it is 1 if t
occurs nowhere but near e.  Terms that reach `threshold` for some entity become
spans of the kind `term` wherever they occur, also in documents that don't name
the entity.  One common document is weak evidence, as any rare word would do:
below `support` common documents only terms count that stand there as a name (a
capital and then none), so that entities of one document are protected too.

All counts cover all documents.  Pairs are counted map-side first, so a term or
an entity that a third of the documents share costs one row per task.  Terms
that can't reach the threshold, going by their counts near entities alone, are
left before the corpus is counted; the others are counted, and those that reach
it are located, through bitmaps and then by their 64-bit hashes, in the document's
own row: no occurrence is a row, so a term that all documents share costs none.
Only more terms than fit (`held_terms`) are joined with their occurrences.

Nulls count as empty texts.  Each row counts as a document of its own, also if
its doc_id repeats or is null, and its spans come from its own text: they are
told apart by doc_id and the text's hash, so equal rows have equal spans.  Texts
may have any length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType, _parse_datatype_string

from ._bitmap import Bitmap, member_bitmap
from ._checkpoint import checkpoint
from ._lean import lean
from ._words import LETTERS, Hasher, batches, text_buffers, word_bounds

KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four dotted numbers whose parts are at most 255; longer chains go four by four."""
    for m in _DOTTED.finditer(text):
        at, groups = m.start(), m.group().split(".")
        for k in range(0, len(groups) - 3, 4):
            four = groups[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    if not _ANY.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(s, k, e) for k, find in enumerate((addresses, cards, phones), 1) for s, e in find(text)]
    return sorted(found)


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_TERMS = Hasher(53, lower=True)


def _terms(column: pa.Array) -> tuple[np.ndarray, ...]:
    """hash, text number, start and end (in code points of the text) of every term, and whether it is written as a name."""
    data, off = text_buffers(column)
    start, end, first = word_bounds(data, off, LETTERS)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    long = end - start >= 3
    start, end, doc = start[long], end[long], doc[long]
    h = _TERMS.hash(data, start, end)
    lo, hi = int(off[0]), int(off[-1])
    points = np.zeros(hi - lo + 1, np.int32)
    np.cumsum((data[lo:hi] & 0xC0) != 0x80, out=points[1:])
    base = points[off[:-1] - lo][doc]
    capital = (data[lo:hi] >= 65) & (data[lo:hi] <= 90)
    named = capital[start - lo] & ~capital[start - lo + 1]
    return h.view(np.int64), doc, points[start - lo] - base, points[end - lo] - base, named


def _pairs(near: int):
    """(term, entity, docs, named) counts of one task's documents, and of those where the term is a name; term 0 stands for the entity itself, entity 0 for any."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = [*count]
            done = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([v[i] for v in count.values()], pa.int64()) for i in range(2))], ["term", "entity", "docs", "named"])
            count.clear()
            return done

        for batch in batches(rows, 4 << 20):
            texts = batch.column(0)
            spans = [base_spans(t.as_py() or "") for t in texts]
            some = [i for i, s in enumerate(spans) if s]
            if not some:
                continue
            held = texts.take(pa.array(some, pa.int32()))
            h, doc, start, end, named = _terms(held)
            first = np.searchsorted(doc, np.arange(len(some) + 1))
            for k, i in enumerate(some):
                text, a, b = held[k].as_py(), first[k], first[k + 1]
                s, e, hh, nn = start[a:b], end[a:b], h[a:b], named[a:b]
                inside = np.zeros(b - a, bool)
                for lo, _, hi in spans[i]:
                    inside |= (s < hi) & (e > lo)
                s, hh, nn = s[~inside], hh[~inside], nn[~inside]
                seen: dict[tuple[int, int], bool] = {}
                for lo, kind, hi in spans[i]:
                    entity = _hash(f"{KINDS[kind]}:{text[lo:hi]}")
                    at = int(np.searchsorted(s, lo))
                    seen[0, entity] = False
                    here = slice(max(0, at - near), at + near)
                    for t, name in zip(hh[here].tolist(), nn[here].tolist()):
                        seen[t, entity] = name or seen.get((t, entity), False)
                        seen[t, 0] = False
                for pair, name in seen.items():
                    n = count.setdefault(pair, [0, 0])
                    n[0] += 1
                    n[1] += name
            if len(count) > 200_000:
                yield out()
        if count:
            yield out()

    return run


def _hits(column: pa.Array, bitmap: Bitmap) -> tuple[np.ndarray, ...]:
    """_terms() that the bitmap has, by text, hash and start, and whether each is the first of its text and hash."""
    h, doc, start, end, _ = _terms(column)
    hit = bitmap.has(h)
    h, doc, start, end = h[hit], doc[hit], start[hit], end[hit]
    order = np.lexsort((start, h, doc))
    h, doc, start, end = h[order], doc[order], start[order], end[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h, doc, start, end, new


def _documents(raw):
    """(term, docs): in how many of a task's documents each term of the bitmap occurs."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(raw.value)
        term, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches(rows, 4 << 20, "text"):
            h, _, _, _, new = _hits(batch.column(0), bits)
            term, back = np.unique(np.r_[term, h[new]], return_inverse=True)
            n = np.bincount(back, np.r_[n, np.ones(int(new.sum()))], len(term)).astype(np.int64)
        for k in range(0, len(term), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(term[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["term", "docs"])

    return run


def _positions(raw):
    """(doc_id, h, term, start, end) of every occurrence of the terms that the bitmap has."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(raw.value)
        for batch in batches(rows, 4 << 20):
            term, doc, start, end, _ = _hits(batch.column(2), bits)
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(term), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc_id", "h", "term", "start", "end"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): doc_id and the text's hash tell rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def terms(docs: DataFrame, near: int = 8, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """(term): hashes of the terms that disclose an entity."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    total = docs.count()
    pairs = docs.mapInArrow(_pairs(near), "term long, entity long, docs long, named long").groupBy("term", "entity").agg(F.sum("docs").alias("both"), F.sum("named").alias("named"))
    pairs = checkpoint(pairs)
    entities = pairs.where("term = 0").select("entity", F.col("both").alias("of_entity"))
    near_any = pairs.where("term != 0 AND entity = 0").select("term", F.col("both").alias("most"))
    evident = (F.col("both") >= support) | (F.col("named") > 0)
    able = pairs.where((F.col("term") != 0) & (F.col("entity") != 0) & evident).join(entities, "entity").where(F.col("of_entity") < total)
    share = lambda c: 1 - F.log(c / F.col("both")) / F.log(F.lit(float(total)) / F.col("of_entity"))
    # A term occurs in at least as many documents as near entities.
    able = able.join(near_any, "term").where(share(F.col("most")) >= threshold).select("term", "both", "of_entity")
    able = checkpoint(able)
    counted = docs.mapInArrow(_documents(member_bitmap(able.select("term").distinct())), "term long, docs long").groupBy("term").agg(F.sum("docs").alias("of_term"))
    return checkpoint(able.join(counted, "term").where(share(F.greatest("of_term", "both")) >= threshold).select("term").distinct())


def disclosing(docs: DataFrame, near: int = 8, threshold: float = 0.8, support: int = 2) -> DataFrame:
    """(doc_id, h, start, end): every occurrence of a term that discloses an entity; h is the text's hash."""
    return _located(_keyed(docs), terms(docs, near, threshold, support))


def _located(docs: DataFrame, found: DataFrame) -> DataFrame:
    schema = StructType([docs.schema["doc_id"], docs.schema["h"]]).add("term", LongType()).add("start", IntegerType()).add("end", IntegerType())
    return docs.mapInArrow(_positions(member_bitmap(found)), schema).join(found, "term").select("doc_id", "h", "start", "end")


def _bases(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    for batch in rows:
        counts: list[list[int]] = [[], [], [], []]
        digests, spans = [], []
        for t in batch.column(2):
            found = base_spans(t.as_py())
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in found))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, kind)], ["doc_id", "h", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"])


def _sorted_terms(found: DataFrame):
    """The terms' hashes, sorted, sent to all executors; counted to be few."""
    hashes = np.sort(found.select("term").toArrow().column("term").to_numpy())
    return found.sparkSession.sparkContext.broadcast(hashes.tobytes())


def _spans(raw, hashes):
    """Counts, digest and all spans of each document, in its own row."""

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = Bitmap(raw.value), np.frombuffer(hashes.value, np.int64)
        for batch in batches(rows, 4 << 20):
            texts = batch.column(2)
            term, doc, start, end, _ = _hits(texts, bits)
            sure = np.searchsorted(known, term)
            sure[sure == len(known)] = 0
            sure = known[sure] == term if len(known) else np.zeros(len(term), bool)
            doc, start, end = doc[sure], start[sure], end[sure]
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for i, t in enumerate(texts):
                text = t.as_py()
                found = base_spans(text)
                own = [0, 0, 0, 0]
                for _, k, _ in found:
                    own[k] += 1
                for k in range(4):
                    counts[k].append(own[k])
                plain = [f"{KINDS[k]}:{s}:{e}" for s, k, e in found]
                digests.append(hashlib.sha256(",".join(plain).encode()).hexdigest())
                s, e = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                if len(s):
                    if found:
                        taken = np.zeros(len(text) + 1, np.int32)
                        for lo, _, hi in found:
                            taken[lo + 1 : hi + 1] = 1
                        upto = np.cumsum(taken)
                        free = upto[e] == upto[s]
                        s, e = s[free], e[free]
                    every = sorted([*found, *zip(s.tolist(), [4] * len(s), e.tolist())])
                    plain = [f"{KINDS[k]}:{a}:{b}" for a, k, b in every]
                spans.append(",".join(plain))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, near: int = 8, threshold: float = 0.8, support: int = 2, held_terms: int = 1 << 22) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of docs.

    spans is kind:start:end of all spans (code points, end exclusive) by start
    and then kind, comma-joined; base_sha256 is the digest of the same string for
    the base kinds alone.  Terms that overlap a base span are left out.

    At most `held_terms` terms (8 bytes each) are sent to every executor and found
    in the document's own row; more are joined with their occurrences.
    """
    span = "array<struct<start:int,kind:int,end:int>>"
    rows = _keyed(docs)
    schema = StructType([rows.schema["doc_id"], rows.schema["h"]])
    for c in ("n_email", "n_ip", "n_card", "n_phone"):
        schema = schema.add(c, LongType())
    found = terms(docs, near, threshold, support)
    if found.count() <= held_terms:
        whole = StructType([f for f in schema.fields if f.name != "h"]).add("base_sha256", StringType()).add("spans", StringType())
        return rows.mapInArrow(_spans(member_bitmap(found), _sorted_terms(found)), whole)
    base = rows.mapInArrow(_bases, schema.add("base_sha256", StringType()).add("base", _parse_datatype_string(span)))
    # One row for each document with terms; a document's own occurrences bound it.
    hits = _located(rows, found).groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("terms"))
    hits = hits.select(F.col("doc_id").alias("of"), F.col("h").alias("hash"), "terms")
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("hash")), "left")
    free = F.filter(F.coalesce("terms", F.array().cast(span)), lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(F.array_sort(F.concat("base", free)), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", spans: str = "spans", out: str = "clean") -> DataFrame:
    """Adds `out`: the text with base spans replaced by their kind in brackets and terms removed.

    A null text stays null; overlapping spans are merged under the first one's kind.
    """
    from ._words import with_fields

    docs = docs.drop(out)
    at, of = docs.columns.index(text), docs.columns.index(spans)

    @lean
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            clean = []
            for t, s in zip(batch.column(at), batch.column(of)):
                t, s, done, parts = t.as_py(), s.as_py() or "", 0, []
                for kind, a, b in (x.split(":") for x in s.split(",") if x):
                    a, b = int(a), int(b)
                    if t is not None and a >= done:
                        parts += [t[done:a], "" if kind == "term" else f"[{kind.upper()}]"]
                    done = max(done, b)
                clean.append(None if t is None else "".join([*parts, t[done:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(run, with_fields(docs, **{out: "string"}))
