"""Byte passages that occur before, found by two-stage suffix sorting in many small arrays.

A byte goes if a window of ``WIDTH`` bytes that covers it also starts earlier: in a document before, or in the same
one at an earlier place. Sorting all suffixes of a corpus in one array needs one machine, so windows are dealt first
such that equal ones meet: the least hash among a window's ``GRAM``-byte grams is the same in equal windows. Runs of
windows with one least hash are pieces of a text.

1. Texts are dealt into chunks of about ``CHUNK`` bytes by their digest, equal texts to one chunk, where only the
   first is looked at: copies of a whole text go entirely.
2. Hashes that occur in one chunk once need no look. For the others, pieces of a chunk that are equal are sent on
   once, the rest of them goes; so a passage that all documents share leaves each chunk once.
3. Pieces meet by hash in groups of about ``GROUP`` bytes, where equal ones are again taken once. The suffixes of
   what is left are sorted in two stages, and common prefixes of neighbours tell the windows that occur before.
4. A hash whose pieces would fill more than a group is dealt over several. What each leaves is at most one copy of a
   window; in a second round the windows are dealt by their own hash over as many groups, a piece going to those that
   have windows of it. No group is cut short.
5. Windows found go back to the chunks, where the bytes they cover are removed.

Results: a null text is an empty one, and both lose nothing. Nulls among identifiers come before all others; of two
texts under one identifier, the one whose digest comes first is earlier; of rows that repeat, all but one are copies.
Texts of any length are read whole, in spans of ``SPAN`` bytes. Further columns are ignored, an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.llm.common import Work
from tarnworks.llm.shingles import P1, P2
from tarnworks.llm.suffixes import repeated_windows

WIDTH, GRAM = 100, 32
CHUNK, GROUP, SPAN = 4 << 20, 1 << 20, 1 << 18
#: Windows of a piece at most.
RUN = 1 << 12
#: Bytes of an average piece.
PIECE = WIDTH + (WIDTH - GRAM) // 2
#: Digests that a task remembers in order not to send a text twice.
DIGESTS = 100_000


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place of ``raw`` where as many are left."""
    view = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    n = len(raw) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for at in range(0, GRAM, 8):
        h += view[at : at + n]
        h *= P1
        h ^= h >> np.uint64(29)
    h *= P2
    h ^= h >> np.uint64(32)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    held = 1
    while 2 * held <= width:
        h = np.minimum(h[:-held], h[held:])
        held *= 2
    return np.minimum(h[: len(h) - (width - held)], h[width - held :]) if held < width else h


def pieces(texts: list[bytes]):
    """Hash, text, first window, number of windows of each piece, and whether it holds its gram twice; span by span."""
    held, size = [], 0
    mask = np.uint64((1 << 20) - 1)

    def of_spans():
        raw = np.frombuffer(b"".join(texts[t][base : base + SPAN + WIDTH - 1] for t, base, _ in held), dtype=np.uint8)
        windows = np.array([n for *_, n in held])
        offsets = np.concatenate([[0], np.cumsum(windows + WIDTH - 1)[:-1]])
        grams = gram_hashes(raw)
        # of equal grams of a window the leftmost: its place stands in the low bits
        place = (least_of(grams & ~mask | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1) & mask).astype(np.int64)
        moves = np.flatnonzero(place[1:] != place[:-1]) + 1
        differs = grams[place[moves]] != grams[place[moves - 1]]
        cuts, twice = np.concatenate([offsets, moves[differs]]), moves[~differs]
        cuts = np.unique(np.concatenate([cuts, *(np.arange(o, o + n, RUN) for o, n in zip(offsets, windows) if n > RUN)]))
        span = np.searchsorted(offsets, cuts, side="right") - 1
        inside = cuts - offsets[span] < windows[span]
        cuts, span = cuts[inside], span[inside]
        stops = np.minimum(np.append(cuts[1:], len(raw)), (offsets + windows)[span])
        owner, base = np.array([t for t, *_ in held]), np.array([b for _, b, _ in held])
        again = np.searchsorted(twice, stops) > np.searchsorted(twice, cuts)
        return grams[place[cuts]].astype(np.int64), owner[span], cuts - offsets[span] + base[span], stops - cuts, again

    for t, text in enumerate(texts):
        for base in range(0, len(text) - WIDTH + 1, SPAN):
            windows = min(SPAN, len(text) - WIDTH + 1 - base)
            held.append((t, base, windows))
            size += windows + WIDTH - 1
            if size >= SPAN:
                yield of_spans()
                held, size = [], 0
    if held:
        yield of_spans()


def all_pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    found = list(pieces(texts))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(5))


OCCURRENCES = pa.schema([("h", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32())])


def occurrences(batches):
    """Hash, chunk and count of the pieces of each batch."""
    for batch in batches:
        texts, chunk = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        own, parts = {}, []
        for c in np.unique(chunk):
            # equal texts of a batch are one
            own[c] = list({texts[i] for i in np.flatnonzero(chunk == c)})
            for h, *_ in pieces(own[c]):
                parts.append((h, np.full(len(h), c)))
        if parts:
            h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            yield pa.record_batch([h[first], c[first].astype(np.int32), np.diff(np.append(first, len(h))).astype(np.int32)], schema=OCCURRENCES)


def once(batches):
    """Rows of chunk, digest and text but for those whose digest the task has just sent."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column(1).to_pylist()):
            if digest not in seen:
                if len(seen) >= DIGESTS:
                    seen.clear()
                seen.add(digest)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def chunk_texts(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """Digests, ascending, and texts of a chunk; the place of a text in it is its number."""
    held = dict(zip(table.column("sha").to_pylist(), table.column("text").to_pylist()))
    digests = sorted(held)
    return digests, [held[d] for d in digests]


#: A piece (its text, the hash that deals it out, over how many groups, and which of its windows count if not all), or
#: windows [start, stop) of a text that go.
FOUND = pa.schema([("h", pa.int64()), ("salts", pa.int32()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("no", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.binary()), ("own", pa.binary())])
FOUND_SQL = "h long, salts int, doc_id long, chunk int, no int, start long, stop long, text binary, own binary"


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def before(doc_id: int | None) -> tuple[bool, int]:
    """A key in which nulls come first."""
    return doc_id is not None, doc_id or 0


def pieces_of_chunk(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Each different piece whose hash occurs again, once; and as windows that go, the copies of it in this chunk."""
    digests, held = chunk_texts(texts)
    if not digests:
        return FOUND.empty_table()
    chunk = texts.column("chunk")[0].as_py()
    ids, salts = {}, {}
    for h, n, sha, doc_id in zip(*(known.column(c).to_pylist() for c in ("h", "salts", "sha", "doc_id"))):
        if sha is None:
            salts[h] = n
        else:
            ids[sha] = doc_id
    h, text, start, windows, twice = all_pieces(held)
    shared = np.fromiter(salts, dtype=np.int64, count=len(salts))
    shared.sort()
    _, place, times = np.unique(h, return_inverse=True, return_counts=True)
    again = np.flatnonzero((times[place] > 1) | twice.astype(bool) | np.isin(h, shared))
    rank = np.empty(len(held), dtype=np.int64)
    rank[sorted(range(len(held)), key=lambda t: (before(ids.get(digests[t])), t))] = np.arange(len(held))
    again = again[np.lexsort((start[again], rank[text[again]]))]
    first, rows = {}, []
    for value, t, a, n, local in zip(*(x[again].tolist() for x in (h, text, start, windows)), (times[place[again]] > 1).tolist()):
        data = held[t][a : a + n + WIDTH - 1]
        copy = (value, data) in first if local else False
        if copy:
            rows.append((value, 0, None, chunk, t, a, a + n, None, None))
        else:
            if local:
                first[value, data] = True
            rows.append((value, salts.get(value, 1), ids.get(digests[t]), chunk, t, a, a + n, data, None))
    return table_of(rows, FOUND)


def window_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``WIDTH`` bytes from each place where as many are left."""
    grams = gram_hashes(raw)
    n = len(raw) - WIDTH + 1
    h = np.zeros(n, dtype=np.uint64)
    for at in [*range(0, WIDTH - GRAM, GRAM), WIDTH - GRAM]:
        h = (h ^ h >> np.uint64(31)) * P1 + grams[at : at + n]
    return h ^ h >> np.uint64(32)


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(marks, prepend=False, append=False)).tolist()
    return list(zip(edges[::2], edges[1::2]))


def windows_before(table: pa.Table) -> pa.Table:
    """Windows that go among a group's pieces; and what stays of a hash that is dealt over several groups, dealt anew."""
    gone = table.filter(pc.is_null(table.column("text"))).select(FOUND.names)
    table = table.filter(pc.is_valid(table.column("text")))
    rows = sorted(zip(*(table.column(c).to_pylist() for c in FOUND.names)), key=lambda r: (before(r[2]), *r[3:6]))
    first, out = {}, []

    def windows(r):
        n = r[6] - r[5]
        return np.ones(n, dtype=bool) if r[8] is None else np.unpackbits(np.frombuffer(r[8], dtype=np.uint8), count=n).astype(bool)

    def goes(r, marks):
        out.extend((r[0], 0, None, r[3], r[4], r[5] + a, r[5] + b, None, None) for a, b in runs(marks))

    for r in rows:
        if first.setdefault((r[7], r[8]), r) is not r:
            goes(r, windows(r))
    if first:
        data = b"".join(text for text, _ in first)
        sizes = np.array([len(text) for text, _ in first])
        ends = np.cumsum(sizes)
        looked_at = np.zeros(len(data), dtype=bool)
        for r, begin in zip(first.values(), (ends - sizes).tolist()):
            looked_at[begin : begin + r[6] - r[5]] = windows(r)
        found = repeated_windows(data, ends, WIDTH, looked_at)
        hashes = window_hashes(np.frombuffer(data, dtype=np.uint8)) if any(r[1] > 1 for r in first.values()) else None
        for r, begin in zip(first.values(), (ends - sizes).tolist()):
            place = slice(begin, begin + r[6] - r[5])
            goes(r, found[place])
            if r[1] > 1:
                group = (hashes[place] % np.uint64(r[1])).astype(np.int64)
                group[found[place]] = -1
                for k in np.unique(group[group >= 0]).tolist():
                    own = group == k
                    a, b = int(own.argmax()), len(own) - int(own[::-1].argmax())  # what the group needs of the piece
                    mark = r[0] ^ (k + 1) * int(P1) & (1 << 63) - 1
                    out.append((mark, 1, r[2], r[3], r[4], r[5] + a, r[5] + b, r[7][a : b + WIDTH - 1], np.packbits(own[a:b]).tobytes()))
    return pa.concat_tables([gone.cast(FOUND), table_of(out, FOUND)])


KEPT = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def removed_from_chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Of each text that loses bytes: how many, in how many runs, and the digest of the rest."""
    digests, held = chunk_texts(texts)
    spans: dict[int, list] = {}
    for no, start, stop in zip(*(found.column(c).to_pylist() for c in ("no", "start", "stop"))):
        spans.setdefault(no, []).append((start, stop + WIDTH - 1))
    rows = []
    for no, own in spans.items():
        merged: list[list[int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        rest, at = hashlib.sha256(), 0
        view = memoryview(held[no])
        for a, b in merged:
            rest.update(view[at:a])
            at = b
        rest.update(view[at:])
        rows.append((digests[no], sum(b - a for a, b in merged), len(merged), rest.hexdigest()))
    return table_of(rows, KEPT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    work = Work(docs.sparkSession, "repeats")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("text"))
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    rows = work.cut(texts.groupBy("sha", "doc_id").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).cast("long").alias("n_bytes")), "rows")
    chunks = 1 + (rows.agg(F.sum("n_bytes")).first()[0] or 0) // CHUNK
    chunk = F.pmod(F.xxhash64("sha"), F.lit(chunks)).cast("int")
    texts = texts.where(F.octet_length("text") >= WIDTH).select(chunk.alias("chunk"), "sha", "text")

    met = texts.select("text", "chunk").mapInArrow(occurrences, "h long, chunk int, n int")
    own = Window.partitionBy("h")
    met = met.select("h", "chunk", F.min("chunk").over(own).alias("low"), F.max("chunk").over(own).alias("high"), F.sum("n").over(own).alias("n"))
    shared = work.cut(met.where("low < high").select("chunk", "h", F.ceil(F.col("n") * PIECE / GROUP).cast("int").alias("salts"), "n"), "shared")
    count, most = shared.agg(F.count("*"), F.max("salts")).first()
    groups = 1 + count * PIECE // GROUP

    earliest = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id").alias("doc_id")
    firsts = rows.where(F.col("n_bytes") >= WIDTH).groupBy("sha").agg(earliest).select(chunk.alias("chunk"), "sha", "doc_id")
    known = shared.select("chunk", "h", "salts").unionByName(firsts, allowMissingColumns=True)
    sent = texts.mapInArrow(once, "chunk int, sha binary, text binary")

    found = sent.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(pieces_of_chunk, FOUND_SQL)
    salt = F.xxhash64("h", F.pmod(F.xxhash64("chunk", "no", "start"), F.col("salts")))
    place = F.when(F.col("salts") > 1, salt).otherwise(F.pmod("h", F.lit(groups)))
    found = found.withColumn("place", place).groupBy("place").applyInArrow(windows_before, FOUND_SQL)
    if (most or 0) > 1:
        found = found.withColumn("place", F.pmod(F.xxhash64("h"), F.lit(16 * groups))).groupBy("place").applyInArrow(windows_before, FOUND_SQL)
    gone = found.where("text is null").select("chunk", "no", "start", "stop")
    kept = sent.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(removed_from_chunk, "sha binary, n_removed long, n_spans long, kept_sha256 string")

    first = firsts.select("sha", F.col("doc_id").alias("first_id"), F.lit(True).alias("long_enough")).join(kept, "sha", "left")
    each = rows.join(first, "sha", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copy = F.col("long_enough").isNotNull() & ~((F.col("k") == 1) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
