"""Near-duplicates within a group by shared k-mers.

Sequences are hashed where they are read (two 64-bit rolling hashes a k-mer).  A
k-mer is named by the least hash of the words of ``SEED`` characters in it, so
some dozens of neighbours have one name, and the k-mers of a name in a sequence
are a part.  A part is sent as its name, a hash of its set of k-mers and their
number.  Where a name has the same part in all sequences of a group, its k-mers
are the same in all, and are counted and linked without being sent.  Of the other
names each different part is taken from one sequence that has it, and its k-mers
are sent (88 bits of their hashes) with the number of sequences that have the part.

A task reduces what it sends to one entry each, with the least sequence that has
it and the number of sequences, and links its own repeats as stars.  Entries
travel as packed arrays to buckets by hash range, where the least sequences of
different tasks meet.  So a k-mer that a third of all sequences share is one
entry a task, and stars keep links linear: they give the components that all
pairs would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.functions.storage import dealt_into, materialize, shuffle_partitions, spread
from cladeframe.operators.components import connected_components

BASES = ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F))
#: Entries that a task holds before it reduces them.
HELD = 2_000_000
#: Entries, some 16 bytes each as they are sent, in a partition; of texts 32 characters an entry.
DEALT = 1 << 21
#: Characters of the words that name k-mers.  Longer ones make more parts, shorter ones more names that have several.
SEED = 40
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        p = np.full(max(n, 4096), np.uint64(base))
        p[0] = 1
        known = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return known[:n]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hash pairs are adjacent, and where each run begins in it."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    begin = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, np.int64)
    return order, begin


def _rolling(code: np.ndarray, k: int, salt: int, base: int) -> np.ndarray:
    """Hashes of all windows of ``k`` characters."""
    n = len(code)
    # prefix sums of mix(c_j) b**j modulo 2**64; b is odd, so b**-i brings a window to its own power
    sums = np.r_[np.uint64(0), np.cumsum(_mix(code.astype(np.uint64), salt) * _power(base, n), dtype=np.uint64)]
    return (sums[k:] - sums[:-k]) * _power(pow(base, -1, 1 << 64), n)[: n - k + 1]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    now = 1
    while now < width:
        step = min(now, width - now)
        x = np.minimum(x[:-step], x[step:])
        now += step
    return x


def _kmers(code: np.ndarray, k: int, min_distinct: int, forbidden: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each distinct valid k-mer, and one place of it, in the order of places."""
    none = np.empty(0, np.uint64)
    n = len(code)
    if n < k:
        return none, none, np.empty(0, np.int64)
    starts = n - k + 1
    # A character counts in the windows from after its last occurrence, or k - 1 back, up to itself.
    by = np.argsort(code.astype(np.uint16) if code.max() < 65536 else code, kind="stable")
    last = np.full(n, -1, np.int64)
    same = code[by[1:]] == code[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    at = np.arange(n)
    first = np.maximum(last + 1, at - k + 1)
    step = np.bincount(first, minlength=n + 1)
    step[1:] -= 1
    ok = np.cumsum(step)[:starts] >= min_distinct
    bad = np.zeros(n, bool)
    for c in forbidden:
        bad |= code == ord(c)
    if bad.any():
        upto = np.r_[0, np.cumsum(bad)]
        ok &= upto[k:] == upto[:-k]
    if not ok.any():
        return none, none, np.empty(0, np.int64)
    h1, h2 = (_rolling(code, k, salt, base)[ok] for salt, base in BASES)
    order, begin = _runs(h1, h2)
    one = np.sort(order[begin])
    return h1[one], h2[one], np.flatnonzero(ok)[one]


def _code(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("utf-32-le"), np.uint32)


def rolling_kmers(seq: str, k: int, min_distinct: int, forbidden: str) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each distinct valid k-mer of a sequence."""
    return _kmers(_code(seq), k, min_distinct, forbidden)[:2]


def named_kmers(seq: str, k: int, min_distinct: int, forbidden: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each distinct valid k-mer and its name, which depends on the k-mer only: the least hash of its words of ``seed`` characters."""
    code = _code(seq)
    h1, h2, at = _kmers(code, k, min_distinct, forbidden)
    if not len(at):
        return h1, h2, h1
    name = _least(_mix(_rolling(code, seed, *BASES[0]), 3) >> np.uint64(64 - SENT[0]), k - seed + 1)
    return h1, h2, name[at]


def kmer_parts(seq: str, k: int, min_distinct: int, forbidden: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name of a sequence's k-mers, a hash of the set of k-mers that have it, and their number."""
    h1, h2, name = named_kmers(seq, k, min_distinct, forbidden, seed)
    if not len(name):
        return name, name, np.empty(0, np.int64)
    begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    size = np.diff(np.r_[begin, len(name)])
    part = np.add.reduceat(_mix(h1 ^ _mix(h2, 5), 7), begin)
    by = np.argsort(name[begin])
    name, part, size = name[begin][by], part[by], size[by]
    begin = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    return name[begin], np.add.reduceat(part, begin), np.add.reduceat(size, begin)


def _stars(ids: np.ndarray, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least id of each run, and the distinct links from least ids to the others."""
    ids = ids[order]
    least = np.minimum.reduceat(ids, begin) if len(begin) else np.empty(0, np.int64)
    src = np.repeat(least, np.diff(np.r_[begin, len(ids)]))
    other = ids != src
    src, dst = src[other], ids[other]
    by = np.lexsort((dst, src))
    src, dst = src[by], dst[by]
    new = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])] if len(src) else np.zeros(0, bool)
    return least, src[new], dst[new]


PACKED = ("h1", "h2", "least", "n", "kmers", "src", "dst")
#: Bits of a k-mer's hashes that are sent, 88 in all: of 10**10 k-mers two are taken for one with a chance of 2e-7.
#: Names have as many as the first; the hash of a part is sent whole.
SENT = (40, 48)


def _gaps(h: np.ndarray) -> bytes:
    """Sorted numbers as the first of them and differences."""
    return h[:1].tobytes() + _narrow(np.diff(h))


def _from_gaps(b: pa.Buffer, n: int) -> np.ndarray:
    return np.cumsum(np.r_[np.frombuffer(b, np.uint64, 1), _wide(b, n - 1, 8)], dtype=np.uint64)


def _narrow(x: np.ndarray) -> bytes:
    """64-bit numbers in as many bytes each as the largest needs; a negative one needs all."""
    width = max(1, (int(x.view(np.uint64).max(initial=0)).bit_length() + 7) // 8)
    return x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(b: pa.Buffer, n: int, begin: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        narrow = np.frombuffer(b, np.uint8, offset=begin).reshape(n, -1)
        out[:, : narrow.shape[1]] = narrow
    return out.view(np.uint64).ravel()


def _reduced(rows: DataFrame, entries: Callable, buckets: int) -> DataFrame:
    """(grp, bucket, packed arrays) for each task, group and bucket.

    ``rows`` is (grp, id, seq) and what else ``entries`` takes: it makes a
    sequence's entries, two hashes, a number of sequences and one of k-mers each.
    """
    kind = rows.schema["grp"]
    schema = T.StructType([kind, T.StructField("bucket", T.IntegerType()), T.StructField("size", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in PACKED)])
    edges = np.array([-(-(j << SENT[0]) // buckets) for j in range(1, buckets)], dtype=np.uint64)

    def flush(groups: dict, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
        for g, held in groups.items():
            h1, h2, n, size, ids = (np.concatenate(x) for x in zip(*held))
            order, begin = _runs(h1, h2)
            least, src, dst = _stars(ids, order, begin)
            n, one = np.add.reduceat(n[order], begin), order[begin]
            h1, h2, size = h1[one], h2[one], size[one]
            cuts = [0, *np.searchsorted(h1, edges), len(h1)]
            out: list[list] = [[] for _ in range(2 + len(PACKED))]
            for j in range(buckets):
                a, b = cuts[j], cuts[j + 1]
                if a < b:
                    links = (src, dst) if not out[0] else (src[:0], dst[:0])  # links go with the first row
                    packed = (_gaps(h1[a:b]), *(_narrow(x[a:b]) for x in (h2, least, n, size)), *(x.tobytes() for x in links))
                    for r, v in zip(out, (j, int(b - a), *packed)):
                        r.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(out[0]), arrow), *(pa.array(r, pa.int32()) for r in out[:2]), *(pa.array(r, pa.binary()) for r in out[2:])], names=["grp", "bucket", "size", *PACKED]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        held, arrow = 0, None
        for b in batches:
            arrow = b.column(0).type
            for g, i, *own in zip(*(b.column(j).to_pylist() for j in range(3)), *(b.column(j) for j in range(3, b.num_columns))):
                found = entries(*own)
                if len(found[0]):
                    groups.setdefault(g, []).append((*found, np.full(len(found[0]), i, np.int64)))
                    held += len(found[0])
                if held >= HELD:
                    yield from flush(groups, arrow)
                    groups, held = {}, 0
        if groups:
            yield from flush(groups, arrow)

    return rows.mapInArrow(run, schema)


MET = ("src", "dst", "n_shared", "n_postings", "name", "n", "n_kmers")


def _meet(t: pa.Table, parts: bool) -> pa.Table:
    """Of one bucket links between the least sequences of its entries, those made before, and its counts.

    Of parts, names that have several are told: a sequence that has the part, the
    number of sequences and of k-mers.
    """
    flat = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(c)])
    sizes = t.column("size").to_pylist()
    h1 = np.concatenate([_from_gaps(x.as_buffer(), k) for x, k in zip(t.column("h1"), sizes)])
    h2, ids, n, kmers = (np.concatenate([_wide(x.as_buffer(), k) for x, k in zip(t.column(c), sizes)]) for c in ("h2", "least", "n", "kmers"))
    ids, n, kmers = ids.view(np.int64), n.view(np.int64), kmers.view(np.int64)
    order, begin = _runs(h1, h2)
    least, src, dst = _stars(ids, order, begin)
    src, dst = np.r_[flat("src", np.int64), src], np.r_[flat("dst", np.int64), dst]
    n, kmers, h1 = np.add.reduceat(n[order], begin), kmers[order[begin]], h1[order[begin]]
    same = h1[1:] == h1[:-1]
    several = (np.r_[same, False] | np.r_[False, same]) & parts
    shared = (n > 1) & ~several
    here = {
        "links": (src, dst, None, None, None, None, None),
        "counts": (None, None, kmers[shared].sum(keepdims=True), (n * kmers)[shared].sum(keepdims=True), None, None, None),
        "several": (least[several], None, None, None, h1[several].view(np.int64), n[several], kmers[several]),
    }
    size = {c: next(len(x) for x in v if x is not None) for c, v in here.items()}
    columns = [pa.chunked_array([pa.nulls(size[c], pa.int64()) if v[j] is None else pa.array(v[j], pa.int64()) for c, v in here.items()]) for j in range(len(MET))]
    grp = t.column("grp")[0].as_py()
    return pa.table([pa.array([grp] * sum(size.values()), t.column("grp").type), *columns], names=["grp", *MET])


def _met(packed: DataFrame, parts: bool) -> DataFrame:
    schema = T.StructType([packed.schema["grp"], *(T.StructField(c, T.LongType()) for c in MET)])
    return packed.groupBy("grp", "bucket").applyInArrow(lambda t: _meet(t, parts), schema)


def kmer_meetings(seqs: DataFrame, k: int = 100, min_distinct: int = 15, id_col: str = "protein_id", group_col: str = "species_id", seq_col: str = "seq", forbidden: str = "X*") -> DataFrame:
    """(grp, src, dst, n_shared, n_postings): links, and rows of counts without a link.

    Ids must be unique.  Sequences shorter than ``k``, null ones among them, have none.
    """
    rows = seqs.select(F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(seq_col).cast("string").alias("seq"))
    total, seed = rows.agg(F.sum(F.length("seq"))).first()[0] or 0, min(k, SEED)
    # 32 bytes an entry, 16 MB a bucket
    buckets = lambda entries: max(shuffle_partitions(seqs.sparkSession), min(4096, entries * 32 // (16 << 20)))

    def parts(seq: str | None) -> tuple[np.ndarray, ...]:
        name, part, size = kmer_parts(seq or "", k, min_distinct, forbidden, seed)
        return name, part, np.ones(len(name), np.int64), size

    def kmers(seq: str, of: pa.ListScalar) -> tuple[np.ndarray, ...]:
        h1, h2, name = named_kmers(seq, k, min_distinct, forbidden, seed)
        told = np.asarray(of.values.field("name")).astype(np.uint64)
        by = np.argsort(told)
        at = np.minimum(np.searchsorted(told[by], name), len(told) - 1)
        kept = told[by][at] == name
        h1, h2 = (h[kept] >> np.uint64(64 - bits) for h, bits in zip((h1, h2), SENT))
        return h1, h2, np.asarray(of.values.field("n"))[by][at[kept]], np.ones(len(h1), np.int64)

    own = 2 * total // (k - seed + 2)
    with dealt_into(seqs.sparkSession, own // DEALT):
        met = materialize(_met(_reduced(spread(rows), parts, buckets(own)), True), "kmer-parts")
    several = met.where("name IS NOT NULL")
    counted = ["grp", *MET[:4]]
    out = met.where("name IS NULL").select(counted)
    left = several.agg(F.sum("n_kmers")).first()[0]
    if not left:
        return out
    of = several.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("name", "n")).alias("of"))
    again = rows.join(of.hint("shuffle_hash"), "id").select("grp", "id", "seq", "of")
    with dealt_into(seqs.sparkSession, max(left // DEALT, total // (32 * DEALT))):
        return out.unionByName(materialize(_met(_reduced(again, kmers, buckets(left)), False).select(counted), "kmers"))


def valid_kmers(seqs: DataFrame, k: int = 100, min_distinct: int = 15, id_col: str = "protein_id", seq_col: str = "seq", forbidden: str = "X*") -> DataFrame:
    """(id, n_valid): the distinct k-mers of each sequence that count, as the clusters see them."""
    rows = seqs.select(F.col(id_col).alias("id"), F.col(seq_col).cast("string").alias("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(rolling_kmers(s or "", k, min_distinct, forbidden)[0]) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_valid"])

    return spread(rows).mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("n_valid", T.LongType())]))


def kmer_links(seqs: DataFrame, k: int = 100, min_distinct: int = 15, id_col: str = "protein_id", group_col: str = "species_id", seq_col: str = "seq") -> DataFrame:
    """(grp, src, dst): stars over the sequences that share a k-mer."""
    return kmer_meetings(seqs, k, min_distinct, id_col, group_col, seq_col).where("src IS NOT NULL").select("grp", "src", "dst")


def shared_kmers(seqs: DataFrame, k: int = 100, min_distinct: int = 15, id_col: str = "protein_id", group_col: str = "species_id", seq_col: str = "seq") -> DataFrame:
    """(grp, n_shared, n_postings): k-mers of a group that several sequences have, and how many have them."""
    out = kmer_meetings(seqs, k, min_distinct, id_col, group_col, seq_col).where("n_shared IS NOT NULL")
    return out.groupBy("grp").agg(F.sum("n_shared").alias("n_shared"), F.sum("n_postings").alias("n_postings"))


def kmer_clusters(seqs: DataFrame, k: int = 100, min_distinct: int = 15, id_col: str = "protein_id", group_col: str = "species_id", seq_col: str = "seq") -> DataFrame:
    """(rep_id, member_id, grp) for every sequence; the longest of a cluster represents it, ties by id.

    Ids must be unique.  Sequences without a shared k-mer represent themselves.
    """
    comps = connected_components(kmer_links(seqs, k, min_distinct, id_col, group_col, seq_col))
    rows = seqs.select(F.col(id_col).cast("long").alias("member_id"), F.col(group_col).alias("grp"), F.coalesce(F.length(seq_col), F.lit(0)).alias("size"))
    named = materialize(
        rows.join(comps, rows["member_id"] == comps["node"], "left").select("member_id", "grp", "size", F.coalesce("component", "member_id").alias("component")),
        "clusters",
    )
    reps = named.groupBy("component").agg(F.max_by("member_id", F.struct("size", -F.col("member_id"))).alias("rep_id"))
    return named.join(reps, "component").select("rep_id", "member_id", "grp")
