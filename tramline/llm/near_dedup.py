"""MinHash near-duplicate detection with fast similarity sketching.

Every document becomes its set of word shingles.  The set is sketched by rounds
of hashed bin placement (Dahlgaard, Knudsen and Thorup 2017): in round i every
element goes to one random bin, an unfilled bin keeps the round's smallest
value, and after as many rounds as bins each bin is offered all elements, so
every coordinate is filled.  Bands of coordinates give candidate buckets.  Each
link is confirmed on the full sets, whose shingles are told apart by their words.

Documents whose words are the same are reduced to one first.  Within a bucket
documents are compared with a lead, the member with the most companions, and
with the lead that they share most buckets with.  Documents of a bucket that are
still apart afterwards are compared with each other, where their sizes, the
shingles that no other document has and their distances from the common lead
leave the threshold possible.  A link between two documents of the same
component says nothing new and isn't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import kernel as K
from tramline.llm.graph import Scratch, connected_components, numbered_rows

_SKETCH = "row long, doc_id long, n_shingles long, text_a long, text_b long, bands array<long>"


def sketches(x: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The sketch, a row of `bins` coordinates, of each of n sets of 64-bit hashes; owner has the set of each x."""
    out = np.zeros((n, bins), dtype=K.U64)
    flat = out.reshape(-1)
    filled = np.zeros(flat.shape, dtype=bool)
    owner = owner.astype(np.int64)
    shift = K.U64(bins.bit_length() - 1)
    worst = K.U64(2**64 - 1)
    for i in range(bins):
        if not len(x):
            return out
        h = K.mix(x, i + 1)
        at = owner * bins + (h & K.U64(bins - 1)).astype(np.int64)
        free = ~filled[at]
        at, h = at[free], h[free] >> shift
        flat[at] = worst
        np.minimum.at(flat, at, h)
        filled[at] = True
        if i < 16 or i % 16 == 0:  # sets whose bins are all filled take part no longer
            open_ = ~filled.reshape(n, bins).all(axis=1)
            left = open_[owner]
            x, owner = x[left], owner[left]
    for j in range(bins):
        if not len(x):
            return out
        at = owner * bins + j
        free = ~filled[at]
        at, h = at[free], K.mix(x[free], bins + j + 1) >> shift
        flat[at] = worst
        np.minimum.at(flat, at, h)
        filled[at] = True
    return out


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bins: int, rows: int) -> Iterator[pa.RecordBatch]:
    bands = bins // rows
    for whole in batches:
        for batch in K.slices(whole):
            data, offs = K.text_bytes(batch.column("text"))
            data = K.lower_ascii(data)
            owner, x, _ = K.shingle_numbers(data, offs, words)
            n = batch.num_rows
            size = np.bincount(owner, minlength=n)
            some = np.flatnonzero(size)
            place = np.cumsum(size > 0) - 1
            sk = sketches(x, place[owner], len(some), bins)
            keys = np.zeros((len(some), bands), dtype=K.U64)
            for r in range(rows):
                keys = K.mix(keys * K.U64(3) + sk[:, r : bands * rows : rows])
            keys = K.mix(keys + np.arange(bands, dtype=K.U64) * K.U64(0x2545F4914F6CDD1D))
            full = np.zeros(n, dtype=np.int64)
            full[some] = bands
            same = b"".join(_digest(data[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
            same = np.frombuffer(same, np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(size.astype(np.int64)),
                    pa.array(same[:, 0]), pa.array(same[:, 1]), _lists(full, K.signed(keys.reshape(-1))),
                ],
                names=["row", "doc_id", "n_shingles", "text_a", "text_b", "bands"],
            )


def _digest(text: bytes) -> bytes:
    """128 bits that stand for the sequence of words."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _shingles(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The hashes of each row's distinct shingles, one row each."""
    for whole in batches:
        for batch in K.slices(whole):
            data, offs = K.text_bytes(batch.column("text"))
            owner, x, _ = K.shingle_numbers(K.lower_ascii(data), offs, words)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), pa.array(K.signed(x))], names=["row", "shingle"])


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def _led(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    """Members with their lead's shingles: rows come by lead, the lead's own text first.

    Yields member and lead columns, and hashes, numbers, the lead's range in them
    and each member's (one bound more than members).
    """
    lead, text = None, np.zeros(0, np.uint8)  # that of the slice before
    for whole in batches:
        for batch in K.slices(whole):
            data, offs = K.text_bytes(batch.column("text"))
            data = K.lower_ascii(data)
            member, of, rank = (np.asarray(batch.column(c)) for c in ("member", "lead", "rank"))
            own = np.flatnonzero(rank == 0)
            # Row 0 is the last lead's text again; shingles are numbered in one call, so that equal numbers are equal words.
            owner, h, which = K.shingle_numbers(np.concatenate([text, data]), np.concatenate([[0], offs + len(text)]), words)
            first = np.searchsorted(owner, np.arange(len(rank) + 2))
            for head, a, b in zip([0, *(own + 1)], [0, *(own + 1)], [*own, len(rank)], strict=True):  # the text in row `head` leads the batch's rows a to b, which are one further on here
                if b > a and (head > 0 or lead is not None):
                    yield member[a:b], of[a:b], h, which, slice(first[head], first[head + 1]), first[a + 1 : b + 2]
            if len(own):
                last = int(own[-1])
                lead, text = of[last], data[offs[last] : offs[last + 1]].copy()


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """How far apart each pair is and whether it is linked."""
    for member, lead, _, which, mine, bounds in _led(batches, words):
        mark = np.zeros(int(which.max(initial=-1)) + 1, bool)
        mark[which[mine]] = True
        hit = mark[which[bounds[0] : bounds[-1]]]
        size = np.diff(bounds)
        both = np.add.reduceat(np.append(hit, False).astype(np.int64), np.minimum(bounds[:-1] - bounds[0], len(hit)))
        both[size == 0] = 0
        union = size + (mine.stop - mine.start) - both
        linked = (both > 0) & (100 * both >= percent * union)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (member, lead, union - both, linked)], names=["u", "v", "apart", "linked"])


def _differences(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the shingles that only one of a pair has, told apart by which; null where two of them are equal."""
    for member, lead, h, which, mine, bounds in _led(batches, words):
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            gone = ~np.isin(which[mine], which[a:b], assume_unique=True)
            new = ~np.isin(which[a:b], which[mine], assume_unique=True)
            x = np.concatenate([K.mix(h[mine][gone], 21), K.mix(h[a:b][new], 22)])
            out.append(K.signed(x) if len(np.unique(x)) == len(x) else None)
        yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(lead), pa.array(out, pa.list_(pa.int64()))], names=["row", "center", "diff"])


def _with_leads(pairs: DataFrame, texts: DataFrame, work: Scratch, block: int = 256) -> DataFrame:
    """The texts of the pairs (member, lead) as _led() wants them.

    A lead with many members is given to several tasks, `block` members or so
    each, and its text goes along to all of them.
    """
    pairs = work.keep(pairs.select("member", "lead").distinct())
    leads = work.keep(pairs.groupBy("lead").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    members = pairs.join(leads, "lead").select(
        F.col("member").alias("row"), "lead", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("rank")
    )
    own = leads.select(F.col("lead").alias("row"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("rank"))
    return (
        texts.join(members.unionByName(own), "row")
        .select(F.col("row").alias("member"), "lead", "part", "rank", "text")
        .repartition("lead", "part")
        .sortWithinPartitions("lead", "part", "rank")
        .select("member", "lead", "rank", "text")
    )


def _compared(pairs: DataFrame, texts: DataFrame, work: Scratch, words: int, percent: int) -> DataFrame:
    """The pairs (member, lead) as u and v with the number of shingles that only one of them has, and whether they are linked."""
    rows = _with_leads(pairs, texts, work)
    return work.keep(rows.mapInArrow(lambda it: _confirm(it, words, percent), "u long, v long, apart long, linked boolean"))


def _components(docs: DataFrame, work: Scratch, words: int, percent: int, bins: int, rows: int) -> DataFrame:
    """(row, doc_id, n_shingles, component) of docs, which has row, doc_id and text; rows are unique."""
    sk = work.keep(docs.mapInArrow(lambda it: _sketch(it, words, bins, rows), _SKETCH))
    # Equal texts first: only one document of each goes on.
    reps = work.keep(
        sk.where("n_shingles > 0").groupBy("text_a", "text_b").agg(F.min(F.struct("row", "n_shingles", "bands")).alias("x"))
        .select("text_a", "text_b", "x.*")
    )
    hashed = reps.select("row", "n_shingles", F.explode("bands").alias("key"))
    live = work.keep(hashed.join(hashed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    # A bucket is led by its document with the most companions in all of its buckets: the middle of a group of copies.
    middle = live.groupBy("row").agg(F.sum("n").alias("near"))
    lead = (
        live.join(middle, "row").groupBy("key").agg(F.max(F.struct("near", (-F.col("row")).alias("minus"), F.col("n_shingles").alias("lead_size"))).alias("x"))
        .select("key", "x.near", "x.minus", "x.lead_size")
    )
    possible = 100 * F.least("n_shingles", "lead_size") >= percent * F.greatest("n_shingles", "lead_size")
    shared = work.keep(
        live.join(lead, "key").where(F.col("row") != -F.col("minus"))
        .groupBy(F.col("row").alias("member"), "near", "minus").agg(F.count("*").alias("shared"), F.max(possible).alias("possible"))
    )
    # Each document is compared with its center, the lead in the middle of its largest group,
    # and of the leads of fitting size with the most central one and the one that it shares most bands with.
    best = work.keep(
        shared.groupBy("member").agg(
            F.max(F.struct("near", "minus")).alias("center"),
            *(F.max(F.when(F.col("possible"), F.struct(*order, "minus"))).alias(n) for n, order in (("a", ("near", "shared")), ("b", ("shared", "near")))),
        ).select("member", (-F.col("center.minus")).alias("center"), (-F.col("a.minus")).alias("a"), (-F.col("b.minus")).alias("b"))
    )
    stars = best.select("member", F.explode(F.array("center", "a", "b")).alias("lead")).where("lead IS NOT NULL")
    texts = work.keep(docs.select("row", "text").join(live.select("row").distinct(), "row"))
    tested = _compared(stars, texts, work, words, percent)
    comp = connected_components(tested.where("linked").select("u", "v"), work)
    # What still is apart within a bucket.
    own = live.select("key", "row").join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = work.keep(own.join(mixed, "key"))
    if not rest.isEmpty():
        tested = tested.unionByName(_residual(rest, best, tested, reps, texts, work, words, percent))
        work.drop(comp)
        comp = connected_components(tested.where("linked").select("u", "v"), work)
    work.drop(live, shared, best, texts, rest)
    final = (
        reps.select("text_a", "text_b", F.col("row").alias("node")).join(comp, "node", "left")
        .select("text_a", "text_b", F.coalesce("component", "node").alias("component"))
    )
    plain = sk.select("row", "doc_id", "n_shingles", "text_a", "text_b")
    out = work.keep(
        plain.where("n_shingles > 0").join(final, ["text_a", "text_b"]).select("row", "doc_id", "n_shingles", "component")
        .unionByName(plain.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("row").alias("component")))
    )
    work.drop(sk, reps, comp)
    return out


def _residual(rest: DataFrame, best: DataFrame, tested: DataFrame, reps: DataFrame, texts: DataFrame, work: Scratch, words: int, percent: int) -> DataFrame:
    """The pairs that can still be linked within the buckets of `rest`, compared.

    A shingle of one document only is in no intersection; sizes within the
    threshold lie in one class of sizes or in neighbouring ones; and two documents
    with one center are as far apart as their differences from it are.  These are
    bounds, so no link is lost by them.
    """
    some = rest.select("row").distinct()
    near = (
        tested.select(F.col("u").alias("member"), F.col("v").alias("center"), "apart").join(best.select("member", "center"), ["member", "center"])
        .select(F.col("member").alias("row"), "center", "apart").join(some, "row")
    )
    counted = some.unionByName(near.select(F.col("center").alias("row"))).distinct()
    alone = (
        texts.join(counted, "row").mapInArrow(lambda it: _shingles(it, words), "row long, shingle long")
        .groupBy("shingle").agg(F.min("row").alias("row"), F.max("row").alias("last")).where("row = last")
        .groupBy("row").agg(F.count("*").alias("alone"))
    )
    step = F.log(F.lit(100 / percent)) if percent < 100 else F.lit(1.0)
    sized = work.keep(
        reps.select("row", "n_shingles").join(some, "row").join(alone, "row", "left").select(
            "row", "n_shingles", F.coalesce("alone", F.lit(0)).alias("alone"), F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("int").alias("class")
        ).where(100 * (F.col("n_shingles") - F.col("alone")) >= percent * F.col("n_shingles"))
    )
    # Where a document is closer to its center than it is long, what sets it apart says more than the sizes do.
    close = near.join(sized, "row").where("apart <= n_shingles").select(F.col("row").alias("member"), F.col("center").alias("lead"))
    diffs = work.keep(_with_leads(close, texts, work).mapInArrow(lambda it: _differences(it, words), "row long, center long, diff array<long>"))
    left = work.keep(rest.join(sized, "row").join(diffs, "row", "left"))
    # Rounding may put a pair at the very threshold one class further apart.
    right = left.select("key", F.explode(F.sequence(F.col("class") - 2, F.col("class") + 2)).alias("class"), *(F.col(c).alias(f"r_{c}") for c in left.columns if c not in ("key", "class")))
    both = F.least(F.col("n_shingles") - F.col("alone"), F.col("r_n_shingles") - F.col("r_alone"))
    apart = F.size("diff") + F.size("r_diff") - 2 * F.size(F.array_intersect("diff", "r_diff"))
    far = (F.col("center") == F.col("r_center")) & ((100 + percent) * apart > (100 - percent) * (F.col("n_shingles") + F.col("r_n_shingles")))
    pairs = (
        left.join(right, ["key", "class"])
        .where(
            (F.col("row") > F.col("r_row")) & (F.col("component") != F.col("r_component"))
            & (100 * both >= percent * (F.col("n_shingles") + F.col("r_n_shingles") - both)) & ~F.coalesce(far, F.lit(False))
        )
        .select(F.col("row").alias("member"), F.col("r_row").alias("lead"))
        .distinct()
        .join(tested.select(F.greatest("u", "v").alias("member"), F.least("u", "v").alias("lead")), ["member", "lead"], "left_anti")
    )
    return _compared(pairs, texts, work, words, percent)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    Returns (doc_id, n_shingles, component_id, kept) with one row per input row;
    other columns are ignored, whatever their names.  A pair at a similarity of
    exactly 0.8 shares none of the 42 bands of 6 coordinates in 3 of 10**6 cases,
    a pair at 0.85 in 1 of 10**9; nothing else loses a link.  Null or empty texts,
    and texts without words, have no shingles and are linked with nothing.

    component_id is the smallest id in the component, and kept says whether it is
    the row's own.  Rows that repeat an id are documents of their own, so equal
    ones are all kept or all not.  A row without an id is kept and belongs to no
    component; deduplicated() judges such rows as well.
    """
    work = Scratch(documents.sparkSession)
    all_ = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs, odd = numbered_rows(all_.where("doc_id IS NOT NULL"), work)
    out = _components(docs, work, words, percent, bins, rows)
    if odd:
        least = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = out.join(least, "component")
    else:
        out = out.withColumn("component_id", F.col("component"))
    nameless = all_.where("doc_id IS NULL").withColumn("row", F.col("doc_id")).mapInArrow(lambda it: _sketch(it, words, bins, rows), _SKETCH)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(
        nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    )


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bins: int = 256, rows: int = 6) -> DataFrame:
    """One row of each component of near_duplicates(), with all columns of documents.

    The row with the smallest id stays, any of them where several have it, and one
    without an id only where all are.  Rows without words all stay.
    """
    work = Scratch(documents.sparkSession)
    whole = F.struct(*(documents[c].alias(f"c{i}") for i, c in enumerate(documents.columns) if c != text_col), F.lit(0).alias("c"))
    packed = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].alias("text"), whole.alias("rest"))
    docs, odd = numbered_rows(packed, work)
    out = _components(docs.select("row", "doc_id", "text"), work, words, percent, bins, rows)
    if odd:
        first = out.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("x.row")
        gone = out.select("row").join(first, "row", "left_anti")
    else:
        gone = out.where("row <> component").select("row")
    return docs.join(gone, "row", "left_anti").select(*((F.col("text") if c == text_col else F.col("rest")[f"c{i}"]).alias(c) for i, c in enumerate(documents.columns)))
