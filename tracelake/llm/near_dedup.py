"""MinHash near-dedup: one-permutation hashing, densified, banded, star edges.

One hash of each shingle fills every bin of a signature (one permutation);
empty bins copy a filled one picked by a random order of their own (optimal
densification). Bands of the signature deal the distinct sets into buckets, and
a bucket gives only edges to its centre: fewer edges than members. Edges are
confirmed on whole sets. What a star can miss, a link between two members that
are not linked to the centre, is found exactly: buckets that still hold several
components are gathered to clusters and finished block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import common as C

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Bands whose stars are confirmed before those of all others are looked at.
EARLY_BANDS = 4
#: Most sets that one task compares with as many others when clusters are finished. A cluster has PARTS blocks at least, of LEAST_BLOCK sets or more.
BLOCK, PARTS, LEAST_BLOCK = 4096, 16, 128
#: Shingles of all sets of a block, which bounds a task's memory when sets are long.
BLOCK_SHINGLES = 4 << 20
#: Postings that a task looks at in one step.
POSTINGS = 1 << 22

_rng = np.random.Generator(np.random.PCG64(77))
_PROBE = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
#: From here on nodes have names that aren't ids: sets of rows without an id, and further sets of a repeated id.
UNNAMED = 1 << 62
_BAND_CODE = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each text with a word, and its sorted distinct shingle hashes."""
    for lo, hi, buf, offsets in C.slices(texts):
        starts, ends, doc = C.words(buf, offsets)
        hashes = C.hash_ranges(buf, starts, ends, C.BYTE_CODE_LOWER)
        grams, first = C.word_grams(hashes, doc, width)
        of = doc[first] if len(first) else np.zeros(0, np.int64)
        at = np.searchsorted(of, np.arange(hi - lo + 1))
        words_at = np.searchsorted(doc, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if at[k + 1] > at[k]:
                yield lo + k, np.unique(grams[at[k] : at[k + 1]])
            elif n := int(words_at[k + 1] - words_at[k]):
                few = hashes[words_at[k] : words_at[k + 1]]
                total = np.uint64(n)
                for j in range(n):
                    total = np.uint64((int(total) + int(few[j]) * int(C.STEPS[j])) % (1 << 64))
                yield lo + k, C.mix(np.array([total], np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin has that of the first filled one in its own order."""
    at = np.searchsorted(shingles, _EDGES)
    filled = at < np.append(at[1:], len(shingles))
    values = shingles[np.minimum(at, len(shingles) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _PROBE[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    return C.mix((values.reshape(BANDS, ROWS) * C.STEPS[:ROWS]).sum(1, dtype=np.uint64) + _BAND_CODE)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, keys, rows = np.zeros(n, np.int64), [None] * n, [None] * n
            for k, found in shingle_sets(C.rows_of(batch, "text"), width):
                sizes[k], keys[k], rows[k] = len(found), _set_key(found), bands(signature(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], schema=schema)

    return run


def _whole_sets(width: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, rows, ids = [], [], batch.column("rep").to_pylist()
            for k, found in shingle_sets(C.rows_of(batch, "text"), width):
                reps.append(ids[k])
                rows.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], schema=schema)

    return run


def connected(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).

    Every round each node hooks to its smallest neighbour if that is smaller, and
    follows the hooks to their end; edges move to those ends, and those within
    one node go. Of the nodes with an edge at most half are left, so rounds and
    passes are few for chains of any length. State is written between them; a
    round without edges ends the loop.
    """
    both = C.materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = None
    for _ in range(max_rounds):
        hooks = C.materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("end")))
        while True:
            # Each pass doubles how far a node has followed the hooks, until all are at the smallest of their tree.
            onward = hooks.select(F.col("node").alias("end"), F.col("end").alias("onward"))
            passed = C.materialize(hooks.join(onward, "end").select("node", "end", "onward"))
            hooks = passed.select("node", F.col("onward").alias("end"))
            if not passed.where("end <> onward").limit(1).count():
                break
        if labels is None:
            labels = hooks.withColumnRenamed("end", "component")
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "component"), "component", "left")
            labels = C.materialize(moved.select("node", F.coalesce("end", "component").alias("component")))
        ends = both.join(hooks.withColumnRenamed("node", "a"), "a").select(F.col("end").alias("from"), "b").join(hooks.withColumnRenamed("node", "b"), "b")
        both = C.materialize(ends.where(F.col("from") != F.col("end")).select(F.col("from").alias("a"), F.col("end").alias("b")).distinct())
        if not both.limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _forest(labels: DataFrame) -> DataFrame:
    """One edge for each labelled node, to the component's smallest: joins what all edges did."""
    return labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= percent * union."""
    left = edges.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    pairs = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return checked.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def _mixed_buckets(crowded: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """crowded with each node's component; and the buckets that hold more than one, with their centre's component, their smallest component and size."""
    labelled = C.materialize(crowded.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", "centre", F.coalesce("component", "rep").alias("component")))
    parts = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("rep") == F.col("centre"), F.col("component"))).alias("of_centre"), F.count(F.lit(1)).alias("n")
    )
    return labelled, C.materialize(parts.where("low < high").select("bucket", "of_centre", "low", "n"))


def links_in_block(left: list[int], right: list[int], sets: list[np.ndarray], group: list[int], percent: int) -> list[tuple[int, int]]:
    """Enough links between members of left and right to join all of their components that any link joins.

    left and right hold row numbers of sets; group is each row's component so far.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = sorted({*left, *right})
    place = {row: k for k, row in enumerate(used)}
    sizes = np.array([len(sets[row]) for row in used])
    values, column = np.unique(np.concatenate([sets[row] for row in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), sizes)
    by_column = np.argsort(column, kind="stable")
    posting, begins = owner[by_column], np.searchsorted(column[by_column], np.arange(len(values) + 1))
    ends = np.cumsum(sizes)
    side = np.zeros(len(used), bool)
    side[[place[row] for row in right]] = True
    found = []
    # Members outside the largest component are few; a link within it changes nothing.
    count: dict[int, int] = {}
    for row in used:
        count[group[row]] = count.get(group[row], 0) + 1
    largest = max(count, key=lambda g: (count[g], -g))
    labels = np.array([group[row] for row in used])
    tops: set[int] = {place[r] for r in left}
    for k in range(len(used)):
        other = side.copy() if k in tops else np.zeros(len(used), bool)
        if side[k]:
            other[list(tops)] = True
        columns = column[ends[k] - sizes[k] : ends[k]]
        width = begins[columns + 1] - begins[columns]
        if labels[k] == largest or 100 * int((width > 1).sum()) < percent * sizes[k]:
            continue
        columns, width = columns[width > 1], width[width > 1]
        shared = np.zeros(len(used), np.int64)
        step = max(1, POSTINGS // len(used))
        for c in range(0, len(columns), step):
            some = width[c : c + step]
            at = np.repeat(begins[columns[c : c + step]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
            shared += np.bincount(posting[at], minlength=len(used))
        close = (100 * shared >= percent * (sizes + sizes[k] - shared)) & other & (labels != labels[k])
        for j in np.flatnonzero(close):
            x, y = top(int(labels[k])), top(int(labels[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((used[k], used[j]))
    return found


def _finish(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [np.asarray(r["shingles"], np.int64) for r in rows]
        left = [k for k, r in enumerate(rows) if r["block"] == r["i"]]
        right = [k for k, r in enumerate(rows) if r["block"] == r["j"]]
        return [(rows[x]["rep"], rows[y]["rep"]) for x, y in links_in_block(left, right, sets, [r["component"] for r in rows], percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            shingles = batch.column("shingles")
            names = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "rep", "component")]
            for n, (cluster, i, j, block, rep, component) in enumerate(zip(*names, strict=True)):
                if held and (held[0]["cluster"], held[0]["i"], held[0]["j"]) != (cluster, i, j):
                    found = solve(held)
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)
                    held = []
                held.append({"cluster": cluster, "i": i, "j": j, "block": block, "rep": rep, "component": component, "shingles": shingles[n].values.to_numpy(zero_copy_only=False)})
        if held:
            found = solve(held)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A text's set is its distinct runs of width words (A-Z lower-cased), or all
    its words as one run if it has fewer. Texts are linked if 100 * intersection
    >= percent * union; component_id is the smallest id that links reach. Texts
    without a word (empty, null) have 0 shingles and are linked with nothing.
    Rows that repeat an id are the same document, whatever their texts. Ids must
    be integers below 2 ** 62. Rows with a null id take part like all others; if
    no id is reachable their component_id is null, and kept is true. An empty
    table gives no rows; other columns are not looked at.
    """
    return _groups(docs, id_col, text_col, width, percent, block).select("doc_id", "n_shingles", "component_id", "kept")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int) -> DataFrame:
    """near_groups() with text_key (xxhash64 of the text), and names of the row's set (rep) and of its component (found)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = C.materialize(source.mapInArrow(_signatures(width), "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"))

    # Documents with one set are one node, named by their smallest id, or by a hash if another node has that name.
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    hashed = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("set_key"), 2)
    turn = F.row_number().over(Window.partitionBy(F.coalesce("least", hashed)).orderBy("set_key"))
    classes = C.materialize(classes.withColumn("rep", F.when(F.col("least").isNull() | (turn > 1), hashed).otherwise(F.col("least"))))
    nodes = signed.join(classes.withColumnRenamed("set_key", "key"), (F.col("set_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("rep", "text_key", "bands").dropDuplicates(["rep"])
    members = C.materialize(nodes.select("rep", "text_key", F.posexplode("bands").alias("band", "bucket")))
    # Written before the join, whose exchanges adaptive execution can then split where a bucket is large.
    shared = C.materialize(members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("bucket", "centre"))
    crowded = C.materialize(members.join(shared, "bucket").select("bucket", "band", "rep", "centre", "text_key"))

    # One text of each node: that of the row with its name, or any equal one where no id names it.
    texts = source.join(crowded.select("rep", "text_key").distinct(), "text_key").where((F.col("doc_id") == F.col("rep")) | (F.col("rep") >= UNNAMED)).select("rep", "text")
    sets = C.materialize(texts.mapInArrow(_whole_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep"]))

    # Stars of a few bands first; of all others only the edges that could still join two components.
    edge = (F.col("centre").alias("a"), F.col("rep").alias("b"))
    early = crowded.where((F.col("rep") != F.col("centre")) & (F.col("band") < EARLY_BANDS)).select(*edge).distinct()
    labels = connected(C.materialize(_confirmed(early, sets, percent)))
    labelled, mixed = _mixed_buckets(crowded, labels)
    late = labelled.join(mixed, "bucket").where((F.col("component") != F.col("of_centre")) & (F.col("band") >= EARLY_BANDS)).select(*edge).distinct()
    labels = connected(_forest(labels).union(C.materialize(_confirmed(late, sets, percent))))

    # Buckets of three or more that still hold several components: finish their clusters exactly.
    labelled, mixed = _mixed_buckets(crowded, labels)
    loose = C.materialize(labelled.join(mixed.where("n > 2"), "bucket").select("rep", "component", "low").distinct())
    clusters = connected(loose.select(F.col("low").alias("a"), F.col("component").alias("b")).distinct())
    placed = loose.select("rep", "component").distinct().join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component")
    placed = C.materialize(placed.join(sets.select("rep", F.size("shingles").alias("n")), "rep"))
    # Links within a cluster's largest component change nothing: its blocks meet only those of the other components.
    parts = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("n", "component", "shingles"))
    sizes = parts.groupBy("cluster").agg(largest.alias("major"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    most = F.least(F.lit(block), F.greatest(F.lit(min(block, LEAST_BLOCK)), F.col("n") / PARTS))
    blocks = lambda n, shingles: F.ceil(F.greatest(n / most, shingles / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("cluster", F.col("major.component").alias("major"), blocks(F.col("n") - F.col("major.n"), F.col("shingles") - F.col("major.shingles")).alias("few"), blocks(F.col("major.n"), F.col("major.shingles")).alias("many"))
    minor = F.col("component") != F.col("major")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    dealt = placed.join(sizes, "cluster").withColumn("block", F.when(minor, deal(F.col("few"))).otherwise(F.col("few") + deal(F.col("many"))))
    with_other = F.explode(F.sequence(F.lit(0), F.when(minor, F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)))
    pairs = dealt.withColumn("other", with_other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
    units = pairs.join(sets, "rep")
    grouped = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    rest = grouped.mapInArrow(_finish(percent), "a long, b long")
    # Sets of one repeated id are linked.
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi").select("doc_id")
    of_id = C.materialize(signed.select("doc_id", "set_key").join(several, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "rep"))
    same_id = of_id.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of_id, "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    final = connected(_forest(labels).union(C.materialize(rest)).union(same_id))

    known = classes.join(final, classes.rep == final.node, "left").select(F.col("set_key").alias("key"), "rep", F.coalesce("component", "rep").alias("found"))
    out = signed.join(known, signed.set_key == known.key, "left")
    component = F.when(F.col("found") < UNNAMED, F.col("found")).when(F.col("found").isNull(), F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_key", "rep", "found")


def keep_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that stay: one for each component.

    Rows that repeat the id of a kept document leave one. Rows without an id stay
    only if no document with an id is near, and of those near each other one
    stays. Texts without a word are kept, one for each id; without an id, one.
    """
    groups = _groups(docs, "doc_id", "text", width, percent, BLOCK)
    stays = F.col("kept") & (F.col("doc_id").isNotNull() | F.col("rep").isNull() | (F.col("rep") == F.col("found")))
    kept = groups.where(stays).select(F.col("doc_id").alias("__tl_id"), F.col("text_key").alias("__tl_kept"), F.coalesce("found", "doc_id").alias("__tl_found")).distinct()
    keyed = docs.withColumn("__tl_key", F.xxhash64("text"))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__tl_id")) & (F.col("__tl_key") == F.col("__tl_kept")))
    order = Window.partitionBy("__tl_found").orderBy(F.asc_nulls_last("doc_id"), "__tl_key")
    return found.withColumn("__tl_rank", F.row_number().over(order)).where("__tl_rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
